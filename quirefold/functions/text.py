"""Text functions as column expressions; white space and word classes are Unicode's, spelled out for Java and RE2."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: What ``str.isspace`` accepts, as members of a regular expression's class; without the line feed in the second.
SPACES = "\\x09-\\x0d\\x1c-\\x20\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
INLINE = SPACES.replace("\\x09-\\x0d", "\\x09\\x0b-\\x0d")
#: Characters that count as European: fixed ranges (the first spans A-z with what lies between).
EUROPEAN = "A-z\u00c0-\u024f\u1e00-\u1eff\u0370-\u03ff\u0400-\u052f\u2c60-\u2c7f\ua640-\ua69f0-9"
WORD = r"[\p{L}\p{N}_][\p{L}\p{N}_']*"
JOINED = "-\\n[^\\n]+"
#: Soft hyphen and zero-width space go; thin, no-break, en and hair space become a space.
_FROM, _TO = "\u2009\u00a0\u2002\u200a\u00ad\u200b", "    "


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACES}]+|[{SPACES}]+$", "")


def normalise_spaces(c: Column) -> Column:
    return F.translate(c, _FROM, _TO)


def _stripped_lines(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, "\n"), strip), "\n")


def fix_hyphens(c: Column) -> Column:
    """Joins words that a hyphen and a line's end cut in two (pairs of lines, not chains); other line ends become spaces."""
    return F.replace(F.regexp_replace(_stripped_lines(c), f"[{INLINE}]*-\\n([^\\n]+)", "$1"), F.lit("\n"), F.lit(" "))


def count_hyphens(c: Column) -> Column:
    return F.regexp_count(_stripped_lines(c), F.lit(JOINED)).cast("long")


def remove_nonprintable(c: Column) -> Column:
    """Line ends and tabs to spaces, control characters away (NUL and DEL stay), runs of spaces to one, stripped."""
    c = F.regexp_replace(F.regexp_replace(c, "[\\r\\n]+", " "), "[\\x01-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")
    return strip(F.regexp_replace(F.replace(c, F.lit("\t"), F.lit(" ")), " +", " "))


def count_visible(c: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(c, f"[{SPACES}]", "")), F.lit(0)).cast("long")


def count_characters(c: Column, include_spaces: bool = True) -> Column:
    return F.coalesce(F.length(c), F.lit(0)).cast("long") if include_spaces else count_visible(c)


def count_words(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def european_ratio(c: Column) -> Column:
    """Share of European characters among all; 0 for no text."""
    n = F.length(c)
    return F.coalesce(F.try_divide(n - F.length(F.regexp_replace(c, f"[{EUROPEAN}]", "")), n), F.lit(0.0))


def is_european(c: Column) -> Column:
    return european_ratio(c) > 0.5


def clean_metadata(m: Column) -> Column:
    return F.map_filter(m, lambda k, v: v.isNotNull() & (v != ""))


def clean_description(c: Column) -> Column:
    """A model's answer without emphasis and heading marks."""
    return strip(F.regexp_replace(c, r"\*\*|#", ""))


def clean_sidecar(c: Column) -> Column:
    """A description file's text without the words start and end; a fixed sentence if nothing stays."""
    c = strip(F.regexp_replace(F.regexp_replace(c, r"(?iU)\b(start|end)\b", ""), " +", " "))
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("No description available"))


def fences(c: Column) -> Column:
    """The bodies of all fenced JSON sections, in order."""
    return F.regexp_extract_all(c, F.lit("(?s)```json\\n(.*?)\\n```"), F.lit(1))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def format_seconds(s: Column) -> Column:
    s = s.cast("long")
    return (
        F.when(s < 60, F.format_string("%ds", s))
        .when(s < 3600, F.format_string("%dm %ds", F.floor(s / 60), s % 60))
        .otherwise(F.format_string("%dh %dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))
    )


def rate(amount: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, amount / seconds).otherwise(0.0)


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(part * 100 / whole)).otherwise(0).cast("long")


def remaining_seconds(done: Column, total: Column, elapsed: Column) -> Column:
    """Expected seconds to go at the pace so far; null while nothing is done."""
    return F.when((done > 0) & (elapsed > 0), (total - done) / (done / elapsed))

