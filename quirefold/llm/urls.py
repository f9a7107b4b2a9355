"""URL filters with redirect equivalence, in DataFrame functions only.

An explicit rule decides a URL by itself.  URLs without one are judged by their class: connected
components over redirect edges (refresh tags, and a table of redirects if given) and canonical-link
edges between normalised URLs (no scheme, no fragment, no dot segments).  A class with an explicit allow is allowed,
otherwise one with an explicit block is blocked, otherwise it is allowed.  URLs of a class need not
be pages of the table: a rule that fits the target of a redirect blocks the pages that lead there.
Link targets are resolved against the page they stand on: a scheme, ``//host``, ``/path``, ``?query``, ``#fragment``
(the page itself) or a relative path, with ``&amp;`` read as ``&``; targets of other schemes (``mailto:x``) join nothing.
Of rules of equal length that fit, an allowing one wins, then the one listed first.

Defined cases: a null URL or one without ``://`` has empty host and path, fits no rule, takes part
in no class and is allowed; null html has no edges; repeated rows each get their row; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quirefold.llm.components import connected_components
from quirefold.llm.scratch import Scratch

#: (verdict, host, path prefix): fixed by the contract of the query.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Rules are compiled into one expression, so their number is bounded.
MOST_RULES = 2_000
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
TARGET = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""
ABSOLUTE, OTHER = r"^[A-Za-z][A-Za-z0-9+.\-]*://", r"^[A-Za-z][A-Za-z0-9+.\-]*:"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def without_dots(path: Column) -> Column:
    """A path with its segments ``.`` and ``..`` carried out."""
    parts = F.split(path, "/")
    folded = F.aggregate(F.slice(parts, 2, F.size(parts)), F.lit(""), lambda done, x: F.when(x == "..", F.regexp_replace(done, r"/[^/]*\z", "")).when(x == ".", done).otherwise(F.concat(done, F.lit("/"), x)))
    return F.when(F.contains(path, F.lit("/.")), F.concat(folded, F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise(""))).otherwise(path)


def node_of(url: Column) -> Column:
    """The URL without scheme, fragment and dot segments, an empty path as ``/``; null where there is no ``://``."""
    path = without_dots(path_of(url))
    node = F.concat(host_of(url), F.when(path == "", "/").otherwise(path), F.coalesce(F.regexp_extract(url, URL, 3), F.lit("")))
    return F.when(F.contains(url, F.lit("://")), node)


def absolute(target: Column, url: Column) -> Column:
    """A link's target seen from the page it stands on."""
    host, path = host_of(url), path_of(url)
    folder = F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"(?s)^(.*/)", 1)).otherwise("/")
    return (
        F.when(target == "", F.lit(None))
        .when(F.rlike(target, F.lit(ABSOLUTE)), target)
        .when(F.startswith(target, F.lit("//")), F.concat(F.lit("http:"), target))
        .when(F.startswith(target, F.lit("#")), url)
        .when(F.startswith(target, F.lit("?")), F.concat(F.lit("http://"), host, path, target))
        .when(F.rlike(target, F.lit(OTHER)), F.lit(None))
        .when(F.startswith(target, F.lit("/")), F.concat(F.lit("http://"), host, target))
        .otherwise(F.concat(F.lit("http://"), host, folder, target))
    )


def _ordered(rules: Sequence[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """The longest first, of equal length the allowing ones first."""
    return sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r[0] != "allow"))


def _matched(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], pick) -> Column:
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} are compiled into an expression")
    out = F.lit(None).cast("string")
    for verdict, name, prefix in reversed(_ordered(rules)):
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(prefix))
        out = F.when(fits, pick(verdict, name, prefix)).otherwise(out)
    return out


def edges_of(pages: DataFrame) -> DataFrame:
    """``(a, b)``: normalised URLs that a page's canonical link or refresh tag joins."""
    found = pages.select("url", F.explode(F.array(
        F.regexp_extract(F.regexp_extract("html", CANONICAL, 0), HREF, 1),
        F.regexp_extract(F.regexp_extract("html", REFRESH, 0), TARGET, 1),
    )).alias("target")).where("target <> '' and url is not null").withColumn("target", F.replace("target", F.lit("&amp;"), F.lit("&")))
    return found.select(node_of(F.col("url")).alias("a"), node_of(absolute(F.col("target"), F.col("url"))).alias("b")).where("a <> b")


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """``pages(page_id, url, html, ...)`` -> ``(page_id, host, path, rule, verdict)``; ``redirects(source, target)``: URLs."""
    scratch = Scratch(pages.sparkSession, "urls")
    edges = edges_of(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("source")).alias("a"), node_of(F.col("target")).alias("b")))
    classes = connected_components(edges, scratch)
    name = F.concat(F.lit("http://"), F.col("node"))
    decided = classes.select("node", "component", _matched(host_of(name), path_of(name), rules, lambda v, h, p: F.lit(v)).alias("own"))
    verdicts = decided.groupBy("component").agg(F.bool_or(F.col("own") == "allow").alias("allowed"), F.bool_or(F.col("own") == "block").alias("blocked"))
    blocked = scratch.save(verdicts.where("blocked and not coalesce(allowed, false)").select("component"), "blocked")
    spread = scratch.save(classes.join(blocked, "component", "left_semi").select("node", F.lit(True).alias("spread")), "spread")
    host, path = F.col("host"), F.col("path")
    judged = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).select(
        "page_id", "host", "path",
        _matched(host, path, rules, lambda v, h, p: F.lit(h + p)).alias("rule"),
        _matched(host, path, rules, lambda v, h, p: F.lit(v)).alias("own"),
        node_of(F.col("url")).alias("node"),
    )
    # Only URLs that no rule decides need their class.
    ruled = judged.where("own is not null or node is null").select("page_id", "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"))
    rest = judged.where("own is null and node is not null").join(spread, "node", "left").select(
        "page_id", "host", "path", "rule", F.when(F.coalesce("spread", F.lit(False)), "block").otherwise("allow").alias("verdict"))
    return ruled.unionByName(rest)


def _sql(rules: Sequence[tuple[str, str, str]] = RULES) -> str:
    def case(host: str, path: str, pick) -> str:
        whens = " ".join(f"WHEN ({host} = '{h}' OR suffix({host}, '.{h}')) AND prefix({path}, '{p}') THEN '{pick(v, h, p)}'" for v, h, p in _ordered(rules))
        return f"CASE {whens} END"

    quoted = {k: v.replace("'", "''") for k, v in (("url", URL), ("canonical", CANONICAL), ("refresh", REFRESH), ("href", HREF), ("target", TARGET))}

    def host(u: str) -> str:
        return f"coalesce(translate(regexp_extract({u}, '{quoted['url']}', 1), '{_UPPER}', '{_LOWER}'), '')"

    def path(u: str) -> str:
        return f"coalesce(regexp_extract({u}, '{quoted['url']}', 2), '')"

    def clean(u: str) -> str:
        folded = f"list_reduce(string_split({path(u)}, '/'), lambda done, x: CASE x WHEN '..' THEN regexp_replace(done, '/[^/]*$', '') WHEN '.' THEN done ELSE done || '/' || x END)"
        return f"CASE WHEN contains({path(u)}, '/.') THEN {folded} || CASE WHEN regexp_matches({path(u)}, '/[.][.]?$') THEN '/' ELSE '' END ELSE {path(u)} END"

    def node(u: str) -> str:
        return f"CASE WHEN contains({u}, '://') THEN {host(u)} || CASE WHEN ({clean(u)}) = '' THEN '/' ELSE {clean(u)} END || coalesce(regexp_extract({u}, '{quoted['url']}', 3), '') END"

    return f"""
WITH RECURSIVE links AS (
  SELECT url, unnest([regexp_extract(regexp_extract(html, '{quoted['canonical']}', 0), '{quoted['href']}', 1),
                      regexp_extract(regexp_extract(html, '{quoted['refresh']}', 0), '{quoted['target']}', 1)]) AS target
  FROM pages WHERE url IS NOT NULL),
full_links AS (
  SELECT url, CASE WHEN regexp_matches(target, '{ABSOLUTE}') THEN target
    WHEN prefix(target, '//') THEN 'http:' || target
    WHEN prefix(target, '#') THEN url
    WHEN prefix(target, '?') THEN 'http://' || {host('url')} || {path('url')} || target
    WHEN regexp_matches(target, '{OTHER}') THEN NULL
    WHEN prefix(target, '/') THEN 'http://' || {host('url')} || target
    ELSE 'http://' || {host('url')} || CASE WHEN contains({path('url')}, '/') THEN regexp_extract({path('url')}, '(?s)^(.*/)', 1) ELSE '/' END || target END AS target
  FROM (SELECT url, replace(target, '&amp;', '&') AS target FROM links) WHERE target <> ''),
one_way AS (SELECT {node('url')} AS a, {node('target')} AS b FROM full_links),
edges AS (SELECT a, b FROM one_way WHERE a <> b UNION SELECT b, a FROM one_way WHERE a <> b),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
decided AS (SELECT a, {case("regexp_extract(b, '^[^/?]*')", "regexp_extract(b, '^[^/?]*([^?]*)', 1)", lambda v, h, p: v)} AS own FROM reach),
spread AS (SELECT a FROM decided GROUP BY a HAVING bool_or(own = 'block') AND NOT coalesce(bool_or(own = 'allow'), false)),
judged AS (SELECT page_id, {host('url')} AS host, {path('url')} AS path, {node('url')} AS node FROM pages)
SELECT page_id, host, path, {case('host', 'path', lambda v, h, p: h + p)} AS rule,
  coalesce({case('host', 'path', lambda v, h, p: v)}, CASE WHEN node IN (SELECT a FROM spread) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged"""


ORACLE = _sql()
