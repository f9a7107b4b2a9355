"""Secret scan in DataFrame functions only: candidate runs, and a random forest that drops false positives.

Candidates are runs of token characters of at least ``SHORTEST``, cut at anything else, and shorter values of at
least ``SHORTEST_ASSIGNED`` characters that a name like ``password`` is set to; of a run ``name=value`` only the
value is one, if it is as long as that.  Neighbours are the characters of the text around it, whatever
other candidates they belong to, in training as in scoring.  Each candidate has features:
length, shares of digits, upper case and distinct characters, changes of character class from one character
to the next, the shares covered by dictionary words and by syllables, assignment and quoting around it,
telling words before it, and a telling path (``source``).  The forest is trained in numpy from labelled
findings and compiled into nested CASE expressions; scoring happens within a row, without a shuffle.

Work and memory are linear in a text's candidates: neighbours come from arrays shifted by a few places, starts
from sums of blocks of ``BLOCK`` lengths, and nothing is looked up by place or built again for each candidate.

Labelled findings come as a table ``(candidate, before, after, path, secret)`` of a bounded size; without
one, ``labelled_findings()`` makes some by rule: keys, tokens and passwords in their usual surroundings,
and checksums, commit ids, placeholders, identifiers, plain and compound words as false positives.

Defined cases: null and empty texts and null sources have no candidates and an empty path; a text without
secrets keeps all its characters; equal candidates in one text are judged place by place; repeated rows
are judged each; a score of exactly ``least`` is a secret; an empty table gives an empty result; further
columns are ignored or kept as they are.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

SHORTEST = 12
TOKEN = r"[A-Za-z0-9+/_\-=.~]"
CANDIDATE = "%s{%d,}+" % (TOKEN, SHORTEST)
#: Names whose short values are candidates too: fixed values.
KEY_NAMES = r"(?i:passw(?:or)?d|passwort|passphrase|pwd|secret|token|api_?key|access_?key)"
SHORTEST_ASSIGNED = 6
ASSIGNED = r"""(?<=[:>="'` \t])(?<=%s["'`]?[ \t]{0,2}(?:=>|[:=]{1,2})[ \t]{0,2}["'`]?)(?![=:>])[^\s"'`<>()\[\]{},;]{%d,}+""" % (KEY_NAMES, SHORTEST_ASSIGNED)
#: A run may not begin with a key name and its '=': then the value after it is the candidate, with all its characters.
_NAME_FIRST = r"""[A-Za-z0-9_.\-]{0,64}%s={1,2}[^\s"'`<>()\[\]{},;=]{%d}""" % (KEY_NAMES, SHORTEST_ASSIGNED)
FIND = f"(?:{ASSIGNED})|(?<!{TOKEN})(?={TOKEN}{{{SHORTEST}}})(?!{_NAME_FIRST})(?:{CANDIDATE})"
#: A run of a name, one or more '=' and a value; '=' at a value's end is padding.
NAMED = r"^(.*=)([^=]{%d,}=*)$" % SHORTEST
MASK = "[SECRET]"
TREES, DEPTH, LEAST_LEAF = 21, 6, 3
#: At most so many labelled findings are fitted on.
MOST_FINDINGS = 20_000
BEFORE, AFTER = 40, 8
#: A candidate and the text before it have so many characters at least (a key name, a sign and a short value, or a run cut off).
LEAST_STEP = 10
BLOCK = 128
#: Telling neighbours and paths: fixed values.
KEY_WORDS = r"(?i)(token|secret|passw|pwd|api|auth|bearer|cred|private|access|key)"
HASH_WORDS = r"(?i)(sha\d*|md5|hash|commit|checksum|digest|revision|uuid|guid|etag|integrity|build|version|http|www|path|file|class|import)"
EXAMPLE_WORDS = r"(?i)(example|sample|placeholder|dummy|test|your|xxxx|changeme|fake|demo|mock)"
#: Dictionary words of names and prose: fixed values.
DICTIONARY = (
    "access", "account", "action", "address", "admin", "alpha", "analysis", "application", "array", "article", "author", "backup", "base", "before", "beta", "between",
    "block", "body", "branch", "buffer", "build", "button", "cache", "callback", "center", "change", "channel", "character", "check", "class", "client", "cluster",
    "code", "color", "column", "comment", "common", "company", "compile", "config", "connection", "console", "contact", "content", "context", "control", "copy", "count",
    "country", "create", "current", "customer", "data", "database", "date", "debug", "default", "delete", "demo", "description", "device", "dialog", "document", "domain",
    "download", "driver", "editor", "element", "email", "enable", "encoding", "engine", "entry", "error", "event", "example", "execute", "expired", "export", "false",
    "feature", "field", "file", "filter", "folder", "format", "function", "general", "global", "group", "handler", "header", "height", "history", "home", "host",
    "image", "import", "index", "information", "input", "install", "integer", "interface", "internal", "item", "language", "length", "level", "library", "license", "line",
    "link", "list", "local", "location", "logger", "machine", "main", "manager", "memory", "message", "method", "missing", "model", "module", "name", "network",
    "node", "none", "null", "number", "object", "option", "order", "output", "package", "page", "parameter", "password", "path", "person", "placeholder", "platform",
    "point", "policy", "private", "process", "product", "profile", "project", "property", "public", "query", "random", "record", "release", "remote", "request", "required",
    "resource", "response", "result", "return", "sample", "schema", "script", "search", "secret", "security", "server", "service", "session", "settings", "source", "static",
    "status", "string", "system", "table", "template", "test", "text", "title", "token", "type", "undefined", "update", "user", "value", "version", "window", "your",
)
WORDS = r"[A-Z]?[a-z]+|[A-Z]+"
SYLLABLES = r"(?i)(the|and|tion|ing|ment|ent|er|en|an|in|on|or|re|le|es|ch|sch|ung|keit|heit|lich|eau|eux|que|ción|ado|ar|st|nd|ou|ea|is|it|al|ed|io|as|os)"


def random_text(r: random.Random, alphabet: str, low: int, high: int) -> str:
    return "".join(r.choice(alphabet) for _ in range(r.randint(low, high)))


def labelled_findings(n: int = 2_400, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """(candidate, before, after, path, secret) by rule; half are secrets."""
    r = random.Random(seed)
    hexa, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    names = ["token", "secret", "api_key", "apikey", "password", "passwd", "auth_token", "access_key", "private_key", "client_secret", "TOKEN", "API_KEY", "bearer", "key"]
    hashes = ["sha256", "sha1", "md5", "commit", "checksum", "digest", "revision", "hash", "etag", "uuid", "integrity", "build"]
    syllables = ["the", "er", "an", "tion", "ing", "ver", "sch", "keit", "ung", "ment", "ou", "re", "be", "ge", "lich", "con", "pro", "ar", "el", "ta", "do", "na", "st"]
    paths = ["src0", "src1", "app/config.py", "deploy/prod.env", "web", "settings.yml", "src12"]
    fake_paths = ["tests/fixtures/data.txt", "docs/example.md", "mock/test_sample.py"]

    def prose(k: int) -> str:
        return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(k))

    def around(name: str) -> tuple[str, str]:
        shape = r.choice([' = "', '="', ": ", "=", ' : "', " = '", ' => "', " "])
        quote = shape[-1] if shape[-1] in "\"'" else ""
        return (prose(r.randint(0, 6)) + " " + name + shape)[-BEFORE:], (quote + r.choice([" ", "\n", ",", ""]) + prose(2))[:AFTER]

    short_names = ["password", "passwd", "pwd", "passphrase", "secret", "token", "PASSWORD", "db_password", "Password"]
    leet = str.maketrans("oeai", "03@1")

    def short_secret() -> str:
        word = "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
        return r.choice([
            lambda: random_text(r, alnum + "!@#$%&*?+-_", 7, 15), lambda: word.capitalize() + random_text(r, "0123456789", 1, 4) + r.choice("!?#$%&*@"),
            lambda: word + random_text(r, "0123456789", 1, 3) + r.choice(["!", "", "#", "$$"]), lambda: word.translate(leet) + random_text(r, alnum + "&!#", 2, 6),
        ])() + r.choice(["", random_text(r, "0123456789", 1, 2)])

    out = []
    for k in range(n // 2):
        if k % 6 == 5:
            before, after = around(r.choice(short_names))
            value = short_secret()
            out.append((value if len(value) >= SHORTEST_ASSIGNED else value + "7x!Q2z", before, after, r.choice(paths), 1))
            continue
        value = r.choice([
            lambda: random_text(r, hexa, 32, 64), lambda: random_text(r, hexa, 40, 40), lambda: random_text(r, alnum, 20, 48), lambda: random_text(r, alnum + "+/", 24, 64) + "==",
            lambda: "AKIA" + random_text(r, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16, 16), lambda: "ghp_" + random_text(r, alnum, 36, 36), lambda: "sk_live_" + random_text(r, alnum, 24, 24),
            lambda: "eyJ" + random_text(r, alnum, 20, 40) + "." + random_text(r, alnum + "_-", 20, 60), lambda: random_text(r, alnum + "_-", 14, 24),
        ])()
        before, after = around(r.choice(names))
        if value[:4] in ("AKIA", "ghp_", "sk_l") and r.random() < 0.4:
            before, after = (prose(5) + " ")[-BEFORE:], (" " + prose(2))[:AFTER]
        out.append((value, before, after, r.choice(paths), 1))
    for k in range(n - n // 2):
        before, after, path = (prose(r.randint(1, 8)) + " ")[-BEFORE:], r.choice([" ", ".", ", ", "\n"]) + prose(1), r.choice(paths + fake_paths)
        kind = k % 10
        if kind == 0:
            value = "".join(r.choice(syllables) for _ in range(r.randint(5, 9)))
            value = value.capitalize() if r.random() < 0.3 else value.upper() if r.random() < 0.2 else value
        elif kind == 1:
            value = random_text(r, hexa, 32, 64)
            before, after = around(r.choice(hashes))
        elif kind == 2:
            value = r.choice(["your_token_here", "example-secret-key", "xxxxxxxxxxxxxxxxxxxx", "changeme-changeme", "placeholder_value", "test-token-1234567", "dummy-password-12", "000000000000000000000000"])
            before, after = around(r.choice(names))
        elif kind == 3:
            value = random_text(r, "0123456789", 12, 20)
        elif kind == 4:
            value = "_".join("".join(r.choice(syllables) for _ in range(2)) for _ in range(r.randint(2, 4)))
            if r.random() < 0.4:
                before, after = around(r.choice(names))
        elif kind == 5:
            value = "/".join("".join(r.choice(syllables) for _ in range(2)) for _ in range(r.randint(2, 4))) + r.choice(["", ".html", ".py"])
        elif kind == 6:
            value = r.choice("-=._~+") * r.randint(12, 60)
        elif kind == 7:
            value = r.choice(["".join(r.choice(syllables) for _ in range(r.randint(2, 4))), r.choice([w for w in DICTIONARY if len(w) >= SHORTEST_ASSIGNED])])
            value = (value if len(value) >= SHORTEST_ASSIGNED else value + "tionen") + r.choice(["", "", ".", "!", "?"])
            value = value.capitalize() if r.random() < 0.3 else value
            before, after = around(r.choice(short_names))
        elif kind == 8:
            value = r.choice(["os.environ", "settings.token", "request.headers", "self._password", "${DB_PASSWORD}", "$PASSWORD", "%(password)s", "********", "xxxxxx", "<password>".strip("<>"), "user.password", "config.secret"])
            before, after = around(r.choice(short_names))
        else:
            value = r.choice(["mail%d.example.com", "www.%d.example.org", "%d-%d-%d" % tuple(r.randint(100, 9999) for _ in range(3)), "192.168.%d.1.10.0.0"])
            value = (value.replace("%d", str(r.randint(0, 99))) + ".example.com")[:40]
        out.append((value, before[-BEFORE:], after[:AFTER], path, 0))
    r.shuffle(out)
    return out


def _name(run: Column) -> Column:
    """What stands before a run's value, with its '='; '' if nothing does."""
    return F.regexp_extract(run, NAMED, 1)


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))


def features(candidate: Column, before: Column, after: Column, path: Column) -> dict[str, Column]:
    """Named features as double columns; the same expressions serve training and scoring."""
    covered = F.length(candidate) - F.length(F.regexp_replace(candidate, SYLLABLES, ""))
    size = F.greatest(F.length(candidate), F.lit(1))
    known = F.filter(F.regexp_extract_all(candidate, F.lit(WORDS), F.lit(0)), lambda w: F.lower(w).isin(*DICTIONARY))
    words = F.aggregate(known, F.lit(0), lambda total, w: total + F.length(w))
    return {k: v.cast("double") for k, v in {
        "length": F.length(candidate),
        "digits": _share(candidate, "[0-9]"),
        "upper": _share(candidate, "[A-Z]"),
        "other": _share(candidate, "[^A-Za-z0-9]"),
        "hex": _share(candidate, "[0-9a-f]"),
        "distinct": F.size(F.array_distinct(F.split(candidate, ""))) / size,
        "changes": F.regexp_count(candidate, F.lit("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])")) / size,
        "vowel_pairs": F.regexp_count(candidate, F.lit("(?i)[aeiou][bcdfghjklmnpqrstvwxyz]")) / size,
        "runs": F.regexp_count(candidate, F.lit(r"(.)\1")) / size,
        "dictionary": covered / size,
        "words": words / size,
        "assigned": F.when(F.rlike(before, F.lit(r"""[=:>]\s*["'`]?$""")), 1).otherwise(0),
        "quoted": F.when(F.rlike(before, F.lit(r"""["'`]$""")) & F.rlike(after, F.lit(r"""^["'`]""")), 1).otherwise(0),
        "key_words": F.when(F.rlike(F.right(before, F.lit(24)), F.lit(KEY_WORDS)), 1).otherwise(0),
        "hash_words": F.when(F.rlike(F.right(before, F.lit(16)), F.lit(HASH_WORDS)), 1).otherwise(0),
        "examples": F.when(F.rlike(F.concat(before, candidate), F.lit(EXAMPLE_WORDS)), 1).otherwise(0),
        "issued": F.when(F.rlike(candidate, F.lit(r"^(AKIA|ASIA|ghp_|gho_|sk_live_|xox[bp]-|eyJ|AIza)")), 1).otherwise(0),
        "path": F.when(F.rlike(path, F.lit(EXAMPLE_WORDS)), 1).otherwise(0),
    }.items()}


class Node(NamedTuple):
    feature: int  # -1: a leaf
    cut: float
    low: Node | None
    high: Node | None
    value: float


def _grow(x: np.ndarray, y: np.ndarray, r: np.random.Generator, depth: int) -> Node:
    if depth == 0 or len(y) < 2 * LEAST_LEAF or y.min() == y.max():
        return Node(-1, 0.0, None, None, float(y.mean()))
    best = None
    for f in r.permutation(x.shape[1])[: max(2, int(np.sqrt(x.shape[1])) + 1)]:
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] > v[:-1]) + 1
        at = at[(at >= LEAST_LEAF) & (at <= len(y) - LEAST_LEAF)]
        if len(at):
            a, n = ones[at - 1], len(y)
            p, q = a / at, (ones[-1] - a) / (n - at)
            gini = at * p * (1 - p) + (n - at) * q * (1 - q)
            k = int(gini.argmin())
            if best is None or gini[k] < best[0]:
                best = (gini[k], int(f), float((v[at[k] - 1] + v[at[k]]) / 2))
    if best is None:
        return Node(-1, 0.0, None, None, float(y.mean()))
    low = x[:, best[1]] <= best[2]
    return Node(best[1], best[2], _grow(x[low], y[low], r, depth - 1), _grow(x[~low], y[~low], r, depth - 1), 0.0)


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 3) -> list[Node]:
    """Bootstrap samples, a random subset of features at each split, Gini impurity."""
    out = []
    for t in range(trees):
        r = np.random.Generator(np.random.PCG64([seed, t]))
        at = r.integers(0, len(y), len(y))
        out.append(_grow(x[at], y[at], r, depth))
    return out


def vote(forest: Sequence[Node], x: np.ndarray) -> np.ndarray:
    """The forest in numpy, for tests: mean leaf value of each row."""

    def leaf(node: Node, row: np.ndarray) -> float:
        while node.feature >= 0:
            node = node.low if row[node.feature] <= node.cut else node.high
        return node.value

    return np.array([np.mean([leaf(t, row) for t in forest]) for row in x])


def compiled(forest: Sequence[Node], columns: Sequence[Column]) -> Column:
    def case(node: Node) -> Column:
        return F.lit(node.value) if node.feature < 0 else F.when(columns[node.feature] <= node.cut, case(node.low)).otherwise(case(node.high))

    total = case(forest[0])
    for tree in forest[1:]:
        total = total + case(tree)
    return total / len(forest)


def train(findings: DataFrame, most: int = MOST_FINDINGS) -> list[Node]:
    """A forest from ``findings(candidate, before, after, path, secret)``; at most ``most`` rows are used, the smallest hashes."""
    names = ("candidate", "before", "after", "path")
    chosen = findings.where("candidate is not null and secret in (0, 1)").orderBy(F.xxhash64(*names), *names).limit(most)
    candidate, before, after, path = (F.coalesce(F.col(c), F.lit("")) for c in names)
    name = _name(candidate)
    value = F.substring(candidate, F.length(name) + 1, F.length(candidate))
    made = features(value, F.right(F.concat(before, name), F.lit(BEFORE)), F.left(after, F.lit(AFTER)), path)
    rows = chosen.select(F.col("secret").cast("int"), *(v.alias(k) for k, v in made.items())).collect()
    if not rows:
        raise ValueError("no labelled findings")
    x = np.array([list(r)[1:] for r in rows], dtype=np.float64)
    order = np.lexsort(x.T[::-1])
    return grow_forest(x[order], np.array([r[0] for r in rows])[order])


def default_findings(spark) -> DataFrame:
    return spark.createDataFrame(labelled_findings(), "candidate string, before string, after string, path string, secret int")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before_each(lengths: Column) -> Column:
    """For an array of numbers the sums of all before each one, block by block."""
    zero = F.lit(0).cast("long")
    grow = lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))

    def of_blocks(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda acc, n: acc + n))
        starts = F.aggregate(sums, F.array(zero), grow)
        pairs = F.slice(F.arrays_zip(blocks.alias("block"), starts.alias("start")), F.lit(1), F.size(blocks))
        return F.flatten(F.transform(pairs, lambda p: F.slice(F.aggregate(p["block"], F.array(p["start"]), grow), F.lit(1), F.size(p["block"]))))

    def of_all(values: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), (F.size(values) - 1).cast("int"), F.lit(BLOCK)), lambda a: F.slice(values, a + 1, F.lit(BLOCK)))
        return F.when(F.size(values) > 0, _let(cut, of_blocks)).otherwise(F.array().cast("array<bigint>"))

    return _let(lengths, of_all)


def found(docs: DataFrame, forest: Sequence[Node], least: float = 0.5) -> DataFrame:
    """``docs(text, source, ...)`` -> all its columns and ``findings``: (start, value, score, secret) of every candidate.

    ``start`` counts characters from 0.
    """
    return _placed(_judged(docs, forest, least)).withColumn("findings", F.col("__placed")).drop("__placed", "__judged", "__parts", "__runs")


def _placed(judged: DataFrame) -> DataFrame:
    """``_judged`` with ``__placed``: (start, value, score, secret) of every candidate."""
    n = F.size("__runs")
    lengths = F.transform(F.slice(F.arrays_zip(F.col("__runs").alias("run"), F.col("__parts").alias("part")), F.lit(1), n), lambda z: (F.length(z["run"]) + F.length(z["part"])).cast("long"))
    zipped = F.slice(F.arrays_zip(F.col("__judged").alias("x"), F.col("__parts").alias("part"), _before_each(lengths).alias("before")), F.lit(1), n)
    return judged.withColumn("__placed", F.transform(zipped, lambda z: F.struct(
        (z["before"] + F.length(z["part"]) + F.length(z["x"]["name"])).alias("start"), z["x"]["value"].alias("value"), z["x"]["score"].alias("score"), z["x"]["secret"].alias("secret"))))


def _judged(docs: DataFrame, forest: Sequence[Node], least: float) -> DataFrame:
    """``docs`` with ``__runs``, the texts between them (``__parts``, one more) and ``__judged``: (name, value, score, secret) of each run."""
    text = F.coalesce(F.col("text"), F.lit(""))
    some = F.rlike(text, F.lit(FIND))
    none = F.array().cast("array<string>")
    path = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    cut = docs.withColumns({"__runs": F.when(some, F.regexp_extract_all(text, F.lit(FIND), F.lit(0))).otherwise(none), "__parts": F.when(some, F.split(text, FIND, -1)).otherwise(none)})
    steps = -(-BEFORE // LEAST_STEP)
    n = F.size("__runs")
    back = [F.concat(F.array_repeat(F.lit(""), k), F.col(c)).alias(f"{c[2]}{k}") for k in range(steps, 0, -1) for c in ("__parts", "__runs")]
    ahead = [F.slice(c, F.lit(2), n).alias(f"{c[2]}_next") for c in ("__parts", "__runs")]
    zipped = F.slice(F.arrays_zip(*back, F.col("__parts").alias("p0"), F.col("__runs").alias("r0"), *ahead), F.lit(1), n)

    def scored(x: Column) -> Column:
        made = features(x["value"], x["before"], x["after"], path)
        score = _let(F.struct(*(c.alias(k) for k, c in made.items())), lambda f: compiled(forest, [f[k] for k in made]))
        return _let(score, lambda s: F.struct(x["name"].alias("name"), x["value"].alias("value"), s.alias("score"), (s >= least).alias("secret")))

    def judged(z: Column) -> Column:
        behind = [F.right(z[f"{c}{k}"], F.lit(BEFORE)) for k in range(steps, 0, -1) for c in "pr"]
        after = F.left(F.concat(F.left(F.coalesce(z["p_next"], F.lit("")), F.lit(AFTER)), F.left(F.coalesce(z["r_next"], F.lit("")), F.lit(AFTER))), F.lit(AFTER))
        return _let(_name(z["r0"]), lambda name: _let(F.struct(
            name.alias("name"), F.substring(z["r0"], F.length(name) + 1, F.length(z["r0"])).alias("value"),
            F.right(F.concat(*behind, F.right(z["p0"], F.lit(BEFORE)), name), F.lit(BEFORE)).alias("before"), after.alias("after")), scored))

    return cut.withColumn("__judged", F.transform(zipped, judged))


def scan(docs: DataFrame, findings: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """``docs(doc_id, text, source, ...)`` -> ``(doc_id, n_candidates, n_secrets, starts, lengths, scores)``; no secret is repeated in it."""
    forest = train(findings if findings is not None else default_findings(docs.sparkSession))
    placed = _placed(_judged(docs.select("doc_id", "text", *[c for c in docs.columns if c == "source"]), forest, least))
    chosen = placed.select("doc_id", F.size("__placed").cast("long").alias("n_candidates"), F.filter("__placed", lambda x: x["secret"]).alias("__secrets"))
    return chosen.select(
        "doc_id", "n_candidates", F.size("__secrets").cast("long").alias("n_secrets"), F.transform("__secrets", lambda x: x["start"]).alias("starts"),
        F.transform("__secrets", lambda x: F.length(x["value"]).cast("long")).alias("lengths"), F.transform("__secrets", lambda x: x["score"]).alias("scores"))


def redact(docs: DataFrame, findings: DataFrame | None = None, least: float = 0.5, mask: str = MASK) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mask``; other texts, and null ones, stay as they are."""
    forest = train(findings if findings is not None else default_findings(docs.sparkSession))
    judged = _judged(docs, forest, least)
    pieces = F.transform(F.arrays_zip(F.col("__parts").alias("part"), F.col("__judged").alias("x")), lambda z: F.concat(
        z["part"], F.coalesce(F.concat(z["x"]["name"], F.when(z["x"]["secret"], F.lit(mask)).otherwise(z["x"]["value"])), F.lit(""))))
    text = F.when(F.exists("__judged", lambda x: x["secret"]), F.array_join(pieces, "")).otherwise(F.col("text"))
    return judged.withColumn("text", text).select(*docs.columns)
