import re
import zlib

from quirefold.llm import secrets as sec

KEY = "ed85aea7af91af30d358df8319c45ee8ae9f5135"
NAMES = ["client_secret", "aws_secret_access_key", "AUTH_ACCESS_TOKEN", "api_key", "database_password"]


def test_assignments_with_long_names_and_lines_of_env_files(spark):
    shapes = ["{}={}", '{} = "{}"', "{}: {}", "export {}={}\n", '"{}": "{}"', "x\n{}={}\nHOST=localhost\n"]
    texts = [(k, s.format(n, KEY)) for k, (n, s) in enumerate((n, s) for n in NAMES for s in shapes)]
    df = spark.createDataFrame([(k, t, "src0") for k, t in texts], "doc_id long, text string, source string")
    out = {r.doc_id: r.text for r in sec.redact(df).collect()}
    assert {k: out[k] for k, _ in texts} == {k: t.replace(KEY, sec.MASK) for k, t in texts}
    for r in sec.scan(df).collect():
        assert r.starts == [dict(texts)[r.doc_id].index(KEY)] and r.lengths == [len(KEY)]


def test_neighbours_are_the_characters_of_the_text(spark, monkeypatch):
    text = f"abcdefghijkl mnopqrstuvwxyz client_secret=={KEY}== short=abc name_of_value=abcdefghijkl==,{KEY} pad{'q' * 20}=="
    df = spark.createDataFrame([(1, text, "")], "doc_id long, text string, source string")
    spans = []
    for m in re.finditer(sec.CANDIDATE, text):
        named = re.match(sec.NAMED, m[0])
        spans.append((m.start() + (len(named[1]) if named else 0), m.end()))
    assert [text[a:b] for a, b in spans][2:4] == [KEY + "==", "abcdefghijkl=="]
    monkeypatch.setattr(sec, "features", lambda candidate, before, after, path: {"before": sec.F.crc32(before).cast("double"), "after": sec.F.crc32(after).cast("double")})
    for k, near in enumerate((lambda a, b: text[max(0, a - sec.BEFORE) : a], lambda a, b: text[b : b + sec.AFTER])):
        monkeypatch.setattr(sec, "compiled", lambda forest, columns: columns[k])
        got = sec.found(df, []).first().findings
        assert [(f.start, f.value, int(f.score)) for f in got] == [(a, text[a:b], zlib.crc32(near(a, b).encode())) for a, b in spans]
