import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold.llm import secrets as sec

SCHEMA = "doc_id long, text string, source string, findings string, value int"
KEY = "ed85aea7af91af30d358df8319c45ee8ae9f5135"


@pytest.fixture(scope="module")
def forest(spark):
    return sec.train(sec.default_findings(spark))


def rows():
    return [
        (1, f'wasonatstea, token = "{KEY}" eratwhhe', "src0"), (2, f"commit {KEY} fixes it", "src1"), (3, "Erschlichereinbelichß erschlichereinbelich von einverkeitung.", "src2"),
        (4, None, "src"), (5, "", None), (6, f'token = "{KEY}" and token = "{KEY}", sha1 {KEY}', "src"), (7, "plain words only", "x"),
        (8, f'api_key: {KEY[::-1]}', "src9"), (9, "wörd " * 30_000 + f'secret = "{KEY}"', "src"), (10, "call 4111-1111-1111-1111 or mail7.example.com", "src"),
    ]


def test_findings_and_places(spark, forest):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows()], SCHEMA).drop("findings", "value")
    got = {r.doc_id: r for r in sec.found(df, forest).collect()}
    for i, text, _ in rows():
        every = [(m.start(), m.group()) for m in re.finditer(sec.CANDIDATE, text or "")]
        assert [(f.start, f.value) for f in got[i].findings] == every
    assert {i for i in got if any(f.secret for f in got[i].findings)} == {1, 6, 8, 9}
    assert [f.secret for f in got[6].findings] == [True, True, False]


def test_scan_and_redaction(spark):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows()] + [(*rows()[0], "again", 2)], SCHEMA)
    out = sec.redact(df).collect()
    assert len(out) == 11 and out[0].__fields__ == df.columns
    texts = {r.doc_id: r.text for r in out}
    assert {r.findings for r in out} == {"clash", "again"}
    for i, text, _ in rows():
        if i in (1, 8, 9):
            assert texts[i] == text.replace(KEY, sec.MASK).replace(KEY[::-1], sec.MASK)
        elif i != 6:
            assert texts[i] == text
    assert texts[6].count(sec.MASK) == 2 and texts[6].endswith(KEY)
    scanned = {r.doc_id: r for r in sec.scan(df).collect()}
    assert scanned[1].starts == [rows()[0][1].index(KEY)] and scanned[1].lengths == [40] and scanned[7].n_candidates == 0 and scanned[4].n_secrets == 0


def test_compiled_forest_equals_numpy(spark, forest):
    df = spark.createDataFrame(sec.labelled_findings(400, seed=77), "candidate string, before string, after string, path string, secret int")
    made = sec.features(*(F.col(c) for c in ("candidate", "before", "after", "path")))
    flat = df.select("secret", *(v.alias(k) for k, v in made.items()))
    got = flat.withColumn("score", sec.compiled(forest, [F.col(k) for k in made])).collect()
    x = np.array([[r[k] for k in made] for r in got])
    assert np.allclose(sec.vote(forest, x), [r.score for r in got])
    assert np.mean([(r.score >= 0.5) == r.secret for r in got]) > 0.96  # findings that were not trained on


def test_empty_and_no_python(spark, forest):
    df = spark.createDataFrame([], SCHEMA)
    assert sec.scan(df).count() == 0 and sec.redact(df).count() == 0
    plan = sec.found(df.drop("findings", "value"), forest)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
