import numpy as np

from quirefold.llm import quality

DOCS = "doc_id long, text string, score string, predicted string, quality int"


def corpus(n, seed):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = ["".join(r.choice(list("abcdefghij"), size=r.integers(2, 8))) for _ in range(r.integers(10, 80))]
        good = i % 3 != 0
        rows.append((i, " ".join(words) + "." if good else r.choice(["!! ", "*** ", " | "]).join(words), int(good)))
    return rows


def test_held_out_accuracy_and_edges(spark):
    rows = corpus(300, 1)
    docs = spark.createDataFrame([(i, t, "x", "y", 9) for i, t, _ in rows] + [(800, None, "", "", 1), (801, "", "", "", 1), (802, "ab! " * 60_000, "", "", 0), (5, rows[5][1], "", "", 1)], DOCS)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows[:200]] + [(None, 1, 0), (3, None, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).collect()
    assert quality.score(docs, model).columns == ["doc_id", "quality", "score", "predicted"]
    assert len(got) == 304
    found = {r.doc_id: r for r in got}
    assert sum(found[i].predicted == q for i, _, q in rows[200:]) >= 95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert found[800].score == found[801].score


def test_one_label_only_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a", "", "", 1)], DOCS)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.fit(docs, labels) is None
    assert quality.score(docs.select("doc_id", "text"), None).first().score == 0.5
    empty = docs.limit(0)
    assert quality.fit(empty, labels.limit(0)) is None and quality.score(empty.select("doc_id", "text"), None).count() == 0


def test_the_loss_is_at_its_minimum():
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 5))
    y = (x[:, 0] + r.normal(size=400) > 0).astype(int)
    model = quality.rank(x, y, pairs=5000)
    assert model.weights[0] > 5 * np.abs(model.weights[1:]).max()
    scores = model.scores(x)
    assert ((scores >= 0.5) == y).mean() >= max((((s := np.sort(scores))[k] <= scores) == y).mean() for k in range(0, 400, 7)) - 1e-9
