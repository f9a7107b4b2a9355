import numpy as np

from quirefold.llm import language as lang

SCHEMA = "doc_id long, text string, lang string, score string, lang_pred string"


def words(r, alphabet, n):
    return " ".join("".join(r.choice(list(alphabet), size=r.integers(2, 7))) for _ in range(n))


def test_gradients_of_the_recurrent_network():
    r = np.random.default_rng(1)
    x = r.integers(0, 5, (6, 3)).astype(np.uint8)
    w, u = (r.normal(size=s).astype(np.float32) * 0.5 for s in ((256, 24), (8, 24)))
    goal = r.normal(size=(6, 3, 8)).astype(np.float32)
    kept = []
    lang._gru(x, w, u, kept)
    gw, gu = lang._gru_back(x, w, u, kept, goal)
    for part, grad, at in [(w, gw, (2, 3)), (w, gw, (1, 12)), (w, gw, (3, 20)), (u, gu, (4, 2)), (u, gu, (1, 11)), (u, gu, (7, 22))]:
        value, e = part[at], np.float32(3e-3)
        part[at] = value + e
        up = float((lang._gru(x, w, u) * goal).sum(dtype=np.float64))
        part[at] = value - e
        down = float((lang._gru(x, w, u) * goal).sum(dtype=np.float64))
        part[at] = value
        assert abs((up - down) / (2 * e) - grad[at]) < 2e-2 * max(1.0, abs(grad[at]))


def test_document_means_equal_window_by_window():
    r = np.random.default_rng(2)
    windows = r.integers(97, 105, (300, lang.WINDOW)).astype(np.uint8)
    model = lang.train(windows, np.arange(300) % 2, ("a", "b"), steps=2)
    texts = [bytes(r.integers(97, 105, n).astype(np.uint8)) for n in (0, 1, 63, 64, 65, 1000)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    got = lang.document_probabilities(model, data, offsets, batch=4)
    for t, p in zip(texts, got):
        parts = [lang.position_probabilities(model, np.frombuffer(t[i : i + lang.WINDOW], np.uint8)[None])[:, 0] for i in range(0, len(t), lang.WINDOW)]
        assert np.allclose(p, np.concatenate(parts).mean(axis=0) if parts else 0, atol=1e-5)


def test_held_out_accuracy_and_edge_cases(spark):
    r = np.random.default_rng(3)
    rows = [(i, words(r, "abcdeü" if i % 2 else "stuvwé", int(r.integers(20, 60))), "one" if i % 2 else "two") for i in range(200)]
    train = spark.createDataFrame([(*x, "", "") for x in rows[:120]], SCHEMA)
    model = lang.fit(train, per_language=50)
    odd = [(900, None, "one"), (901, "", "one"), (902, "12 ² 34 !?", None), (903, "ÄB", None), (904, "abc de " * 40_000, None)]
    test = spark.createDataFrame([(*x, "", "") for x in rows[120:] + odd + rows[130:131]], SCHEMA)
    got = lang.predict(test, model).collect()
    assert len(got) == 86
    found = {x.doc_id: (x.lang_pred, x.score) for x in got}
    assert sum(found[i][0] == name for i, _, name in rows[120:]) >= 78
    assert found[900] == found[901] == found[902] == ("und", 0.0) and found[903][0] != "und" and found[904][0] == "one"
    assert all(0 <= s <= 1 for _, s in found.values())


def test_without_training_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert lang.fit(empty) is None
    df = spark.createDataFrame([(1, "abc", None, "", "")], SCHEMA).select("doc_id", "text")
    assert lang.predict(df, None).first().lang_pred == "und"
    assert lang.predict(empty.select("doc_id", "text"), None).count() == 0


def test_short_texts_train_their_language(spark):
    """A language of texts of about 30 bytes beside one of long texts, and short texts alone; 'und' is for null and letterless texts only."""
    r = np.random.default_rng(5)
    short = [(i, words(r, "abcdeü", 6)[:30], "one") for i in range(120)]
    long = [(200 + i, words(r, "stuvwé", 60), "two") for i in range(60)]
    other = [(300 + i, words(r, "stuvwé", 6)[:30], "two") for i in range(120)]
    for rows, fresh in ((short + long, 80), (short + other, 80)):
        model = lang.fit(spark.createDataFrame([(*x, "", "") for x in rows], SCHEMA))
        assert model.languages == ("one", "two")
        test = [(900 + i, words(r, "abcdeü" if i % 2 else "stuvwé", 6)[:30], None, "", "") for i in range(fresh)] + [(2000, None, None, "", ""), (2001, "12 !", None, "", "")]
        got = {x.doc_id: x.lang_pred for x in lang.predict(spark.createDataFrame(test, SCHEMA), model).collect()}
        assert sum(got[900 + i] == ("one" if i % 2 else "two") for i in range(fresh)) >= 0.9 * fresh
        assert {i for i, v in got.items() if v == "und"} == {2000, 2001}


def test_padding_is_never_read_in_training():
    r = np.random.default_rng(6)
    windows, lengths = r.integers(97, 105, (40, lang.WINDOW)).astype(np.uint8), r.integers(5, 40, 40)
    padded = windows.copy()
    for row, n in zip(padded, lengths):
        row[n:] = 7
    one, two = (lang.train(w, np.arange(40) % 2, ("a", "b"), steps=3, lengths=lengths) for w in (windows, padded))
    assert np.allclose(one.out, two.out) and all(np.allclose(a[97:105], b[97:105]) for a, b in zip(one.inputs, two.inputs))


def test_repeated_rows_of_few_ids_keep_their_language(spark):
    rows = [(k % 3, "abcde cab dec bade", "one", "", "") for k in range(3000)] + [(10 + k, "stuvw vut wuts", "two", "", "") for k in range(300)]
    assert lang.fit(spark.createDataFrame(rows, SCHEMA), per_language=40).languages == ("one", "two")
