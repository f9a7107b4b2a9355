import random
import re

from quirefold.llm.minhash import near_duplicates

SCHEMA = "doc_id long, text string, lang string, component_id string, n long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute(rows, k, percent):
    sets = {}
    for doc_id, text in rows:
        words = [w for w in re.split("[\x20\x09-\x0d]+", lower(text or "")) if w]
        sets[doc_id] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())
    ids = sorted(sets)
    label = {i: i for i in ids}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus():
    r = random.Random(5)
    words = ["w%d" % i for i in range(60)] + ["Ünd", "THE", "the"]
    rows = []
    for g in range(25):
        base = [r.choice(words) for _ in range(r.choice([3, 20, 80, 300]))]
        for _ in range(r.randint(1, 6)):
            copy = [r.choice(words) if r.random() < 0.012 else w for w in base]
            rows.append(" ".join(copy))
    rows += [None, "", " \t\n", "one", "ONE", "one two", "two one", "a\x0bb c", "a b c", "x " * 50_000]
    rows += [rows[0]] * 30
    r.shuffle(rows)
    return list(enumerate(rows))


def collect(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, None, "clash", 7) for i, t in rows], SCHEMA)
    for k, percent in ((3, 85), (5, 80)):
        assert collect(near_duplicates(df, k, percent)) == brute(rows, k, percent)


def test_empty_table_null_ids_and_repeated_ids(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f", "", "", 1), (4, "p q r", "", "", 1), (4, "s t u", "", "", 1), (9, "s t u", "", "", 1)], SCHEMA)
    out = sorted((r.doc_id or -1, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert out == [(-1, None, True), (4, 4, True), (4, 4, True), (9, 4, False)]
