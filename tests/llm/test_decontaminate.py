import random
import re

from quirefold.llm import decontaminate as dec

DOCS = "doc_id long, text string, item_id string, words string, seed int"
ITEMS = "item_id long, text string, run string, doc_id int"


def words(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    """Every diagonal of every pair whose words agree at all ones of some mask at some place."""
    found = {}
    for d, text in docs:
        x = words(text)
        for i, item in items:
            y = words(item)
            if len(y) < dec.LEAST:
                continue
            masks = list(dec.MASKS) if len(y) >= dec.LONGEST else ["1" * len(y)]
            for diagonal in range(-len(y) + 1, len(x)):
                equal = {p: x[p] == y[p - diagonal] for p in range(max(0, diagonal), min(len(x), len(y) + diagonal))}
                seeded = any(all(equal.get(p + k, False) for k, c in enumerate(m) if c == "1") and p + len(m) - 1 in equal for p in equal for m in masks)
                size = min(dec.ENOUGH, len(y))
                covered = {q for a in equal if a + size - 1 in equal and 5 * sum(equal[q] for q in range(a, a + size)) >= 4 * size for q in range(a, a + size)}
                for a in covered if seeded else ():
                    if a - 1 not in covered:
                        b = next(q for q in range(a, a + len(x) + 2) if q not in covered)
                        found[(d, i)] = max(found.get((d, i), 0), sum(equal[q] for q in range(a, b)))
    return found


def corpus():
    r = random.Random(8)
    vocabulary = ["w%d" % i for i in range(300)] + ["the", "of", "Ünd"]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, text(r.choice([12, 20, 35, 35, 60]))) for i in range(12)] + [(20, text(6)), (21, text(9)), (22, text(3))]
    docs = []
    for k in range(60):
        body = text(r.randrange(0, 80))
        for _ in range(r.choice([0, 0, 1, 2])):
            item = list(r.choice(items)[1])
            for _ in range(r.choice([0, 1, 2, 4])):
                item[r.randrange(len(item))] = r.choice(vocabulary)
            item = item[r.choice([0, 0, 5]) :]
            at = r.randrange(len(body) + 1)
            body[at:at] = item
        docs.append((k, r.choice([" ", ", ", "\n- "]).join(body)))
    docs += [(90, None), (91, ""), (92, "... --"), (93, " ".join(items[0][1]).upper())]
    return docs, [(i, " ".join(t)) for i, t in items] + [(30, None), (31, ""), (32, " ".join(items[2][1]))]


def test_against_brute_force(spark):
    docs, items = corpus()
    df = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in docs], DOCS)
    bench = spark.createDataFrame([(i, t, "x", 1) for i, t in items], ITEMS)
    got = {(r.doc_id, r.item_id): r.n_equal for r in dec.overlaps(df, bench).collect()}
    assert got == brute(docs, items) and len(got) > 25 and (93, 0) in got
    kept = {r.doc_id for r in dec.clean(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}


def test_repeated_and_null_ids_and_empty_tables(spark):
    passage = " ".join("p%d" % i for i in range(20))
    df = spark.createDataFrame([(1, passage, "", "", 1), (1, "clean text here", "", "", 1), (None, passage, "", "", 1), (2, "q " * 100_000 + passage, "", "", 1)], DOCS)
    bench = spark.createDataFrame([(5, passage, "", 1)], ITEMS)
    rows = {(r.doc_id, r.item_id, r.start, r.n_equal) for r in dec.overlaps(df, bench).collect()}
    assert rows == {(1, 5, 0, 20), (None, 5, 0, 20), (2, 5, 100_000, 20)}
    assert dec.clean(df, bench).count() == 0
    assert dec.overlaps(df.limit(0), bench).count() == 0
    assert dec.clean(df, bench.limit(0)).count() == 4


def test_substitutions_near_the_ends_are_tolerated(spark):
    """Items with a word or two replaced near an end, four fifths or more of each window still equal."""
    cases = [(18, (3, 14)), (13, (3,)), (14, (3,)), (10, (2,)), (13, (2, 10)), (30, (3, 14, 25))]
    items = [(k, " ".join(f"i{k}x{j}" for j in range(n))) for k, (n, _) in enumerate(cases)]
    docs = []
    for k, (n, gone) in enumerate(cases):
        body = [f"i{k}x{j}" if j not in gone else f"other{j}" for j in range(n)]
        docs.append((k, " ".join(["before", "it", *body, "and", "after"])))
    docs += [(100 + k, " ".join(f"i{k}x{j}" if j % 2 else f"z{j}" for j in range(n))) for k, (n, _) in enumerate(cases)]
    df = spark.createDataFrame([(d, t, "", "", 1) for d, t in docs], DOCS)
    got = {(r.doc_id, r.item_id, r.n_equal) for r in dec.overlaps(df, spark.createDataFrame([(i, t, "", 1) for i, t in items], ITEMS)).collect()}
    assert got == {(k, k, n - len(gone)) for k, (n, gone) in enumerate(cases)}
