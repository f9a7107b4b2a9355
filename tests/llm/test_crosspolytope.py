import numpy as np

from quirefold.llm import crosspolytope as cp

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, component_id string"


def brute(rows, least=0.98):
    ok = {}
    for k, (i, v, label) in enumerate(rows):
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=np.float32).astype(np.float64)
            ok[k] = (label, len(v), x / np.linalg.norm(x))
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ok:
        for b in ok:
            if a < b and ok[a][:2] == ok[b][:2] and ok[a][2] @ ok[b][2] >= least:
                n[a] += 1
                n[b] += 1
                x, y = sorted((find(a), find(b)), key=lambda k: rows[k][0])
                root[y] = x
    return {rows[k][0]: (n[k], rows[find(k)][0], find(k) == k) for k in range(len(rows))}


def test_against_brute_force(spark):
    r = np.random.default_rng(3)
    rows = []
    for g in range(40):
        base = r.normal(size=64)
        for _ in range(int(r.integers(1, 8))):
            v = base + r.normal(size=64) * r.choice([0.02, 0.1, 0.13])
            rows.append((v.tolist(), int(g % 4)))
    hot = r.normal(size=64)
    rows += [((hot + r.normal(size=64) * 0.08).tolist(), 1) for _ in range(1300)]
    rows += [(rows[0][0], rows[0][1])] * 20 + [(rows[0][0], 9), (None, 1), ([], 1), ([0.0] * 64, 1), ([float("nan")] + [1.0] * 63, 1), ([None] + [1.0] * 63, 1), (rows[1][0], None), ([1.0, 2.0], 1), ([2.0, 4.0], 1), ([3.0], 1)]
    order = r.permutation(len(rows))
    rows = [(int(i), [None if x is None else float(np.float32(x)) for x in v] if v is not None else None, label) for i, (v, label) in zip(order, rows)]
    df = spark.createDataFrame([(i, v, label, "x", "y") for i, v, label in rows], SCHEMA)
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in cp.near_duplicate_vectors(df).collect()}
    assert got == brute(rows)


def test_empty_table(spark):
    assert cp.near_duplicate_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rotation_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(cp.hadamard(x), axis=1), 4 * np.linalg.norm(x, axis=1))


def test_buckets_find_pairs_at_the_bound():
    """Of pairs with a cosine of exactly 0.98, whatever the dimension, at least 99 in 100 share a bucket."""
    r = np.random.default_rng(7)
    for dim in (2, 8, 64, 200, 768):
        x, y = r.normal(size=(2, 400, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y -= (y * x).sum(axis=1, keepdims=True) * x
        y = 0.98 * x + np.sqrt(1 - 0.98**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
        assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(cp.buckets(x), cp.buckets(y))]) >= 0.99


def test_wide_vectors_make_more_groups(spark, monkeypatch):
    r = np.random.default_rng(5)
    rows = [(i, (np.eye(1, 300)[0] * 9 + r.normal(size=300) * 0.07).tolist(), 1, "x", "y") for i in range(60)]
    monkeypatch.setattr(cp, "GROUP", 4096)
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in cp.near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute([(i, v, label) for i, v, label, _, _ in rows])
