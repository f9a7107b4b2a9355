"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe, exact check.

A vector is padded to a power of two, and for each of ``TABLES`` tables rotated twice by
H D3 H D2 H D1 (random signs, Hadamard); its bucket is the pair of closest signed axes of the two
rotations (Andoni et al., 2015).  Multiprobe: the closer of the two runner-up axes gives a second
bucket, for every vector, so a pair is found if any of their buckets agree.

Equal vectors of a label collapse first to one class with a multiplicity.  A bucket is cut into
blocks of about ``BLOCK`` classes and each pair of blocks is one group: no task holds a bucket, and
cosines are block products in double precision.  A pair that meets in several buckets counts at the
smallest only, which both sides can tell from their bucket lists, so that link counts need no
distinct over pairs.  Links become stars-of-first-links for the components.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and vectors
with a null label, link with nothing (n_links 0, own component); vectors of different length never
link; rows that repeat a ``vec_id`` are one node but count as vectors of their own; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quirefold.llm.components import connected_components
from quirefold.llm.scratch import Scratch

TABLES, PROBES = 10, 2
BLOCK = 512
#: Shorter vectors are padded to 2 to this many places, as in very few places all rotations have the same few bucket borders.
LEAST_BITS = 4
#: Bytes of a group of bucket blocks, on average, with the vectors in double precision: how many groups there are follows the data.
GROUP = 12 << 20
#: Segments up to this size are compared as listed pairs of one array operation, larger ones as block products.
SMALL = 24


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the last axis (a power of two long)."""
    n, h = x.shape[-1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], axis=-2).reshape(x.shape)
        h *= 2
    return x


def _signs(table: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([table, n])).integers(0, 2, size=(2, 3, n)) * 2.0 - 1.0


def _axes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two closest signed axes of each row (axis j: 2j, minus axis j: 2j + 1) and the second's deficit."""
    size = np.abs(x)
    best = np.argpartition(-size, 1, axis=1)[:, :2] if x.shape[1] > 1 else np.zeros((len(x), 2), int)
    rows = np.arange(len(x))[:, None]
    order = np.argsort(-size[rows, best], axis=1, kind="stable")
    best = best[rows, order]
    gap = size[rows[:, 0], best[:, 0]] - size[rows[:, 0], best[:, 1]]
    return 2 * best + (x[rows, best] < 0), gap


def buckets(vectors: np.ndarray) -> np.ndarray:
    """(rows, TABLES * PROBES) bucket numbers of unit vectors of one length; the table is part of the number."""
    n = 1 << max(LEAST_BITS, int(vectors.shape[1] - 1).bit_length())
    padded = np.zeros((len(vectors), n))
    padded[:, : vectors.shape[1]] = vectors
    out = []
    for t in range(TABLES):
        found = []
        for signs in _signs(t, n):
            x = padded
            for s in signs:
                x = hadamard(x * s) / np.sqrt(n)
            found.append(_axes(x))
        (a, gap_a), (b, gap_b) = found
        first = gap_a <= gap_b
        probes = np.stack([
            a[:, 0] * (2 * n) + b[:, 0],
            np.where(first, a[:, 1] * (2 * n) + b[:, 0], a[:, 0] * (2 * n) + b[:, 1]),
        ], axis=1)
        out.append(t * (4 * n * n) + probes)
    return np.concatenate(out, axis=1)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """(rows, length) of a list column whose lists have one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _hashing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("class_id", pa.int64()), ("keys", pa.list_(pa.int64())), ("dim", pa.int32())])
    for batch in batches:
        dims = np.array([len(v) for v in batch.column(1)], dtype=np.int32)
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            for p in range(0, len(at), 2048):
                part = batch.take(pa.array(at[p : p + 2048]))
                keys = np.sort(buckets(_units(_matrix(part.column(1)))), axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(np.full(len(part), d, np.int32))], schema=schema)


def _candidates(start: np.ndarray, size: np.ndarray, block: np.ndarray, same: np.ndarray, units: np.ndarray, least: float):
    """Row pairs (a before b) of each segment that may reach ``least``; a segment of two blocks pairs across them only."""
    for k in np.flatnonzero(size > SMALL):
        rows = np.arange(start[k], start[k] + size[k])
        low = rows[block[rows] == block[rows[0]]]
        high = low if same[k] else rows[block[rows] != block[rows[0]]]
        good = units[low] @ units[high].T >= least - 1e-9
        a, b = np.nonzero(np.triu(good, 1) if same[k] else good)
        yield low[a], high[b]
    small = np.flatnonzero((size <= SMALL) & (size > 1))
    rows = np.concatenate([np.arange(s, s + n) for s, n in zip(start[small].tolist(), size[small].tolist())]) if len(small) else np.zeros(0, int)
    end = np.repeat(start[small] + size[small], size[small])
    one = np.repeat(same[small], size[small])
    more = end - rows - 1
    for p in range(0, len(rows), 8192):
        own, n = rows[p : p + 8192], more[p : p + 8192]
        a = np.repeat(own, n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        keep = np.repeat(one[p : p + 8192], n) | (block[a] != block[b])
        yield a[keep], b[keep]


def _compare(least: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("kind", "ascending"), ("bucket", "ascending"), ("i", "ascending"), ("j", "ascending"), ("block", "ascending"), ("class_id", "ascending")])
        out = []
        kind, bucket, i, j, block, ids, times = (table.column(c).to_numpy() for c in ("kind", "bucket", "i", "j", "block", "class_id", "times"))
        for d in np.unique(table.column("dim").to_numpy()):  # a kind has one dim, so its rows stay together
            rows = np.flatnonzero(table.column("dim").to_numpy() == d)
            part = table.take(pa.array(rows))
            units, keys = _units(_matrix(part.column("vector"))), _matrix(part.column("keys"))
            own = [x[rows] for x in (kind, bucket, i, j)]
            start = np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in own], axis=0)])
            size = np.diff(np.r_[start, len(rows)])
            for a, b in _candidates(start, size, block[rows], (own[2] == own[3])[start], units, least):
                for p in range(0, len(a), 1 << 14):
                    x, y = a[p : p + (1 << 14)], b[p : p + (1 << 14)]
                    good = np.einsum("ij,ij->i", units[x], units[y]) >= least
                    x, y = x[good], y[good]
                    met = np.full(len(x), np.iinfo(np.int64).max)  # the smallest bucket of both: a pair counts there only
                    for c in range(keys.shape[1]):
                        own_key = keys[x, c]
                        met = np.where((keys[y] == own_key[:, None]).any(axis=1), np.minimum(met, own_key), met)
                    good = met == own[1][x]
                    if good.any():
                        out.append(np.stack([rows[x[good]], rows[y[good]]]))
        if not out:
            return _FOUND.empty_table()
        a, b = np.concatenate(out, axis=1)
        node, weight = np.concatenate([ids[a], ids[b]]), np.concatenate([times[b], times[a]])
        order = np.argsort(node, kind="stable")
        first = np.flatnonzero(np.r_[True, node[order][1:] != node[order][:-1]])
        sums = pa.table([pa.array(node[order][first]), pa.array(np.add.reduceat(weight[order], first)), pa.nulls(len(first), pa.int64()), pa.nulls(len(first), pa.int64())], schema=_FOUND)
        tree = _forest(np.stack([ids[a], ids[b]], axis=1))
        return pa.concat_tables([sums, pa.table([pa.nulls(len(tree), pa.int64()), pa.nulls(len(tree), pa.int64()), pa.array(tree[:, 0]), pa.array(tree[:, 1])], schema=_FOUND)])

    return run


_FOUND = pa.schema([("class_id", pa.int64()), ("weight", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _forest(pairs: np.ndarray) -> np.ndarray:
    """The pairs that join two trees so far: the same components, fewer edges than nodes."""
    parent: dict[int, int] = {}
    keep = []

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, (p, q) in enumerate(pairs.tolist()):
        p, q = find(p), find(q)
        if p != q:
            parent[max(p, q)] = min(p, q)
            keep.append(k)
    return pairs[keep]


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """``vectors(vec_id, embedding, label, ...)`` -> ``(vec_id, n_links, component_id, kept)``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "crosspolytope")
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast(kind).alias("vector"))
    real = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("fine", F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("vector") > 0) & real, F.lit(False)))
    classes = rows.where("fine").groupBy("label", "vector").agg(F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("times"))
    classes = scratch.save(classes, "classes")
    keyed = scratch.save(classes.select("class_id", "vector").mapInArrow(_hashing, "class_id long, keys array<long>, dim int"), "keyed")
    entries = keyed.join(classes.select("class_id", "label"), "class_id").select("class_id", "dim", F.xxhash64("label", "dim").alias("kind"), F.explode(F.array_distinct("keys")).alias("bucket"))
    crowd = entries.groupBy("kind", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowd = scratch.save(crowd.select("kind", "bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "crowd")
    placed = entries.join(crowd, ["kind", "bucket"]).withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
    spread = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "class_id", "dim", "kind", "bucket", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    spread = scratch.save(spread, "spread")
    size = spread.agg(F.sum(F.col("dim").cast("long") * 8 + TABLES * PROBES * 8 + 56)).first()[0] or 0
    groups = max(1, size // GROUP)
    full = spread.join(keyed.select("class_id", "keys"), "class_id").join(classes.select("class_id", "vector", "times"), "class_id")
    full = full.withColumn("part", F.pmod(F.xxhash64("kind", "bucket", "i", "j"), F.lit(groups)))
    found = full.groupBy("part").applyInArrow(_compare(least), "class_id long, weight long, a long, b long")
    found = scratch.save(found, "found")
    parts = connected_components(found.where("a is not null").select("a", "b"), scratch)
    weights = found.where("class_id is not null").groupBy("class_id").agg(F.sum("weight").alias("weight"))
    known = classes.join(weights, "class_id", "left").join(parts.withColumnRenamed("node", "class_id"), "class_id", "left")
    links = F.col("times") - 1 + F.coalesce("weight", F.lit(0))
    known = scratch.save(known.select("label", "vector", links.alias("n_links"), F.coalesce("component", "class_id").alias("component_id")), "known")
    scratch.drop("spread", "found", "keyed", "crowd", "classes")
    single = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = rows.where("fine").join(known, ["label", "vector"]).select("vec_id", "n_links", "component_id").unionByName(single)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
