"""MinHash near-dedup with circulant permutations, banding and exact Jaccard verification.

Signatures (Li & Li, C-MinHash): one permutation ``sigma`` scatters the shingles over a circle of
``CIRCLE`` places, a second one, ``pi``, is shifted by k places to give coordinate k.  The K values
of one shingle are a contiguous slice of ``pi``, so a signature is a running minimum of slices.

Plan:

1. one scan of the texts writes, for each row, the size of its shingle set, a 128-bit digest of the
   set and ``BANDS`` band keys; no set is stored;
2. rows of equal digest collapse (map-side minimum) to a representative, so groups of copies vanish;
3. each bucket (equal band key) is linked as a star around its smallest member, never as all pairs;
   candidate links are verified on full sets, which are built only for rows in candidates;
4. all members of buckets that hold several components after that, linked to a star or not, meet in an exact
   prefix-filter join, which finds every link between different components, whatever the bucket's size;
5. components of all verified links, joined back to the rows.

Shingles are 64-bit hashes, and equal 128-bit digests of sets of one size count as equal sets: two given
different sets are taken for equal with a chance of about 2^-128, one of 10^4 shingles loses two to one hash with 3e-12.

Defined cases: null or word-less texts have an empty set and link with nothing; rows that repeat a
``doc_id`` are one node; a null ``doc_id`` keeps its row with null component and ``kept`` true; an
empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quirefold.llm.components import connected_components
from quirefold.llm.scratch import Scratch
from quirefold.llm.shingles import NOT_SPACE, U, Words, mix, shingle_sets, slices, text_buffers
from quirefold.llm.workers import claim

BANDS, ROWS = 28, 6
WIDTH = BANDS * ROWS
CIRCLE = 1 << 21
SLICE = 1 << 19
_tables: dict[str, np.ndarray] = {}


def _pi() -> np.ndarray:
    """All K-wide slices of the shifted permutation, as a view: row s holds pi(s), pi(s+1), ..."""
    if "pi" not in _tables:
        pi = np.random.Generator(np.random.PCG64(20)).permutation(CIRCLE).astype(np.uint32)
        pi = np.concatenate([pi, pi[:WIDTH]])
        _tables["pi"] = np.lib.stride_tricks.sliding_window_view(pi, WIDTH)[:CIRCLE]
    return _tables["pi"]


def signatures(sets: list[np.ndarray], chunk: int = 1 << 14) -> np.ndarray:
    """(rows, WIDTH) circulant MinHash values; an empty set keeps the largest value everywhere."""
    out = np.full((len(sets), WIDTH), np.uint32(0xFFFFFFFF))
    sizes = np.array([len(s) for s in sets])
    if not sizes.sum():
        return out
    pi, place = _pi(), (mix(np.concatenate(sets) ^ U(0x5851F42D4C957F2D)) & U(CIRCLE - 1)).astype(np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    for a in range(0, len(place), chunk):
        own = owner[a : a + chunk]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        low = np.minimum.reduceat(pi[place[a : a + chunk]], first, axis=0)
        out[own[first]] = np.minimum(out[own[first]], low)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    x = signature.reshape(-1, BANDS, ROWS).astype(np.uint64)
    total = np.zeros(x.shape[:2], dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * U(0xD1342543DE82EF95)
    for r in range(ROWS):
        total = mix(total + x[:, :, r])
    return total.view(np.int64)


def _digest(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate([*sets, np.zeros(1, np.uint64)])
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        x = np.add.reduceat(mix(flat ^ U(salt)), at) if len(sets) else np.zeros(0, np.uint64)
        out.append(np.where(sizes > 0, x, U(0)).view(np.int64))
    return out[0], out[1]


def _row_sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    data, offsets = text_buffers(batch.column(1))
    for a, b in slices(offsets, SLICE):
        yield a, b, shingle_sets(Words(data, offsets[a : b + 1], NOT_SPACE), k)


def _signing(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("shingles")
        for batch in batches:
            for a, b, sets in _row_sets(batch, k):
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                d1, d2 = _digest(sets)
                keys = band_keys(signatures(sets))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(sizes), pa.array(d1), pa.array(d2), lists], schema=schema)

    return run


def _setting(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("shingles")
        for batch in batches:
            for a, b, sets in _row_sets(batch, k):
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), lists], schema=schema)

    return run


class _Links:
    """Verification of candidate pairs on full shingle sets; every batch of links is a written table."""

    def __init__(self, docs: DataFrame, scratch: Scratch, k: int, percent: int):
        self.docs, self.scratch, self.k, self.percent, self.round = docs, scratch, k, percent, 0

    def sets(self, ids: DataFrame, name: str) -> DataFrame:
        """``ids(doc_id)`` -> a written table of their shingle sets."""
        texts = self.docs.join(ids, "doc_id", "left_semi").select("doc_id", "text")
        return self.scratch.save(texts.mapInArrow(_setting(self.k), "doc_id long, shingles array<long>"), name)

    def verified(self, pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame | None:
        """``pairs(a, b)`` distinct -> those with 100 * intersection >= percent * union; None if there are no pairs."""
        self.round += 1
        name = f"{self.round}"
        pairs = self.scratch.save(pairs, f"pairs-{name}")
        if pairs.isEmpty():
            return None
        if sets is None:
            wanted = self.scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), f"wanted-{name}")
            sets = self.sets(wanted, f"sets-{name}")
        left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
        right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        links = (
            pairs.join(right, "b").join(left, "a")
            .where(100 * both >= self.percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")
        )
        links = self.scratch.save(links, f"links-{name}")
        self.scratch.drop(f"pairs-{name}", f"wanted-{name}", f"sets-{name}")
        return links

    def between(self, pool: DataFrame) -> DataFrame | None:
        """All links between rows of ``pool(rep, n, component)`` of different components, by prefix and position filters.

        Shingles stand in order of their frequency in the pool, the rarest first.  Two sets that link share
        one among the first few of each, early enough in both for the needed overlap to follow; texts with
        too many shingles of their own share none and are never paired, however large their bucket is.
        """
        p = self.percent
        sets = self.sets(pool.select(F.col("rep").alias("doc_id")), "pool-sets")
        tokens = sets.select(F.col("doc_id").alias("rep"), F.explode("shingles").alias("token"))
        often = self.scratch.save(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "often")
        order = Window.partitionBy("rep").orderBy(F.coalesce("often", F.lit(1)), "token")
        placed = tokens.join(often, "token", "left").withColumn("at", F.row_number().over(order)).where("often > 1").join(pool, "rep")
        placed = placed.where(f"at <= n - ({p} * n + 99) div 100 + 1").select("rep", "n", "component", "token", "at")
        placed = self.scratch.save(placed, "prefixes")
        short = placed.where(f"at <= n - (2 * {p} * n + {99 + p}) div {100 + p} + 1").select(*(F.col(c).alias(f"{c}_a") for c in ("rep", "n", "component", "at")), "token")
        long = placed.select(*(F.col(c).alias(f"{c}_b") for c in ("rep", "n", "component", "at")), "token")
        pairs = short.join(long, "token").where(
            f"component_a <> component_b and (n_a < n_b or n_a = n_b and rep_a < rep_b) and 100 * n_a >= {p} * n_b"
            f" and 1 + least(n_a - at_a, n_b - at_b) >= ({p} * (n_a + n_b) + {99 + p}) div {100 + p}")
        links = self.verified(pairs.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct(), sets)
        self.scratch.drop("pool-sets", "often", "prefixes")
        return links


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_shingles, component_id, kept)``, one row for each row of ``docs``.

    Two texts are linked if 100 * intersection >= percent * union of their sets of ``shingle``-word
    shingles; ``component_id`` is the smallest ``doc_id`` reachable by links.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = scratch.save(docs.mapInArrow(_signing(shingle), "doc_id long, n long, d1 long, d2 long, bands array<long>"), "signed")
    linked = signed.where("n > 0 and doc_id is not null")
    reps = scratch.save(linked.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "reps")
    rows = reps.select("rep", "n", F.explode("bands").alias("key"))
    pivots = scratch.save(
        rows.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("rep", "n")).alias("low"))
        .where("members > 1").select("key", F.col("low.rep").alias("pivot"), F.col("low.n").alias("pivot_n")),
        "pivots",
    )
    members = scratch.save(rows.join(pivots.select("key"), "key", "left_semi"), "members")
    fits = f"100 * least(n, {{0}}) >= {percent} * greatest(n, {{0}})"
    links = _Links(docs, scratch, shingle, percent)
    stars = members.join(pivots, "key").where(f"rep <> pivot and {fits.format('pivot_n')}").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    copies = linked.select("doc_id", "d1", "d2").join(reps.select("d1", "d2", "rep"), ["d1", "d2"]).select("doc_id", "rep").where("doc_id <> rep")
    copies = scratch.save(copies.distinct(), "copies")

    edges = copies.selectExpr("rep as a", "doc_id as b")
    stars = links.verified(stars)
    placed = members.withColumn("component", F.col("rep"))
    if stars is not None:
        parts = connected_components(stars, scratch, "cc-stars")
        edges = edges.unionByName(parts.selectExpr("component as a", "node as b"))
        placed = members.join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    placed = scratch.save(placed, "placed")
    mixed = scratch.save(placed.groupBy("key").agg(F.max("component").alias("high"), F.min("component").alias("low")).where("low < high").select("key"), "mixed")
    pool = scratch.save(placed.join(mixed, "key", "left_semi").select("rep", "n", "component").distinct(), "pool")
    more = None if pool.isEmpty() else links.between(pool)
    edges = edges if more is None else edges.unionByName(more)
    scratch.drop("placed", "mixed", "pool")
    parts = connected_components(edges, scratch, "cc-all")
    scratch.drop("members", "pivots", "reps")
    ids = signed.select("doc_id", F.col("n").alias("n_shingles"))
    out = ids.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
