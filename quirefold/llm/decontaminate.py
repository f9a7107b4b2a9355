"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive words; words at its zeros may differ.  Hashes of all seeds of
the benchmark go into a Bloom filter of bounded size, which one scan of the texts asks at every word.
What passes is kept as runs: nearby hits with the words around them.  Hits then join the benchmark's
seeds by hash; each (run, item, diagonal) is verified once: it counts if four fifths of the words are equal in any
window of ``ENOUGH`` words on the diagonal, or of the item's length where that is less.  Windows that count and
touch make one stretch, without the different words at its ends; the one with most equal words is reported.

Words are runs of ASCII letters (A-Z lower-cased), digits and non-ASCII characters.  Only the filter
is broadcast, and its size is bounded whatever the benchmark's is; a filter too full lets more through
to the join and changes no result.  Items below ``LEAST`` words are not looked for (they say nothing);
items shorter than a mask are looked for as a whole.

Defined cases: null and word-less texts and items match nothing; equal items each give their rows; rows
that repeat a ``doc_id`` count as one document; null ids are kept as null; empty tables give an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quirefold.llm.scratch import Scratch
from quirefold.llm.shingles import U, Words, byte_table, mix, slices, text_buffers
from quirefold.llm.workers import claim

MASKS = ("11101011", "110110011", "1101001011", "111001101")
LEAST, ENOUGH, RADIUS = 5, 13, 48
LONGEST = max(map(len, MASKS))
#: Bits of the filter: so many for each seed, between these powers of two.
BITS_A_SEED, LEAST_BITS, MOST_BITS = 1024, 20, 27
#: Cells of the filter (64 bits each) that are packed together.
PAGE_BITS = 10
CHUNK = 1 << 18
WORD = byte_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF), inside=True)


def _seeds(hashes: np.ndarray, left: np.ndarray, masks: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each mask: its number, the positions where it fits (``left``: words from there to the text's end) and hashes."""
    for k, mask in enumerate(masks):
        n = len(hashes) - len(mask) + 1
        for low in range(0, n, CHUNK):  # positions in runs, so that a long text makes no wide arrays
            at = low + np.flatnonzero(left[low : min(low + CHUNK, n)] >= len(mask))
            total = np.full(len(at), U((len(mask) * 131 + int(mask, 2)) * 0x9E3779B97F4A7C15 % (1 << 64)))
            for j, c in enumerate(mask):
                if c == "1":
                    total = (total ^ hashes[at + j]) * U(0x9FB21C651E98DF25)
                    total ^= total >> U(29)
            yield k, at, mix(total)


def _left(bounds: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)


def _benchmark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        for a, b in slices(offsets, 1 << 19):
            words = Words(data, offsets[a : b + 1], WORD)
            rows = [words.hash[i:j].view(np.int64) for i, j in zip(words.bounds[:-1], words.bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(rows, pa.list_(pa.int64()))], names=["item_id", "words"])


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for item, words in zip(batch.column(0), batch.column(1)):
            h = np.array(words.as_py(), dtype=np.int64).view(np.uint64)
            if len(h) < LEAST:
                continue
            masks = list(MASKS) if len(h) >= LONGEST else ["1" * len(h)]
            for _, at, seeds in _seeds(h, len(h) - np.arange(len(h)), masks):
                out += [(item.as_py(), int(p), int(s)) for p, s in zip(at, seeds.view(np.int64))]
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], batch.schema.field(0).type), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int64())], names=["item_id", "item_at", "seed"])


def _places(seed: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (seed & U((1 << bits) - 1)).astype(np.int64), ((seed >> U(32)) & U((1 << bits) - 1)).astype(np.int64)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages of the filter as bytes."""
    for batch in batches:
        pages = []
        for cells, bits in zip(batch.column(1), batch.column(2)):
            page = np.zeros(1 << PAGE_BITS, np.int64)
            page[cells.values.to_numpy() & ((1 << PAGE_BITS) - 1)] = bits.values.to_numpy()
            pages.append(page.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(pages, pa.binary())], names=["page", "data"])


_RUNS = "doc_id long, run long, first long, words array<long>, hits array<struct<at:int,seed:long>>"


def _scanning(shared, bits: int, masks: list[str]):
    schema = pa.schema([("doc_id", pa.int64()), ("run", pa.int64()), ("first", pa.int64()), ("words", pa.list_(pa.int64())), ("hits", pa.list_(pa.struct([("at", pa.int32()), ("seed", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("shingles")
        filled = np.frombuffer(shared.value, dtype=np.uint64)

        def passes(seed: np.ndarray) -> np.ndarray:
            a, b = _places(seed, bits)
            ok = np.flatnonzero((filled[a >> 6] >> (a & 63).astype(np.uint64)) & U(1))
            return ok[((filled[b[ok] >> 6] >> (b[ok] & 63).astype(np.uint64)) & U(1)).astype(bool)]

        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in slices(offsets, 1 << 19):
                words = Words(data, offsets[a : b + 1], WORD)
                at, seeds = [], []
                for _, p, s in _seeds(words.hash, _left(words.bounds, len(words.hash)), masks):
                    ok = passes(s)
                    at.append(p[ok])
                    seeds.append(s[ok])
                at, seeds = np.concatenate([np.zeros(0, int), *at]), np.concatenate([np.zeros(0, np.uint64), *seeds])
                if not len(at):
                    continue
                order = np.lexsort((seeds, at))
                at, seeds = at[order], seeds[order]
                owner = np.searchsorted(words.bounds, at, side="right") - 1
                cuts = np.flatnonzero((np.diff(at) > RADIUS) | (np.diff(owner) > 0)) + 1
                rows = []
                for own in np.split(np.arange(len(at)), cuts):
                    d = int(owner[own[0]])
                    low, high = int(words.bounds[d]), int(words.bounds[d + 1])
                    first, last = max(low, int(at[own[0]]) - RADIUS), min(high, int(at[own[-1]]) + LONGEST + RADIUS)
                    near = words.hash[first:last]
                    doc = batch.column(0)[a + d].as_py()
                    key = int((near * (np.arange(len(near), dtype=np.uint64) * U(2) + U(1))).sum(dtype=np.uint64).view(np.int64))
                    rows.append((doc, key ^ (first - low), first - low, near.view(np.int64), [{"at": int(at[i]) - first, "seed": int(seeds[i].view(np.int64))} for i in own]))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in range(5)], schema=schema)

    return run


def stretch(equal: np.ndarray, size: int) -> tuple[int, int]:
    """Bounds of the stretch with most equal words (of equals the first) that windows of ``size`` words, four fifths of them equal, cover; (0, 0) for none."""
    total = np.concatenate([[0], np.cumsum(equal)])
    good = np.flatnonzero(5 * (total[size:] - total[:-size]) >= 4 * size)
    if not len(good):
        return 0, 0
    cut = np.flatnonzero(np.diff(good) > size)
    low, high = good[np.concatenate([[0], cut + 1])], good[np.concatenate([cut, [len(good) - 1]])] + size
    k = int((total[high] - total[low]).argmax())
    inside = low[k] + np.flatnonzero(equal[low[k] : high[k]])
    return int(inside[0]), int(inside[-1]) + 1


def _verifying(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("n_words", pa.int64()), ("n_equal", pa.int64())])
    for batch in batches:
        doc, item, first, diagonal = (batch.column(c).to_pylist() for c in ("doc_id", "item_id", "first", "diagonal"))
        out = []
        for k, (x, y) in enumerate(zip(batch.column("words"), batch.column("item_words"))):
            x, y, d = x.values.to_numpy(), y.values.to_numpy(), diagonal[k]
            low, high = max(0, d), min(len(x), len(y) + d)
            size = min(ENOUGH, len(y))
            if high - low < size:
                continue
            equal = x[low:high] == y[low - d : high - d]
            i, j = stretch(equal, size)
            if j > i:
                out.append((doc[k], item[k], first[k] + low + i, j - i, int(equal[i:j].sum())))
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(5)], schema=schema)


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)``, ``benchmark(item_id, text, ...)`` -> ``(doc_id, item_id, start, n_words, n_equal)``.

    One row for each document and item that overlap: the stretch with most equal words (of equals the shortest, then the first); ``start`` counts the
    document's words from 0.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    items = scratch.save(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_benchmark, "item_id long, words array<long>"), "items")
    seeds = scratch.save(items.mapInArrow(_item_seeds, "item_id long, item_at int, seed long"), "seeds")
    short = items.select(F.size("words").alias("n")).where(f"n >= {LEAST} and n < {LONGEST}").distinct().collect()  # at most LONGEST - LEAST rows
    masks = [*MASKS, *("1" * n for n in sorted(r["n"] for r in short))]
    n = seeds.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (max(1, n) * BITS_A_SEED - 1).bit_length()))
    low = (1 << bits) - 1
    place = F.explode(F.array(F.col("seed").bitwiseAND(F.lit(low)), F.shiftrightunsigned("seed", 32).bitwiseAND(F.lit(low)))).alias("place")
    cells = seeds.select(place).groupBy(F.shiftright("place", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits"))
    pages = cells.groupBy(F.shiftright("cell", PAGE_BITS).alias("page")).agg(F.collect_list("cell").alias("cells"), F.collect_list("bits").alias("bits"))
    filled = np.zeros(1 << (bits - 6), dtype=np.int64)
    for r in pages.mapInArrow(_packed, "page long, data binary").collect():  # at most 2^(bits - 6 - PAGE_BITS) rows: the filter's bytes, 16 MB at most
        filled[r["page"] << PAGE_BITS : (r["page"] + 1) << PAGE_BITS] = np.frombuffer(bytes(r["data"]), np.int64)
    shared = spark.sparkContext.broadcast(filled.tobytes())
    runs = scratch.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scanning(shared, bits, masks), _RUNS), "runs")
    hits = runs.select("doc_id", "run", F.explode("hits").alias("hit")).select("doc_id", "run", F.col("hit.at").alias("at"), F.col("hit.seed").alias("seed"))
    met = hits.join(seeds, "seed").select("doc_id", "run", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
    met = scratch.save(met, "met")
    full = (
        met.join(runs.select("doc_id", "run", "first", "words").distinct(), (met["run"] == runs["run"]) & met["doc_id"].eqNullSafe(runs["doc_id"]))
        .select(met["doc_id"], "item_id", "diagonal", "first", "words").alias("x")
        .join(items.withColumnRenamed("words", "item_words").alias("y"), F.expr("x.item_id <=> y.item_id"))
        .select("x.doc_id", "x.item_id", "x.first", "x.diagonal", "x.words", "y.item_words")
    )
    good = full.mapInArrow(_verifying, "doc_id long, item_id long, start long, n_words long, n_equal long")
    best = good.groupBy("doc_id", "item_id").agg(F.min_by(F.struct("start", "n_words", "n_equal"), F.struct(-F.col("n_equal"), F.col("n_words"), F.col("start"))).alias("x"))
    return best.select("doc_id", "item_id", "x.start", "x.n_words", "x.n_equal")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark item; null ids are compared like values."""
    leaks = overlaps(docs, benchmark).select(F.col("doc_id").alias("__leak")).distinct()
    return docs.join(leaks, F.col("doc_id").cast("long").eqNullSafe(F.col("__leak")), "left_anti")
