"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is a linear function of features of its text.  Of a bounded sample of labelled
rows, pairs of a good and a bad document say which is preferred; the weights minimise the logistic
loss of the feature differences.  The cut is a quantile of the sample's strengths: the one at which
most of the sample's labels come out right.  ``score`` is the logistic function of the distance from
the cut, so 0.5 is the cut itself.

Defined cases: null and empty texts have the features of an empty text and get a score like any
other; rows that repeat score alike; a sample without both labels gives every text 0.5; an empty
table gives an empty result; labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quirefold.llm.scratch import small_batches
from quirefold.llm.shingles import CHUNK, NOT_SPACE, Words, slices, text_buffers
from quirefold.llm.workers import claim

#: At most so many labelled rows are fitted on, and so many pairs of them.
SAMPLE, PAIRS = 6_000, 60_000
_CLASSES = ("a-z", "A-Z", "0-9", " \t", "\n\r", ".", ",", "!", "|", "*", "#$%&", "\"'()[]{}<>", ":;?=+-/_\\@^`~", "other ASCII", "not ASCII")


def _byte_classes() -> np.ndarray:
    out = np.full(256, 13, dtype=np.int64)
    out[128:] = 14
    for i, members in enumerate(_CLASSES[:13]):
        if len(members) == 3 and members[1] == "-" and members[0].isalnum():
            out[ord(members[0]) : ord(members[2]) + 1] = i
        else:
            out[[ord(c) for c in members]] = i
    return out


_CLASS = _byte_classes()
_ENDS = np.ones(256, bool)
_ENDS[[10, 13]] = False


def _spread(words: Words, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each row: words, distinct words, equal neighbours, and the share of the most frequent word."""
    bounds = words.bounds
    n = np.diff(bounds)
    owner = np.repeat(np.arange(rows), n)
    order = np.lexsort((words.hash, owner))
    h, o = words.hash[order], owner[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])]) if len(h) else np.zeros(0, int)
    distinct = np.bincount(o[first], minlength=rows)
    top = np.zeros(rows)
    np.maximum.at(top, o[first], np.diff(np.r_[first, len(h)]))
    same = np.flatnonzero((words.hash[1:] == words.hash[:-1]) & (owner[1:] == owner[:-1]))
    return n, distinct, np.bincount(owner[same], minlength=rows), top / np.maximum(n, 1)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, features) of the texts between ``offsets``."""
    rows, base = len(offsets) - 1, int(offsets[0])
    text = data[base : int(offsets[-1])]
    size = np.diff(offsets)
    if rows == 1:  # may be long: counted in runs
        counts = sum((np.bincount(_CLASS[text[a : a + CHUNK]], minlength=len(_CLASSES)) for a in range(0, len(text), CHUNK)), np.zeros(len(_CLASSES), np.int64))[None]
    else:
        owner = np.repeat(np.arange(rows), size)
        counts = np.bincount(owner * len(_CLASSES) + _CLASS[text], minlength=rows * len(_CLASSES)).reshape(rows, -1)
    shares = counts / np.maximum(size, 1)[:, None]
    n, distinct, same, top = _spread(Words(data, offsets, NOT_SPACE), rows)
    lines, kinds, same_lines, top_line = _spread(Words(data, offsets, _ENDS), rows)
    words = np.maximum(n, 1)
    return np.column_stack([
        shares, np.sqrt(shares), np.log1p(size), np.log1p(n), size / words / 10, distinct / words, same / words, top,
        kinds / np.maximum(lines, 1), same_lines / np.maximum(lines, 1), top_line, np.log1p(size / np.maximum(lines, 1)),
        distinct / np.sqrt(words) / 10, (size == 0).astype(float),
    ])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    width: float

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.strengths(x) - self.cut) / self.width, -40, 40)))


def rank(x: np.ndarray, labels: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, steps: int = 25, seed: int = 4) -> Model | None:
    """Newton steps on the pairwise logistic loss, then the cut by quantile."""
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        return None
    r = np.random.Generator(np.random.PCG64(seed))
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.clip((x - mean) / scale, -6, 6)
    d = z[r.choice(good, pairs)] - z[r.choice(bad, pairs)]
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # probability of the wrong order
        grad = -d.T @ p / pairs + ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / pairs + (ridge + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 3 / (np.linalg.norm(step) + 1e-12))
    s = z @ w
    order = np.argsort(s, kind="stable")
    # Right labels if the lowest k strengths count as bad: choose the quantile k / n.
    right = np.concatenate([[0], np.cumsum(labels[order] == 0)]) + (labels == 1).sum() - np.concatenate([[0], np.cumsum(labels[order] == 1)])
    best = np.flatnonzero(right == right.max())
    k = int(best[len(best) // 2])
    low = s[order[k - 1]] if k else s[order[0]] - 1
    high = s[order[k]] if k < len(s) else s[order[-1]] + 1
    return Model(mean, scale, w, float((low + high) / 2), 1.0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """``docs(doc_id, text)`` and ``labels(doc_id, quality)`` -> a model of at most ``sample`` labelled rows (the smallest hashes)."""
    chosen = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by ``sample``
    columns = len(features(np.zeros(0, np.uint8), np.zeros(2, np.int64))[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in slices(offsets, 1 << 19):
                x = features(data, offsets[a : b + 1])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * columns), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), lists], names=["doc_id", "quality", "x"])

    kind = dict(rows.dtypes)
    got = rows.mapInArrow(run, f"doc_id {kind['doc_id']}, quality {kind['quality']}, x array<double>").collect()
    got.sort(key=lambda g: (g.doc_id, g.quality, g.x))
    return rank(np.array([g.x for g in got]), np.array([g.quality for g in got])) if got else None


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs(text, ...)`` -> its other columns, ``score`` and ``predicted``; columns of these two names are replaced."""
    docs = docs.drop("score", "predicted")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            keep = [i for i, f in enumerate(batch.schema) if f.name != "text"]
            data, offsets = text_buffers(batch.column(batch.schema.get_field_index("text")))
            for a, b in slices(offsets, 1 << 19):
                s = model.scores(features(data, offsets[a : b + 1])) if model else np.full(b - a, 0.5)
                fields = [*(batch.schema.field(i) for i in keep), pa.field("score", pa.float64()), pa.field("predicted", pa.int32())]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in keep), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], schema=pa.schema(fields))

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]
    return docs.mapInArrow(run, ", ".join([*kept, "score double", "predicted int"]))
