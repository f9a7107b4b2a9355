"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

A text's bytes are cut into windows of ``WINDOW`` bytes, every byte in one of them; a GRU runs over
each window in both directions, a softmax labels every position, and a document's probabilities are
the means over its positions.  Training is backpropagation through time with Adam on windows of a
bounded sample: at most ``per_language`` rows of each learned language (the smallest hashes of
``doc_id``) and ``WINDOWS_A_TEXT`` windows of each; a text shorter than a window is one of its own length, and
nothing is read or learned beyond its end.  Prediction covers every byte of every text.

A softmax over learned languages says nothing about others, so ``fit`` also measures what it would take
for foreign: the mean log-probability of a text's letter pairs under its predicted language, with a bound
between held-out rows of that language and what stands for foreign text: rows of the other languages and
rows in random order.  At least 99 of 100 held-out windows lie above the bound.

Defined cases: a null text or one without a letter gives ``und`` with score 0 and trains nothing; with no
training rows at all every text gives ``und``; any labelled text with a letter trains, however short; rows that repeat are judged alike; an empty table gives an empty
result; ``lang``, ``source`` and ``doc_id`` are never inputs of a prediction; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from quirefold.llm.scratch import small_batches
from quirefold.llm.shingles import slices, text_buffers
from quirefold.llm.workers import claim

WINDOW, HIDDEN = 64, 8
WINDOWS_A_TEXT, PER_LANGUAGE, MOST_LANGUAGES = 6, 400, 200
STEPS, BATCH, RATE = 220, 192, 0.02
#: Pairs: weight of unseen ones, windows that a bound is measured on at least, spreads below the mean that count as far (one in a hundred), and bytes at once.
PRIOR, LEAST_HELD, FAR, PAIRS_AT_ONCE = 0.02, 20, 2.33, 1 << 20
#: Bytes by class: ASCII other than letters becomes a space.
_FOLDED = np.array([b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)], np.uint8)
_LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Model:
    """``languages`` and, for each direction, input rows (256, 3H), recurrent weights (H, 3H); then the labels' weights."""

    languages: tuple[str, ...]
    inputs: tuple[np.ndarray, np.ndarray]
    recurrent: tuple[np.ndarray, np.ndarray]
    out: np.ndarray
    bias: np.ndarray
    pairs: Pairs | None = None


@dataclass(frozen=True)
class Pairs:
    """Log-probabilities (languages, 65536) of a byte after another in lower case; for each language the bound, and mean and spread of windows."""

    logs: np.ndarray
    bound: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def foreign(self, language: int, mean: float, n: int) -> bool:
        """Whether ``n`` pairs of this mean are foreign; fewer pairs than a window has are given the wider spread of their mean."""
        if not n:
            return False
        return mean < min(self.bound[language], self.mean[language] - FAR * self.spread[language] * max(1.0, np.sqrt(WINDOW / n)))


def _gru(x: np.ndarray, w: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (T, N, H) of a GRU over bytes ``x`` (T, N); ``keep`` gets what backpropagation needs."""
    t_len, n = x.shape
    hid = u.shape[0]
    gates = [np.ascontiguousarray(w[:, k * hid : (k + 1) * hid]) for k in range(3)]
    weights = [np.ascontiguousarray(u[:, k * hid : (k + 1) * hid]) for k in range(3)]
    states = np.empty((t_len, n, hid), np.float32)
    h = np.zeros((n, hid), np.float32)
    z, r, c, s = (np.empty((n, hid), np.float32) for _ in range(4))
    for t in range(t_len):
        b = x[t]
        for gate, k in ((z, 0), (r, 1)):
            # sigmoid by tanh: the halving is folded into both weights by the caller
            np.matmul(h, weights[k], out=gate)
            gate += gates[k].take(b, axis=0)
            np.tanh(gate, out=gate)
            gate += 1
            gate *= 0.5
        np.multiply(r, h, out=s)
        np.matmul(s, weights[2], out=c)
        c += gates[2].take(b, axis=0)
        np.tanh(c, out=c)
        if keep is not None:
            keep.append((h.copy(), z.copy(), r.copy(), c.copy()))
        np.subtract(h, c, out=s)
        s *= z
        np.add(c, s, out=states[t])
        h = states[t]
    return states


def _gru_back(x, w, u, kept, grad):
    """Gradients of the input rows and recurrent weights from those of the states (T, N, H)."""
    hid = u.shape[0]
    gw, gu = np.zeros_like(w), np.zeros_like(u)
    dh = np.zeros_like(grad[0])
    for t in range(len(kept) - 1, -1, -1):
        h, z, r, c = kept[t]
        dh = dh + grad[t]
        dc = dh * (1 - z) * (1 - c * c)
        dz = dh * (h - c) * z * (1 - z) * 2  # the halved pre-activation: d sigmoid(2a)/da
        drh = dc @ u[:, 2 * hid :].T
        dr = drh * h * r * (1 - r) * 2
        d = np.concatenate([dz, dr, dc], axis=1)
        gu[:, :hid] += h.T @ dz
        gu[:, hid : 2 * hid] += h.T @ dr
        gu[:, 2 * hid :] += (r * h).T @ dc
        order = np.argsort(x[t], kind="stable")
        rows, at = np.unique(x[t][order], return_index=True)
        gw[rows] += np.add.reduceat(d[order], at, axis=0)
        dh = dh * z + drh * r + dz @ u[:, :hid].T + dr @ u[:, hid : 2 * hid].T
    return gw, gu


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def _turned(lengths: np.ndarray, t_len: int) -> np.ndarray:
    """(T, N) places that turn the first ``lengths`` bytes of each window about and leave the rest; its own inverse."""
    t = np.arange(t_len)[:, None]
    return np.where(t < lengths, lengths - 1 - t, t)


def train(windows: np.ndarray, labels: np.ndarray, languages: tuple[str, ...], steps: int = STEPS, seed: int = 7, lengths: np.ndarray | None = None) -> Model:
    """``windows`` (N, WINDOW) bytes with a label each -> the model after ``steps`` Adam steps; only the first ``lengths`` bytes of a window count."""
    lengths = np.full(len(windows), windows.shape[1]) if lengths is None else lengths
    r = np.random.Generator(np.random.PCG64(seed))
    hid, k = HIDDEN, len(languages)
    parts = [r.normal(0, 0.3, (256, 3 * hid)), r.normal(0, 0.3, (256, 3 * hid)), r.normal(0, 0.25, (hid, 3 * hid)), r.normal(0, 0.25, (hid, 3 * hid)), r.normal(0, 0.3, (2 * hid, k)), np.zeros(k)]
    parts = [p.astype(np.float32) for p in parts]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    members = [np.flatnonzero(labels == i) for i in range(k)]
    for step in range(1, steps + 1):
        at = np.concatenate([r.choice(m, size=max(1, BATCH // k)) for m in members])
        x, y, turn = np.ascontiguousarray(windows[at].T), labels[at], _turned(lengths[at], windows.shape[1])
        back = np.take_along_axis(x, turn, axis=0)
        kf, kb = [], []
        turn = turn[:, :, None]
        both = np.concatenate([_gru(x, parts[0], parts[2], kf), np.take_along_axis(_gru(back, parts[1], parts[3], kb), turn, axis=0)], axis=2)
        p = _softmax(both @ parts[4] + parts[5])
        p[:, np.arange(len(y)), y] -= 1
        inside = np.arange(p.shape[0])[:, None] < lengths[at]
        p *= (inside / inside.sum()).astype(np.float32)[:, :, None]
        flat = both.reshape(-1, 2 * hid)
        g_out, g_bias = flat.T @ p.reshape(-1, k), p.reshape(-1, k).sum(axis=0)
        d = p @ parts[4].T
        gw0, gu0 = _gru_back(x, parts[0], parts[2], kf, d[:, :, :hid])
        gw1, gu1 = _gru_back(back, parts[1], parts[3], kb, np.take_along_axis(d[:, :, hid:], turn, axis=0))
        grads = [gw0, gw1, gu0, gu1, g_out, g_bias]
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * min(1.0, 2.0 * (1 - (step - 1) / steps))
        for i, g in enumerate(grads):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            parts[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    return Model(languages, (parts[0], parts[1]), (parts[2], parts[3]), parts[4], parts[5])


def position_probabilities(model: Model, windows: np.ndarray) -> np.ndarray:
    """(T, N, languages) for windows (N, T) of bytes."""
    x = np.ascontiguousarray(windows.T)
    fore = _gru(x, model.inputs[0], model.recurrent[0])
    back = _gru(np.ascontiguousarray(x[::-1]), model.inputs[1], model.recurrent[1])[::-1]
    p = fore @ model.out[:HIDDEN]
    p += back @ model.out[HIDDEN:]
    p += model.bias
    np.exp(np.clip(p, -30, 30, out=p), out=p)
    p /= p.sum(axis=2, keepdims=True)
    return p


def document_probabilities(model: Model, data: np.ndarray, offsets: np.ndarray, batch: int = 2048) -> np.ndarray:
    """Mean probabilities over all positions of each text (offsets into ``data``)."""
    lengths = np.diff(offsets)
    counts = -(-lengths // WINDOW)
    first = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(len(lengths)), counts)
    start = offsets[:-1][owner] + (np.arange(len(owner)) - first[:-1][owner]) * WINDOW
    size = np.minimum(offsets[1:][owner] - start, WINDOW)
    total = np.zeros((len(lengths), len(model.languages)))
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    # Short ends of texts run in batches of their own length, so that no padding is ever read as text.
    order = np.argsort(-size, kind="stable")
    full = int((size == WINDOW).sum())
    groups = [order[a : min(a + batch, full)] for a in range(0, full, batch)]
    rest = order[full:]
    cuts = np.flatnonzero(np.diff(size[rest])) + 1 if len(rest) else []
    for part in [*groups, *np.split(rest, cuts)]:
        if len(part):
            t = int(size[part[0]])
            windows = padded[start[part][:, None] + np.arange(t)]
            np.add.at(total, owner[part], position_probabilities(model, windows).sum(axis=0))
    return total / np.maximum(lengths, 1)[:, None]


def _pairs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of neighbouring bytes with a letter, and their numbers; ASCII other than letters is one class."""
    folded = _FOLDED[data]
    pairs = (folded[:-1].astype(np.int32) << 8) | folded[1:]
    at = np.flatnonzero(pairs != 0x2020)
    return at, pairs[at]


def text_means(logs: np.ndarray, data: np.ndarray, offsets: np.ndarray, language: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text (offsets into ``data``) the mean over its pairs under its language, and their number; no pair crosses texts."""
    means, counts = np.zeros(len(language)), np.zeros(len(language), np.int64)
    for i, k in enumerate(language):
        total = 0.0
        for low in range(offsets[i], offsets[i + 1], PAIRS_AT_ONCE):
            at, pairs = _pairs(data[low : min(low + PAIRS_AT_ONCE + 1, offsets[i + 1])])
            total += float(logs[k].take(pairs).sum(dtype=np.float64))
            counts[i] += len(pairs)
        means[i] = total / max(1, counts[i])
    return means, counts


def _lowered(window: np.ndarray) -> np.ndarray:
    return np.frombuffer(window.tobytes().decode("utf-8", "ignore").lower().encode(), np.uint8)


def _log_table(windows: list[np.ndarray]) -> np.ndarray:
    counts = np.full((256, 256), PRIOR)
    for w in windows:
        np.add.at(counts.reshape(-1), _pairs(w)[1], 1)
    return np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32).reshape(-1)


def fit_pairs(windows: Sequence[np.ndarray], labels: np.ndarray, owners: np.ndarray, k: int, seed: int = 7) -> Pairs:
    """Tables of all windows; bounds from tables of every other text's windows on those of the texts between."""
    r = np.random.Generator(np.random.PCG64(seed))
    lowered = [_lowered(w) for w in windows]
    half = owners % 2 == 0

    def own(which: np.ndarray) -> list[np.ndarray]:
        return [_log_table([lowered[i] for i in np.flatnonzero(which & (labels == c))]) for c in range(k)]

    def means(logs: np.ndarray, which: list[np.ndarray]) -> np.ndarray:
        made = [_pairs(w)[1] for w in which]
        return np.array([logs.take(p).mean() for p in made if len(p) >= WINDOW // 2])

    tables = own(half)
    bound, mean, spread = np.full(k, -np.inf), np.zeros(k), np.zeros(k)
    for c in range(k):
        held = [lowered[i] for i in np.flatnonzero(~half & (labels == c))]
        known = means(tables[c], held)
        if len(known) < LEAST_HELD:
            continue  # too few rows to measure: nothing of this language is foreign
        mixed = means(tables[c], [r.permutation(w) for w in held])
        others = [means(tables[c], [lowered[i] for i in np.flatnonzero(~half & (labels == o))]) for o in range(k) if o != c]
        strange = max((float(np.quantile(x, 0.99)) for x in [mixed, *others] if len(x)), default=-np.inf)
        low = float(np.quantile(known, 0.01))
        bound[c], mean[c], spread[c] = min(low, (low + strange) / 2), known.mean(), known.std()
    return Pairs(np.stack(own(np.ones(len(labels), bool))), bound, mean, spread)


def _has_letter(text: str) -> bool:
    found = _LETTER.search(text)
    return found is not None and (found[0].isalpha() or any(map(str.isalpha, text)))


def _sample(docs: DataFrame, per_language: int, most: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, tuple[str, ...]]:
    """Training windows of a bounded sample: the smallest hashes of each language; their labels, and numbers of their texts.

    Ids are ranked without their texts, and of a large language only about twice as many ids as are wanted.
    """
    usable = docs.where("lang is not null and text is not null").where(F.rlike("text", F.lit(r"\p{L}")))
    counts = usable.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("ids")).orderBy("lang").limit(most + 1).collect()
    if len(counts) > most:
        raise ValueError(f"more than {most} languages in the training rows")
    if not counts:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64), ()
    most_hash = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], int(min(1.0, (2.0 * per_language + 50) / max(1, r["ids"])) * (1 << 40)))))
    low = usable.select("lang", "doc_id").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) <= F.element_at(most_hash, F.col("lang")))
    order = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), "doc_id")
    chosen = low.distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language).select(F.col("lang").alias("__lang"), F.col("doc_id").alias("__id"))
    picked = usable.join(F.broadcast(chosen), (F.col("lang") == F.col("__lang")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")  # at most per_language * most rows
    picked = picked.groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    size, raw = F.octet_length("text"), F.to_binary("text", F.lit("utf-8"))
    middles = [F.floor(size * (2 * i + 1) / (2 * WINDOWS_A_TEXT) - WINDOW / 2).cast("int") for i in range(WINDOWS_A_TEXT)]
    starts = F.array_distinct(F.array(*(F.greatest(F.lit(0), F.least(m, size - WINDOW)) for m in middles)))
    rows = picked.select("lang", "doc_id", "text", F.explode(starts).alias("start")).select("lang", "doc_id", F.substring(raw, F.col("start") + 1, F.lit(WINDOW)).alias("w"))
    got = rows.collect()
    got.sort(key=lambda r: (r.lang, r.doc_id is not None, r.doc_id or 0, bytes(r.w)))
    names = sorted({r.lang for r in got})
    place = {name: i for i, name in enumerate(names)}
    texts = {key: i for i, key in enumerate(dict.fromkeys((r.lang, r.doc_id) for r in got))}
    owners = np.array([texts[r.lang, r.doc_id] for r in got], dtype=np.int64)
    return [np.frombuffer(bytes(r.w), np.uint8) for r in got], np.array([place[r.lang] for r in got], dtype=np.int64), owners, tuple(names)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, most_languages: int = MOST_LANGUAGES) -> Model | None:
    """``docs(doc_id, text, lang, ...)`` -> a model of the languages in it, None without training rows.

    At most ``per_language`` rows of a language reach the driver, ``WINDOWS_A_TEXT`` windows of each.
    """
    windows, labels, owners, names = _sample(docs, per_language, most_languages)
    if not windows:
        return None
    lengths = np.array([len(w) for w in windows])
    filled = np.zeros((len(windows), WINDOW), np.uint8)
    for row, w in zip(filled, windows):
        row[: len(w)] = w
    return replace(train(filled, labels, names, lengths=lengths), pairs=fit_pairs(windows, labels, owners, len(names)))


def _predicting(shared, keep_text: bool, open_set: bool):
    schema = pa.schema([("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("language")
        model: Model | None = shared.value
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            data, offsets = text_buffers(text)
            names, scores = [], []
            for a, b in slices(offsets, 1 << 18):
                own = offsets[a : b + 1]
                p = document_probabilities(model, data[own[0] : own[-1]], own - own[0]) if model else None
                if open_set and p is not None:
                    means, pairs = text_means(model.pairs.logs, *text_buffers(pc.utf8_lower(text.slice(a, b - a))), p.argmax(axis=1))
                for i, t in enumerate(text[a:b].to_pylist()):
                    if p is None or not t or not _has_letter(t) or open_set and model.pairs.foreign(int(p[i].argmax()), means[i], int(pairs[i])):
                        names.append("und")
                        scores.append(0.0)
                    else:
                        k = int(p[i].argmax())
                        names.append(model.languages[k])
                        scores.append(float(min(1.0, p[i][k])))
            columns = [batch.column(i) for i, f in enumerate(batch.schema) if keep_text or f.name != "text"]
            fields = [f for f in batch.schema if keep_text or f.name != "text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema=pa.schema([*fields, *schema]))

    return run


def predict(docs: DataFrame, model: Model | None, keep_text: bool = False, open_set: bool = False) -> DataFrame:
    """``docs(text, ...)`` -> its other columns (``text`` too if asked for) with ``lang_pred`` and ``score`` (the mean position probability).

    With ``open_set`` texts foreign to their best language are ``und`` with score 0.  Columns of these two names are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if keep_text or f.name != "text")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_predicting(shared, keep_text, open_set), f"{rest}{', ' * bool(rest)}lang_pred string, score double")
