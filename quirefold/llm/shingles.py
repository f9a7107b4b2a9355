"""Vectorised hashing of words and word shingles over whole texts (numpy, 64 bits)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK = 1 << 20
_R = U(0x9E3779B97F4A7C15 | 1)
_RINV = U(pow(int(_R), -1, 1 << 64))
_SALTS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                   0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(kind: str, n: int) -> np.ndarray:
    if kind not in _powers or len(_powers[kind]) < n:
        x = np.full(max(n, 1 << 16), _R if kind == "up" else _RINV, dtype=np.uint64)
        x[0] = 1
        _powers[kind] = np.cumprod(x, dtype=np.uint64)
    return _powers[kind]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (one more than rows) of a string array; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def slices(offsets: np.ndarray, most: int):
    """Row ranges whose texts hold about ``most`` bytes; a longer text is a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = b


class Words:
    """Word hashes of the rows a..b: ``hash``, and ``bounds`` with the first word of each row."""

    __slots__ = ("hash", "bounds", "start", "end")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
        """``is_word``: for each of 256 bytes (A-Z count as a-z already) whether it belongs to a word."""
        base = int(offsets[0])
        text = data[base : int(offsets[-1])]
        text = np.where((text >= 65) & (text <= 90), text + np.uint8(32), text)
        inside = is_word[text]
        before = np.empty_like(inside)
        n = len(text)
        if n:
            before[0] = False
            before[1:] = inside[:-1]
            at = (offsets[:-1] - base)[(offsets[:-1] - base) < n]
            before[at] = False
        start = np.flatnonzero(inside & ~before)
        if n:
            after = np.empty_like(inside)
            after[-1] = False
            after[:-1] = inside[1:] & before[1:]
        end = np.flatnonzero(inside & ~after) + 1 if n else start
        # Runs of words of about CHUNK bytes: the wide arrays stay small however long a text is.
        self.hash, i = np.empty(len(start), dtype=np.uint64), 0
        while i < len(start):
            low = start[i]
            j = max(i + 1, int(np.searchsorted(end, low + CHUNK, side="right")))
            own = text[low : end[j - 1]]
            total = np.zeros(len(own) + 1, dtype=np.uint64)
            np.cumsum((own.astype(np.uint64) + U(1)) * _power("up", len(own))[: len(own)], out=total[1:])
            h = (total[end[i:j] - low] - total[start[i:j] - low]) * _power("down", len(own))[start[i:j] - low]
            self.hash[i:j] = mix(h + (end[i:j] - start[i:j]).astype(np.uint64) * _SALTS[7])
            i = j
        self.bounds = np.searchsorted(start, offsets - base)
        self.start, self.end = start, end


def byte_table(*ranges: tuple[int, int], inside: bool) -> np.ndarray:
    out = np.full(256, not inside)
    for a, b in ranges:
        out[a : b + 1] = inside
    return out


#: Words are whatever stands between ASCII white space.
NOT_SPACE = byte_table((0x20, 0x20), (0x09, 0x0D), inside=False)


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each row's k-word shingles; fewer words make one shingle, none an empty set."""
    h, bounds = words.hash, words.bounds
    rolled = np.zeros(max(0, len(h) - k + 1), dtype=np.uint64)
    for j in range(k):
        rolled += h[j : j + len(rolled)] * _SALTS[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            own = h[a:b] * _SALTS[: b - a]
            out.append(mix(own.sum(dtype=np.uint64, keepdims=True) + np.array([b - a], np.uint64) * _SALTS[6]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
