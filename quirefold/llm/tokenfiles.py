"""Token ids of whole documents in binary segments, written in ascending order of ``doc_id`` and read back.

Documents are dealt out by ranges of ``doc_id`` and of their texts' starts, so that one id on very many rows, or none,
is many ranges, and sorted within them; each task tokenizes its own and
packs them into segments of about ``SEGMENT`` ids (a longer document has one of its own) in the format of
``rangecoder``.  Segments are the rows of a Parquet table, so that any file system that Spark reaches can
hold them and a lost executor's part is written again.  A document's place among all ids is its range's
total before it, of which one number for each range reaches the driver, plus its place within the range.

Texts are cut where the tokenizer's own pattern always ends a piece (``_cuts``).  The library encodes each new chunk;
known ones are found by all their bytes, for a batch at once, as a chunk's ids do not depend on its neighbours.  Chunks
of more than ``LONGEST`` bytes, and all texts for patterns or tokenizers of another kind, are split into pieces by the
pattern instead.  ``encode_special_tokens`` holds: special strings in a text are text.

Defined cases: null and empty texts have the end id only; a null ``doc_id`` comes first and stays null;
rows that repeat an id are each written, in order of their texts; an empty table gives no segment and an
empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quirefold.llm.bpe import Splitter
from quirefold.llm.rangecoder import pack, unpack
from quirefold.llm.scratch import Scratch
from quirefold.llm.workers import claim

SEGMENT, PIECES = 1 << 22, 500_000
CHUNK = 1 << 20
#: Most bytes of a chunk that is looked up; chunks kept, at most, before all are let go; new ones in a text for the library.
LONGEST, KEPT, TOGETHER = 23, 1_200_000, 256
SLOTS, MOST_IDS = 1 << 22, 1 << 25


class _Pieces:
    """The library's tokenizer with results of pieces kept as little-endian ids."""

    def __init__(self, tokenizer, pattern: str):
        self.tokenizer, self.split, self.known = tokenizer, Splitter(pattern), {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        pieces = list(map(self.split, texts))
        if len(self.known) > PIECES:
            self.known = {}
        new = list(set(chain.from_iterable(pieces)) - self.known.keys())
        for piece, coded in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            self.known[piece] = np.array(coded.ids, "<u4").tobytes()
        find = self.known.__getitem__
        return [b"".join(map(find, p)) for p in pieces]


#: Classes of bytes: ASCII letters; the rest of ASCII; visible ASCII; sure white space; what begins a character that is surely
#: none; what begins the Latin-1 letters of two bytes, and what ends one.
_LETTER, _OTHER, _VISIBLE, _WHITE, _SOLID, _LATIN, _TAIL = (1 << k for k in range(7))
_CLASS = np.zeros(256, np.uint8)
_CLASS[:128] = _OTHER
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_CLASS[[9, 10, 13, 32]] |= _WHITE
_CLASS[0x21:0x7F] |= _VISIBLE | _SOLID
_CLASS[[*range(0xC3, 0xE1), *range(0xE4, 0xEF), *range(0xF0, 0xF5)]] |= _SOLID
_CLASS[0xC3] |= _LATIN
_CLASS[[k for k in range(0x80, 0xC0) if k not in (0x97, 0xB7)]] |= _TAIL


def _cuts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the chunks of texts begin that stand one after the other, none of them empty; ``ends``: those of the texts.

    The plain pattern ends a piece between a letter and another character, between a visible character and white space,
    after a single line feed between visible characters, and before a space with a visible character after it.  What
    stands before such a place has the same pieces without what follows, as white space at an end is one piece.
    """
    kind = _CLASS.take(data)
    word, other, white, solid = ((kind & k) != 0 for k in (_LETTER, _OTHER, _WHITE, _SOLID))
    word[1:] |= ((kind[:-1] & _LATIN) != 0) & ((kind[1:] & _TAIL) != 0)
    visible = word | ((kind & _VISIBLE) != 0)
    cut = np.zeros(len(data), bool)
    cut[1:] = word[:-1] & other[1:] | visible[:-1] & white[1:]
    cut[2:] |= visible[:-2] & (data[1:-1] == 10) & solid[2:]
    spaces = data == 32
    spaces[:-1] &= solid[1:]
    spaces[ends - 1] = False
    cut |= spaces
    cut[0] = True
    cut[ends[:-1]] = True
    return np.flatnonzero(cut)


_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class _Chunks:
    """The library's tokenizer for whole batches of texts, with the ids of chunks kept in a hash table of arrays."""

    def __init__(self, tokenizer, pattern: str):
        self.tokenizer, self.pieces = tokenizer, _Pieces(tokenizer, pattern)
        vocabulary = tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a byte-level token has a character for each byte
        for token, k in vocabulary.items():
            self.bytes_of[k] = len(token)
        self.clear()

    def clear(self) -> None:
        self.slots = np.zeros(SLOTS, np.int32)  # numbers of chunks; 0 is none
        self.size, self.used = 1, 0
        self.keys = [np.zeros(1 << 16, np.uint64) for _ in range(3)]
        self.offsets, self.counts = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.int32)

    def _room(self, chunks: int, ids: int = 0) -> None:
        if self.size + chunks > len(self.offsets):
            grow = lambda a: np.concatenate([a, np.zeros(max(len(a), chunks), a.dtype)])
            self.keys, self.offsets, self.counts = [grow(k) for k in self.keys], grow(self.offsets), grow(self.counts)
        if self.used + ids > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), ids), np.int32)])

    def _find(self, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of chunks by their bytes, and which of them are new: their first places here."""
        n, size = len(keys[0]), self.size
        self._room(n)
        for kept, key in zip(self.keys, keys):
            kept[size : size + n] = key
        mixed = keys[0] * _MIX[0] ^ keys[1] * _MIX[1] ^ keys[2] * _MIX[2]
        slot = ((mixed ^ mixed >> np.uint64(29)) * _MIX[0] >> np.uint64(64 - SLOTS.bit_length() + 1)).view(np.int64)
        number, place, todo = np.empty(n, np.int64), np.empty(n, np.int64), np.arange(n)
        while len(todo):
            found = self.slots.take(slot).astype(np.int64)
            free = np.flatnonzero(found == 0)
            if len(free):
                self.slots[slot[free]] = size + todo[free]
                found[free] = self.slots[slot[free]]
            same = np.ones(len(todo), bool)
            for kept, key in zip(self.keys, keys):
                same &= kept.take(found) == (key if len(todo) == n else key.take(todo))
            number[todo[same]], place[todo[same]] = found[same], slot[same]
            other = ~same
            todo, slot = todo[other], (slot[other] + 1) & (SLOTS - 1)
        new = np.flatnonzero(number == size + np.arange(n))
        if len(new):  # their numbers follow one another
            number[number >= size] = size + np.searchsorted(new, number[number >= size] - size)
            self.slots[place[new]] = size + np.arange(len(new))
            for kept, key in zip(self.keys, keys):
                kept[size : size + len(new)] = key[new]
        return number, new

    def _encode(self, data: bytes, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunks of ``data`` -> their ids and the numbers of ids; those that begin with a space stand in one text, as a piece ends before each."""
        kind = np.frombuffer(data + b"\0", np.uint8)
        spaced = (kind[starts] == 32) & (lengths > 1) & ((_CLASS.take(kind[starts + 1]) & _SOLID) != 0)
        order, n = np.argsort(~spaced, kind="stable"), int(spaced.sum())
        chunks = [data[a:b] for a, b in zip(starts[order].tolist(), (starts + lengths)[order].tolist())]
        texts = [b"".join(chunks[k : min(k + TOGETHER, n)]).decode() for k in range(0, n, TOGETHER)] + [c.decode() for c in chunks[n:]]
        ids = np.fromiter(chain.from_iterable([c.ids for c in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]), np.int32)
        ends, wanted = np.cumsum(self.bytes_of.take(ids)), np.cumsum(lengths[order])
        last = np.searchsorted(ends, wanted)
        if last[-1] != len(ids) - 1 or (ends[last] != wanted).any():
            raise ValueError("the tokenizer's ids do not end where its pieces end")
        counts, first = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        counts[order] = np.diff(last, prepend=-1)
        first[order] = last + 1 - counts[order]
        return ids.take(_spread(first, counts)), counts

    def __call__(self, data: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of texts in a row and how many each has -> their ids, each with the end id, and how many each has."""
        ends, out, upto, total = np.cumsum(lengths), [], np.zeros(len(lengths), np.int64), 0
        a, size, closed = 0, CHUNK, 0
        while closed < len(lengths):
            part = data[a : a + size]
            inner = ends[np.searchsorted(ends, a, side="right") : np.searchsorted(ends, a + len(part))] - a
            starts = _cuts(part, np.append(inner, len(part))) if len(part) else np.zeros(0, np.int64)
            stop = len(part)
            if a + stop < len(data):  # the last chunk may go on
                if len(starts) == 1:
                    size *= 2
                    continue
                # A part that was made longer for its first chunk gives no more than that, so that the chunks of a part are bounded.
                starts, stop = (starts[:-1], int(starts[-1])) if size == CHUNK else (starts[:1], int(starts[1]))
            closing = ends[closed : np.searchsorted(ends, a + stop, side="right")] - a
            ids, n = self._part(part[:stop].tobytes(), starts, np.diff(starts, append=stop), closing, end_id)
            out.append(ids)
            upto[closed : closed + len(closing)] = total + n
            a, size, closed, total = a + stop, CHUNK, closed + len(closing), total + len(ids)
        return np.concatenate(out) if out else np.zeros(0, np.int32), np.diff(upto, prepend=0)

    def _part(self, data: bytes, starts: np.ndarray, lengths: np.ndarray, closing: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks with the end id at the places where texts end, and how many there are up to each end."""
        if self.size > KEPT or len(self.ids) > MOST_IDS:
            self.clear()
        counts, offsets, long = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), lengths > LONGEST
        short, far = np.flatnonzero(~long), np.flatnonzero(long)
        if len(short):
            size = self.size
            numbers, new = self._find(_keys(data, starts[short], lengths[short]))
            if len(new):
                try:
                    ids, n = self._encode(data, starts[short[new]], lengths[short[new]])
                except BaseException:
                    self.clear()  # the table has numbers without ids
                    raise
                self._room(0, len(ids))
                self.ids[self.used : self.used + len(ids)] = ids
                self.counts[size : size + len(n)], self.offsets[size : size + len(n)] = n, self.used + np.cumsum(n) - n
                self.size, self.used = size + len(n), self.used + len(ids)
            counts[short], offsets[short] = self.counts.take(numbers), self.offsets.take(numbers)
        # The end id and long chunks' ids stand behind the kept ones for this part only.
        coded = self.pieces([data[a : a + n].decode() for a, n in zip(starts[far].tolist(), lengths[far].tolist())])
        extra = np.frombuffer(b"".join([np.array([end_id], "<u4").tobytes(), *coded]), "<u4").astype(np.int32)
        self._room(0, len(extra))
        self.ids[self.used : self.used + len(extra)] = extra
        counts[far] = [len(c) // 4 for c in coded]
        offsets[far] = self.used + 1 + np.cumsum(counts[far]) - counts[far]
        at = np.searchsorted(starts, closing)
        counts, offsets = np.insert(counts, at, 1), np.insert(offsets, at, self.used)
        return self.ids.take(_spread(offsets, counts)), np.cumsum(counts)[at + np.arange(len(at))]


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All places of ranges, one range after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def _keys(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """All bytes of chunks of up to ``LONGEST`` bytes and their number as three words."""
    padded = data + bytes(24)
    words = np.ndarray((len(data) + 17,), "<u8", padded, strides=(1,))  # eight bytes from every place
    keys = [words[starts + 8 * k] & _FIRST_BYTES.take(np.minimum(np.maximum(lengths - 8 * k, 0), 8)) for k in range(3)]
    keys[2] |= lengths.astype(np.uint64) << np.uint64(56)
    return keys


class _Tokenizer:
    """Columns of texts -> ids with the end id after each text, and how many each text has."""

    def __init__(self, text: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer, own = Tokenizer.from_str(text), json.loads(text)
        tokenizer.encode_special_tokens = True
        split = own.get("pre_tokenizer") or {}
        plain = Splitter(pattern).quick and not own.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
        self.chunks = _Chunks(tokenizer, pattern) if plain else None
        self.pieces = None if plain else _Pieces(tokenizer, pattern)

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        if self.pieces:
            last = np.array([end_id], "<u4").tobytes()
            coded = [c + last for c in self.pieces(texts.to_pylist())]
            return np.frombuffer(b"".join(coded), "<u4").astype(np.int32), np.array([len(c) // 4 for c in coded], np.int64)
        cut = _offsets(texts)
        data = texts.buffers()[2]
        data = np.frombuffer(data, np.uint8)[int(cut[0]) : int(cut[-1])] if data else np.zeros(0, np.uint8)
        return self.chunks(data, np.diff(cut), end_id)


def _offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def _worker(data: str, pattern: str) -> _Tokenizer:
    kept = claim("tokenfiles")
    if pattern not in kept:
        kept[pattern] = _Tokenizer(data, pattern)
    return kept[pattern]


def _writing(shared, pattern: str, end_id: int):
    schema = pa.schema([("part", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("segment", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part = _worker(shared.value, pattern), TaskContext.get().partitionId()
        before, names, coded, sizes, size = 0, [], [], [], 0

        def segment() -> pa.RecordBatch:
            nonlocal before, names, coded, sizes, size
            data = pack(names, np.concatenate(sizes), np.concatenate(coded))
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([data], pa.binary())], schema=schema)
            before, names, coded, sizes, size = before + size, [], [], [], 0
            return out

        for batch in batches:
            ids, column = batch.column(0).to_pylist(), batch.column(1)
            ends, a = _offsets(column)[1:], 0
            while a < len(ids):  # rows of about CHUNK bytes, at least one
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else ends[0]) + CHUNK)))
                found, lengths = tokenizer(column.slice(a, b - a), end_id)
                names += ids[a:b]
                coded.append(found)
                sizes.append(lengths)
                size += len(found)
                if size >= SEGMENT:
                    yield segment()
                a = b
        if names:
            yield segment()

    return run


def write(docs: DataFrame, scratch: Scratch, name: str, tokenizer_path: str, end_id: int, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Writes ``docs(doc_id, text, ...)`` and returns the table of segments: (part, before, n_ids, segment)."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.substring("text", 1, 64).alias("start"))  # ranges are drawn from starts, as texts may be long
    ordered = keyed.repartitionByRange("doc_id", "start").sortWithinPartitions("doc_id", "text").select("doc_id", "text")
    return scratch.save(ordered.mapInArrow(_writing(shared, pattern, end_id), "part int, before long, n_ids long, segment binary"), name)


def _starts(segments: DataFrame) -> dict[int, int]:
    """The ids before each range; one number for each."""
    out, total = {}, 0
    for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        out[r["part"]] = total
        total += r["n"]
    return out


def _documents(batches: Iterator[pa.RecordBatch], starts: dict[int, int]):
    for batch in batches:
        for part, before, data in zip(batch.column(0), batch.column(1), batch.column(2)):
            names, lengths, ids = unpack(data.as_py())
            start = starts[part.as_py()] + before.as_py() + np.concatenate([[0], np.cumsum(lengths)])
            yield names, start, ids


def read(segments: DataFrame) -> DataFrame:
    """A table of segments -> ``(doc_id, start, ids array<int>)``."""
    starts = _starts(segments)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, start, ids in _documents(batches, starts):
            lists = pa.ListArray.from_arrays(pa.array((start - start[0]).astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(start[:-1]), lists], names=["doc_id", "start", "ids"])

    return segments.select("part", "before", "segment").mapInArrow(run, "doc_id long, start long, ids array<int>")


def digests(segments: DataFrame) -> DataFrame:
    """A table of segments -> ``(doc_id, start, n_tokens, ids_crc32)`` of the ids read from it."""
    starts = _starts(segments)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, start, ids in _documents(batches, starts):
            data, cut = memoryview(ids.astype("<u4").tobytes()), (start - start[0]) * 4
            crcs = [zlib.crc32(data[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(start[:-1]), pa.array(np.diff(start)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.select("part", "before", "segment").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
