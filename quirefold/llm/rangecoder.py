"""Token ids as compressed segments: an adaptive context-mixing range coder over independent blocks.

A segment holds whole documents: a header with their ids and lengths, the ids that occur with their frequencies,
then the ids of all documents in blocks of ``BLOCK``.  Blocks are coded independently, each with a model of its own
that starts empty, and have a CRC-32 each; so all blocks of a segment run in lockstep as lanes of numpy arrays.

The model predicts whole ids, which it knows by symbols: their places among the segment's ids.  Order 2 and order 1
name the symbol that followed the same two or one symbols before in the block, each with a confidence; order 2 goes
before order 1.  A binary decision says whether the name is right.  It mixes two adaptive estimates, one by the
confidences and one by the place in the block and the decisions before, in the logistic domain, with weights that every
block learns by gradient steps.  Where the name is wrong, order 0 codes the symbol by its frequency in the segment.
A 64-bit range coder turns all of this into 32-bit digits; carries are resolved at the end of a block.

All lanes take every step, with a part for a right and one for a wrong name, as numpy picks lanes out at a higher cost
than it computes both; what the two orders and the two estimates have in common is one array of two rows.

All arithmetic is in integers, so that files can be read on any machine.  Ids are below ``MOST_ID``.

Layout, little-endian: magic, version, block size, bits of the frequencies' sum, numbers of documents, ids, blocks and
symbols, bytes of the symbols (uint32 each but uint64 for the ids), CRC-32 of all that stands before the blocks
without itself (uint32); document ids (int64) and whether they are null (uint8); document lengths (int64); for each
block its bytes (uint32) and the CRC-32 of its ids and bytes (uint32); the symbols' ids and frequencies (uint32 by
planes of bytes, deflated); the blocks.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

MAGIC, VERSION, BLOCK = 0x51464C44, 3, 1024
_HEAD, _CRC = struct.Struct("<IIIIIQIII"), struct.Struct("<I")
MOST_ID = 1 << 28
DENSE = 1 << 22  # ids below are numbered by a table, others by sorting
LEAST_BITS, SPARE_BITS, TABLE_BITS = 16, 2, 24  # of the frequencies' sum: at least, above the symbols' own, at most for a table of all parts


class CorruptBlock(ValueError):
    """A block whose ids do not have the CRC-32 written with it, or a segment cut short."""


class Frequencies:
    """Order 0: the parts of ``1 << bits`` that each symbol has, 1 at least."""

    def __init__(self, parts: np.ndarray, bits: int):
        self.bits, self.parts = np.uint64(bits), parts.astype(np.uint64)
        self.before = np.cumsum(self.parts, dtype=np.uint64) - self.parts
        self.most = 4096 - max(64, 1 << max(0, bits - 19))  # chances above would leave too little to order 0
        self.table = None  # made when a decoder asks for it

    @classmethod
    def of(cls, counts: np.ndarray) -> Frequencies:
        bits = max(LEAST_BITS, len(counts).bit_length() + 1, min(TABLE_BITS, len(counts).bit_length() + SPARE_BITS))
        parts = 1 + counts * ((1 << bits) - len(counts)) // counts.sum()
        parts[parts.argmax()] += (1 << bits) - parts.sum()
        return cls(parts, bits)

    def symbol_at(self, part: np.ndarray) -> np.ndarray:
        """The symbols that have these parts; a part beyond all is the last symbol's."""
        if self.bits > TABLE_BITS:
            return np.searchsorted(self.before, part, side="right") - 1
        if self.table is None:
            self.table = np.repeat(np.arange(len(self.parts), dtype=np.int32), self.parts.astype(np.int64))
        return self.table.take(np.minimum(part, np.uint64(len(self.table) - 1)).view(np.int64))


#: Without frequencies: ids below 1 << LEAST_BITS are their own symbols, all alike.
_ALIKE = Frequencies(np.ones(1 << LEAST_BITS, np.int64), LEAST_BITS)


#: Probabilities of 12 bits by 256 times their log odds.
_SQUASH = np.array([max(1, min(4095, int(4096 / (1 + math.exp(-x / 256)) + 0.5))) for x in range(-2047, 2048)], np.int32)
#: An estimate's state is how often the name was wrong and right, up to 31 each; its log odds.
_ODDS = np.array([max(-2047, min(2047, round(256 * math.log((yes + 0.4) / (no + 0.4))))) for no in range(32) for yes in range(32)], np.int32)


def _next_states() -> np.ndarray:
    """By outcome and state the state after: a full count stays and the other one shrinks."""
    no, yes = np.divmod(np.arange(1024), 32)
    wrong = np.where(no < 31, (no + 1) << 5 | yes, no << 5 | (yes - (yes + 16) // 32))
    right = np.where(yes < 31, no << 5 | yes + 1, (no - (no + 16) // 32) << 5 | yes)
    return np.concatenate([wrong, right]).astype(np.int16)


_NEXT = _next_states()
WEIGHT, MOST_WEIGHT, RATE = 26_000, 3 << 16, 5
_K1, _K2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


#: States to start with by the higher confidence of the two orders.
_START = (12 << 5, 3 << 5 | 1, 2 << 5 | 2, 1 << 5 | 3)


def _first_states() -> np.ndarray:
    """(2, 32): the states that contexts start with, by confidences of order 2 and order 1 and whether they agree, and by time and last decisions."""
    own = np.zeros((2, 32), np.int16)
    for second in range(4):
        for first in range(4):
            for agree in range(2):
                own[0, second << 3 | first << 1 | agree] = _START[max(second, first)]
    own[1] = _START[1]
    return own


class _Model:
    """The models of n blocks in lockstep."""

    def __init__(self, n: int, most: int):
        self.squash = np.minimum(_SQUASH, most)
        lane = np.arange(n, dtype=np.int64)
        self.base = np.stack([lane << 10, (lane + n) << 10])
        self.table = np.zeros(n << 11, np.int32)  # a symbol and 2 bits of confidence; 0 if none
        self.hash = np.zeros((2, n), np.uint32)
        self.own = np.stack([lane << 5, (lane + n) << 5])
        self.states = np.repeat(_first_states(), n, axis=0).reshape(-1)
        self.weights = np.full((2, n), WEIGHT, np.int32)
        self.lately = np.zeros(n, np.int64)
        self.context = np.empty((2, n), np.int64)

    def predict(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each lane the symbol named and the chance of 4096 that it is right."""
        self.at = self.base + (self.hash >> 22)
        self.entry = self.table.take(self.at)
        self.trust, self.named = self.entry & 3, self.entry >> 2
        one, two = self.named
        best = np.where(self.entry[1] > 0, two, one)
        np.add((self.trust[1] << 3) + (self.trust[0] << 1), one == two, out=self.context[0])
        np.add(self.lately, min(t >> 7, 7) << 2, out=self.context[1])
        self.context += self.own
        self.state = self.states.take(self.context)
        self.odds = _ODDS.take(self.state)
        mixed = self.weights * self.odds
        total = (mixed[0] + mixed[1]) >> 16
        self.chance = self.squash.take(np.minimum(np.maximum(total, -2047), 2047) + 2047)
        return best, self.chance

    def learn(self, symbol: np.ndarray, hit: np.ndarray) -> None:
        goal = hit.astype(np.int32)
        miss = ((goal << 12) - self.chance) * RATE
        self.weights += (self.odds * miss + 2048) >> 12
        np.minimum(np.maximum(self.weights, -MOST_WEIGHT, out=self.weights), MOST_WEIGHT, out=self.weights)
        self.states[self.context] = _NEXT.take((goal << 10) + self.state)
        self.lately = (self.lately << 1 & 2) + goal
        other = np.where(self.trust > 1, self.entry - 1, (symbol << 2) + 1)
        self.table[self.at] = np.where(self.named == symbol, self.entry + (self.trust < 3), other)
        latest = (symbol.astype(np.uint32) + np.uint32(1)) * _K1
        self.hash[1] = latest + self.hash[0] * _K2
        self.hash[0] = latest


_HALF, _LOW_HALF, _LEAST_RANGE = np.uint64(32), np.uint64(0xFFFFFFFF), np.uint64(1 << 32)
_BIT = np.uint64(12)  # bits of a decision's interval
_ZERO = np.uint64(0)


class _Writer:
    """Range coders of n lanes; what is carried over is added to the digit before, and passed on at the end."""

    def __init__(self, n: int, most: int):
        self.low, self.range = np.zeros(n, np.uint64), np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.digits = np.zeros((n, most), np.uint64)
        self.flat, self.first = self.digits.reshape(-1), np.arange(n, dtype=np.int64) * most
        self.place = self.first.copy()

    def put(self, chance: np.ndarray, hit: np.ndarray, before: np.ndarray, parts: np.ndarray, bits: np.uint64) -> None:
        start = (self.range >> _BIT) * chance
        part = (self.range - start) >> bits
        low = self.low + np.where(hit, _ZERO, start + part * before)
        span = np.where(hit, start, part * parts)
        carried = np.flatnonzero(low < self.low)
        if len(carried):
            self.flat[self.place[carried] - 1] += np.uint64(1)
        small = np.flatnonzero(span < _LEAST_RANGE)
        if len(small):
            at, digit = self.place[small], low[small]
            self.flat[at] = digit >> _HALF
            self.place[small] = at + 1
            low[small] = digit << _HALF
            span[small] <<= _HALF
        self.low, self.range = low, span

    def end(self) -> list[bytes]:
        for digit in (self.low >> _HALF, self.low & _LOW_HALF):
            self.flat[self.place] = digit
            self.place += 1
        used = self.place - self.first
        for k in range(int(used.max()) - 1, 0, -1):
            self.digits[:, k - 1] += self.digits[:, k] >> _HALF
        short = (self.digits & _LOW_HALF).astype("<u4")
        return [short[i, :k].tobytes() for i, k in enumerate(used.tolist())]


class _Reader:
    def __init__(self, blocks: list[bytes]):
        width = max(map(len, blocks)) // 4 + 2
        digits = np.zeros((len(blocks), width), np.uint64)
        for i, b in enumerate(blocks):
            digits[i, : len(b) // 4] = np.frombuffer(b, "<u4", len(b) // 4)
        self.flat = digits.reshape(-1)
        self.code = digits[:, 0] << _HALF | digits[:, 1]
        self.range = np.full(len(blocks), 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.place = np.arange(len(blocks), dtype=np.int64) * width + 2
        self.last = self.place + (width - 3)

    def get(self, chance: np.ndarray, order0: Frequencies) -> tuple[np.ndarray, np.ndarray]:
        """Whether the name is right, and the symbol where it is not."""
        start = (self.range >> _BIT) * chance
        hit = self.code < start
        part = (self.range - start) >> order0.bits
        code = self.code - start
        symbol = order0.symbol_at(code // part)
        code = np.where(hit, self.code, code - part * order0.before.take(symbol))
        span = np.where(hit, start, part * order0.parts.take(symbol))
        small = np.flatnonzero(span < _LEAST_RANGE)
        if len(small):
            at = self.place[small]
            code[small] = code[small] << _HALF | self.flat[np.minimum(at, self.last[small])]
            self.place[small] = at + 1
            span[small] <<= _HALF
        self.code, self.range = code, span
        return hit, symbol


def slots_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(blocks, length) ids -> their numbers in order of first appearance in the block, and whether they are new there."""
    n, length = ids.shape
    order = np.argsort(ids, axis=1, kind="stable")
    ranked = np.take_along_axis(ids, order, axis=1)
    starts = np.ones((n, length), bool)
    starts[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
    run = np.maximum.accumulate(np.where(starts, np.arange(length), 0), axis=1)
    first = np.empty((n, length), np.int64)
    np.put_along_axis(first, order, np.take_along_axis(order, run, axis=1), axis=1)
    new = first == np.arange(length)
    return np.take_along_axis(np.cumsum(new, axis=1) - 1, first, axis=1), new


def encode_blocks(symbols: np.ndarray, order0: Frequencies = _ALIKE) -> list[bytes]:
    """(blocks, length) symbols -> the bytes of each block."""
    n, length = symbols.shape
    if symbols.size and not 0 <= int(symbols.min()) <= int(symbols.max()) < len(order0.parts):
        raise ValueError(f"symbols must be from 0 to {len(order0.parts) - 1}")
    columns = np.ascontiguousarray(symbols.T.astype(np.int32))
    model, out = _Model(n, order0.most), _Writer(n, length + 4)
    for t, symbol in enumerate(columns):
        named, chance = model.predict(t)
        hit = named == symbol
        out.put(chance.astype(np.uint64), hit, order0.before.take(symbol), order0.parts.take(symbol), order0.bits)
        model.learn(symbol, hit)
    return out.end()


def decode_blocks(blocks: list[bytes], length: int, order0: Frequencies = _ALIKE) -> np.ndarray:
    """The bytes of blocks of ``length`` symbols each -> (blocks, length) symbols."""
    n = len(blocks)
    model, source, columns = _Model(n, order0.most), _Reader(blocks), np.empty((length, n), np.int32)
    for t in range(length):
        named, chance = model.predict(t)
        hit, symbol = source.get(chance.astype(np.uint64), order0)
        columns[t] = np.where(hit, named, symbol)
        model.learn(columns[t], hit)
    return columns.T


def _check(ids: np.ndarray, block: bytes) -> int:
    return zlib.crc32(block, zlib.crc32(ids.astype("<u4").tobytes()))


def _numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids -> the ids that occur, and of each its place there."""
    if int(ids.max()) < DENSE:
        found = np.flatnonzero(np.bincount(ids))
        place = np.zeros(int(found[-1]) + 1, np.int32)
        place[found] = np.arange(len(found))
        return found, place.take(ids)
    slots, new = slots_of(ids[None])
    return ids[new[0]], slots[0]


def _planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u4").view("u1").reshape(-1, 4).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, "u1").reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment; ``ids`` are those of all documents in order, each below ``MOST_ID``."""
    if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >= MOST_ID):
        raise ValueError(f"ids must be from 0 to {MOST_ID - 1}")
    n = -(-len(ids) // BLOCK)
    table, blocks, crcs, found, bits = b"", [], [], [], LEAST_BITS
    if n:
        padded = np.zeros((n, BLOCK), np.int32)
        padded.reshape(-1)[: len(ids)] = ids
        found, symbols = _numbered(padded.reshape(-1))
        order0 = Frequencies.of(np.bincount(symbols))
        bits = int(order0.bits)
        table = zlib.compress(_planes(found) + _planes(order0.parts), 9)
        blocks = encode_blocks(symbols.reshape(n, BLOCK), order0)
        crcs = [_check(row, b) for row, b in zip(padded, blocks)]
    head = _HEAD.pack(MAGIC, VERSION, BLOCK, bits, len(doc_ids), len(ids), n, len(found), len(table))
    rest = b"".join([
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(), np.asarray(lengths, "<i8").tobytes(),
        np.array([(len(b), c) for b, c in zip(blocks, crcs)], "<u4").tobytes(), table,
    ])
    return b"".join([head, _CRC.pack(zlib.crc32(rest, zlib.crc32(head))), rest, *blocks])


def unpack(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """A segment -> document ids, lengths and all ids; raises ``CorruptBlock`` where a check fails."""
    try:
        magic, version, block, bits, docs, total, n, most, deflated = _HEAD.unpack_from(data)
        at = _HEAD.size + _CRC.size
        end = at + 17 * docs + 8 * n + deflated
        if (magic, version, block) != (MAGIC, VERSION, BLOCK):
            raise CorruptBlock("not a segment of this version")
        if end > len(data) or zlib.crc32(data[at:end], zlib.crc32(data[: _HEAD.size])) != _CRC.unpack_from(data, _HEAD.size)[0]:
            raise CorruptBlock("the header fails its checksum")
        ids = np.frombuffer(data, "<i8", docs, at).tolist()
        null = np.frombuffer(data, "u1", docs, at + 8 * docs)
        lengths = np.frombuffer(data, "<i8", docs, at + 9 * docs)
        table = np.frombuffer(data, "<u4", 2 * n, at + 17 * docs).reshape(n, 2)
        planes = zlib.decompress(data[end - deflated : end]) if n else b""
        ends = end + np.cumsum(table[:, 0], dtype=np.int64)
    except (struct.error, zlib.error, ValueError) as e:
        raise CorruptBlock(str(e)) from e
    if len(data) != (int(ends[-1]) if n else end) or int(lengths.sum()) != total or len(planes) != 8 * most:
        raise CorruptBlock("the segment's parts do not add up")
    blocks = [data[int(e) - int(s) : int(e)] for s, e in zip(table[:, 0], ends)]
    out = np.zeros((0, block), np.int32)
    if n:
        found, parts = _from_planes(planes[: 4 * most]), _from_planes(planes[4 * most :])
        out = found.astype(np.int32).take(np.ascontiguousarray(decode_blocks(blocks, block, Frequencies(parts, bits))))
    for k, row in enumerate(out):
        if _check(row, blocks[k]) != int(table[k, 1]):
            raise CorruptBlock(f"block {k} fails its checksum")
    return [None if z else d for d, z in zip(ids, null)], lengths, out.reshape(-1)[:total]
