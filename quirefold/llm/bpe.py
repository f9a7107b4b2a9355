"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

A token sequence is the merge result of its bytes exactly when each neighbouring pair is the merge
result of its own bytes (Berglund & van der Merwe, "Formalizing BPE tokenization").  So one machine
reads the bytes of a piece: a hypothesis is the last finished token, the trie node of the token under
way and the tokens not emitted yet.  A set of hypotheses is a state of the determinised machine,
made when it is first reached; where a trie node can only become a few tokens, the hypothesis keeps
those that may follow in place of its last token, so that many histories share a state.  Each byte finishes exactly one hypothesis; tokens that all living
hypotheses share are emitted.  As tokens have a greatest length, the lookahead is bounded.

States are kept up to a fixed number and then forgotten, and so are whole-piece results, those that are
met often last; this changes the time taken and nothing else.  Whole texts are split by the tokenizer's pattern, each match separately.

Decoding maps ids to bytes and cuts text at character ends by an incremental UTF-8 state machine;
malformed bytes become U+FFFD as in Python's "replace".

Defined cases: null texts count as empty, an empty text has no ids; repeated rows and columns of
other names are left as they are.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from quirefold.llm.scratch import small_batches
from quirefold.llm.workers import claim

#: Characters on which Python's ``re`` and the pattern's Unicode classes agree; other texts take ``regex``.
_PLAIN = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧‰-⁞一-鿿]")
_FAST = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"


class Splitter:
    """The pieces of a text: all matches of the pattern."""

    def __init__(self, pattern: str):
        self.exact = regex.compile(pattern).findall
        # The quick equivalent holds for this one pattern; any other is used as it is.
        same = pattern == r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.quick = re.compile(_FAST).findall if same else None

    def __call__(self, text: str) -> list[str]:
        if self.quick and (text.isascii() and not re.search("[\x1c-\x1f]", text) or not text.isascii() and not _PLAIN.search(text)):
            return self.quick(text)
        return self.exact(text)


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Plain BPE: the pair of lowest rank merges, the leftmost first. The definition that the machine is built from."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
        if best is None:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


#: So many pieces and states are kept by default: about 350 MB of a worker's memory at most.
PIECES, STATES = 350_000, 100_000
#: Up to so many tokens below a trie node are tried at once.
FEW = 20


class Transducer:
    """Bytes of one piece to token ids."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = STATES):
        self.ranks, self.most = ranks, most_states
        self.token = {r: t for t, r in ranks.items()}
        self.edges: dict[tuple[int, bool], list[tuple[bytes, int, int]] | None] = {}
        self.next: dict[int, int] = {}
        self.ends: list[int] = [-1]
        for t, r in ranks.items():
            node = 0
            for b in t:
                key = node << 8 | b
                if key not in self.next:
                    self.next[key] = len(self.ends)
                    self.ends.append(-1)
                node = self.next[key]
            self.ends[node] = r
        # Tokens that a node can still become, where they are few; a hypothesis is dropped early if none of them can follow.
        self.below: list[tuple[int, ...] | None] = [()] * len(self.ends)
        parent = {child: key >> 8 for key, child in self.next.items()}
        for node in range(len(self.ends) - 1, 0, -1):  # children have greater numbers than their parents
            own, up = self.below[node], parent[node]
            more = None if own is None or self.below[up] is None else (*self.below[up], *own, *((self.ends[node],) if self.ends[node] >= 0 else ()))
            self.below[up] = None if more is None or len(more) > FEW else more
        self.pairs: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        start = ((-1, 0, ()),)
        self.states: dict[tuple, int] = {start: 0}
        self.items: list[tuple] = [start]
        self.last: list[tuple[int, ...]] = [()]
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}

    def edge(self, token: int, right: bool) -> list[tuple[bytes, int, int]] | None:
        """The parts that stand at a token's right or left end while its bytes merge, with the ranks at which each
        comes and goes; None if the token is not the merge result of its bytes."""
        key = (token, right)
        if key not in self.edges:
            if merge(self.token[token], self.ranks) != [token]:
                self.edges[key] = None
            else:
                out, part, end = [], self.token[token], 1 << 30
                while True:
                    rank = self.ranks[part] if len(part) > 1 else -1
                    out.append((part, rank, end))
                    if len(part) == 1:
                        break
                    halves = merge(part, {t: r for t, r in ((part[i:j], self.ranks.get(part[i:j])) for i in range(len(part)) for j in range(i + 1, len(part) + 1)) if r is not None and t != part})
                    part, end = self.token[halves[-1 if right else 0]], rank
                self.edges[key] = out
        return self.edges[key]

    def fits(self, before: int, token: int) -> bool:
        """Whether the merges of both tokens' bytes give just these two (or the token alone at the start).

        They do if no part at the right end of the first and part at the left end of the second, present at
        one time, would merge before the next merge takes either away."""
        key = before << 20 | token
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > 3 * self.most:
                self.pairs.clear()
            left, right = [("", -1, 0)] if before < 0 else self.edge(before, True), self.edge(token, False)
            found = left is not None and right is not None
            if found and before >= 0:
                ranks = self.ranks.get
                for a, a_from, a_to in left:
                    for b, b_from, b_to in right:
                        if a_from < b_to and b_from < a_to and (rank := ranks(a + b)) is not None and rank < a_to and rank <= b_to:
                            found = False
            self.pairs[key] = found
        return found

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Makes the move of a state on a byte: the next state and the tokens emitted."""
        alive, done = [], None
        for context, node, pending in self.items[state]:
            node = self.next.get(node << 8 | byte)
            if node is None:
                continue
            token, few = self.ends[node], self.below[node]
            if type(context) is tuple:
                if done is None and token >= 0 and token in context:
                    done = (token, 0, (*pending, token))
                context = tuple([t for t in few if t in context])
            else:
                if done is None and token >= 0 and self.fits(context, token):
                    done = (token, 0, (*pending, token))
                if few is not None:
                    context = tuple([t for t in few if self.fits(context, t)])
            if context != ():
                alive.append((context, node, pending))
        if done is None:
            raise ValueError("the ranks do not hold every single byte")
        alive.append(done)
        shared = 0
        if len(alive) == 1:
            shared = len(done[2])
        else:
            least = min([len(x[2]) for x in alive])
            while shared < least and len({x[2][shared] for x in alive}) == 1:
                shared += 1
        emitted = done[2][:shared]
        new = tuple([(context, node, pending[shared:]) for context, node, pending in alive]) if shared else tuple(alive)
        number = self.states.get(new)
        if number is None:
            number = self.states[new] = len(self.items)
            self.items.append(new)
            self.last.append(new[-1][2])
        move = self.moves[state << 8 | byte] = (number, emitted)
        return move

    def encode(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(self.items) > self.most:
            self.reset()
        state, out, moves = 0, [], self.moves
        for byte in piece:
            move = moves.get(state << 8 | byte) or self.step(state, byte)
            state = move[0]
            if move[1]:
                out += move[1]
        out += self.last[state]
        return tuple(out)


class Pieces(dict):
    """Results of pieces by their text; a missing one is made.

    Two generations of ``most / 2`` each: when the young one is full, it takes the place of the old one, and a piece
    of the old one that is met again is young once more; so what is met often stays, and the rest is forgotten.
    """

    def __init__(self, make: Callable[[str], object], most: int):
        super().__init__()
        self.make, self.most, self.old = make, max(1, most // 2), {}

    def __missing__(self, piece: str):
        found = self.old.get(piece)
        if found is None:
            found = self.make(piece)
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found


class Encoder:
    """Whole texts to ids, with the results of up to ``most_pieces`` pieces kept."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most_pieces: int = PIECES, most_states: int = STATES):
        self.split, self.machine = Splitter(pattern), Transducer(ranks, most_states)
        self.known = Pieces(lambda piece: self.machine.encode(piece.encode("utf-8")), most_pieces)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.split(text))))


#: How many bytes a character has by its first byte's state; 0: no first byte.
def _need(byte: int) -> int:
    return 1 if byte < 0x80 else 2 if 0xC2 <= byte < 0xE0 else 3 if 0xE0 <= byte < 0xF0 else 4 if 0xF0 <= byte < 0xF5 else 0


class Utf8Stream:
    """Incremental UTF-8: ``feed`` returns the text of all characters that are complete."""

    def __init__(self):
        self.rest = b""

    @staticmethod
    def _open(data: bytes) -> int:
        """How many bytes at the end are a character's beginning that more bytes could complete."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 == 0x80:
                continue
            if _need(byte) <= back:
                return 0
            if back > 1:
                second = data[1 - back]
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
                if not low <= second <= high:
                    return 0
            return back
        return 0

    def feed(self, data: bytes) -> str:
        data = self.rest + data
        n = self._open(data)
        self.rest = data[len(data) - n :]
        return data[: len(data) - n].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.rest = self.rest, b""
        return rest.decode("utf-8", "replace")


def stream_decode(ids: Iterable[int], tokens: list[bytes], chunk: int = 1 << 14) -> Iterator[str]:
    """Pieces of text, each as soon as its ids have come."""
    stream, ids = Utf8Stream(), list(ids)
    for a in range(0, len(ids), chunk):
        yield stream.feed(b"".join(map(tokens.__getitem__, ids[a : a + chunk])))
    yield stream.end()


def _encoder(data: bytes, key: tuple[str, str], pieces: int = PIECES) -> tuple[Encoder, list[bytes]]:
    """A worker's encoder; kept from task to task."""
    kept, key = claim("bpe"), (*key, pieces)
    if key not in kept:
        kept.clear()
        ranks = read_ranks(data)
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            tokens[r] = t
        kept[key] = (Encoder(ranks, key[1], pieces), tokens)
    return kept[key]


def _rank_file(spark: SparkSession, path: str):
    """The vocabulary, a file of fixed size, as a broadcast variable: executors need not have it."""
    small_batches(spark)
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _apply(docs: DataFrame, ranks_path: str, pattern: str, fields: list[tuple[str, pa.DataType, str]], make, pieces: int = PIECES) -> DataFrame:
    """``docs`` without ``text``, and new columns made by ``make(encoder, tokens, text)``; columns of their names are replaced."""
    docs = docs.drop(*(name for name, _, _ in fields))
    shared, key = _rank_file(docs.sparkSession, ranks_path), (ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tokens = _encoder(shared.value, key, pieces)
        for batch in batches:
            keep = [i for i, f in enumerate(batch.schema) if f.name != "text"]
            text = batch.column(batch.schema.get_field_index("text"))
            for a in range(0, len(batch), 256):
                rows = [make(encoder, tokens, t or "") for t in text[a : a + 256].to_pylist()]
                new = [pa.array([r[i] for r in rows], kind) for i, (_, kind, _) in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, len(rows)) for i in keep), *new], schema=pa.schema([*(batch.schema.field(i) for i in keep), *((n, k) for n, k, _ in fields)]))

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]
    return docs.mapInArrow(run, ", ".join([*kept, *(f"{n} {s}" for n, _, s in fields)]))


def encode(docs: DataFrame, ranks_path: str, pattern: str, pieces: int = PIECES) -> DataFrame:
    """``docs(text, ...)`` -> the other columns and ``ids array<int>``; fewer ``pieces`` kept take less memory and more time."""
    return _apply(docs, ranks_path, pattern, [("ids", pa.list_(pa.int32()), "array<int>")], lambda e, tokens, text: (e.encode(text),), pieces)


def decode(coded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``coded(ids array<int>, ...)`` -> the other columns and ``text``; null ids count as empty, a column ``text`` is replaced."""
    coded = coded.drop("text")
    shared, key = _rank_file(coded.sparkSession, ranks_path), (ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _encoder(shared.value, key)[1]
        for batch in batches:
            keep = [i for i, f in enumerate(batch.schema) if f.name != "ids"]
            texts = ["".join(stream_decode(x.as_py() or [], tokens)) for x in batch.column(batch.schema.get_field_index("ids"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(texts, pa.string())], schema=pa.schema([*(batch.schema.field(i) for i in keep), ("text", pa.string())]))

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema if f.name != "ids"]
    return coded.mapInArrow(run, ", ".join([*kept, "text string"]))


class _Decimal(dict):
    def __missing__(self, number: int) -> str:
        text = self[number] = str(number)
        return text


_DECIMAL = _Decimal()  # as many entries as the vocabulary has ids


def _digests(encoder: Encoder, tokens: list[bytes], text: str) -> tuple[int, str, str]:
    ids = encoder.encode(text)
    decoded = hashlib.sha256()
    for part in stream_decode(ids, tokens):
        decoded.update(part.encode("utf-8"))
    return len(ids), hashlib.sha256(" ".join(map(_DECIMAL.__getitem__, ids)).encode()).hexdigest(), decoded.hexdigest()


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: encoded, then decoded from the ids."""
    fields = [("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")]
    return _apply(docs.select("doc_id", "text"), ranks_path, pattern, fields, _digests)
