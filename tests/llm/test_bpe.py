import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from quirefold.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "e", "th", "ing", " ", "  ", "\n", "\t", "1", "23", "²", "Ⅷ", "é", "ß", "中", "😀", "́", "\x1c", "\x85", "\xa0", "'s", "'", "_", "-", "!!", "İ", "THE", " the", "ation", "\x00", "०", "<|endoftext|>", "löich"]


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as f:
        return bpe.read_ranks(f.read())


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randrange(0, 30))) for _ in range(n)]


def test_equals_the_library(ranks, reference):
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN, most_pieces=500)
    encoder.machine.most = 300  # states and pieces are forgotten many times
    for text in [*texts(3000), "", "ab" * 5000, " " * 3000, "x" * 700]:
        assert encoder.encode(text) == reference.encode_ordinary(text)


def test_pair_rule_equals_merging(ranks):
    machine, r = bpe.Transducer(ranks), random.Random(4)
    for _ in range(4000):
        a, b = r.randrange(4000), r.randrange(4000)
        assert machine.fits(a, b) == (bpe.merge(machine.token[a] + machine.token[b], ranks) == [a, b])


def test_machine_equals_merging_on_any_bytes(ranks):
    machine, r, tokens = bpe.Transducer(ranks), random.Random(5), list(ranks)
    for _ in range(3000):
        piece = b"".join(r.choice(tokens) for _ in range(r.randrange(1, 4)))
        assert list(machine.encode(piece)) == bpe.merge(piece, ranks) or piece in ranks


def test_utf8_stream_equals_whole_decoding():
    r = random.Random(6)
    for _ in range(2000):
        data = bytes(r.choice([65, 0xC3, 0xA9, 0xE4, 0xB8, 0xAD, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0, 0xF4, 0x90, 0xFF, 0xE0]) for _ in range(r.randrange(0, 12)))
        stream, out, at = bpe.Utf8Stream(), "", 0
        while at < len(data):
            n = r.randrange(1, 4)
            out += stream.feed(data[at : at + n])
            at += n
        assert out + stream.end() == data.decode("utf-8", "replace")


def test_round_trip_over_rows(spark, reference):
    rows = [*enumerate(texts(200, 2)), (900, None), (901, ""), (902, "long text " * 30_000), (None, "no id"), (902, "again")]
    df = spark.createDataFrame([(i, t, 3, "clash") for i, t in rows], "doc_id long, text string, n_tokens int, ids string")
    got = sorted(map(tuple, bpe.round_trip(df, PATH, public_tokenizers.PATTERN).collect()), key=str)
    want = []
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    coded = bpe.encode(df, PATH, public_tokenizers.PATTERN)
    assert {(r.doc_id, r.text) for r in bpe.decode(coded, PATH, public_tokenizers.PATTERN).collect()} == {(i, t or "") for i, t in rows}
    assert bpe.round_trip(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
