import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from quirefold.llm import rangecoder as rc, tokenfiles as tf
from quirefold.llm.scratch import Scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, ids string, start long"


def test_coder_round_trip():
    r = np.random.default_rng(1)
    for ids in (np.zeros(0, int), np.array([65535]), np.zeros(5000, int), r.integers(0, 65536, 3001), r.zipf(1.4, 9000) % 50257, np.tile(r.integers(0, 50257, 17), 200), np.full(1024, 65535), r.integers(0, rc.MOST_ID, 2500), np.arange(3000) + 70_000):
        lengths = np.array([len(ids) // 3, 0, len(ids) - len(ids) // 3])
        names, n, got = rc.unpack(rc.pack([7, None, -3], lengths, ids))
        assert names == [7, None, -3] and n.tolist() == lengths.tolist() and (got == ids).all()
    with pytest.raises(ValueError):
        rc.pack([1], np.array([1]), np.array([rc.MOST_ID]))


def test_predictable_ids_shrink():
    r = np.random.default_rng(2)
    ids = np.tile(r.integers(0, 50257, 40), 2000)
    assert len(rc.pack([1], np.array([len(ids)]), ids)) < 0.35 * 2 * len(ids)


def test_smaller_than_zlib_on_real_texts():
    """Whole blocks of real texts' ids take fewer bytes than zlib at level 6 over the same blocks, with the headers counted."""
    tokenizer = Tokenizer.from_file(PATH)
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()[:300]
    ids = np.concatenate([np.array([*e.ids, 2]) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)])
    plain = sum(len(zlib.compress(ids[i : i + rc.BLOCK].astype("<u2").tobytes(), 6)) for i in range(0, len(ids), rc.BLOCK))
    assert len(ids) > 100_000 and len(rc.pack([1], np.array([len(ids)]), ids)) < 0.85 * plain


def test_slots_number_first_appearances():
    slots, new = rc.slots_of(np.array([[5, 5, 9, 1, 9, 5], [0, 1, 2, 3, 4, 5]]))
    assert slots.tolist() == [[0, 0, 1, 2, 1, 0], [0, 1, 2, 3, 4, 5]] and new.tolist() == [[True, False, True, True, False, False], [True] * 6]


def test_damage_is_found():
    ids = np.random.default_rng(3).integers(0, 50257, 5000)
    data = rc.pack([1, 2], np.array([2000, 3000]), ids)
    for at in (0, 9, len(data) // 2, len(data) - 3):
        with pytest.raises(rc.CorruptBlock):
            rc.unpack(data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1 :])
    for cut in (3, 40, len(data) - 1):
        with pytest.raises(rc.CorruptBlock):
            rc.unpack(data[:cut])


def test_blocks_are_independent():
    ids = np.random.default_rng(4).integers(0, 900, (5, rc.BLOCK))
    together = rc.encode_blocks(ids)
    assert together == [rc.encode_blocks(row[None])[0] for row in ids]
    assert (rc.decode_blocks(together[3:4], rc.BLOCK)[0] == ids[3]).all()


def test_files_equal_the_library(spark, monkeypatch):
    texts = ["Hello wörld, it's 12²  times\n\n  x", None, "", "<|endoftext|> as text", "long " * 40_000, "the of and " * 50]
    rows = [(i * 3 - 4, t) for i, t in enumerate(texts)] + [(None, "no id"), (5, "again"), (5, "a second time")]
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], SCHEMA).repartition(3)
    segments = tf.write(df, Scratch(spark, "t"), "s", PATH, end_id=2)
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    place, want, whole = 0, [], []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, place, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        whole.append((i, place, ids))
        place += len(ids)
    assert sorted(map(tuple, tf.digests(segments).collect()), key=lambda r: r[1]) == want
    assert sorted(((r.doc_id, r.start, r.ids) for r in tf.read(segments).collect()), key=lambda r: r[1]) == whole


def test_empty_table(spark):
    segments = tf.write(spark.createDataFrame([], SCHEMA), Scratch(spark, "t"), "s", PATH, end_id=2)
    assert tf.digests(segments).count() == 0 and tf.read(segments).count() == 0
