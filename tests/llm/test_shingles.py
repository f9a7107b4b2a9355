import random

import numpy as np
import pyarrow as pa

from quirefold.llm import decontaminate, quality, shingles


def texts():
    r = random.Random(1)
    return ["".join(r.choice("abcdeXÜ \n\t.") for _ in range(r.choice([0, 1, 7, 90, 700]))) for _ in range(60)] + [None, "q" * 300, " " * 200]


def hashed(column):
    data, offsets = shingles.text_buffers(column)
    words = shingles.Words(data, offsets, shingles.NOT_SPACE)
    return [words.hash[a:b].tolist() for a, b in zip(words.bounds[:-1], words.bounds[1:])]


def test_equal_words_have_equal_hashes_wherever_they_stand(monkeypatch):
    column = pa.array(texts())
    whole = hashed(column)
    names = {}
    for text, hashes in zip(texts(), whole):
        found = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
        assert len(found) == len(hashes)
        for w, h in zip(found, hashes):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)
    monkeypatch.setattr(shingles, "CHUNK", 50)
    assert hashed(column) == whole
    assert [hashed(column.slice(i, 1))[0] for i in range(len(column))] == whole


def test_seeds_and_counts_in_runs(monkeypatch):
    h = np.random.default_rng(2).integers(0, 1 << 63, 500).astype(np.uint64)
    left = 500 - np.arange(500)
    flat = lambda: sorted((k, int(p), int(s)) for k, at, seeds in decontaminate._seeds(h, left, list(decontaminate.MASKS)) for p, s in zip(at, seeds))
    whole = flat()
    monkeypatch.setattr(decontaminate, "CHUNK", 37)
    assert flat() == whole
    data, offsets = shingles.text_buffers(pa.array(texts()))
    together = quality.features(data, offsets)
    monkeypatch.setattr(quality, "CHUNK", 11)
    assert np.allclose(together, np.concatenate([quality.features(data, offsets[i : i + 2]) for i in range(len(offsets) - 1)]))
