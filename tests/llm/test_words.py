"""Words, shingles and numbering against plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest

from reviewlens.llm import common as C


@pytest.mark.parametrize("segment", [7, 64, 1 << 20])
def test_words_and_shingles(monkeypatch, segment):
    monkeypatch.setattr(C, "_SEGMENT", segment)
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \né") for _ in range(rng.choice([0, 1, 2, 5, 30, 60]))) for _ in range(300)]
    texts += [None, "", "x" * 50, "  "]
    data, at = C.text_bytes(pa.array(texts))
    words, rows = C.word_hashes(data, at)
    shingles, places = C.shingle_hashes(words, rows, 3)
    seen, seen_shingles = {}, {}
    for i, t in enumerate(texts):
        own = (t or "").encode().split()
        assert len(own) == rows[i + 1] - rows[i]
        for w, h in zip(own, words[rows[i]:rows[i + 1]]):
            assert seen.setdefault(w, h) == h
        want = [tuple(own[k:k + 3]) for k in range(len(own) - 2)] if len(own) >= 3 else [tuple(own)] if own else []
        found = shingles[places[i]:places[i + 1]]
        assert len(found) == len(want)
        for w, h in zip(want, found):
            assert seen_shingles.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen) and len(set(seen_shingles.values())) == len(seen_shingles)


def test_sliced_columns():
    column = pa.array(["aa bb", None, "cc", "dd ee ff"]).slice(1, 3)
    data, at = C.text_bytes(column)
    assert data.tobytes() == b"ccdd ee ff" and at.tolist() == [0, 0, 2, 10]
    assert C.text_bytes(pa.array([], pa.string()))[1].tolist() == [0]


def test_lower_case_is_ascii_only():
    a, b, c, d = (C.word_hashes(*C.text_bytes(pa.array([t])), lower=True)[0][0] for t in ("ABz", "abZ", "É", "é"))
    assert a == b and c != d


def test_rank_within_numbers_each_key_from_zero(spark):
    rows = [(1, i) for i in range(500)] + [(2, i) for i in range(1000, 1003)]
    found = C.rank_within(spark.createDataFrame(rows, "k long, t long"), "k", "t", "r", buckets=8).collect()
    for k, n in ((1, 500), (2, 3)):
        assert sorted(r.r for r in found if r.k == k) == list(range(n))


def test_number_parts(spark):
    df = spark.createDataFrame([(0, 5), (0, 1), (3, 2), (4, 9)], "part long, w long")
    assert {(r.part, r.base, r.n) for r in C.number_parts(df, "part", "w").collect()} == {(0, 0, 6), (3, 6, 2), (4, 8, 9)}


def test_mix_has_no_collisions():
    assert len(np.unique(C.mix(np.arange(10_000, dtype=np.uint64)))) == 10_000
