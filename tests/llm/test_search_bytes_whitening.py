"""Ranked search, byte-level BPE and whitening: brute force on small tables and odd rows."""

import hashlib
import math
import random
import re
import struct

import numpy as np
import pytest

from reviewlens.llm import op11_search as P11
from reviewlens.llm import op12_bytes as P12
from reviewlens.llm import op13_whitening as P13

from .conftest import SF

# ---------------------------------------------------------------- ranked search


def terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute_search(docs, items, top=10):
    held = [(d, terms(t)) for d, t in docs]
    held = [(d, ws) for d, ws in held if ws]
    n_docs, n_terms = len(held), sum(len(ws) for _, ws in held)
    out = []
    for item, text in items:
        scored = []
        own = set(terms(text))
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in ws for _, ws in held) + 1))) for t in own}
        for d, ws in held:
            m = 10 + (90 * len(ws) * n_docs) // n_terms
            s = sum(weight[t] * ((1_000_000_000 * ws.count(t)) // (1000 * ws.count(t) + 8 * m)) for t in own)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def search_rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["Éa", "日本", "x1", "A", "a-b", "ß"]
    docs = [(i, " ".join(rng.choice(words[:rng.choice([4, 15, 46])]) for _ in range(rng.choice([1, 3, 12, 80])))) for i in range(150)]
    docs += [(200, docs[3][1]), (201, docs[3][1]), (3, docs[3][1]), (None, docs[5][1]), (202, None), (203, ""), (204, " .,- "),
             (205, "w1 " * 30_000), (206, "long" * 30_000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 25])))) for i in range(25)]
    items += [(30, None), (31, ""), (32, "unknownterm"), (33, " ".join(f"t{i}" for i in range(130)) + " w1 w2"), (None, "w3 W3"), (34, "long" * 30_000)]
    return docs, items


@pytest.mark.parametrize("block_terms", [1 << 16, 20])
def test_search_equals_brute_force(spark, block_terms):
    docs, items = search_rows()
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, score int, rank string").repartition(5)
    asked = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, doc_id int").repartition(3)
    found = P11.search(frame, asked, block_terms=block_terms).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in found), key=str) == brute_search(docs, items)


def test_search_of_nothing(spark, empty):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert P11.search(empty, items).count() == 0
    assert P11.search(docs.filter("doc_id = 2"), items).count() == 0
    assert P11.search(docs, items.limit(0)).count() == 0
    assert P11.search(docs, items).count() == 1


def test_masks_group_documents():
    rng = np.random.default_rng(2)
    for n_terms in (3, 64, 65, 130):
        present = (rng.random((n_terms, 50)) < 0.03).astype(np.uint8)
        masks, which = P11._masks(present)
        assert np.array_equal(masks[which].T, present) and len(masks) == len({r.tobytes() for r in present.T.copy()})


# ---------------------------------------------------------------- byte-level BPE


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    ranks = P12.read_ranks(P12.default_ranks())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_encode_to_themselves(library):
    """What makes merging all occurrences of a pair at once right."""
    for piece, rank in P12.read_ranks(P12.default_ranks()).items():
        assert library._encode_single_piece(piece) == [rank]


def byte_texts():
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    return [
        "", "a", " ", None, "hello world's  don't\n\n x", "y" * 150_000, " " * 5000, "\n" * 3000 + "x", "日本語のテキスト" * 50, "😀 x" * 30,
        "é̂té naïve \x85  x\xa0  y", "<|endoftext|>", "".join(rng.choice(letters) for _ in range(4000)), "ab" * 4000,
        chr(68928) + chr(261183) + " a" + chr(0x1E900), "0123456789" * 40, "=-" * 300 + "_" * 999,
        "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(128, 0xD7FF), rng.randrange(0x10000, 0x2FFFF)])) for _ in range(3000)),
        " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 15))) for _ in range(3000)),
    ]


def test_bytes_equal_the_library(spark, library, monkeypatch):
    texts = byte_texts()
    rows = [(i, t, b"x", 0) for i, t in enumerate(texts)] + [(None, "a b", b"", 1), (4, texts[4], b"", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids binary, words int").coalesce(2)
    for block, memo in ((P12.BLOCK_WORDS, P12.MEMO_WORDS), (500, 900)):  # many blocks, and starting afresh
        monkeypatch.setattr(P12, "BLOCK_WORDS", block)
        monkeypatch.setattr(P12, "MEMO_WORDS", memo)
        found = P12.round_trip(docs).collect()
        want = []
        for d, t, _, _ in rows:
            ids = library.encode_ordinary(t or "")
            want.append((d, struct.pack(f"<{len(ids)}I", *ids), (t or "").encode()))
        assert sorted(((r.doc_id, bytes(r.ids), bytes(r.bytes)) for r in found), key=str) == sorted(want, key=str)
    parts = P12.decode(P12.encode(docs.filter("doc_id < 5"))).collect()
    assert {(r.doc_id, bytes(r.bytes)) for r in parts} == {(i, (t or "").encode()) for i, t in enumerate(texts[:5])}


def test_bytes_of_nothing_and_unknown_ids(spark, empty):
    assert P12.round_trip(empty).count() == 0
    assert P12.decode(spark.createDataFrame([(1, None)], "doc_id long, ids binary")).collect()[0].bytes is None
    with pytest.raises(Exception, match="out of bounds"):
        P12.decode(spark.createDataFrame([(1, struct.pack("<I", 60_000))], "doc_id long, ids binary")).collect()


def test_byte_query(spark, library):
    found = {r.doc_id: r for r in P12.query(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode_ordinary(r.text)
        own = found.pop(r.doc_id)
        assert own.n_tokens == len(ids) and own.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert own.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    assert not found


# ---------------------------------------------------------------- whitening


def brute_whitening(rows, k):
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    n, dims = len(x), len(x[0])
    sums = [sum(r[d] for r in x) for d in range(dims)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(r, sums)] for r in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    return deviation, centred @ axes[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def test_whitening_equals_plain_arrays(spark):
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found = P13.query(spark, SF).collect()
    deviation, whitened, explained = brute_whitening(rows, 32)
    place = {v: i for i, (v, _) in enumerate(rows)}
    got = np.zeros_like(whitened)
    for r in found:
        got[place[r.vec_id], r.component - 1] = r.whitened
        assert r.n == len(rows) and r.deviation == deviation[place[r.vec_id]] and abs(r.explained - explained[r.component - 1]) < 1e-10
    assert len(found) == got.size and np.abs(got * np.sign((got * whitened).sum(axis=0)) - whitened).max() < 1e-8
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(1)
    good = [(i, (100 * rng.normal(size=3)).tolist()) for i in range(40)] + [(None, [1.0, 2.0, 3.0]), (3, [5.0, 5.0, 5.0]), (3, [5.0, 5.0, 5.0])]
    bad = [(50, None), (51, [nan, 1.0, 2.0]), (52, [1.0, None, 2.0]), (53, [inf, 0.0, 0.0]), (54, []), (55, [1.0]), (56, [1e30, 0.0, 0.0])]
    frame = spark.createDataFrame([(i, v, 1, "c") for i, v in good + bad], "vec_id long, embedding array<double>, index int, centred string")
    found = P13.whiten(frame.repartition(4)).collect()
    assert len(found) == 3 * len(good) and {r.n for r in found} == {len(good)}
    deviation, whitened, _ = brute_whitening(good, 3)
    assert sorted(r.deviation for r in found if r.component == 1) == sorted(deviation)
    for c in range(3):
        assert np.allclose(sorted(abs(r.whitened) for r in found if r.component == c + 1), sorted(abs(whitened[:, c])))
    assert P13.whiten(frame.limit(0)).count() == 0
    assert P13.whiten(spark.createDataFrame(good[-2:], "vec_id long, embedding array<double>")).count() == 0
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(9)], "vec_id long, embedding array<double>")
    assert {r.component for r in P13.whiten(flat).collect()} == {1}


def test_whitening_in_many_blocks(spark, monkeypatch):
    """Several row blocks and column blocks, and fewer splits than blocks."""
    monkeypatch.setattr(P13, "BLOCK_ROWS", 16)
    monkeypatch.setattr(P13, "BLOCK_COLS", 4)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=10) * np.arange(1, 11) * 10).tolist()) for i in range(150)]
    found = P13.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), 4).collect()
    _, whitened, _ = brute_whitening(rows, 4)
    got = np.zeros_like(whitened)
    for r in found:
        got[r.vec_id, r.component - 1] = r.whitened
    assert np.abs(got * np.sign((got * whitened).sum(axis=0)) - whitened).max() < 1e-8
