"""Encoding, token files, counts, packing and piece encoding against the plain libraries."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from reviewlens.llm import common as C
from reviewlens.llm import op5_pieces as P5
from reviewlens.llm import op7_binary as P7
from reviewlens.llm import op9_counts as P9
from reviewlens.llm import op10_packing as P10
from reviewlens.llm import queries, tokens

from .conftest import SF


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.default_tokenizer())


def plain(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_word_encoder_equals_library(library, odd_rows, monkeypatch):
    texts = [r[1] for r in odd_rows] + ["Å Å ﬁ İx", "\x01 a\x01b \x01\x01", "<|endoftext|> x<|startoftext|>y", "a b c\x1cd\x85e"]
    for memo in (10, 600_000):
        monkeypatch.setattr(tokens, "MEMO_WORDS", memo)
        enc = tokens.WordEncoder(tokens.default_tokenizer(), 1)
        for _ in range(2):
            for first, ids, at in enc.encode_column(pa.array(texts), limit=1000):
                for k in range(len(at) - 1):
                    assert ids[at[k]:at[k + 1]].tolist() == plain(library, texts[first + k]) + [1]


def brute_files(library, rows):
    start, out = 0, []
    for doc_id, text in sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0], r[1])):
        ids = np.array(plain(library, text) + [1], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return sorted(out)


def test_token_files(spark, library, odd, odd_rows, empty):
    path = C.new_path(spark, "files")
    parts = P7.write_documents(odd, path)
    rows = P7.read_documents(parts, path).join(C.number_parts(parts, "part", "n_ids").select("part", "base"), "part").collect()
    assert sorted((r.doc_id, r.base + r.local_start, r.n_tokens, r.ids_crc32) for r in rows) == brute_files(library, odd_rows)
    reader = P7.PartReader(path, parts.first().part)
    for i in random.Random(0).sample(range(reader.n), min(5, reader.n)):  # single documents by the index
        text = next(r[1] for r in odd_rows if r[0] == reader.doc_ids[i])
        assert reader.ids(i).tolist() == plain(library, text) + [1]
    none = C.new_path(spark, "files")
    assert P7.read_documents(P7.write_documents(empty, none), none).count() == 0


def test_token_files_refuse_a_foreign_dictionary_and_null_ids(spark, small):
    path = C.new_path(spark, "files")
    part = P7.write_documents(small, path).first().part
    fs, folder = P7._fs(path)
    P7._put(fs, f"{folder}/dictionary.bin", [b"other"])
    with pytest.raises(ValueError):
        P7.PartReader(path, part)
    with pytest.raises(Exception, match="doc_id must not be null"):
        P7.write_documents(spark.createDataFrame([(None, "a")], "doc_id long, text string"), C.new_path(spark, "files"))


def test_query_of_token_files(spark, library, small):
    rows = queries.QUERIES["op7_token_files"](spark, SF).collect()
    want = brute_files(library, [(r.doc_id, r.text) for r in small.collect()])
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows) == want


def test_counts_query(spark, library, small):
    library = Tokenizer.from_file(tokens.default_tokenizer())
    library.encode_special_tokens = True
    want = {r.doc_id: len(plain(library, r.text)) for r in small.collect()}
    rows = queries.QUERIES["op9_token_counts"](spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == want and len(rows) == len(want) and all(r.complete for r in rows)


def test_counts_stitch_blocks(spark, empty, odd):
    rng = random.Random(2)
    path = C.new_path(spark, "flat")
    fs, folder = P7._fs(path)
    fs.create_dir(folder)
    want = set()
    for name in ("a.bin", "b.bin", "c.bin", "d.bin"):
        lens = [rng.choice([0, 0, 1, 3, 40]) for _ in range(60)] if name != "c.bin" else []
        open_end = {"a.bin": 0, "b.bin": 7, "c.bin": 0, "d.bin": 100}[name]
        if name == "d.bin":
            lens = []
        ids, at = [], 0
        for k, n in enumerate(lens):
            ids += [5] * n + [9]
            want.add((name, k, at, n, True))
            at += n + 1
        if open_end:
            want.add((name, len(lens), at, open_end, False))
        P7._put(fs, f"{folder}/{name}", [np.array(ids + [5] * open_end, "<u2").tobytes()])
    for block in (2, 10, 64, 1 << 20):
        found = P9.count_tokens(P9.list_files(spark, path), path, end_id=9, width=2, block_bytes=block).collect()
        assert {tuple(r) for r in found} == want and len(found) == len(want)
    for table, n in ((empty, 0), (odd, odd.count())):
        flat = C.new_path(spark, "flat")
        rows = P9.write_flat(table, flat)
        assert rows.join(P9.count_tokens(P9.list_files(spark, flat), flat), ["file", "ordinal"]).count() == n


def packed_well(rows, capacity):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing(spark, library, odd, odd_rows, empty):
    rows = P10.pack(P10.pieces(odd)).collect()
    want = []
    for r in odd_rows:
        ids = np.array(plain(library, r[1]) + [0], "<u4")
        want += [(r[0], k // 2048, k, len(ids[k:k + 2048]), zlib.crc32(ids[k:k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    assert packed_well(rows, 2048) <= -(-sum(r.length for r in rows) // 2048) + 2
    assert P10.pack(P10.pieces(empty)).count() == 0


def test_packing_query(spark):
    rows = queries.QUERIES["op10_best_fit_packing"](spark, SF).collect()
    assert packed_well(rows, 2048) <= 1.05 * -(-sum(r.length for r in rows) // 2048)


def expand(places, lengths, counts):
    out = []
    for length, n in zip(lengths, counts):
        lo, hi = np.searchsorted(places["length"], [length, length + 1])
        rank = np.arange(n)
        row = lo + np.searchsorted(places["rank"][lo:hi], rank, side="right") - 1
        out.append(np.stack([places["seq"][row] + rank - places["rank"][row], places["offset"][row], np.full(n, length)], axis=1))
    return np.concatenate(out)


@pytest.mark.parametrize("seed", range(12))
def test_plan_places_every_item_once(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([1, 7, 40, 500, 2048]))
    lengths, counts = np.unique(rng.integers(1, capacity + 1, int(rng.choice([1, 5, 60, 3000]))), return_counts=True)
    if seed % 3 == 0:
        counts = counts * 37  # hot lengths
    placed = expand(P10.plan(lengths, counts, capacity, groups=int(rng.choice([1, 8, 48]))), lengths, counts)
    placed = placed[np.lexsort((placed[:, 1], placed[:, 0]))]
    same = placed[1:, 0] == placed[:-1, 0]
    assert (placed[1:, 1][same] == (placed[:-1, 1] + placed[:-1, 2])[same]).all()
    assert (placed[np.r_[True, ~same], 1] == 0).all()
    assert np.bincount(placed[:, 0], placed[:, 2]).max() <= capacity


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(1)
    x = np.clip(np.exp(rng.normal(6, 1.2, 20_000)).astype(int), 1, 2048)
    lengths, counts = np.unique(x, return_counts=True)
    assert P10.plan(lengths, counts)["sequences"][0] <= 1.01 * (lengths * counts).sum() / 2048


@pytest.fixture(scope="module")
def pieces():
    return P5.encoder(P5.default_model())


def test_pieces_are_the_best(pieces):
    v = pieces.vocabulary

    def brute(s):
        if not s:
            return 0.0
        found = [v.scores[v.ids[s[:k]]] + brute(s[k:]) for k in range(1, min(v.longest, len(s)) + 1) if s[:k] in v.ids]
        return max(found + ([P5.UNKNOWN + brute(s[1:])] if s[0] not in v.ids else []))

    for text in (" hello", " world!", "  the ca", " ▁é", " 日本x"):
        assert v.scores[v.best(text)].sum() == brute(text)


def test_texts_round_trip(pieces, odd_rows):
    v = pieces.vocabulary
    texts = [r[1] or "" for r in odd_rows] + [" ", "  ", "a  ", "   b", "▁a ▁", "a\tb  \n c"]
    ids, at = pieces.encode_texts(texts)
    for k, t in enumerate(texts):
        own = ids[at[k]:at[k + 1]]
        assert v.decode(own) == (" " + t if t else "")
        if t and len(t) < 1000:
            assert v.scores[own].sum() == v.scores[v.best(" " + t)].sum()


def test_chunks_give_the_best_path(pieces):
    v, rng = pieces.vocabulary, random.Random(6)
    for _ in range(60):
        text = " " + rng.choice(["".join(rng.choice("ab \n▁é the") for _ in range(rng.randint(60, 300))), "x" * rng.randint(40, 90), "hello" * 20])
        ends = P5.cuts(len(text), 33)
        chunks = [P5.Chunk(pieces, text[a:b + v.longest - 1], b - a) for a, b in zip(ends, ends[1:])]
        matrices = [c.matrix() for c in chunks]
        left, right = P5.combine(P5.combine(matrices[0], matrices[1]), matrices[1]), P5.combine(matrices[0], P5.combine(matrices[1], matrices[1]))
        assert np.array_equal(left, right)
        states = P5.boundary_states(matrices)
        out = [i for c, a, b in zip(chunks, states, states[1:]) for i in c.ids(a, b)]
        assert v.decode(out) == text and v.scores[out].sum() == v.scores[v.best(text)].sum()


def test_piece_tables(spark, pieces, odd, odd_rows, empty):
    whole = {r.doc_id: r.score for r in P5.encode(odd, chunk=1 << 20).groupBy("row").agg({"score": "sum", "doc_id": "min"})
             .toDF("row", "score", "doc_id").collect()}
    rows = P5.encode(odd, chunk=1000)
    assert rows.filter("not same").count() == 0
    texts = defaultdict(list)
    for r in P5.decode(rows).collect():
        texts[r.row, r.doc_id].append((r.chunk, r.text))
    found = sorted((d, "".join(t for _, t in sorted(parts))) for (_, d), parts in texts.items())
    assert found == sorted((r[0], r[1] or "") for r in odd_rows)
    for r in rows.groupBy("row").agg({"score": "sum", "doc_id": "min"}).toDF("row", "score", "doc_id").collect():
        assert r.score == whole[r.doc_id]
    assert P5.encode(empty).count() == 0


def test_pieces_query(spark, small):
    rows = queries.QUERIES["op5_pieces"](spark, SF).collect()
    lens = {r.doc_id: len(r.text or "") for r in small.collect()}
    assert {r.doc_id: r.n_chars for r in rows} == lens and all(r.round_trip for r in rows)
