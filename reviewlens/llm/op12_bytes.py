"""Byte-level BPE by Spark higher-order functions, and its inverse.

Texts are split by the pattern in the JVM. The distinct new words of a block of documents then form one array of byte arrays,
and an ``aggregate`` over each word merges its pieces: the state holds the pieces (as ranks) and the rank of every two
neighbours, a step joins the leftmost two of least rank. The rank map is a literal: ``BUCKETS`` small maps, in which a pair of
pieces is found by its hash. Blocks hold whole documents up to ``BLOCK_WORDS`` words; a task keeps the numbers of the words that
it has met, up to ``MEMO_WORDS``, then starts afresh. So nothing is shuffled, stored or broadcast, memory does not grow with the
table, and a lost executor repeats only its own tasks. Decoding concatenates the binary pieces of the ids.

Words above ``LONG`` bytes are first cut where no vocabulary piece contains the two bytes, across which nothing can merge. What
stays longer is merged by all occurrences of the best pair at once; with a vocabulary whose pieces encode to themselves (a
test asserts it) no merge makes a neighbour of lower rank, so the result is the same, and a run of one character takes a few steps.

Null and empty texts have no ids. A null document id stays null, repeated rows are each encoded, an empty table gives no rows.
Texts of any length are encoded whole (a document above ``BLOCK_WORDS`` words is a block of its own). Columns other than
``doc_id`` and ``text`` are not looked at, whatever their names. Texts with characters that the JVM's Unicode tables do not
know are split in the task, by the pattern's own library.
"""

from __future__ import annotations

import base64
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.llm import common as C

BLOCK_WORDS, MEMO_WORDS, LONG = 2_000_000, 1_000_000, 128
BUCKETS, _FACTOR = 1 << 16, 31_337
#: A rank is held shifted, with room for a place below it; no rank; a piece that joins with nothing.
_ROOM, _EDGE = 12, 60_000
_NONE = 2**31 - (1 << _ROOM)
#: Unicode white space, for a pattern language whose \s knows ASCII only (fixed values).
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines of a base64 piece and its rank; every single byte must be a piece."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the vocabulary lacks single bytes")
    return ranks


def jvm_pattern(pattern: str) -> str:
    """The pattern with white space spelled out (inside brackets and outside)."""
    out, inside, i = "", False, 0
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two[0] == "\\":
            out += {"\\s": _SPACE if inside else f"[{_SPACE}]", "\\S": f"[^{_SPACE}]"}.get(two, two)
            i += 2
            continue
        inside = (inside or two[0] == "[") and two[0] != "]"
        out += two[0]
        i += 1
    return out


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The literal: for each two pieces that make a piece, its shifted rank, in the map of their hash, under the first one's rank.

    The hash and the first rank determine the second one.
    """
    if max(ranks.values()) >= _EDGE:
        raise ValueError(f"ranks must lie below {_EDGE}")
    cells: list[dict] = [{"k": [], "r": []} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            a, b = ranks.get(piece[:i]), ranks.get(piece[i:])
            if a is not None and b is not None:
                cell = cells[(a * _FACTOR + b) % BUCKETS]
                cell["k"].append(a)
                cell["r"].append(rank << _ROOM)
    read = F.from_json(F.lit(json.dumps(cells, separators=(",", ":"))), "array<struct<k:array<int>,r:array<int>>>")
    return F.transform(read, lambda c: F.map_from_arrays(c["k"], c["r"]))


def _rank(a: str, b: str) -> str:
    return f"coalesce(element_at(get(ranks, ({a} * {_FACTOR} + {b}) & {BUCKETS - 1}), {a}), {_NONE})"


def merged_words(words: str) -> str:
    """SQL for the ids of each word of the array ``words`` (arrays of the bytes' ranks), with the rank map bound to ``ranks``."""
    # A state is (pieces between two edges, shifted rank of each piece with the next one, the least rank with its place). Steps take
    # turns: one finds the least, leftmost first, the next joins there. An edge joins with nothing, so the least has place 0 when
    # nothing can be joined any more. (A search for the place with array_position is many times slower than this sum.)
    at, new = f"(s.m & {(1 << _ROOM) - 1})", f"shiftright(s.m, {_ROOM})"
    start = f"""transform(array(concat(array({_EDGE}), w, array({_EDGE}))), p -> named_struct('p', p,
        'r', transform(slice(p, 2, size(w) + 1), (b, i) -> {_rank('p[i]', 'b')}), 'm', -1))[0]"""
    find = "named_struct('p', s.p, 'r', s.r, 'm', array_min(transform(s.r, (x, i) -> x + i)))"
    join = f"""named_struct(
        'p', flatten(array(slice(s.p, 1, {at}), array({new}), slice(s.p, {at} + 3, size(s.p)))),
        'r', flatten(array(slice(s.r, 1, {at} - 1), array({_rank(f's.p[{at} - 1]', new)}, {_rank(new, f's.p[{at} + 2]')}),
                           slice(s.r, {at} + 3, size(s.r)))), 'm', -1)"""
    one_by_one = f"""aggregate(sequence(3, 2 * size(w)), {start}, (s, i) -> if(s.m = {_NONE}, s, if(s.m = -1, {find}, {join})),
        s -> slice(s.p, 2, size(s.p) - 2))"""
    # Long words: ranks as a text between commas, in which one replacement joins all occurrences of a pair.
    cells = "transform(split(trim(BOTH ',' FROM s.t), ',,'), x -> cast(x AS int))"
    least = f"array_min(transform(slice(c, 2, size(c)), (b, i) -> {_rank('c[i]', 'b')} * {1 << 31}L + i))"
    joined = f"""transform(array({cells}), c -> transform(array({least}), m -> if(coalesce(m, {_NONE << 31}L) >= {_NONE << 31}L,
        named_struct('t', s.t, 'more', false),
        transform(array(cast(m & {(1 << 31) - 1}L AS int)), k -> named_struct('t', replace(s.t, concat(',', c[k], ',,', c[k + 1], ','),
            concat(',', shiftright(m, {31 + _ROOM}), ',')), 'more', true))[0]))[0])[0]"""
    at_once = f"""aggregate(slice(w, 2, size(w)), named_struct('t', concat(',', array_join(transform(w, x -> cast(x AS string)), ',,'), ','), 'more', true),
        (s, i) -> if(s.more, {joined}, s), s -> {cells})"""
    return f"transform({words}, w -> if(size(w) = 1, w, if(size(w) <= {LONG}, {one_by_one}, {at_once})))"


def _cuts(word: bytes, joins: np.ndarray) -> list[bytes]:
    """A long word cut between bytes that no piece contains side by side."""
    b = np.frombuffer(word, np.uint8)
    at = np.flatnonzero(~joins[b[:-1], b[1:]]) + 1
    return [word[i:j] for i, j in zip([0, *at.tolist()], [*at.tolist(), len(word)])]


class _Words:
    """The words that a task has met, in the order of their numbers; a long word is met as its parts."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.met = ranks, pa.array([], pa.binary())
        self.pieces = pa.array(sorted(ranks, key=ranks.get), pa.binary())
        self.of_piece = np.array(sorted(ranks.values()), np.int32)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.joins = np.zeros((256, 256), bool)
        for piece in ranks:
            b = np.frombuffer(piece, np.uint8)
            self.joins[b[:-1], b[1:]] = True

    def number(self, words: pa.Array) -> tuple[np.ndarray, dict[int, np.ndarray], pa.Array]:
        """The number of each of the distinct words, the numbers of those that are several parts, and the words new to the task."""
        parts, spans = [], {}
        for k in np.flatnonzero(pc.greater(pc.binary_length(words), LONG).to_numpy(zero_copy_only=False)).tolist():
            word = words[k].as_py()
            own = [word] if word in self.ranks else _cuts(word, self.joins)
            spans[k] = (len(parts), len(parts) + len(own))
            parts += own
        each = words
        if spans:
            short = np.ones(len(words), bool)
            short[list(spans)] = False
            each = pc.unique(pa.concat_arrays([words.filter(pa.array(short)), pa.array(parts, pa.binary())]))
        known = pc.index_in(each, value_set=self.met)
        unknown = known.is_null().to_numpy(zero_copy_only=False)
        new = each.filter(pa.array(unknown))
        numbers = known.fill_null(0).to_numpy().astype(np.int64)
        numbers[unknown] = len(self.met) + np.arange(len(new))
        self.met = pa.concat_arrays([self.met, new])
        if not spans:
            return numbers, {}, new
        of_part = numbers[pc.index_in(pa.array(parts, pa.binary()), value_set=each).to_numpy()]
        several = {k: of_part[a:b] for k, (a, b) in spans.items()}
        of_word = pc.index_in(words, value_set=each).fill_null(0).to_numpy()
        return numbers[of_word], several, new

    def arrays(self, new: pa.Array) -> pa.ListArray:
        """Byte arrays of the words as ranks; a word that is a piece is one rank."""
        piece = pc.index_in(new, value_set=self.pieces)
        whole = piece.is_valid().to_numpy(zero_copy_only=False)
        length = pc.binary_length(new).to_numpy().astype(np.int64)
        data = self.bytes[C.text_bytes(new)[0]]
        per = np.where(whole, 1, length)
        ends = np.cumsum(per)
        keep = np.ones(len(data), bool)
        if whole.any():
            inner = np.arange(len(data)) - np.repeat(np.cumsum(length) - length, length)
            keep = (inner == 0) | ~np.repeat(whole, length)
        data = data[keep]
        data[ends[whole] - 1] = self.of_piece[piece.filter(pa.array(whole)).to_numpy()]
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(data))


def _rows(batch, split):
    """Words of each row of (doc_id, words, raw) end to end, and their counts; where ``raw`` is given it is split here."""
    lists, raw = batch.column(1), batch.column(2)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    rare = np.flatnonzero(raw.is_valid().to_numpy(zero_copy_only=False)).tolist()
    if rare:
        parts, begins, last = [], np.concatenate([[0], np.cumsum(sizes)]), 0
        for r in rare:
            own = [m.group() for m in split.finditer(raw[r].as_py())]
            parts += [flat.slice(begins[last], begins[r] - begins[last]), pa.array(own, pa.string())]
            sizes[r], last = len(own), r
        flat = pa.concat_arrays([*parts, flat.slice(begins[last])])
    return flat, sizes


def _blocks(batches, pattern: str, ranks_path: str):
    """Rows of a block: document ids, words per document, the number of each word, the words new to the task."""
    import regex

    known, split, fresh = _Words(read_ranks(ranks_path)), regex.compile(pattern), False
    for batch in batches:
        flat, sizes = _rows(batch, split)
        ends = np.cumsum(sizes)
        i = 0
        while i < len(sizes):
            begin = ends[i] - sizes[i]
            j = max(i + 1, int(np.searchsorted(ends, begin + BLOCK_WORDS, side="right")))
            coded = flat.slice(begin, ends[j - 1] - begin).dictionary_encode()
            index, counts = coded.indices.to_numpy(), sizes[i:j]
            numbers, several, new = known.number(coded.dictionary.cast(pa.binary()))
            if several:
                index, counts = _spread(index, counts, numbers, several)
            else:
                index = numbers[index]
            yield pa.RecordBatch.from_arrays([
                pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), batch.column(0).slice(i, j - i)),
                *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x.astype(np.int32))) for x in (counts, index)),
                pa.ListArray.from_arrays(pa.array([0, len(new)], pa.int32()), known.arrays(new)), pa.array([fresh])],
                ["doc_ids", "counts", "index", "words", "fresh"])
            fresh = len(known.met) > MEMO_WORDS
            if fresh:
                known.met = known.met[:0]
            i = j


def _spread(index, counts, numbers, several):
    """Numbers of all words where some of them stand for several parts, and the counts with these."""
    times = np.ones(len(numbers), np.int64)
    times[list(several)] = [len(v) for v in several.values()]
    per = times[index]
    out = np.repeat(numbers[index], per)
    begin = np.cumsum(per) - per
    for at in np.flatnonzero(per > 1).tolist():
        out[begin[at]:begin[at] + per[at]] = several[int(index[at])]
    doc = np.repeat(np.arange(len(counts)), counts)
    return out, np.bincount(doc, per, len(counts)).astype(np.int64)


def _documents(batches):
    """Ids of each document as little-endian unsigned 32-bit integers, from blocks whose new words are encoded."""
    none = np.zeros(0, np.int64)
    flat, sizes = none.astype("<u4"), none
    for batch in batches:
        for r in range(batch.num_rows):
            doc_ids, counts, index, codes = (batch.column(k).slice(r, 1).flatten() for k in range(4))
            if batch.column(4)[r].as_py():
                flat, sizes = flat[:0], sizes[:0]
            counts, index = counts.to_numpy(), index.to_numpy()
            flat = np.concatenate([flat, codes.flatten().to_numpy().astype("<u4")])
            sizes = np.concatenate([sizes, codes.value_lengths().to_numpy().astype(np.int64)])
            starts = np.cumsum(sizes) - sizes
            edges = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
            lo = 0
            while lo < len(counts):  # runs of documents, so that the gathered ids stay small
                hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + 500_000, side="right")) - 1)
                own = index[edges[lo]:edges[hi]]
                per = sizes[own]
                ends = np.cumsum(per)
                data = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[own] - (ends - per), per)]
                cuts = np.concatenate([[0], ends])[edges[lo:hi + 1] - edges[lo]] * 4
                held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(cuts), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([doc_ids.slice(lo, hi - lo), held.cast(pa.binary())], ["doc_id", "ids"])
                lo = hi


def encode(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids) of each row of (doc_id, text); ``ids`` holds little-endian unsigned 32-bit integers end to end."""
    return _encoded_blocks(docs, ranks or default_ranks(), pattern or default_pattern()).mapInArrow(_documents, "doc_id long, ids binary")


def _encoded_blocks(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    text, unknown = F.coalesce("text", F.lit("")), F.col("text").rlike(r"\p{Cn}")
    split = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(~unknown, F.regexp_extract_all(text, F.lit(jvm_pattern(pattern)), F.lit(0))).alias("words"),
        F.when(unknown, F.col("text")).alias("raw"))
    kinds = "doc_ids array<long>, counts array<int>, index array<int>, words array<array<int>>, fresh boolean"
    blocks = split.mapInArrow(lambda b: _blocks(b, pattern, ranks), kinds)
    bound = blocks.withColumn("bound", F.array(rank_map(read_ranks(ranks))))
    return bound.select("doc_ids", "counts", "index", F.expr(f"transform(bound, ranks -> {merged_words('words')})[0]").alias("codes"), "fresh")


_ROUND = "doc_id long, ids binary, bytes binary"


def _joined(batches, path: str):
    """The binary pieces of the ids of each row end to end."""
    table = read_ranks(path)
    if sorted(table.values()) != list(range(len(table))):
        raise ValueError("ranks must run from 0 without gaps")
    pieces = pa.array(sorted(table, key=table.get), pa.large_binary())
    for batch in batches:
        texts = []
        for ids in batch.column(1):
            if not ids.is_valid or not len(ids.as_buffer()):
                texts.append(b"" if ids.is_valid else None)
                continue
            own = np.frombuffer(ids.as_buffer(), "<u4")
            _, offsets, held = pieces.take(pa.array(own)).buffers()
            edge = np.frombuffer(offsets, np.int64)
            texts.append(held.slice(edge[0], edge[len(own)] - edge[0]).to_pybytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], ["doc_id", "ids", "bytes"])


def decode(coded: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, ids, bytes): the binary pieces of the ids end to end; null ids give null. An id without a piece is an error."""
    path = ranks or default_ranks()

    return coded.select("doc_id", "ids").mapInArrow(lambda b: _joined(b, path), _ROUND)


def round_trip(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids, bytes): ``decode`` of ``encode``, without a second pass through Python."""
    path = ranks or default_ranks()
    return _encoded_blocks(docs, path, pattern or default_pattern()).mapInArrow(lambda b: _joined(_documents(b), path), _ROUND)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs).select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
