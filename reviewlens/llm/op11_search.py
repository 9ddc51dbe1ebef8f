"""Ranked lexical search by presence masks.

One pass over the texts keeps, for each document, its number of terms and how often it holds each term of the questions. A
second pass ranks: the documents of a task are taken in blocks, each term of the questions is a bitmap over the block, and the
bitmaps of an item's terms, turned about, give every document the mask of the terms it matches. Documents are grouped by mask.
The maximum of a mask is the sum of its terms' weights times the most that each term adds to any document of the block; masks are
evaluated from the highest maximum down, until the maximum lies below the score of the last place so far, which later blocks
of the task start from. Only the best rows of a task leave it, ``top`` for each item, and are merged in two steps.

Questions are taken in blocks of ``BLOCK_TERMS`` terms (one item alone may have more), so what is sent to the tasks has a bound
whatever the table of items holds; every block is ranked against all documents.

Terms: runs of letters and digits of ASCII (A-Z lower-cased) and of all other characters. Null and empty texts have no terms: such
a document is not counted and never returned, such an item returns nothing. Each row of items is ranked on its own, and each
row of documents, so repeated rows appear repeatedly. Equal scores go by document id, null ids last. Texts of any length are
read whole. Empty tables give no rows; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlens.llm import common as C

#: Fixed values of the score.
LENGTH_SHARE, LENGTH_BASE, SCALE, FLATTEN, WEIGHT_SCALE = 90, 10, 1_000_000_000, 8, 1000
TOP = 10
BLOCK_TERMS, CELLS, SALTS = 1 << 16, 1 << 23, 32
#: Bytes that are in no term.
GAPS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def terms_of(text: str | None) -> list[bytes]:
    """Distinct terms of one text."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    _, _, begin, size = C.word_spans(data, np.array([0, len(data)]), True, GAPS)
    low = C._LOWER[data].tobytes()
    return sorted({low[b:b + n] for b, n in zip(begin.tolist(), size.tolist())})


class Vocabulary:
    """The terms of a block of questions, found by hash and confirmed by their bytes."""

    def __init__(self, terms: list[bytes]):
        self.data = np.frombuffer(b"".join(terms), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(np.int64)
        # Terms lie end to end here, so each is a row of its own.
        hashes = C.word_spans(self.data, self.at, False, GAPS)[0]
        self.order = np.argsort(hashes, kind="stable")
        self.sorted = hashes[self.order]
        if (self.sorted[1:] == self.sorted[:-1]).any():
            raise ValueError("two terms share a hash")

    def find(self, low: np.ndarray, hashes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that are terms, and the numbers of these terms."""
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        place = np.flatnonzero(self.sorted[at] == hashes)
        term = self.order[at[place]]
        same = size[place] == (self.at[term + 1] - self.at[term])
        place, term = place[same], term[same]
        if not len(place):
            return place, term
        n = size[place]
        ends = np.cumsum(n)
        inner = np.arange(ends[-1]) - np.repeat(ends - n, n)
        equal = low[np.repeat(begin[place], n) + inner] == self.data[np.repeat(self.at[term], n) + inner]
        sure = np.logical_and.reduceat(equal, ends - n)
        return place[sure], term[sure]


def index(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, tf) of each document with a term, stored: all its terms counted, and those in ``terms`` by number."""

    def read(batches):
        words = Vocabulary(terms)
        for batch in batches:
            data, at = C.text_bytes(batch.column(1))
            for i, j in C.row_blocks(at):
                low = C._LOWER[data[at[i]:at[j]]]
                hashes, rows, begin, size = C.word_spans(low, at[i:j + 1] - at[i], False, GAPS)
                n = np.diff(rows)
                place, term = words.find(low, hashes, begin, size)
                row = np.searchsorted(rows, place, side="right") - 1
                cells, tf = np.unique(row * len(terms) + term, return_counts=True)
                has = np.flatnonzero(n)
                per = np.bincount(cells // len(terms), minlength=j - i)[has]
                at_row = pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i).take(pa.array(has)), pa.array(n[has]),
                    pa.ListArray.from_arrays(at_row, pa.array((cells % len(terms)).astype(np.int32))),
                    pa.ListArray.from_arrays(at_row, pa.array(tf.astype(np.int32)))], ["doc_id", "n", "terms", "tf"])

    read_from = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return C.saved(read_from.mapInArrow(read, "doc_id long, n long, terms array<int>, tf array<int>"), "terms")


def _frequencies(indexed: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each term."""

    def count(batches):
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_terms)
        has = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(df[has])], ["term", "df"])

    df = np.zeros(n_terms, np.int64)
    for term, n in indexed.select("terms").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df")).collect():
        df[term] = n
    return df


class _Best:
    """The best rows of one item so far."""

    def __init__(self, top: int):
        self.top, self.score, self.doc, self.null = top, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        keep = score >= self.least()
        score, doc, null = (np.concatenate([a, b[keep]]) for a, b in ((self.score, score), (self.doc, doc), (self.null, null)))
        order = np.lexsort((doc, null, -score))[:self.top]
        self.score, self.doc, self.null = score[order], doc[order], null[order]


def _masks(present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct masks (rows of 0 and 1 over the terms) of the documents in ``present`` (terms x documents), and each one's mask."""
    packed = np.packbits(present, axis=0, bitorder="little").T
    wide = -(-packed.shape[1] // 8) * 8
    bytes_ = np.zeros((packed.shape[0], wide), np.uint8)
    bytes_[:, :packed.shape[1]] = packed
    keys = bytes_.view(np.uint64).ravel() if wide == 8 else bytes_.view(np.dtype((np.void, wide))).ravel()
    found, which = np.unique(keys, return_inverse=True)
    held = found.view(np.uint8).reshape(len(found), wide)
    return np.unpackbits(held, axis=1, count=present.shape[0], bitorder="little"), which.ravel()


def _search_block(items, weights, best, doc, null, bits, adds, most, n_docs) -> None:
    """Rank one block: ``bits`` the terms' bitmaps, ``adds`` what a term adds to a document, ``most`` its largest value."""
    for k, own in enumerate(items):
        own = own[most[own] > 0]
        if not len(own):
            continue
        w = weights[own]
        present = np.unpackbits(bits[own], axis=1, count=n_docs, bitorder="little")
        some = np.flatnonzero(present.any(axis=0))
        masks, which = _masks(present[:, some])
        maximum = masks @ (w * most[own])
        order = np.argsort(-maximum, kind="stable")
        by_mask = np.argsort(which, kind="stable")
        edges = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(masks)))])
        at, step = 0, 16
        while at < len(order) and maximum[order[at]] >= best[k].least():
            now = order[at:at + step]
            now = now[maximum[now] >= best[k].least()]
            rows = some[np.concatenate([by_mask[edges[m]:edges[m + 1]] for m in now.tolist()])]
            best[k].add(w @ adds[np.ix_(own, rows)].astype(np.int64), doc[rows], null[rows])
            at, step = at + step, step * 2


def _rank(batches, items, weights, n_docs_all, n_terms_all, top):
    best = [_Best(top) for _ in items]
    width = max(8, CELLS // max(1, len(weights)) // 8 * 8)
    for batch in batches:
        for lo in range(0, batch.num_rows, width):
            part = batch.slice(lo, width)
            n = part.num_rows
            null = part.column(0).is_null().to_numpy(zero_copy_only=False)
            doc = part.column(0).fill_null(0).to_numpy()
            m = LENGTH_BASE + LENGTH_SHARE * part.column(1).to_numpy() * n_docs_all // n_terms_all
            lists = part.column(2)
            term, tf = lists.flatten().to_numpy(), part.column(3).flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(n), lists.value_lengths().to_numpy())
            c = SCALE * tf // (1000 * tf + FLATTEN * m[row])
            adds = np.zeros((len(weights), n), np.int32)
            adds[term, row] = c
            held = np.zeros((len(weights), n), bool)
            held[term, row] = True
            bits = np.packbits(held, axis=1, bitorder="little")
            del held
            _search_block(items, weights, best, doc, null, bits, adds, adds.max(axis=1).astype(np.int64), n)
    for k, b in enumerate(best):
        if len(b.score):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(b.score), k, np.int32)), pa.array(b.doc, mask=b.null), pa.array(b.score)], ["item", "doc_id", "score"])


def _blocks(items: DataFrame, block_terms: int):
    """Lists of (item_id, terms), read from the table a block at a time."""
    block, held = [], 0
    for item_id, text in items.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        own = terms_of(text)
        if own:
            if block and held + len(own) > block_terms:
                yield block
                block, held = [], 0
            block.append((item_id, own))
            held += len(own)
    if block:
        yield block


def _ranked(docs: DataFrame, block: list, top: int) -> DataFrame | None:
    terms = sorted({t for _, own in block for t in own})
    number = {t: k for k, t in enumerate(terms)}
    items = [np.array([number[t] for t in own]) for _, own in block]
    indexed = index(docs, terms)
    n_docs, n_terms = indexed.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        return None
    weights = np.array([math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in _frequencies(indexed, len(terms)).tolist()])
    found = indexed.mapInArrow(lambda b: _rank(b, items, weights, n_docs, n_terms, top), "item int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    spread = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    spread = spread.withColumn("r", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).filter(F.col("r") <= top)
    ranked = spread.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top)
    ids = docs.sparkSession.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], "item int, item_id long")
    return C.saved(ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"), "ranked")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of (doc_id, text) for each row of (item_id, text), scores above 0."""
    found = [r for r in (_ranked(docs, block, top) for block in _blocks(items, block_terms)) if r is not None]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.union, found)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def check_sql(docs: str = "documents", items: str = "benchmark", top: int = TOP) -> str:
    """DuckDB query for the rows of ``query`` (ids have to be unique)."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    terms = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return rf"""
WITH t AS (SELECT doc_id, unnest({terms}) AS term FROM {docs}),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
s AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM n),
m AS (SELECT doc_id, {LENGTH_BASE} + ({LENGTH_SHARE} * n * n_docs) // n_terms AS m FROM n, s),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({terms}) AS term FROM {items})),
df AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM q) GROUP BY term),
w AS (SELECT term, CAST(floor({WEIGHT_SCALE} * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, s),
found AS (SELECT item_id, doc_id, CAST(sum(w * (({SCALE} * tf) // (1000 * tf + {FLATTEN} * m))) AS BIGINT) AS score
          FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
      FROM found WHERE score > 0)
SELECT * FROM r WHERE rank <= {top}"""
