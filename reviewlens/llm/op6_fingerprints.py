"""Document fingerprints by one-permutation MinHash.

Each shingle (five words; the whole text if it has fewer) is hashed once: the high bits choose one of ``BINS`` bins, the
rest is its value, a bin keeps its least. An empty bin borrows from the bin that a fixed sequence of probes finds first
(optimal densification), the same for all documents. Of each bin ``BITS`` low bits are stored, packed, as hex digits.
Likeness is the share of equal bins, corrected for those that agree by chance: (share - 2**-BITS) / (1 - 2**-BITS).

A text without words has the empty fingerprint; its likeness is 1 to another empty one and 0 to any other. Null counts
as empty text. Rows with one document id are ordered by text; a null id comes first. A table of one row has itself as
next document; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlens.llm import common as C

WIDTH, BINS, BITS = 5, 256, 4
_BIN_BITS = BINS.bit_length() - 1
_EMPTY = np.uint64((1 << 64) - 1)


def _probe(step: int) -> np.ndarray:
    """The bin that each empty bin looks at in this step."""
    return (C.mix(np.arange(BINS, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(step * 977 + 1)) % np.uint64(BINS)).astype(np.int64)


def densified(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Least value of each bin, (rows, BINS), with empty bins filled; every row must have a shingle."""
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
    bins = (hashes >> np.uint64(64 - _BIN_BITS)).astype(np.int64)
    table = np.full((len(at) - 1) * BINS, _EMPTY)
    np.minimum.at(table, rows * BINS + bins, hashes & np.uint64((1 << (64 - _BIN_BITS)) - 1))
    table = table.reshape(-1, BINS)
    full = table != _EMPTY
    row, col = np.nonzero(~full)
    step = 0
    while len(row):
        source = _probe(step)[col]
        found = full[row, source]
        table[row[found], col[found]] = table[row[found], source[found]]
        row, col = row[~found], col[~found]
        step += 1
    return table


def fingerprints(texts: list[str]) -> np.ndarray:
    """Packed low bits, (texts, BINS * BITS / 8), and an all-zero row with flag False for texts without words."""
    data, at = C.text_bytes(pa.array(texts, pa.large_string()))
    words, begins = C.word_hashes(data, at)
    hashes, places = C.shingle_hashes(words, begins, WIDTH)
    full = np.diff(places) > 0
    low = np.zeros((len(texts), BINS), np.uint8)
    if full.any():
        low[full] = densified(hashes, np.append(places[:-1][full], places[-1])) & np.uint64((1 << BITS) - 1)
    return low, full


def as_text(low: np.ndarray, full: np.ndarray) -> list[str]:
    per_byte = 8 // BITS
    packed = np.zeros((len(low), BINS // per_byte), np.uint8)
    for k in range(per_byte):
        packed |= low[:, k::per_byte] << (BITS * (per_byte - 1 - k))
    return [p.tobytes().hex() if f else "" for p, f in zip(packed, full)]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Estimated Jaccard similarity of rows, 0 to 1."""
    chance = 2.0 ** -BITS
    share = (a[0] == b[0]).mean(axis=1)
    value = np.clip((share - chance) / (1 - chance), 0, 1)
    return np.where(a[1] & b[1], value, (a[1] == b[1]).astype(float))


_FIELDS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
#: Rows of the first pass: finished documents, and the first and last text of each range partition.
_SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double,"
           " near_next double, kind int, part long, text string")


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many of the next document's first ones (or all it has)."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def _described(ids: list, texts: list[str], following: list[str]) -> list[pa.Array]:
    changed = [edited(a, b) for a, b in zip(texts, following)]
    own, new, after = fingerprints(texts), fingerprints(changed), fingerprints(following[-1:])
    beside = [np.concatenate([o[1:], a]) for o, a in zip(own, after)]
    return [pa.array(c, t) for c, t in zip((
        ids, [len(t) for t in texts], [hashlib.sha256(t.encode()).hexdigest() for t in changed], as_text(*own), as_text(*new),
        likeness(own, new), likeness(own, tuple(beside))), _TYPES)]


def _blocks(texts: list[str], limit: int = 2 << 20):
    """Runs of rows with a bounded number of characters."""
    i = 0
    while i < len(texts):
        j, size = i + 1, len(texts[i])
        while j < len(texts) and size + len(texts[j]) <= limit:
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of (doc_id, text), of the edited texts, and likeness to these and to the next document.

    Rows are sorted in range partitions, so a document and its successor are neighbours; only the last document of a
    partition waits for the first one of the next partition that has rows, and these pairs are joined afterwards.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def inside(batches):
        part = TaskContext.get().partitionId()
        held: tuple | None = None
        first = True

        def edge(kind, row):
            values = [pa.array([row[0]], pa.int64())] + [pa.nulls(1, t) for t in _TYPES[1:]]
            values += [pa.array([kind], pa.int32()), pa.array([part], pa.int64()), pa.array([row[1]])]
            return pa.RecordBatch.from_arrays(values, [*_FIELDS, "kind", "part", "text"])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if not ids:
                continue
            if first:
                yield edge(1, (ids[0], texts[0]))
                first = False
            if held:
                ids, texts = [held[0], *ids], [held[1], *texts]
            held = (ids[-1], texts[-1])
            for i, j in _blocks(texts[:-1]):
                values = _described(ids[i:j], texts[i:j], texts[i + 1:j + 1])
                n = j - i
                values += [pa.array([0] * n, pa.int32()), pa.array([part] * n, pa.int64()), pa.nulls(n, pa.string())]
                yield pa.RecordBatch.from_arrays(values, [*_FIELDS, "kind", "part", "text"])
        if held:
            yield edge(2, held)

    def across(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays(
                    _described(*(one.column(c).to_pylist() for c in ("doc_id", "text", "following"))), _FIELDS)

    ordered = docs.repartitionByRange(C.shuffle_parts(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    rows = C.saved(ordered.mapInArrow(inside, _SCHEMA), "fingerprints")
    # One row per partition from here on.
    firsts = rows.filter("kind = 1").select(F.col("part").alias("after"), F.col("text").alias("following"))
    parts = rows.filter("kind = 1").select("part")
    order = Window.orderBy("part")
    follow = parts.select("part", F.lead("part").over(order).alias("after"), F.min("part").over(Window.partitionBy()).alias("lowest"))
    follow = follow.select("part", F.coalesce("after", "lowest").alias("after"))
    lasts = rows.filter("kind = 2").select("doc_id", "text", "part").join(follow, "part").join(firsts, "after")
    schema = _SCHEMA.split(", kind")[0]
    closing = lasts.select("doc_id", "text", "following").mapInArrow(across, schema)
    return rows.filter("kind = 0").select(*_FIELDS).unionByName(closing)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
