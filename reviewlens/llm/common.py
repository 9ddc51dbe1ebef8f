"""Shared helpers: scratch tables, numbering over ordered partitions, words and shingles of Arrow text columns."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_SPACES = b" \t\n\x0b\x0c\r"
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_local: list[str] = []


# ---------------------------------------------------------------- tables in the shared folder


def shared_folder(spark: SparkSession) -> str:
    """Folder of ``spark.checkpoint.dir``; where it is unset, a temporary one on a single machine, an error elsewhere."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return _local[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str = "step") -> DataFrame:
    """Write the frame once to the shared folder and read it: a lost executor costs a re-read, not a replay."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- numbering without one large task


def number_parts(df: DataFrame, part: str, weight: str | None = None, name: str = "base") -> DataFrame:
    """Rows of (part, base, n): ``base`` counts rows (or sums ``weight``) of all parts before.

    ``part`` is the number of an ordered partition, so the frame that the window sees has one row per partition.
    """
    from pyspark.sql import Window

    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    per_part = df.groupBy(part).agg(n.cast("long").alias("n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(name), "n")


def rank_within(df: DataFrame, key: str, tie: str, rank: str = "rank", buckets: int = 256) -> DataFrame:
    """Number the rows of each key from 0, in any order, without bringing a hot key into one task.

    Rows are cut by the hash of ``tie``; each (key, bucket) is numbered alone and starts behind the buckets before it.
    The counts table has at most ``buckets`` rows per key.
    """
    from pyspark.sql import Window

    cut = df.withColumn("_b", F.pmod(F.xxhash64(tie), F.lit(buckets)))
    inside = cut.withColumn("_r", F.row_number().over(Window.partitionBy(key, "_b").orderBy(tie)) - 1)
    counts = cut.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(key, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    return inside.join(starts, [key, "_b"]).withColumn(rank, F.col("_r") + F.col("_s")).drop("_b", "_r", "_s")


# ---------------------------------------------------------------- text columns as bytes


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values end to end and the n + 1 places where they begin; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    size = np.int64 if large else np.int32
    buffers = column.buffers()
    at = np.frombuffer(buffers[1], size, len(column) + 1, column.offset * size().itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    if buffers[2] is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(buffers[2], np.uint8)[at[0]:at[-1]], at - at[0]


def row_blocks(at: np.ndarray, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most ``limit`` bytes (one row alone may have more)."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEGMENT = 1 << 20
_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 64), _BASE, np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps)
    return _powers


_IS_WORD = np.ones(256, bool)
_IS_WORD[list(WORD_SPACES)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: np.ndarray, at: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of each row, and the n + 1 places where rows begin."""
    return word_spans(data, at, lower)[:2]


def word_spans(
    data: np.ndarray, at: np.ndarray, lower: bool = False, spaces: bytes = WORD_SPACES,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``word_hashes``, with the first byte and the number of bytes of each word; words lie between bytes of ``spaces``.

    A word's hash is a sum over its bytes, so a row is read in segments of fixed size and a word may cross them.
    """
    hashes, begins, sizes = [], [], []
    in_word = _IS_WORD
    if spaces != WORD_SPACES:
        in_word = np.ones(256, bool)
        in_word[list(spaces)] = False
    open_len, total = 0, len(data)
    inner = at[1:-1]
    for lo in range(0, total, _SEGMENT):
        seg = data[lo:lo + _SEGMENT]
        if lower:
            seg = _LOWER[seg]
        inside = in_word[seg]
        before = np.empty_like(inside)
        before[1:] = inside[:-1]
        before[0] = False
        a, b = np.searchsorted(inner, [lo, lo + len(seg)])
        cuts = inner[a:b] - lo
        before[cuts] = False
        starts = np.flatnonzero(inside & ~before)
        goes_on = open_len > 0 and len(seg) and inside[0] and not (len(cuts) and cuts[0] == 0)
        if not len(starts):
            open_len = 0
            continue
        flat = seg[inside].astype(np.uint64) + np.uint64(1)
        first = np.cumsum(inside)[starts] - 1
        lens = np.diff(np.append(first, len(flat)))
        pw = _power_table(int(lens.max()) + 1)
        rel = np.arange(len(flat)) - np.repeat(first, lens)
        h = np.add.reduceat(flat * pw[rel], first)
        if goes_on:
            carried = (int(h[0]) * pow(_BASE, open_len, 1 << 64)) & _MASK
            hashes[-1][-1] = (int(hashes[-1][-1]) + carried) & _MASK
            sizes[-1][-1] += lens[0]
            kept, kept_starts, kept_lens = h[1:], starts[1:], lens[1:]
        else:
            kept, kept_starts, kept_lens = h, starts, lens
        if inside[-1]:
            open_len = int(lens[-1]) + (open_len if goes_on and len(h) == 1 else 0)
        else:
            open_len = 0
        if len(kept):
            hashes.append(kept)
            begins.append(kept_starts + lo)
            sizes.append(kept_lens)
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64), none, none
    begin = np.concatenate(begins)
    return mix(np.concatenate(hashes)), np.searchsorted(begin, at).astype(np.int64), begin, np.concatenate(sizes)


def shingle_hashes(words: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word windows of each row, in text order, and where rows begin.

    A row with fewer words gives its whole sequence as one shingle; a row without words gives none.
    """
    n = np.diff(at)
    counts = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out_at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    factors = mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    out = np.empty(out_at[-1], np.uint64)
    whole = len(words) - width + 1
    if whole > 0:
        acc = words[:whole] * factors[0]
        for k in range(1, width):
            acc += words[k:k + whole] * factors[k]
        full = n >= width
        keep = np.zeros(whole + 1, np.int32)
        np.add.at(keep, at[:-1][full], 1)
        np.add.at(keep, at[1:][full] - width + 1, -1)
        inside = np.cumsum(keep[:whole]) > 0
        places = np.ones(len(out), bool)
        places[out_at[:-1][(n < width) & (n > 0)]] = False
        out[places] = mix(acc[inside])
    for i in np.flatnonzero((n < width) & (n > 0)):
        own = words[at[i]:at[i + 1]]
        out[out_at[i]] = mix(np.array([np.add.reduce(own * factors[:len(own)]) + np.uint64(len(own))], np.uint64))[0]
    return out, out_at
