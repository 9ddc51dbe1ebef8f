"""Shards along a Hilbert curve over metadata, for file pruning in several dimensions.

Each dimension is quantised at its own quantiles, the cells are numbered along the curve, and the table is sorted by
curve index and document id. The sorted table is cut into runs with row counts at most one apart; every run is a folder
of Parquet files whose minima and maxima are narrow in all dimensions at once.

Numeric dimensions are taken as they are, strings by the order of their first seven bytes. Nulls form the lowest cell.
Null text has size 1 and checksum 0. Equal and repeated rows are neighbours and count each on their own; an empty table
gives no rows. Extra columns are written along (the names ``shard`` and ``slot`` are taken by this operator).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.llm import common as C

SHARDS = 16
DIMENSIONS = ("source", "lang", "n_chars", "doc_id")
#: Bits for each dimension; cells of a dimension hold about equally many rows.
BITS = 8


def as_number(docs: DataFrame, name: str) -> Column:
    """A long whose order is that of the column; null is the lowest."""
    lowest = F.lit(-(1 << 62))
    kind = docs.schema[name].dataType
    if isinstance(kind, T.StringType):
        head = F.rpad(F.hex(F.substring(F.encode(name, "UTF-8"), 1, 7)), 14, "0")
        return F.coalesce(F.conv(head, 16, 10).cast("long"), lowest)
    return F.coalesce(F.col(name).cast("long"), lowest)


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the curve of each cell; ``cells`` has one row per dimension, values below ``2**bits``.

    Works on the transposed index: from the highest bit down, the part of the curve that a bit selects is reflected or has
    two axes exchanged; Gray decoding and interleaving of the bits follow.
    """
    x = cells.astype(np.int64).copy()
    n = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap if i else 0
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn = np.where(x[n - 1] & q, turn ^ (q - 1), turn)
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve_column(docs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> Column:
    """Curve index of each row. One aggregation finds the quantiles, ``2**bits - 1`` numbers for each dimension."""
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = docs.agg(*[F.percentile_approx(as_number(docs, d), shares).alias(d) for d in dimensions]).first()
    cuts = [np.array(found[d] or [], np.int64) for d in dimensions]

    @F.pandas_udf("long")
    def index(*values: pd.Series) -> pd.Series:
        # A frequent value takes many cuts; it stands in the middle of them, so that every dimension fills its range.
        cells = np.stack([(np.searchsorted(c, v.to_numpy()) + np.searchsorted(c, v.to_numpy(), side="right")) // 2
                          for c, v in zip(cuts, values)])
        return pd.Series(hilbert_index(cells, bits))

    return index(*[as_number(docs, d) for d in dimensions])


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """Write ``docs`` with ``slot`` to ``path/shard=N`` in curve order and return the table read back."""
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    # The input travels in one struct, so that no column of it meets a name of this function.
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    docs = docs.select(held, curve_column(docs, dimensions).alias("_curve"))
    ties = [f"_doc.{c}" for c in ("doc_id", "text") if c in docs.schema["_doc"].dataType.names]
    # Position: the number of the range partition and the row's place in it.
    ordered = docs.repartitionByRange(C.shuffle_parts(spark), "_curve", *ties[:1]).sortWithinPartitions("_curve", *ties)
    placed = C.saved(ordered.drop("_curve").withColumn("_at", F.monotonically_increasing_id()), "curve")
    part = F.shiftright("_at", 33)
    base = C.number_parts(placed.select(part.alias("_part")), "_part")
    total = placed.count()
    rank = F.col("base") + F.col("_at").bitwiseAND((1 << 33) - 1)
    # Whole numbers only, so that shard s begins exactly at the first rank r with r * shards >= s * total.
    shard = F.expr(f"_rank * {shards}L div {max(total, 1)}L").cast("int")
    first = F.expr(f"(_shard * {total}L + {shards - 1}L) div {shards}L")
    cut = placed.withColumn("_part", part).join(F.broadcast(base), "_part").withColumn("_rank", rank).withColumn("_shard", shard)
    cut = cut.select("_doc.*", F.col("_shard").alias("shard"), (F.col("_rank") - first).alias("slot"))
    cut.write.partitionBy("shard").parquet(path)
    return spark.read.schema(cut.schema).parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = write_shards(docs, C.new_path(spark, "shards"))
    text = F.coalesce("text", F.lit(""))
    return rows.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
