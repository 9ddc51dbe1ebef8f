"""Exclusive running totals per group, as a scan of two levels over range partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.session import cut_lineage


def running_totals(
    df: DataFrame, by: list[str], order: str, tie: Column, sums: dict[str, Column], parts: int | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add, for each row, the sums over the rows before it in its group; ``keep`` names the columns that are wanted, all by default.

    Rows are ordered by ``order`` (NULL last) and then by ``tie``, a hash of the row key. They are dealt once into ranges of
    (group, order, tie), so a group with many rows is several parts, whatever its order values are. The window runs inside the
    group's share of a part; only the first group of a part has rows before it elsewhere, and adds the totals of its earlier
    parts. The rows are read for the ranges and once more to be written; all else reads what was written. ``parts`` is the
    number of ranges (by default that of shuffle partitions).
    """
    # A struct compares equal where its NULL fields do, so rows without a key form a group too.
    group = F.struct(*by) if by else F.lit(0)
    keep = df.columns if keep is None else keep
    work = df.select(*keep, F.col(order).alias("_order"), tie.alias("_tie"), group.alias("_group"),
                     *[value.alias(f"_v_{name}") for name, value in sums.items()])
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = work.repartitionByRange(parts, F.col("_group"), F.col("_order").asc_nulls_last(), F.col("_tie"))
    placed = cut_lineage(ranged.withColumn("_part", F.spark_partition_id()))

    totals = placed.groupBy("_group", "_part").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    earlier = totals.select(
        "_group", "_part", *[_before(f"_t_{n}", ["_group"], ["_part"], f"_off_{n}") for n in sums],
        F.row_number().over(Window.partitionBy("_group").orderBy("_part")).alias("_nth"),
    )
    # A part has one group at most that began in an earlier part, so these are no more rows than parts.
    carried = F.broadcast(earlier.filter("_nth > 1").drop("_nth"))
    rows = placed.select("*", *[_before(f"_v_{n}", ["_part", "_group"], ["_order", "_tie"], f"_in_{n}") for n in sums])
    return rows.join(carried, ["_group", "_part"], "left").select(
        *keep, *[(F.col(f"_in_{n}") + F.coalesce(F.col(f"_off_{n}"), F.lit(0))).alias(n) for n in sums])


def _before(value: str, by: list[str], order: list[str], name: str) -> Column:
    window = (
        Window.partitionBy(*by)
        .orderBy(*[F.col(o).asc_nulls_last() for o in order])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return F.coalesce(F.sum(value).over(window), F.lit(0)).alias(name)
