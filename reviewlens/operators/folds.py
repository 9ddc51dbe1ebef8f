"""Validation folds that depend on keys and dates, never on row position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.operators.running import running_totals


def hash_bucket(hex_hash: Column, k: int) -> Column:
    return F.pmod(F.conv(F.substring(hex_hash, 1, 8), 16, 10).cast("long"), F.lit(k))


def hash_folds(df: DataFrame, hex_hash: Column, k: int, out: str = "fold") -> DataFrame:
    """Shuffled k-fold: the fold is a function of the row key. No shuffle."""
    return df.withColumn(out, hash_bucket(hex_hash, k))


def year_fold_table(spark: SparkSession, years: list[int]) -> DataFrame:
    return spark.createDataFrame([(i, y) for i, y in enumerate(years)], "fold int, val_year int")


def present_years(df: DataFrame, year: str, years: DataFrame) -> DataFrame:
    """The folds whose validation year has rows."""
    return years.join(df.select(F.col(year).alias("val_year")).distinct(), "val_year", "left_semi")


def time_folds(df: DataFrame, year: str, folds: DataFrame) -> DataFrame:
    """Rows of every expanding fold: earlier years train, the fold's year validates.

    A row appears once per fold it takes part in. Years without rows give no fold, NULL years take no
    part. ``folds`` is one row per fold.
    """
    folds = present_years(df, year, folds)
    out = df.join(F.broadcast(folds), F.col(year) <= F.col("val_year"))
    role = F.when(F.col(year) == F.col("val_year"), "validate").otherwise("train")
    return out.withColumn("role", role)


def last_years(df: DataFrame, year: str, n: int) -> DataFrame:
    """Fold table of the last ``n`` years that occur, oldest first."""
    years = df.filter(F.col(year).isNotNull()).select(F.col(year).alias("val_year")).distinct()
    last = years.orderBy(F.col("val_year").desc()).limit(n)
    # n rows in one array: the position in it is the fold number.
    return last.agg(F.sort_array(F.collect_list("val_year")).alias("y")).select(
        F.posexplode("y").alias("fold", "val_year")
    )


def group_folds(df: DataFrame, key: str, k: int, out: str = "fold", parts: int | None = None) -> DataFrame:
    """(key, size, fold): whole groups, dealt out by falling size in a back-and-forth order.

    The position of a group is the number of larger groups plus its position among the groups of its
    own size, which is ordered by hash, so the ranking never needs all groups in one task.
    """
    sizes = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.withColumn("_hash", F.md5(F.col(key).cast("string")))
    within = running_totals(
        sizes, ["size"], "_hash", F.col("_hash"), {"_at": F.lit(1)}, parts
    )
    # One row per distinct size; the sizes add up to the number of rows, so there are few of them.
    per_size = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("_groups"))
    larger = running_totals(
        per_size.withColumn("_falling", -F.col("size")), [], "_falling", F.lit(""), {"_larger": F.col("_groups")}
    ).select("size", "_larger")
    position = F.col("_larger") + F.col("_at")
    lap, step = F.floor(position / k), F.pmod(position, F.lit(k))
    fold = F.when(F.pmod(lap, F.lit(2)) == 0, step).otherwise(k - 1 - step)
    return within.join(larger, "size").select(key, "size", fold.cast("int").alias(out))


def stratified_folds(
    df: DataFrame, label: str, hex_hash: Column, k: int, out: str = "fold", parts: int | None = None
) -> DataFrame:
    """Rows of each label dealt out in turn, in hash order."""
    hashed = df.withColumn("_hash", hex_hash)
    dealt = running_totals(
        hashed, [label], "_hash", F.col("_hash"), {"_at": F.lit(1)}, parts
    )
    return dealt.withColumn(out, F.pmod(F.col("_at"), F.lit(k)).cast("int")).drop("_at", "_hash")


def weighted_score(scores: DataFrame, score: str, weight: str) -> DataFrame:
    """Weighted mean of metrics: by row share, or by fixed scheme weights."""
    return scores.agg((F.sum(F.col(score) * F.col(weight)) / F.sum(weight)).alias("weighted_score"))
