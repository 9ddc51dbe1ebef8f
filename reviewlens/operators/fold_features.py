"""Features of expanding time folds, made from the train years of each fold alone.

The rows carry ``fold``; ``folds`` is one row per fold, (fold, val_year). Train is summed once per (column, category, year), for all
columns in one pass; prefix totals over the years then give every fold's statistics, so neither rows nor passes multiply by folds.
A label of a fold's validation year, or of a later one, enters no feature of that fold.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.columns import safe_ratio
from reviewlens.operators import factor as X
from reviewlens.operators.encode import smoothed
from reviewlens.session import cut_lineage


def fold_statistics(train: DataFrame, folds: DataFrame, columns: list[str], target: str, year: str) -> DataFrame:
    """(fold, name, value, s, n): label sum and count per fold and category, stored; ``name`` "" holds the whole fold.

    Rows without a category take no part in it, rows without a year in no fold. Categories enter as text.
    """
    entries = [F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns]
    whole = F.struct(F.lit("").alias("name"), F.lit("").alias("value"))
    long = train.filter(F.col(year).isNotNull()).select(F.explode(F.array(whole, *entries)).alias("e"), F.col(year).alias("y"), F.col(target).alias("t"))
    per_year = long.filter("e.value IS NOT NULL").groupBy("e.name", "e.value", "y").agg(F.sum("t").alias("s"), F.count("t").alias("n"))
    # One row per fold: a handful, fixed by the validation scheme.
    in_fold = per_year.join(F.broadcast(folds), F.col("y") < F.col("val_year"))
    return cut_lineage(in_fold.groupBy("fold", "name", "value").agg(F.sum("s").alias("s"), F.sum("n").alias("n")))


def _with(rows: DataFrame, stats: DataFrame, column: str, out: dict[str, Column]) -> DataFrame:
    """Left join of the statistics of one column; ``out`` may use ``_s`` and ``_n``, null where the fold has no such category."""
    own = stats.filter(F.col("name") == column).select("fold", F.col("value").alias("_value"), F.col("s").alias("_s"), F.col("n").alias("_n"))
    keyed = rows.withColumn("_value", F.col(column).cast("string")).join(own, ["fold", "_value"], "left")
    return keyed.withColumns(out).drop("_value", "_s", "_n")


def fold_encodings(
    rows: DataFrame, train: DataFrame, folds: DataFrame, means: dict[str, float], counts: list[str], target: str, year: str,
    ratios: tuple[str, str] | None = None,
) -> DataFrame:
    """Smoothed means of ``means`` (column -> weight of the prior), review counts, and ratios of (critic, movie) if named.

    A category that the fold's train rows lack has the fold's mean and the count 0.
    """
    columns = list(dict.fromkeys([*means, *counts, *(ratios or ())]))
    stats = fold_statistics(train, folds, columns, target, year)
    prior = stats.filter("name = ''").select("fold", (F.col("s") / F.col("n")).alias("_prior"))
    df = rows.join(F.broadcast(prior), "fold", "left")
    zero = F.lit(0)
    for column in columns:
        out = {}
        if column in means:
            out[f"{column}_te"] = smoothed(F.coalesce("_s", zero), F.coalesce("_n", zero), F.col("_prior"), means[column])
        if column in counts:
            out[f"{column}_review_count"] = F.coalesce("_n", zero)
        if ratios and column == ratios[0]:
            out["critic_avg_fresh"] = F.coalesce(F.col("_s") / F.col("_n"), F.col("_prior"))
        df = _with(df, stats, column, out)
    if ratios:
        critic, movie = ratios
        df = df.withColumns({
            "ratio_movie_te_to_critic": safe_ratio(F.col(f"{movie}_te"), F.col("critic_avg_fresh")),
            "ratio_movie_te_to_global": F.try_divide(f"{movie}_te", "_prior"),
            "ratio_critic_te_to_global": F.try_divide(f"{critic}_te", "_prior"),
        })
    return df.drop("_prior")


def fold_factors(
    rows: DataFrame, train: DataFrame, folds: DataFrame, critic: str, movie: str, year: str,
    fit: Callable[[DataFrame], tuple[DataFrame, DataFrame, Column, Column]], out: tuple[str, str],
) -> DataFrame:
    """Factor vectors of both sides, fitted per fold; ``fit`` takes the pairs of a fold and returns factors and defaults of both."""
    done = []
    for r in folds.collect():
        pairs = X.interactions([train.filter(F.col(year) < r.val_year)], critic, movie)
        critics, movies, no_critic, no_movie = fit(pairs)
        part = X.attach_factors(rows.filter(F.col("fold") == r.fold), critics, critic, "vector", out[0], no_critic)
        done.append(cut_lineage(X.attach_factors(part, movies, movie, "vector", out[1], no_movie)))
    return reduce(DataFrame.unionByName, done)


def svd_fit(k: int, size: int = 2000, critic: str = "critic", movie: str = "movie"):
    """Neighbour documents of the fold: zeros for unseen critics, column means for unseen movies."""

    def fit(pairs: DataFrame):
        critics = cut_lineage(X.neighbour_factors(pairs, critic, movie, k, size))
        movies = cut_lineage(X.neighbour_factors(pairs, movie, critic, k, size))
        return critics, movies, F.array_repeat(F.lit(0.0), k), X.column_means(movies, "vector")

    return fit


def nmf_fit(k: int, iterations: int = 50, critic: str = "critic", movie: str = "movie"):
    """Non-negative factors of the fold: zeros for unseen critics, the mean of all entries for unseen movies."""

    def fit(pairs: DataFrame):
        critics, movies = X.non_negative_factors(pairs.withColumn("value", F.lit(1.0)), critic, movie, "value", k, iterations)
        overall = movies.select(F.explode("vector").alias("x")).agg(F.avg("x")).scalar()
        return critics, movies, F.array_repeat(F.lit(0.0), k), F.array_repeat(overall, k)

    return fit
