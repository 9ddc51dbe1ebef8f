"""Category encodings that do not leak labels, and aggregates over the review graph.

Encoders come in two halves: a statistics table made from the train rows, and its application to any
rows by a left join. Statistics are grouped sums, so Spark adds them up before the shuffle and a
category with a third of all rows costs no more than a small one. Joins carry no broadcast hint: the
tables grow with the number of categories, and Spark picks the strategy by their measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.columns import TARGET_MEAN_EDGES, clip_ratio, right_closed_bin, safe_ratio
from reviewlens.operators.running import running_totals
from reviewlens.session import cut_lineage


def mean_of(train: DataFrame, value: str) -> Column:
    """Mean over all train rows, as a scalar subquery."""
    return train.agg(F.avg(value).alias("mean")).scalar()


def smoothed(total: Column, count: Column, prior: Column, m: float) -> Column:
    return (total + m * prior) / (count + m)


def category_sums(train: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sum and count of ``value`` per category; rows without a key take no part."""
    for k in keys:
        train = train.filter(F.col(k).isNotNull())
    return train.groupBy(*keys).agg(F.sum(value).alias("_sum"), F.count(value).alias("_count"))


def target_means(train: DataFrame, keys: list[str], target: str, m: float, out: str) -> DataFrame:
    """Statistics table of the smoothed target mean."""
    stats = category_sums(train, keys, target)
    return stats.select(*keys, smoothed(F.col("_sum"), F.col("_count"), mean_of(train, target), m).alias(out))


def lookup(df: DataFrame, stats: DataFrame, keys: list[str], default: dict[str, Column | float]) -> DataFrame:
    """Left join of a statistics table; ``default`` fills categories it does not hold."""
    joined = df.join(stats, keys, "left")
    columns = {
        name: F.coalesce(F.col(name), fill if isinstance(fill, Column) else F.lit(fill))
        for name, fill in default.items()
    }
    return joined.withColumns(columns)


def target_encode(df: DataFrame, train: DataFrame, keys: list[str], target: str, m: float, out: str) -> DataFrame:
    """Smoothed target mean of train on any rows; unseen categories get the train mean."""
    return lookup(df, target_means(train, keys, target, m, out), keys, {out: mean_of(train, target)})


def time_ordered_target_encode(
    train: DataFrame,
    key: str,
    target: str,
    order: str,
    tie: Column,
    out: str,
    m: float = 10,
    prior: Column | None = None,
    parts: int | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Smoothed mean over the strictly earlier rows of the category; no history gives the prior.

    ``keep`` names the columns wanted beside the key, all by default; the others are not moved.
    """
    prior = mean_of(train, target) if prior is None else prior
    df = running_totals(
        train, [key], order, tie, {"_past_sum": F.col(target), "_past_count": F.lit(1)}, parts,
        None if keep is None else [key, *keep],
    )
    known = F.col(key).isNotNull() & (F.col("_past_count") > 0)
    value = F.when(known, smoothed(F.col("_past_sum"), F.col("_past_count"), prior, m)).otherwise(prior)
    return df.withColumn(out, value).drop("_past_sum", "_past_count")


def with_bin(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(f"{name}_bin", right_closed_bin(name, TARGET_MEAN_EDGES))


def prior_rate(
    train: DataFrame, key: str, target: str, order: str, tie: Column, parts: int | None = None
) -> DataFrame:
    """Count and unsmoothed positive rate of the earlier rows with the same key."""
    df = running_totals(
        train, [key], order, tie, {"_past_sum": F.col(target), "prior_count": F.lit(1)}, parts
    )
    known = F.col(key).isNotNull()
    return (
        df.withColumn("prior_count", F.when(known, F.col("prior_count")).otherwise(0))
        .withColumn(
            "prior_rate",
            F.coalesce(F.try_divide(F.when(known, F.col("_past_sum")), F.col("prior_count")), mean_of(train, target)),
        )
        .drop("_past_sum")
    )


def total_rate(df: DataFrame, train: DataFrame, key: str, target: str) -> DataFrame:
    """The held-out form of ``prior_rate``: totals of train."""
    stats = category_sums(train, [key], target).select(
        key, F.col("_count").alias("prior_count"), (F.col("_sum") / F.col("_count")).alias("prior_rate")
    )
    return lookup(df, stats, [key], {"prior_count": 0, "prior_rate": mean_of(train, target)})


def frequency_encode(df: DataFrame, train: DataFrame, key: str, out: str | None = None) -> DataFrame:
    out = out or f"{key}_freq"
    stats = train.groupBy(key).agg(F.count(F.lit(1)).alias(out))
    return lookup(df, stats, [key], {out: 0})


def group_totals(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sum and count of the group on each of its rows.

    A grouped sum joined back, not a window: a window would send every row of a hot key to one task.
    """
    stats = category_sums(df, keys, value).withColumnsRenamed({"_sum": "group_sum", "_count": "group_count"})
    return df.join(stats, keys, "left")


def leave_one_out_encode(
    train: DataFrame, keys: list[str], target: str, out: str, m: float = 5, prior: Column | None = None
) -> DataFrame:
    """Mean of the other rows of the category, smoothed with the full category count."""
    prior = mean_of(train, target) if prior is None else prior
    df = group_totals(train, keys, target)
    n, total = F.col("group_count"), F.col("group_sum")
    raw = F.when(n > 1, F.try_divide(total - F.col(target), n - 1)).otherwise(prior)
    return df.withColumn(out, smoothed(n * raw, n, prior, m)).drop("group_count", "group_sum")


def out_of_fold_encode(
    train: DataFrame, keys: list[str], target: str, fold: str, out: str, m: float = 10, prior: Column | None = None,
    base: DataFrame | None = None,
) -> DataFrame:
    """Smoothed mean of the rows in the other folds.

    One pass for all folds: the sums of a category minus its sums inside the row's own fold. ``base``
    holds the same rows before earlier encoders were joined to them, to take the sums from.
    """
    prior = mean_of(train, target) if prior is None else prior
    inside = category_sums(train if base is None else base, [*keys, fold], target)
    whole = inside.groupBy(*keys).agg(F.sum("_sum").alias("_all_sum"), F.sum("_count").alias("_all_count"))
    stats = inside.join(whole, keys).select(
        *keys, fold, (F.col("_all_sum") - F.col("_sum")).alias("_s"), (F.col("_all_count") - F.col("_count")).alias("_n")
    )
    df = train.join(stats, [*keys, fold], "left")
    value = F.when(F.col("_n") > 0, smoothed(F.col("_s"), F.col("_n"), prior, m)).otherwise(prior)
    return df.withColumn(out, value).drop("_s", "_n")


def fold_target_encode(
    rows: DataFrame,
    train: DataFrame,
    folds: DataFrame,
    keys: list[str],
    target: str,
    year: str,
    out: str,
    m: float = 10,
) -> DataFrame:
    """Encode the rows of every expanding time fold with statistics of that fold's train years only.

    ``rows`` carries a ``fold`` column, ``folds`` holds (fold, val_year). Train is summed per category
    and year first, so the years, not the rows, are repeated per fold. NULL years belong to no fold.
    """
    per_year = (
        train.filter(F.col(year).isNotNull())
        .groupBy(*keys, F.col(year).alias("_year"))
        .agg(F.sum(target).alias("_s"), F.count(target).alias("_n"))
    )
    # One row per fold: a handful, fixed by the validation scheme.
    in_fold = per_year.join(F.broadcast(folds), F.col("_year") < F.col("val_year"))
    prior = in_fold.groupBy("fold").agg((F.sum("_s") / F.sum("_n")).alias("_prior"))
    stats = in_fold.groupBy("fold", *keys).agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    df = rows.join(F.broadcast(prior), "fold", "left").join(stats, ["fold", *keys], "left")
    value = F.when(F.col("_n").isNotNull(), smoothed(F.col("_s"), F.col("_n"), F.col("_prior"), m)).otherwise(
        F.col("_prior")
    )
    return df.withColumn(out, value).drop("_s", "_n", "_prior")


def ratio_to_own_mean(df: DataFrame, train: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Value over the key's train mean of it, clipped to [0, 1e6]; unseen keys use the train mean."""
    stats = train.groupBy(key).agg(F.avg(value).alias("_own_mean"))
    df = lookup(df, stats, [key], {"_own_mean": mean_of(train, value)})
    return df.withColumn(out, clip_ratio(safe_ratio(F.col(value), F.col("_own_mean")))).drop("_own_mean")


def encoding_ratios(
    df: DataFrame, train: DataFrame, critic: str, movie_te: str, critic_te: str, target: str
) -> DataFrame:
    """Movie encoding over the critic's mean, and both encodings over the train mean."""
    means = category_sums(train, [critic], target).select(
        critic, (F.col("_sum") / F.col("_count")).alias("critic_avg_fresh")
    )
    prior = mean_of(train, target)
    df = lookup(df, means, [critic], {"critic_avg_fresh": prior})
    return df.withColumns(
        {
            "ratio_movie_te_to_critic": safe_ratio(F.col(movie_te), F.col("critic_avg_fresh")),
            "ratio_movie_te_to_global": F.col(movie_te) / prior,
            "ratio_critic_te_to_global": F.col(critic_te) / prior,
        }
    )


def two_hop(
    df: DataFrame,
    train: DataFrame,
    movie: str,
    values: dict[str, str],
    count: str | None = None,
    leave_one_out: bool = False,
) -> DataFrame:
    """Mean of train values over all reviews of the movie, and their number.

    ``values`` maps output name to train column; only what is asked for is computed. Unseen movies get
    the mean over movies, each movie counting once. ``leave_one_out`` takes the row's own value out;
    use it on the train rows only.
    """
    # Written once, as the join and the overall mean both read it: the plan of ``train`` may be a long one.
    stats = cut_lineage(train.groupBy(movie).agg(
        *[F.sum(v).alias(f"_s_{o}") for o, v in values.items()],
        *[F.count(v).alias(f"_n_{o}") for o, v in values.items()],
        F.count(F.lit(1)).alias("_rows"),
    ))
    means = {o: F.try_divide(F.col(f"_s_{o}"), F.col(f"_n_{o}")) for o in values}
    overall = stats.agg(
        F.struct(
            *[F.avg(m).alias(o) for o, m in means.items()], F.avg(F.col("_rows").cast("double")).alias("_rows")
        ).alias("means")
    ).scalar()
    df = df.join(stats.filter(F.col(movie).isNotNull()), movie, "left").withColumn("_overall", overall)
    out = {}
    for o, v in values.items():
        mean = means[o]
        if leave_one_out:
            mean = F.try_divide(F.col(f"_s_{o}") - F.col(v), F.col(f"_n_{o}") - 1)
        out[o] = F.coalesce(mean, F.col(f"_overall.{o}"))
    if count:
        rows = F.col("_rows") - 1 if leave_one_out else F.col("_rows")
        out[count] = F.coalesce(rows.cast("double"), F.col("_overall._rows"))
    df = df.withColumns(out)
    return df.drop("_rows", "_overall", *[f"_{p}_{o}" for p in "sn" for o in values])


def two_hop_ratio(df: DataFrame, critic_te: str, movie_mean: str, out: str) -> DataFrame:
    """Critic encoding over the movie's mean of it. A zero or unknown mean counts as 1."""
    divisor = F.coalesce(F.nullif(F.col(movie_mean), F.lit(0.0)), F.lit(1.0))
    return df.withColumn(out, F.coalesce(F.col(critic_te) / divisor, F.lit(1.0)))


def metadata_two_hop(train: DataFrame, critic: str, movie: str, values: list[str]) -> DataFrame:
    """Per movie: the mean, over its reviews, of its critics' mean movie metadata. Uses no label."""
    per_critic = train.groupBy(critic).agg(*[F.avg(v).alias(f"_{v}") for v in values])
    pairs = train.groupBy(critic, movie).agg(F.count(F.lit(1)).alias("_w"))
    known = pairs.join(per_critic, critic)
    return known.groupBy(movie).agg(
        *[
            F.try_divide(
                F.sum(F.col(f"_{v}") * F.col("_w")), F.sum(F.when(F.col(f"_{v}").isNotNull(), F.col("_w")))
            ).alias(f"{v}_two_hop")
            for v in values
        ]
    )


def neighbour_profile(
    train: DataFrame, key: str, neighbour: str, target: str, edges: tuple[float, ...], high: int = 50
) -> DataFrame:
    """Per key: rows, distinct neighbours, count bin, high-volume flag and rate minus the overall rate.

    Counting pairs first keeps the distinct count a plain grouped sum.
    """
    pairs = train.groupBy(key, neighbour).agg(F.count(F.lit(1)).alias("_n"), F.sum(target).alias("_s"))
    stats = pairs.groupBy(key).agg(
        F.sum("_n").alias("rows"), F.count(neighbour).alias("neighbours"), F.sum("_s").alias("_s")
    )
    return stats.select(
        key,
        "rows",
        "neighbours",
        right_closed_bin(F.col("rows"), edges, default=len(edges) - 2).cast("int").alias("count_bin"),
        (F.col("rows") >= high).cast("int").alias("high_volume"),
        (F.col("_s") / F.col("rows") - mean_of(train, target)).alias("centred_rate"),
    )


def class_balance(train: DataFrame, target: str) -> DataFrame:
    """Negatives, positives and the weight of a positive that balances them."""
    return train.agg(
        F.count_if(F.col(target) == 0).alias("n_neg"), F.count_if(F.col(target) == 1).alias("n_pos")
    ).select("n_neg", "n_pos", (F.col("n_neg") / F.greatest(F.col("n_pos"), F.lit(1))).alias("pos_weight"))
