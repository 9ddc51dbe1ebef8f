"""Prediction quality: outcomes, AUC, segment summaries, threshold grids, coverage statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.operators.running import running_totals


def score_counts(df: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score: all that rank metrics need."""
    return df.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"), F.sum((1 - F.col(label)).cast("long")).alias("neg")
    )


def auc_of_counts(counts: DataFrame, by: list[str], out: str = "auc") -> DataFrame:
    """Area under the ROC curve per group, ties averaged, NULL where only one class occurs.

    A positive beats the negatives with lower scores and half of those with its own: one running total over the distinct
    scores, in as many ranges as there are partitions, however the scores cluster.
    """
    below = running_totals(counts, by, "score", F.lit(""), {"_below": F.col("neg")})
    wins = F.sum(F.col("pos") * (F.col("_below") + F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return below.groupBy(*by).agg(F.try_divide(wins, pairs).alias(out))


def average_rank(df: DataFrame, by: list[str], score: str) -> DataFrame:
    """(by, score, n, average_rank): rank of every distinct value in its group from 1, equal values sharing the mean of theirs."""
    counts = df.groupBy(*by, F.col(score).alias("score")).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(counts, by, "score", F.lit(""), {"_before": F.col("n")})
    return ranked.select(*by, "score", "n", (F.col("_before") + (F.col("n") + 1) / 2).alias("average_rank"))


def auc(df: DataFrame, by: list[str], label: str, score: str, out: str = "auc") -> DataFrame:
    return auc_of_counts(score_counts(df, by, label, score), by, out)


def segment_summary(
    df: DataFrame, segments: list[str], label: str, score: str, threshold: float = 0.5, min_count: int = 50
) -> DataFrame:
    """Outcome counts, rates and AUC of every value of every segment column, in one grouped pass.

    The rows of a NULL segment form a group. Groups below ``min_count`` rows are left out. The
    predicted-positive rate is always cut at 0.5, the outcomes at ``threshold``.
    """
    entries = [F.struct(F.lit(s).alias("segment"), F.col(s).cast("string").alias("value")) for s in segments]
    by = ["segment", "value"]
    long = df.select(F.explode(F.array(*entries)).alias("_e"), label, score).select("_e.*", label, score)
    counts = score_counts(long, by, label, score)
    hit = F.col("score") >= threshold
    summary = counts.groupBy(*by).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n"),
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("n_TP"),
        F.sum(F.when(hit, 0).otherwise(F.col("neg"))).alias("n_TN"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("n_FP"),
        F.sum(F.when(hit, 0).otherwise(F.col("pos"))).alias("n_FN"),
        F.sum("pos").alias("_pos"),
        F.sum(F.when(F.col("score") >= 0.5, F.col("pos") + F.col("neg")).otherwise(0)).alias("_hits"),
    )
    areas = auc_of_counts(counts, by)
    joined = summary.filter(F.col("n") >= min_count).alias("s").join(
        areas.alias("a"),
        (F.col("s.segment") == F.col("a.segment")) & F.col("s.value").eqNullSafe(F.col("a.value")),
    )
    return joined.select(
        "s.segment",
        "s.value",
        "n",
        "n_TP",
        "n_TN",
        "n_FP",
        "n_FN",
        ((F.col("n_TP") + F.col("n_TN")) / F.col("n")).alias("accuracy"),
        "auc",
        F.try_divide("n_FP", F.col("n_TN") + F.col("n_FP")).alias("FP_rate"),
        F.try_divide("n_FN", F.col("n_TP") + F.col("n_FN")).alias("FN_rate"),
        (F.col("_pos") / F.col("n")).alias("pos_rate"),
        (F.col("_hits") / F.col("n")).alias("pred_pos_rate"),
    )


def worst_segment(summary: DataFrame) -> DataFrame:
    """Per segment column, the value with the lowest AUC; equal values resolve by name."""
    known = summary.filter(F.col("auc").isNotNull())
    return known.groupBy("segment").agg(
        F.min_by("value", F.struct("auc", "value")).alias("worst_value"), F.min("auc").alias("worst_auc")
    )


def probability_metrics(df: DataFrame, by: list[str], label: str, score: str, eps: float = 1e-15) -> DataFrame:
    """Log loss, Brier score, error rates at 0.5 and the gap between predicted and actual positives."""
    p = F.least(F.lit(1 - eps), F.greatest(F.lit(eps), F.col(score)))
    y, hit = F.col(label), F.col(score) >= 0.5
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(-F.ln(F.when(y == 1, p).otherwise(1 - p))).alias("log_loss"),
        F.avg((F.col(score) - y) * (F.col(score) - y)).alias("brier"),
        F.try_divide(F.count_if(hit & (y == 0)), F.count_if(y == 0)).alias("FP_rate"),
        F.try_divide(F.count_if(~hit & (y == 1)), F.count_if(y == 1)).alias("FN_rate"),
        (F.avg(hit.cast("int")) - F.avg(y)).alias("positive_rate_gap"),
    )


def fold_summary(scores: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and population deviation of a metric over folds or seeds."""
    return scores.groupBy(*by).agg(
        F.avg(value).alias(f"{value}_mean"), F.stddev_pop(value).alias(f"{value}_std")
    )


def threshold_grid(df: DataFrame, score: str, pairs: list[tuple[float, float]]) -> DataFrame:
    """Rows at or beyond each (high, low) pair. All pairs are counted in one pass over the rows."""
    counts = [
        F.struct(
            F.lit(high).alias("high"),
            F.lit(low).alias("low"),
            F.count_if(F.col(score) >= high).alias("n_high"),
            F.count_if(F.col(score) <= low).alias("n_low"),
            F.count(F.lit(1)).alias("n"),
        )
        for high, low in pairs
    ]
    grid = df.agg(F.array(*counts).alias("_g")).select(F.inline("_g"))
    return grid.withColumn("n_both", F.col("n_high") + F.col("n_low")).withColumn(
        "share", F.try_divide(F.col("n_both"), F.col("n"))
    )


def coverage(train: DataFrame, test: DataFrame, key: str, approximate: bool = False) -> DataFrame:
    """Seen and unseen test entities, and the test rows they bring.

    ``approximate`` replaces the exact counts of train and test entities by sketches.
    """
    if approximate:
        a = train.agg(F.approx_count_distinct(key).alias("n_train_keys"))
        b = test.agg(F.approx_count_distinct(key).alias("n_test_keys"))
        return a.select("n_train_keys", b.scalar().alias("n_test_keys"))
    per_key = (
        train.groupBy(key).agg(F.count(F.lit(1)).alias("_tr"), F.lit(0).cast("long").alias("_te"))
        .unionByName(test.groupBy(key).agg(F.lit(0).cast("long").alias("_tr"), F.count(F.lit(1)).alias("_te")))
        .filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.sum("_tr").alias("_tr"), F.sum("_te").alias("_te"))
    )
    in_train, in_test = F.col("_tr") > 0, F.col("_te") > 0
    out = per_key.agg(
        F.count_if(in_train).alias("n_train_keys"),
        F.count_if(in_test).alias("n_test_keys"),
        F.count_if(in_train & in_test).alias("n_seen"),
        F.count_if(in_test & ~in_train).alias("n_unseen"),
        F.sum(F.when(in_train, F.col("_te")).otherwise(0)).alias("rows_seen"),
        F.sum(F.when(in_train, 0).otherwise(F.col("_te"))).alias("rows_unseen"),
    )
    return out.withColumn(
        "rows_seen_pct", F.try_divide(F.col("rows_seen") * 100, F.col("rows_seen") + F.col("rows_unseen"))
    )


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """First n rows of a total order; each task keeps n rows, nothing is sorted as a whole."""
    return df.orderBy(*order).limit(n)
