"""Blending, alignment and verification of prediction sets (one id, one score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.columns import clean_score, confidence, is_confident


def tagged_union(sets: dict[str, DataFrame], key: str, score: str) -> DataFrame:
    """(key, source, score) of all sets."""
    out = None
    for name, df in sets.items():
        part = df.select(key, F.lit(name).alias("source"), F.col(score).cast("double").alias(score))
        out = part if out is None else out.unionByName(part)
    return out


def side_by_side(sets: dict[str, DataFrame], key: str, score: str) -> DataFrame:
    """One row per id that occurs in every set, one column per set.

    An inner join of N sets as one union and one grouped pass: one shuffle whatever N is. Ids must be
    unique in each set, as ``verify`` checks.
    """
    names = list(sets)
    wide = tagged_union(sets, key, score).groupBy(key).agg(
        *[F.max(F.when(F.col("source") == n, F.col(score))).alias(f"_p{i}") for i, n in enumerate(names)],
        *[F.max((F.col("source") == n).cast("int")).alias(f"_in{i}") for i, n in enumerate(names)],
    )
    everywhere = F.lit(True)
    for i in range(len(names)):
        everywhere = everywhere & (F.col(f"_in{i}") == 1)
    return wide.filter(everywhere).select(key, *[F.col(f"_p{i}").alias(n) for i, n in enumerate(names)])


def normal_weights(weights: dict[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    if total == 0:
        raise ValueError("the weights add up to 0")
    return {n: w / total for n, w in weights.items()}


def _mix(weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + F.lit(float(w)) * F.col(name)
    return out


def blend(sets: dict[str, DataFrame], weights: dict[str, float], key: str, score: str) -> DataFrame:
    """Weighted mean over the ids found in all sets; weights are normalized to 1."""
    if set(weights) != set(sets):
        raise ValueError("weights and prediction sets do not match")
    mixed = _mix(normal_weights(weights))
    return side_by_side(sets, key, score).select(key, clean_score(mixed).alias(score))


def blend_pair(a: DataFrame, b: DataFrame, weight_a: float, key: str, score: str) -> DataFrame:
    """weight_a : 1 - weight_a, taken as they are."""
    mixed = _mix({"a": weight_a, "b": 1.0 - weight_a})
    return side_by_side({"a": a, "b": b}, key, score).select(key, clean_score(mixed).alias(score))


def blend_grid(
    sets: dict[str, DataFrame], patterns: dict[str, dict[str, float]], key: str, score: str
) -> DataFrame:
    """(pattern, key, score) for every weight vector. The sets are brought together once for all."""
    wide = side_by_side(sets, key, score)
    entries = [
        F.struct(F.lit(name).alias("pattern"), clean_score(_mix(normal_weights(w))).alias(score))
        for name, w in patterns.items()
    ]
    return wide.select(key, F.inline(F.array(*entries)))


def share_patterns(anchor: str, others: list[str], ratio: list[float], new: str, shares: list[float]) -> dict:
    """Weight vectors with ``new`` at each share and the rest split by ratio. Fixed value: the anchor's weight of .45."""
    out = {}
    for share in shares:
        rest = 1 - 0.45 - share
        weights = {anchor: 0.45, new: share}
        weights.update({o: rest * r / sum(ratio) for o, r in zip(others, ratio)})
        out[f"new_{share:.2f}"] = weights
    return out


def mean_score(scores: DataFrame, key: str, score: str) -> DataFrame:
    """Mean score per id over models, folds or seeds."""
    return scores.groupBy(key).agg(F.avg(score).alias(score))


def align(predictions: DataFrame, ids: DataFrame, key: str, score: str, default: float = 0.5) -> DataFrame:
    """One row per wanted id; ids without a prediction get ``default``."""
    joined = ids.select(key).join(predictions.select(key, score), key, "left")
    return joined.withColumn(score, F.coalesce(F.col(score), F.lit(default)))


def alignment_report(predictions: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """One row: wanted and given ids, missing, extra and repeated ones, from one grouped pass."""
    sides = ids.select(key, F.lit(1).alias("_w"), F.lit(0).alias("_g")).unionByName(
        predictions.select(key, F.lit(0).alias("_w"), F.lit(1).alias("_g"))
    )
    per_key = sides.groupBy(key).agg(F.sum("_w").alias("_w"), F.sum("_g").alias("_g"))
    zero = F.lit(0).cast("long")
    return per_key.agg(
        F.coalesce(F.sum("_w"), zero).alias("n_ids"),
        F.coalesce(F.sum("_g"), zero).alias("n_predictions"),
        F.count_if((F.col("_w") > 0) & (F.col("_g") == 0)).alias("n_missing"),
        F.count_if((F.col("_w") == 0) & (F.col("_g") > 0)).alias("n_extra"),
        F.count_if(F.col("_g") > 1).alias("n_repeated"),
    )


def align_strict(predictions: DataFrame, ids: DataFrame, key: str, score: str) -> DataFrame:
    """Like ``align``, but the job fails when ids are missing, extra or repeated.

    The condition is a filter over the wanted ids, so no action on the result can prune it: it costs one scalar subquery.
    Without any wanted id there is no row that could fail; ``require_aligned`` covers that case, too.
    """
    report = alignment_report(predictions, ids, key)
    wrong = report.select(F.col("n_missing") + F.col("n_extra") + F.col("n_repeated")).scalar()
    joined = ids.select(key).join(predictions.select(key, score), key, "left")
    stop = F.raise_error("prediction ids do not match the wanted ids").cast("boolean")
    return joined.filter(F.when(wrong == 0, F.lit(True)).otherwise(stop))


def require_aligned(predictions: DataFrame, ids: DataFrame, key: str) -> None:
    """Raise an error, before anything is written, when ids are missing, extra or repeated."""
    found = alignment_report(predictions, ids, key).first()
    if found.n_missing + found.n_extra + found.n_repeated:
        raise ValueError(f"prediction ids do not match the wanted ids: {found.asDict()}")


def verify(predictions: DataFrame, ids: DataFrame, key: str = "ID", score: str = "target") -> DataFrame:
    """One row that tells whether a prediction set can be handed in, and which check fails.

    Compared by key, so row order does not matter; repeated ids are a failure of their own.
    """
    cols_ok = predictions.columns == [key, score]
    if key not in predictions.columns or score not in predictions.columns:
        n = predictions.agg(F.count(F.lit(1)).alias("rows"))
        return n.select(
            "rows", F.lit(False).alias("rows_ok"), F.lit(False).alias("cols_ok"), F.lit(False).alias("target_ok"),
            F.lit(False).alias("id_ok"), F.lit(False).alias("ok"),
            F.lit("rows_ok / cols_ok / target_ok / id_ok").alias("message"),
        )
    in_range = predictions.agg(
        F.count_if(~F.coalesce(F.col(score).between(0, 1) & ~F.isnan(score), F.lit(False))).alias("bad")
    ).scalar()
    report = alignment_report(predictions, ids, key).select(
        F.col("n_predictions").alias("rows"),
        (F.col("n_predictions") == F.col("n_ids")).alias("rows_ok"),
        F.lit(cols_ok).alias("cols_ok"),
        (in_range == 0).alias("target_ok"),
        ((F.col("n_missing") + F.col("n_extra") + F.col("n_repeated")) == 0).alias("id_ok"),
    )
    checks = ["rows_ok", "cols_ok", "target_ok", "id_ok"]
    ok = F.col(checks[0])
    for c in checks[1:]:
        ok = ok & F.col(c)
    failing = F.concat_ws(" / ", *[F.when(~F.col(c), c) for c in checks])
    return report.withColumn("ok", ok).withColumn("message", F.when(ok, "OK").otherwise(failing))


def verify_all(sets: dict[str, DataFrame], ids: DataFrame, key: str = "ID", score: str = "target") -> DataFrame:
    out = None
    for name, df in sets.items():
        row = verify(df, ids, key, score).select(F.lit(name).alias("source"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def difference(a: DataFrame, b: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Largest absolute difference per value of two computations of the same rows, and unmatched rows."""
    left = a.select(*key, F.lit(1).alias("_a"), *[F.col(v).alias(f"_a_{v}") for v in values])
    right = b.select(*key, F.lit(1).alias("_b"), *[F.col(v).alias(f"_b_{v}") for v in values])
    both = left.join(right, key, "full_outer")
    return both.agg(
        F.count_if(F.col("_b").isNull()).alias("only_in_first"),
        F.count_if(F.col("_a").isNull()).alias("only_in_second"),
        *[F.max(F.abs(F.col(f"_a_{v}") - F.col(f"_b_{v}"))).alias(f"max_diff_{v}") for v in values],
    )


def pseudo_labels(
    scored: DataFrame, key: list[str], score: str, high: float = 0.95, low: float = 0.05, cap: int | None = 1500,
    weight: float = 0.3,
) -> DataFrame:
    """The most confident held-out rows as labelled rows of a lower weight.

    The cap is part of the method: it bounds the noise that self-training adds.
    """
    sure = scored.filter(is_confident(score, high, low))
    if cap is not None:
        sure = sure.orderBy(confidence(score).desc(), *[F.col(k).asc() for k in key]).limit(cap)
    return sure.withColumn("target", (F.col(score) >= 0.5).cast("int")).withColumn("weight", F.lit(weight))


def with_pseudo_rows(train: DataFrame, pseudo: DataFrame, columns: list[str]) -> DataFrame:
    """Labelled rows at weight 1 and pseudo-labelled rows at theirs."""
    real = train.withColumn("weight", F.lit(1.0)).select(*columns, "target", "weight")
    return real.unionByName(pseudo.select(*columns, "target", "weight"))


def route(scored: DataFrame, seen: str, known: str, unknown: str, out: str) -> DataFrame:
    """Score of the model for seen movies where the movie is seen, of the other model elsewhere."""
    return scored.withColumn(out, F.when(F.col(seen) == 1, F.col(known)).otherwise(F.col(unknown)))
