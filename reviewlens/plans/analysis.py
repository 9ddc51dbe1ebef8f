"""Queries of prediction analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens.operators import analyze as A
from reviewlens.operators import folds as K
from reviewlens.plans.registry import query
from reviewlens.plans.tables import over_reviews, reviews


def _auc_sql(score, by=""):
    """Rank form on distinct scores, per group."""
    part = f"PARTITION BY {by}" if by else ""
    sel, grp = (f"{by},", f"GROUP BY {by}") if by else ("", "")
    return f"""SELECT {sel} round(CASE WHEN sum(p) > 0 AND sum(q) > 0
      THEN sum(p * (below + q / 2.0::DOUBLE)) / (sum(p)::DOUBLE * sum(q)::DOUBLE) END, 6) AS auc
      FROM (SELECT *, coalesce(sum(q) OVER ({part} ORDER BY {score} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
        FROM (SELECT {sel} {score}, sum(target) AS p, sum(1 - target) AS q FROM reviews GROUP BY {sel} {score})) {grp}"""


@query("a11_auc", over_reviews(_auc_sql("pred")))
def a11(spark, sf_dir):
    return A.auc(reviews(spark, sf_dir), [], "target", "pred").withColumn("auc", F.round("auc", 6))


@query(
    "a11_auc_per_segment",
    over_reviews(_auc_sql("score", "publisher").replace(
        "FROM reviews", "FROM (SELECT *, round((pred * 7 + pred_b * 3 + pred_c * 11) / 21, 6) AS score FROM reviews)")),
)
def a11_segments(spark, sf_dir):
    df = reviews(spark, sf_dir)
    df = df.withColumn("score", F.round((F.col("pred") * 7 + F.col("pred_b") * 3 + F.col("pred_c") * 11) / 21, 6))
    return A.auc(df, ["publisher"], "target", "score").withColumn("auc", F.round("auc", 6))


@query(
    "w7_average_rank",
    over_reviews("""SELECT pred_c AS score, count(*) AS n, (sum(count(*)) OVER (ORDER BY pred_c)
      - count(*) / 2.0 + 0.5)::DOUBLE AS average_rank FROM reviews GROUP BY pred_c"""),
)
def w7(spark, sf_dir):
    return A.average_rank(reviews(spark, sf_dir), [], "pred_c")


@query(
    "w7_average_rank_in_groups",
    over_reviews("""SELECT publisher, pred_c AS score, count(*) AS n, (sum(count(*)) OVER (PARTITION BY publisher ORDER BY pred_c)
      - count(*) / 2.0 + 0.5)::DOUBLE AS average_rank FROM reviews GROUP BY publisher, pred_c"""),
)
def w7_groups(spark, sf_dir):
    return A.average_rank(reviews(spark, sf_dir), ["publisher"], "pred_c")


def _segments_sql(threshold, min_count):
    hit = f"(pred >= {threshold})"
    auc = """SELECT segment, value, CASE WHEN sum(p) > 0 AND sum(q) > 0
        THEN sum(p * (below + q / 2.0::DOUBLE)) / (sum(p)::DOUBLE * sum(q)::DOUBLE) END AS auc
      FROM (SELECT *, coalesce(sum(q) OVER (PARTITION BY segment, value ORDER BY pred ROWS BETWEEN UNBOUNDED PRECEDING
          AND 1 PRECEDING), 0) AS below
        FROM (SELECT segment, value, pred, sum(target) AS p, sum(1 - target) AS q FROM long GROUP BY 1, 2, 3)) GROUP BY 1, 2"""
    return (
        """long AS (SELECT 'review_year' AS segment, review_year::VARCHAR AS value, target, pred FROM reviews UNION ALL
          SELECT 'content_rating', content_rating, target, pred FROM reviews UNION ALL
          SELECT 'production_company', production_company, target, pred FROM reviews)""",
        f"areas AS ({auc})",
        f"""summary AS (SELECT l.*, a.auc FROM (SELECT segment, value, count(*) AS n,
          count(*) FILTER (WHERE target = 1 AND {hit}) AS n_TP, count(*) FILTER (WHERE target = 0 AND NOT {hit}) AS n_TN,
          count(*) FILTER (WHERE target = 0 AND {hit}) AS n_FP, count(*) FILTER (WHERE target = 1 AND NOT {hit}) AS n_FN,
          avg(target) AS pos_rate, avg(CAST(pred >= 0.5 AS INTEGER)) AS pred_pos_rate
          FROM long GROUP BY 1, 2 HAVING count(*) >= {min_count}) l
          JOIN areas a ON a.segment = l.segment AND a.value IS NOT DISTINCT FROM l.value)""",
    )


@query(
    "a10_segment_summary",
    over_reviews(
        """SELECT segment, value, n, n_TP, n_TN, n_FP, n_FN, round((n_TP + n_TN) / n::DOUBLE, 6) AS accuracy,
          round(auc, 6) AS auc, round(n_FP / nullif(n_TN + n_FP, 0)::DOUBLE, 6) AS FP_rate,
          round(n_FN / nullif(n_TP + n_FN, 0)::DOUBLE, 6) AS FN_rate, round(pos_rate, 6) AS pos_rate,
          round(pred_pos_rate, 6) AS pred_pos_rate FROM summary""",
        *_segments_sql(0.6, 50),
    ),
)
def a10(spark, sf_dir):
    out = A.segment_summary(
        reviews(spark, sf_dir), ["review_year", "content_rating", "production_company"], "target", "pred", threshold=0.6
    )
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes])


@query(
    "l3_worst_segment",
    over_reviews(
        """SELECT segment, value AS worst_value, round(auc, 6) AS worst_auc FROM (
          SELECT *, row_number() OVER (PARTITION BY segment ORDER BY auc, value) AS r FROM summary WHERE auc IS NOT NULL)
        WHERE r = 1""",
        *_segments_sql(0.5, 50),
    ),
)
def l3(spark, sf_dir):
    summary = A.segment_summary(
        reviews(spark, sf_dir), ["review_year", "content_rating", "production_company"], "target", "pred"
    )
    return A.worst_segment(summary).withColumn("worst_auc", F.round("worst_auc", 6))


_METRICS_SQL = """count(*) AS n,
  round(avg(-ln(CASE WHEN target = 1 THEN least(1 - 1e-15, greatest(1e-15, pred)) ELSE 1 - least(1 - 1e-15, greatest(1e-15, pred)) END)), 6)
    AS log_loss,
  round(avg((pred - target) * (pred - target)), 6) AS brier,
  round(count(*) FILTER (WHERE pred >= 0.5 AND target = 0) / nullif(count(*) FILTER (WHERE target = 0), 0)::DOUBLE, 6) AS FP_rate,
  round(count(*) FILTER (WHERE pred < 0.5 AND target = 1) / nullif(count(*) FILTER (WHERE target = 1), 0)::DOUBLE, 6) AS FN_rate,
  round(avg(CAST(pred >= 0.5 AS INTEGER)) - avg(target), 6) AS positive_rate_gap"""


@query("a12_probability_metrics", over_reviews(f"SELECT review_year, {_METRICS_SQL} FROM reviews GROUP BY review_year"))
def a12(spark, sf_dir):
    out = A.probability_metrics(reviews(spark, sf_dir), ["review_year"], "target", "pred")
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes])


@query(
    "a13_fold_mean_and_deviation",
    over_reviews("""SELECT publisher, round(avg(auc), 6) AS auc_mean, round(stddev_pop(auc), 6) AS auc_std FROM (
      SELECT publisher, fold, CASE WHEN sum(p) > 0 AND sum(q) > 0
        THEN sum(p * (below + q / 2.0::DOUBLE)) / (sum(p)::DOUBLE * sum(q)::DOUBLE) END AS auc
      FROM (SELECT *, coalesce(sum(q) OVER (PARTITION BY publisher, fold ORDER BY pred
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
        FROM (SELECT publisher, review_year - 1998 AS fold, pred, sum(target) AS p, sum(1 - target) AS q FROM train
          WHERE review_year >= 1998 GROUP BY 1, 2, 3)) GROUP BY 1, 2) GROUP BY publisher"""),
)
def a13(spark, sf_dir):
    folds = K.year_fold_table(spark, [1998, 1999, 2000])
    rows = K.time_folds(reviews(spark, sf_dir).filter("is_train"), "review_year", folds).filter("role = 'validate'")
    scores = A.auc(rows, ["publisher", "fold"], "target", "pred")
    out = A.fold_summary(scores, ["publisher"], "auc")
    return out.select("publisher", *[F.round(c, 6).alias(c) for c in ("auc_mean", "auc_std")])


@query(
    "a14_key_coverage",
    over_reviews(
        """SELECT count(*) FILTER (WHERE tr > 0) AS n_train_keys, count(*) FILTER (WHERE te > 0) AS n_test_keys,
          count(*) FILTER (WHERE tr > 0 AND te > 0) AS n_seen, count(*) FILTER (WHERE tr = 0) AS n_unseen,
          CAST(sum(te) FILTER (WHERE tr > 0) AS BIGINT) AS rows_seen, CAST(sum(te) FILTER (WHERE tr = 0) AS BIGINT) AS rows_unseen,
          round(CAST(sum(te) FILTER (WHERE tr > 0) AS DOUBLE) * 100 / sum(te)::DOUBLE, 6) AS rows_seen_pct
        FROM (SELECT movie, count(*) FILTER (WHERE is_train) AS tr, count(*) FILTER (WHERE NOT is_train) AS te
          FROM reviews GROUP BY movie)"""
    ),
)
def a14(spark, sf_dir):
    df = reviews(spark, sf_dir)
    out = A.coverage(df.filter("is_train"), df.filter("NOT is_train"), "movie")
    return out.withColumn("rows_seen_pct", F.round("rows_seen_pct", 6))


@query(
    "a14_key_coverage_sketch",
    "SELECT true AS train_within, true AS test_within",
)
def a14_sketch(spark, sf_dir):
    """Whether the sketched counts are within 15 percent, three times their standard error, of the exact ones."""
    df = reviews(spark, sf_dir)
    train, test = df.filter("is_train"), df.filter("NOT is_train")
    sketch, exact = A.coverage(train, test, "movie", approximate=True), A.coverage(train, test, "movie")
    return sketch.select(*[
        (F.abs(F.col(f"n_{s}_keys") - exact.select(f"n_{s}_keys").scalar()) <= 0.15 * exact.select(f"n_{s}_keys").scalar())
        .alias(f"{s}_within") for s in ("train", "test")
    ])


# Upper and lower limits of the grid.
_PAIRS = [(0.95, 0.05), (0.90, 0.10), (0.85, 0.15), (0.80, 0.20)]


@query(
    "a15_threshold_grid",
    over_reviews(
        """SELECT high, low, count(*) FILTER (WHERE pred >= high) AS n_high, count(*) FILTER (WHERE pred <= low) AS n_low,
          count(*) AS n, count(*) FILTER (WHERE pred >= high) + count(*) FILTER (WHERE pred <= low) AS n_both,
          round((count(*) FILTER (WHERE pred >= high) + count(*) FILTER (WHERE pred <= low)) / count(*)::DOUBLE, 6) AS share
        FROM test, (VALUES (0.95::DOUBLE, 0.05::DOUBLE), (0.9, 0.1), (0.85, 0.15), (0.8, 0.2)) t(high, low) GROUP BY high, low"""
    ),
)
def a15(spark, sf_dir):
    out = A.threshold_grid(reviews(spark, sf_dir).filter("NOT is_train"), "pred", _PAIRS)
    return out.withColumn("share", F.round("share", 6))
