"""Queries of blending, alignment and verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens.operators import blend as B
from reviewlens.operators import encode as E
from reviewlens.operators.keys import flag_seen
from reviewlens.plans.registry import query
from reviewlens.plans.tables import KEY, KEY_SQL, TIE_SQL, over_reviews, reviews, tie

SETS_SQL = (
    f"ids AS (SELECT {TIE_SQL} AS ID, * FROM reviews WHERE NOT is_train)",
    "a AS (SELECT ID, pred AS target FROM ids)",
    "b AS (SELECT ID, pred_b AS target FROM ids WHERE top_critic)",
    "c AS (SELECT ID, pred_c AS target FROM ids WHERE runtime IS NOT NULL)",
)
RULE_SQL = "round(least(1, greatest(0, {})), 6)"


def _sets(spark, sf_dir):
    ids = reviews(spark, sf_dir).filter("NOT is_train").withColumn("ID", tie())
    sets = {
        "a": ids.select("ID", F.col("pred").alias("target")),
        "b": ids.filter("top_critic").select("ID", F.col("pred_b").alias("target")),
        "c": ids.filter("runtime IS NOT NULL").select("ID", F.col("pred_c").alias("target")),
    }
    return ids, sets


def _rounded(df):
    return df.withColumn("target", F.round("target", 6))


@query(
    "j03_ids_of_all_sets",
    over_reviews(
        "SELECT ID, a.target AS a, b.target AS b, c.target AS c FROM a JOIN b USING (ID) JOIN c USING (ID)", *SETS_SQL
    ),
)
def j03(spark, sf_dir):
    _, sets = _sets(spark, sf_dir)
    return B.side_by_side(sets, "ID", "target")


@query(
    "j04_align_to_ids",
    over_reviews("SELECT ID, coalesce(b.target, 0.5) AS target FROM ids LEFT JOIN b USING (ID)".replace(
        "ids LEFT", "(SELECT ID FROM ids) LEFT"), *SETS_SQL),
)
def j04(spark, sf_dir):
    ids, sets = _sets(spark, sf_dir)
    return B.align(sets["b"], ids, "ID", "target")


@query("j05_strict_align", over_reviews("SELECT ID, target FROM a", *SETS_SQL))
def j05(spark, sf_dir):
    ids, sets = _sets(spark, sf_dir)
    return B.align_strict(sets["a"], ids, "ID", "target")


@query(
    "j05_alignment_report",
    over_reviews(
        """SELECT (SELECT count(*) FROM ids) AS n_ids, (SELECT count(*) FROM c) AS n_predictions,
          (SELECT count(*) FROM ids WHERE ID NOT IN (SELECT ID FROM c)) AS n_missing, 0::BIGINT AS n_extra,
          0::BIGINT AS n_repeated""",
        *SETS_SQL,
    ),
)
def j05_report(spark, sf_dir):
    ids, sets = _sets(spark, sf_dir)
    return B.alignment_report(sets["c"], ids, "ID")


@query(
    "a16_mean_score",
    over_reviews(
        """SELECT ID, round(avg(target), 6) AS target FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)
        GROUP BY ID""",
        *SETS_SQL,
    ),
)
def a16(spark, sf_dir):
    _, sets = _sets(spark, sf_dir)
    return _rounded(B.mean_score(B.tagged_union(sets, "ID", "target"), "ID", "target"))


@query(
    "a17_weighted_blend",
    over_reviews(
        f"""SELECT ID, {RULE_SQL.format('(2 * a.target + b.target + c.target) / 4')} AS target
        FROM a JOIN b USING (ID) JOIN c USING (ID)""",
        *SETS_SQL,
    ),
)
def a17(spark, sf_dir):
    _, sets = _sets(spark, sf_dir)
    return _rounded(B.blend(sets, {"a": 2.0, "b": 1.0, "c": 1.0}, "ID", "target"))


@query(
    "a17_weighted_pair",
    over_reviews(
        f"SELECT ID, {RULE_SQL.format('0.65::DOUBLE * a.target + 0.35::DOUBLE * b.target')} AS target FROM a JOIN b USING (ID)",
        *SETS_SQL,
    ),
)
def a17_pair(spark, sf_dir):
    _, sets = _sets(spark, sf_dir)
    return _rounded(B.blend_pair(sets["a"], sets["b"], 0.65, "ID", "target"))


@query(
    "a18_weight_grid",
    over_reviews(
        f"""SELECT pattern, ID, {RULE_SQL.format('wa * a.target + wb * b.target + wc * c.target')} AS target
        FROM a JOIN b USING (ID) JOIN c USING (ID), (VALUES
          ('new_0.05', 0.45::DOUBLE, 0.5::DOUBLE, 0.05::DOUBLE), ('new_0.08', 0.45, 0.47, 0.08),
          ('new_0.10', 0.45, 0.45, 0.1), ('new_0.12', 0.45, 0.43, 0.12), ('new_0.15', 0.45, 0.4, 0.15),
          ('new_0.18', 0.45, 0.37, 0.18)) w(pattern, wa, wb, wc)""",
        *SETS_SQL,
    ),
)
def a18(spark, sf_dir):
    _, sets = _sets(spark, sf_dir)
    # Shares of the new set.
    patterns = B.share_patterns("a", ["b"], [1.0], "c", [0.05, 0.08, 0.10, 0.12, 0.15, 0.18])
    return _rounded(B.blend_grid(sets, patterns, "ID", "target"))


@query(
    "a18_weight_grid_four_sets",
    over_reviews(
        f"""SELECT pattern, ID, {RULE_SQL.format('wa * a.target + wb * b.target + wc * c.target + wd * (1 - a.target)')} AS target
        FROM a JOIN b USING (ID) JOIN c USING (ID), (VALUES
          ('p1', 0.2::DOUBLE, 0.2::DOUBLE, 0.5::DOUBLE, 0.1::DOUBLE), ('p2', 0.2, 0.2, 0.45, 0.15)) w(pattern, wa, wb, wc, wd)""",
        *SETS_SQL,
    ),
)
def a18_four(spark, sf_dir):
    _, sets = _sets(spark, sf_dir)
    sets["d"] = sets["a"].select("ID", (1 - F.col("target")).alias("target"))
    names = ["a", "b", "c", "d"]
    patterns = {"p1": dict(zip(names, (0.2, 0.2, 0.5, 0.1))), "p2": dict(zip(names, (0.2, 0.2, 0.45, 0.15)))}
    return _rounded(B.blend_grid(sets, patterns, "ID", "target"))


@query(
    "l2_top_by_confidence",
    over_reviews(f"""SELECT {KEY_SQL}, pred, CAST(pred >= 0.5 AS INTEGER) AS target, 0.3::DOUBLE AS weight FROM test
      WHERE pred >= 0.95 OR pred <= 0.05 ORDER BY greatest(pred, 1 - pred) DESC, {KEY_SQL} LIMIT 1500"""),
)
def l2(spark, sf_dir):
    _, test = (reviews(spark, sf_dir).filter(f) for f in ("is_train", "NOT is_train"))
    return B.pseudo_labels(test, KEY, "pred").select(*KEY, "pred", "target", "weight")


@query(
    "m07_pseudo_label_rows",
    over_reviews(f"""SELECT {KEY_SQL}, CAST(pred_c >= 0.5 AS INTEGER) AS target, 0.3::DOUBLE AS weight FROM test
      WHERE pred_c >= 0.9 OR pred_c <= 0.1 UNION ALL SELECT {KEY_SQL}, target, 1::DOUBLE FROM train"""),
)
def m07(spark, sf_dir):
    df = reviews(spark, sf_dir)
    pseudo = B.pseudo_labels(df.filter("NOT is_train").drop("target"), KEY, "pred_c", 0.9, 0.1, cap=None)
    return B.with_pseudo_rows(df.filter("is_train"), pseudo, KEY)


@query(
    "m05_seen_unseen_routing",
    over_reviews(f"""SELECT {KEY_SQL}, CASE WHEN movie IN (SELECT movie FROM train) THEN pred ELSE pred_b END AS score FROM test"""),
)
def m05(spark, sf_dir):
    df = reviews(spark, sf_dir)
    test = flag_seen(df.filter("NOT is_train"), df.filter("is_train"), "movie", "seen")
    return B.route(test, "seen", "pred", "pred_b", "score").select(*KEY, "score")


@query(
    "q1_verify_prediction_sets",
    over_reviews(
        """SELECT source, rows, rows = (SELECT count(*) FROM ids) AS rows_ok, true AS cols_ok, bad = 0 AS target_ok,
          rows = (SELECT count(*) FROM ids) AS id_ok, rows = (SELECT count(*) FROM ids) AND bad = 0 AS ok,
          CASE WHEN rows = (SELECT count(*) FROM ids) AND bad = 0 THEN 'OK'
            WHEN rows = (SELECT count(*) FROM ids) THEN 'target_ok' WHEN bad = 0 THEN 'rows_ok / id_ok'
            ELSE 'rows_ok / target_ok / id_ok' END AS message
        FROM (SELECT source, count(*) AS rows, count(*) FILTER (WHERE target < 0 OR target > 1) AS bad FROM (
          SELECT 'a' AS source, target FROM a UNION ALL SELECT 'b', target FROM b UNION ALL
          SELECT 'c', target FROM c UNION ALL SELECT 'd', target + 0.5 FROM a) GROUP BY source)""",
        *SETS_SQL,
    ),
)
def q1(spark, sf_dir):
    ids, sets = _sets(spark, sf_dir)
    sets["d"] = sets["a"].select("ID", (F.col("target") + 0.5).alias("target"))
    return B.verify_all(sets, ids)


@query(
    "q2_difference_of_two_paths",
    over_reviews(f"""SELECT 0::BIGINT AS only_in_first, count(*) FILTER (WHERE review_year = 1995) AS only_in_second,
      0.0::DOUBLE AS max_diff_te FROM train"""),
)
def q2(spark, sf_dir):
    """Leave-one-out means by the encoder and as sums over all rows minus the row, without 1995."""
    train = reviews(spark, sf_dir).filter("is_train")
    first = E.leave_one_out_encode(train, ["critic"], "target", "te")
    totals = train.groupBy("critic").agg(F.sum("target").alias("s"), F.count("target").alias("n"))
    prior = train.agg(F.avg("target")).scalar()
    n, raw = F.col("n"), (F.col("s") - F.col("target")) / (F.col("n") - 1)
    second = train.join(totals, "critic").withColumn("te", (n * raw + 5 * prior) / (n + 5))
    out = B.difference(first.filter("review_year > 1995"), second, KEY, ["te"])
    return out.withColumn("max_diff_te", F.round("max_diff_te", 9))
