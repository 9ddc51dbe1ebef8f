"""Queries of the fold builders."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens.operators import analyze as A
from reviewlens.operators import folds as K
from reviewlens.plans.registry import query
from reviewlens.plans.tables import KEY, KEY_SQL, TIE_SQL, over_reviews, reviews, tie


def _train(spark, sf_dir):
    return reviews(spark, sf_dir).filter("is_train")


@query(
    "c1_expanding_time_folds",
    over_reviews(
        f"""SELECT fold, {KEY_SQL}, CASE WHEN review_year = val_year THEN 'validate' ELSE 'train' END AS role
        FROM train JOIN folds ON review_year <= val_year
        WHERE val_year IN (SELECT review_year FROM train)""",
        "folds AS (SELECT * FROM (VALUES (0, 1998), (1, 1999), (2, 2000), (3, 2013)) t(fold, val_year))",
    ),
)
def c1(spark, sf_dir):
    folds = K.year_fold_table(spark, [1998, 1999, 2000, 2013])
    return K.time_folds(_train(spark, sf_dir), "review_year", folds).select("fold", *KEY, "role")


@query(
    "c2_group_folds",
    over_reviews("""SELECT movie, size, CAST(CASE WHEN (pos // 5) % 2 = 0 THEN pos % 5 ELSE 4 - pos % 5 END AS INTEGER) AS fold
      FROM (SELECT movie, size, row_number() OVER (ORDER BY size DESC, md5(movie::VARCHAR)) - 1 AS pos
        FROM (SELECT movie, count(*) AS size FROM train GROUP BY movie))"""),
)
def c2(spark, sf_dir):
    return K.group_folds(_train(spark, sf_dir), "movie", 5)


@query(
    "c3_hash_folds",
    over_reviews(f"SELECT {KEY_SQL}, CAST(('0x' || substr({TIE_SQL}, 1, 8)) AS BIGINT) % 5 AS fold FROM train"),
)
def c3(spark, sf_dir):
    return K.hash_folds(_train(spark, sf_dir), tie(), 5).select(*KEY, "fold")


@query(
    "c4_stratified_folds",
    over_reviews(f"""SELECT {KEY_SQL}, CAST((row_number() OVER (PARTITION BY target ORDER BY {TIE_SQL}) - 1) % 5 AS INTEGER)
      AS fold FROM train"""),
)
def c4(spark, sf_dir):
    return K.stratified_folds(_train(spark, sf_dir), "target", tie(), 5).select(*KEY, "fold")


@query(
    "c5_last_years_folds",
    over_reviews(
        f"""SELECT fold, val_year, {KEY_SQL}, CASE WHEN review_year = val_year THEN 'validate' ELSE 'train' END AS role
        FROM train JOIN folds ON review_year <= val_year""",
        """folds AS (SELECT CAST(row_number() OVER (ORDER BY val_year) - 1 AS INTEGER) AS fold, val_year FROM (
          SELECT DISTINCT review_year AS val_year FROM train ORDER BY 1 DESC LIMIT 3))""",
    ),
)
def c5(spark, sf_dir):
    train = _train(spark, sf_dir)
    folds = K.last_years(train, "review_year", 3)
    return K.time_folds(train, "review_year", folds).select("fold", "val_year", *KEY, "role")


@query(
    "c6_weighted_cv_score",
    over_reviews("""SELECT round(sum(m * n) / sum(n), 6) AS weighted_score FROM (
      SELECT movie IN (SELECT movie FROM train) AS seen, avg((pred - target) * (pred - target)) AS m, count(*) AS n
      FROM test GROUP BY 1)"""),
)
def c6(spark, sf_dir):
    from reviewlens.operators.keys import flag_seen

    df = reviews(spark, sf_dir)
    test = flag_seen(df.filter("NOT is_train"), df.filter("is_train"), "movie", "seen")
    scores = A.probability_metrics(test, ["seen"], "target", "pred").select("brier", "n")
    return K.weighted_score(scores, "brier", "n").withColumn("weighted_score", F.round("weighted_score", 6))
