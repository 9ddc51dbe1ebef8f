"""Queries of joins on keys, set operations, ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens.operators import keys as S
from reviewlens.operators.analyze import top_n
from reviewlens.operators.blend import with_pseudo_rows, pseudo_labels
from reviewlens.plans.registry import query
from reviewlens.plans.tables import KEY, KEY_SQL, load, over_reviews, reviews


def _sides(spark, sf_dir):
    df = reviews(spark, sf_dir)
    return df.filter("is_train"), df.filter("NOT is_train")


@query(
    "j06_seen_flag",
    over_reviews(f"""SELECT {KEY_SQL}, CAST(movie IN (SELECT movie FROM train) AS INTEGER) AS movie_seen,
      CAST(critic IN (SELECT critic FROM train) AS INTEGER) AS critic_seen FROM test"""),
)
def j06(spark, sf_dir):
    train, test = _sides(spark, sf_dir)
    out = S.flag_seen(S.flag_seen(test, train, "movie", "movie_seen"), train, "critic", "critic_seen")
    return out.select(*KEY, "movie_seen", "critic_seen")


@query(
    "j07_new_keys_after_train_keys",
    over_reviews("""SELECT movie, 'train' AS side FROM train GROUP BY movie
      UNION ALL SELECT DISTINCT movie, 'test' FROM test WHERE movie NOT IN (SELECT movie FROM train)"""),
)
def j07(spark, sf_dir):
    train, test = _sides(spark, sf_dir)
    old = train.select("movie").distinct().withColumn("side", F.lit("train"))
    return old.unionByName(S.new_keys(test, train, ["movie"]).withColumn("side", F.lit("test")))


@query(
    "u1_distinct_keys_of_both_sides",
    over_reviews("SELECT DISTINCT critic, movie FROM (SELECT critic, movie FROM train UNION ALL SELECT critic, movie FROM test)"),
)
def u1(spark, sf_dir):
    return S.distinct_keys(list(_sides(spark, sf_dir)), ["critic", "movie"])


@query(
    "u2_union_with_weights",
    over_reviews(f"""SELECT {KEY_SQL}, target, 1.0::DOUBLE AS weight FROM train UNION ALL
      SELECT * FROM (SELECT {KEY_SQL}, CAST(pred >= 0.5 AS INTEGER), 0.3::DOUBLE FROM test
        WHERE pred >= 0.9 OR pred <= 0.1 ORDER BY greatest(pred, 1 - pred) DESC, {KEY_SQL} LIMIT 1500)"""),
)
def u2(spark, sf_dir):
    train, test = _sides(spark, sf_dir)
    pseudo = pseudo_labels(test.drop("target"), KEY, "pred", 0.9, 0.1)
    return with_pseudo_rows(train, pseudo, KEY)


@query(
    "u3_key_set_sizes",
    over_reviews("""SELECT CAST(sum(a) AS BIGINT) AS n_a, CAST(sum(b) AS BIGINT) AS n_b, CAST(sum(a * b) AS BIGINT) AS n_both,
      CAST(sum(a * (1 - b)) AS BIGINT) AS n_only_a, CAST(sum(b * (1 - a)) AS BIGINT) AS n_only_b
      FROM (SELECT movie, max(CAST(is_train AS INTEGER)) AS a, max(CAST(NOT is_train AS INTEGER)) AS b
        FROM reviews GROUP BY movie)"""),
)
def u3(spark, sf_dir):
    train, test = _sides(spark, sf_dir)
    return S.set_sizes(train, test, "movie")


@query(
    "w5_top_rows_per_key",
    over_reviews(f"""SELECT {KEY_SQL}, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY critic
      ORDER BY pred DESC, {KEY_SQL}) AS INTEGER) AS rank FROM reviews) WHERE rank <= 5"""),
)
def w5(spark, sf_dir):
    order = [F.col("pred").desc(), *[F.col(k) for k in KEY]]
    return S.top_per_key(reviews(spark, sf_dir), ["critic"], order, 5).select(*KEY, "rank")


@query(
    "w6_first_row_per_key",
    over_reviews(f"""SELECT {KEY_SQL}, target FROM (SELECT *, row_number() OVER (PARTITION BY movie
      ORDER BY review_date, {KEY_SQL}) AS r FROM reviews) WHERE r = 1"""),
)
def w6(spark, sf_dir):
    order = [F.col("review_date"), *[F.col(k) for k in KEY]]
    return S.first_per_key(reviews(spark, sf_dir), ["movie"], order).select(*KEY, "target")


@query(
    "w8_dense_key_numbers",
    """SELECT l_partkey, row_number() OVER (ORDER BY md5(l_partkey::VARCHAR)) - 1 AS node
      FROM (SELECT DISTINCT l_partkey FROM lineitem)""",
)
def w8(spark, sf_dir):
    return S.number_keys(load(spark, sf_dir, "lineitem").select("l_partkey").distinct(), "l_partkey", "node")


@query(
    "l1_top_by_total",
    over_reviews("""SELECT publisher, round(sum(abs(pred - target)), 6) AS total FROM train GROUP BY publisher
      ORDER BY total DESC, publisher LIMIT 5"""),
)
def l1(spark, sf_dir):
    train, _ = _sides(spark, sf_dir)
    totals = train.groupBy("publisher").agg(F.round(F.sum(F.abs(F.col("pred") - F.col("target"))), 6).alias("total"))
    return top_n(totals, [F.col("total").desc(), F.col("publisher")], 5)
