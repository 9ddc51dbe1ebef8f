"""Queries of the encoders, graph aggregates and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens.functions import columns as C
from reviewlens.operators import encode as E
from reviewlens.operators import fold_features as FF
from reviewlens.operators import folds as K
from reviewlens.plans.registry import query
from reviewlens.plans.tables import KEY, KEY_SQL, TIE_SQL, load, over_reviews, reviews, tie

FOLD_SQL = f"CAST(('0x' || substr({TIE_SQL}, 1, 8)) AS BIGINT) % 5"
GM = "(SELECT avg(target) FROM train)"


def _sides(spark, sf_dir, release=False):
    df = reviews(spark, sf_dir, release)
    return df.filter("is_train"), df.filter("NOT is_train"), df


def _stats_sql(name, key, m):
    return (
        f"{name} AS (SELECT {key}, (sum(target) + {m} * {GM}) / (count(*) + {m}) AS {name} FROM train "
        f"WHERE {key.split(',')[0]} IS NOT NULL GROUP BY {key})"
    )


def _ts_sql(key, name, m=10):
    """Time-ordered mean of train rows as a CTE ``name``."""
    return f"""{name} AS (SELECT *, CASE WHEN {key} IS NOT NULL AND n > 0 THEN (s + {m} * {GM}) / (n + {m}) ELSE {GM} END AS te
      FROM (SELECT *, coalesce(sum(target) OVER w, 0) AS s, count(*) OVER w AS n FROM train
        WINDOW w AS (PARTITION BY {key} ORDER BY review_date NULLS LAST, {TIE_SQL}
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""


def _bin_sql(x):
    return (
        f"CASE WHEN {x} > 0 AND {x} <= 0.33 THEN 0::DOUBLE WHEN {x} > 0.33 AND {x} <= 0.67 THEN 1 "
        f"WHEN {x} > 0.67 AND {x} <= 1.01 THEN 2 ELSE 1 END"
    )


@query(
    "a01_smoothed_target_mean",
    over_reviews("SELECT critic, round(te, 6) AS te FROM te", _stats_sql("te", "critic", 10)),
)
def a01(spark, sf_dir):
    train, _, _ = _sides(spark, sf_dir)
    return E.target_means(train, ["critic"], "target", 10, "te").select("critic", F.round("te", 6).alias("te"))


@query(
    "a02_frequency_encoding",
    over_reviews(f"""SELECT {KEY_SQL}, coalesce(a.n, 0) AS critic_freq, coalesce(b.n, 0) AS publisher_freq,
      coalesce(c.n, 0) AS production_company_freq FROM reviews
      LEFT JOIN (SELECT critic, count(*) AS n FROM train GROUP BY 1) a USING (critic)
      LEFT JOIN (SELECT publisher, count(*) AS n FROM train GROUP BY 1) b USING (publisher)
      LEFT JOIN (SELECT production_company, count(*) AS n FROM train GROUP BY 1) c USING (production_company)"""),
)
def a02(spark, sf_dir):
    train, _, df = _sides(spark, sf_dir)
    names = ["critic", "publisher", "production_company"]
    for name in names:
        df = E.frequency_encode(df, train, name)
    return df.select(*KEY, *[f"{n}_freq" for n in names])


def _loo_sql(keys):
    return f"""SELECT {KEY_SQL}, round((n * raw + 5 * {GM}) / (n + 5), 6) AS te FROM (
      SELECT *, CASE WHEN n > 1 THEN (s - target)::DOUBLE / (n - 1) ELSE {GM} END AS raw FROM (
        SELECT *, sum(target) OVER w AS s, count(*) OVER w AS n FROM train WINDOW w AS (PARTITION BY {keys})))"""


@query("a03_leave_one_out", over_reviews(_loo_sql("critic")))
def a03(spark, sf_dir):
    train, _, _ = _sides(spark, sf_dir)
    return E.leave_one_out_encode(train, ["critic"], "target", "te").select(*KEY, F.round("te", 6).alias("te"))


@query("a03_leave_one_out_composite_key", over_reviews(_loo_sql("critic, content_rating")))
def a03_pair(spark, sf_dir):
    train, _, _ = _sides(spark, sf_dir)
    df = E.leave_one_out_encode(train, ["critic", "content_rating"], "target", "te")
    return df.select(*KEY, F.round("te", 6).alias("te"))


@query(
    "a03_leave_one_out_held_out_side",
    over_reviews(
        f"SELECT {KEY_SQL}, round(coalesce(te, {GM}), 6) AS te FROM test LEFT JOIN te USING (critic)",
        _stats_sql("te", "critic", 5),
    ),
)
def a03_test(spark, sf_dir):
    train, test, _ = _sides(spark, sf_dir)
    return E.target_encode(test, train, ["critic"], "target", 5, "te").select(*KEY, F.round("te", 6).alias("te"))


@query(
    "a04_out_of_fold_encoding",
    over_reviews(
        f"""SELECT {', '.join('f.' + k for k in KEY)}, f.fold,
          round(coalesce((c.s - coalesce(o.s, 0) + 10 * {GM}) / nullif(c.n - coalesce(o.n, 0), 0)
            * (c.n - coalesce(o.n, 0)) / (c.n - coalesce(o.n, 0) + 10), {GM}), 6) AS critic_te,
          round(CASE WHEN mc.n > mo.n THEN (mc.s - mo.s + 15 * {GM}) / (mc.n - mo.n + 15) ELSE {GM} END, 6) AS movie_te
        FROM f LEFT JOIN c USING (critic) LEFT JOIN o ON o.critic = f.critic AND o.fold = f.fold
        LEFT JOIN mc ON mc.movie = f.movie LEFT JOIN mo ON mo.movie = f.movie AND mo.fold = f.fold""",
        f"f AS (SELECT *, {FOLD_SQL} AS fold FROM train)",
        "c AS (SELECT critic, sum(target) AS s, count(*) AS n FROM f GROUP BY 1)",
        "o AS (SELECT critic, fold, sum(target) AS s, count(*) AS n FROM f GROUP BY 1, 2)",
        "mc AS (SELECT movie, sum(target) AS s, count(*) AS n FROM f GROUP BY 1)",
        "mo AS (SELECT movie, fold, sum(target) AS s, count(*) AS n FROM f GROUP BY 1, 2)",
    ),
)
def a04(spark, sf_dir):
    train, _, _ = _sides(spark, sf_dir)
    df = K.hash_folds(train, tie(), 5)
    base = df
    df = E.out_of_fold_encode(df, ["critic"], "target", "fold", "critic_te", m=10, base=base)
    df = E.out_of_fold_encode(df, ["movie"], "target", "fold", "movie_te", m=15, base=base)
    return df.select(
        *KEY, "fold", F.round("critic_te", 6).alias("critic_te"), F.round("movie_te", 6).alias("movie_te")
    )


@query(
    "a05_review_counts",
    over_reviews(f"""SELECT {KEY_SQL}, coalesce(a.n, 0) AS critic_review_count, coalesce(b.n, 0) AS movie_review_count
      FROM reviews LEFT JOIN (SELECT critic, count(*) AS n FROM train GROUP BY 1) a USING (critic)
      LEFT JOIN (SELECT movie, count(*) AS n FROM train GROUP BY 1) b USING (movie)"""),
)
def a05(spark, sf_dir):
    train, _, df = _sides(spark, sf_dir)
    df = E.frequency_encode(df, train, "critic", "critic_review_count")
    df = E.frequency_encode(df, train, "movie", "movie_review_count")
    return df.select(*KEY, "critic_review_count", "movie_review_count")


@query(
    "a06_encoding_ratios",
    over_reviews(
        f"""SELECT {KEY_SQL}, round(coalesce(mt / nullif(ca, 0), 1), 6) AS ratio_movie_te_to_critic,
          round(mt / {GM}, 6) AS ratio_movie_te_to_global, round(ct / {GM}, 6) AS ratio_critic_te_to_global
        FROM (SELECT r.*, coalesce(movie_te, {GM}) AS mt, coalesce(critic_te, {GM}) AS ct, coalesce(avg_fresh, {GM}) AS ca
          FROM reviews r LEFT JOIN movie_te USING (movie) LEFT JOIN critic_te USING (critic)
          LEFT JOIN (SELECT critic, avg(target) AS avg_fresh FROM train GROUP BY 1) USING (critic))""",
        _stats_sql("movie_te", "movie", 10),
        _stats_sql("critic_te", "critic", 10),
    ),
)
def a06(spark, sf_dir):
    train, _, df = _sides(spark, sf_dir)
    df = E.target_encode(df, train, ["movie"], "target", 10, "movie_te")
    df = E.target_encode(df, train, ["critic"], "target", 10, "critic_te")
    df = E.encoding_ratios(df, train, "critic", "movie_te", "critic_te", "target")
    names = ["ratio_movie_te_to_critic", "ratio_movie_te_to_global", "ratio_critic_te_to_global"]
    return df.select(*KEY, *[F.round(n, 6).alias(n) for n in names])


@query(
    "a07_ratio_to_own_mean",
    over_reviews(f"""SELECT {KEY_SQL}, round(least(1e6::DOUBLE, greatest(0, coalesce(runtime / nullif(
      coalesce(m, (SELECT avg(runtime) FROM train)), 0), 1))), 6) AS runtime_ratio,
      round(least(1e6::DOUBLE, greatest(0, coalesce(pred_b / nullif(
      coalesce(p, (SELECT avg(pred_b) FROM train)), 0), 1))), 6) AS pred_ratio
      FROM reviews LEFT JOIN (SELECT critic, avg(runtime) AS m, avg(pred_b) AS p FROM train GROUP BY 1) USING (critic)"""),
)
def a07(spark, sf_dir):
    train, _, df = _sides(spark, sf_dir)
    df = E.ratio_to_own_mean(df, train, "critic", "runtime", "runtime_ratio")
    df = E.ratio_to_own_mean(df, train, "critic", "pred_b", "pred_ratio")
    return df.select(
        *KEY, F.round("runtime_ratio", 6).alias("runtime_ratio"), F.round("pred_ratio", 6).alias("pred_ratio")
    )


_TWO_HOP_SQL = (
    _ts_sql("critic", "ts"),
    "hop AS (SELECT movie, avg(target) AS rate, avg(te) AS te_mean, count(*) AS n FROM ts GROUP BY movie)",
)


@query(
    "a08_two_hop_means",
    over_reviews(
        f"""SELECT {KEY_SQL}, round(coalesce(rate, (SELECT avg(rate) FROM hop)), 6) AS movie_fresh_rate_mean,
          round(coalesce(te_mean, (SELECT avg(te_mean) FROM hop)), 6) AS movie_critic_te_mean,
          round(coalesce(n, (SELECT avg(n) FROM hop)), 6) AS movie_review_count
        FROM reviews LEFT JOIN hop USING (movie)""",
        *_TWO_HOP_SQL,
    ),
)
def a08(spark, sf_dir):
    train, _, df = _sides(spark, sf_dir)
    encoded = E.time_ordered_target_encode(train, "critic", "target", "review_date", tie(), "critic_te")
    out = E.two_hop(
        df, encoded, "movie", {"movie_fresh_rate_mean": "target", "movie_critic_te_mean": "critic_te"}, "movie_review_count"
    )
    names = ["movie_fresh_rate_mean", "movie_critic_te_mean", "movie_review_count"]
    return out.select(*KEY, *[F.round(n, 6).alias(n) for n in names])


@query(
    "a08_two_hop_leave_one_out",
    over_reviews(
        f"""SELECT {KEY_SQL}, round(coalesce((s - target)::DOUBLE / nullif(n - 1, 0), (SELECT avg(rate) FROM hop)), 6)
          AS movie_fresh_rate_mean
        FROM (SELECT *, sum(target) OVER (PARTITION BY movie) AS s, count(*) OVER (PARTITION BY movie) AS n FROM train)""",
        "hop AS (SELECT movie, avg(target) AS rate FROM train GROUP BY movie)",
    ),
)
def a08_loo(spark, sf_dir):
    train, _, _ = _sides(spark, sf_dir)
    out = E.two_hop(train, train, "movie", {"movie_fresh_rate_mean": "target"}, leave_one_out=True)
    return out.select(*KEY, F.round("movie_fresh_rate_mean", 6).alias("movie_fresh_rate_mean"))


@query(
    "a09_two_hop_ratio",
    over_reviews(
        f"""SELECT {KEY_SQL}, round(te / coalesce(nullif(te_mean, 0), 1), 6) AS ratio
        FROM ts JOIN hop USING (movie)""",
        *_TWO_HOP_SQL,
    ),
)
def a09(spark, sf_dir):
    train, _, _ = _sides(spark, sf_dir)
    encoded = E.time_ordered_target_encode(train, "critic", "target", "review_date", tie(), "critic_te")
    out = E.two_hop(encoded, encoded, "movie", {"te_mean": "critic_te"})
    return E.two_hop_ratio(out, "critic_te", "te_mean", "ratio").select(*KEY, F.round("ratio", 6).alias("ratio"))


@query(
    "a24_metadata_two_hop",
    over_reviews("""SELECT movie, round(avg(cr), 6) AS runtime_two_hop, round(avg(cy), 6) AS review_year_two_hop
      FROM train JOIN (SELECT critic, avg(runtime) AS cr, avg(review_year) AS cy FROM train GROUP BY 1) USING (critic)
      GROUP BY movie"""),
)
def a24(spark, sf_dir):
    train, _, _ = _sides(spark, sf_dir)
    out = E.metadata_two_hop(train, "critic", "movie", ["runtime", "review_year"])
    names = ["runtime_two_hop", "review_year_two_hop"]
    return out.select("movie", *[F.round(n, 6).alias(n) for n in names])


@query(
    "a21_neighbour_profile",
    over_reviews(f"""SELECT publisher, count(*) AS rows, count(DISTINCT critic) AS neighbours,
      CASE WHEN count(*) <= 100 THEN 0 WHEN count(*) <= 1500 THEN 1 ELSE 2 END AS count_bin,
      CAST(count(*) >= 50 AS INTEGER) AS high_volume, round(avg(target) - {GM}, 6) AS centred_rate
      FROM train GROUP BY publisher"""),
)
def a21(spark, sf_dir):
    train, _, _ = _sides(spark, sf_dir)
    out = E.neighbour_profile(train, "publisher", "critic", "target", (0, 100, 1500, 1e12))
    return out.withColumn("centred_rate", F.round("centred_rate", 6))


@query(
    "a23_class_balance",
    over_reviews("""SELECT count(*) FILTER (WHERE target = 0) AS n_neg, count(*) FILTER (WHERE target = 1) AS n_pos,
      round(count(*) FILTER (WHERE target = 0) / greatest(count(*) FILTER (WHERE target = 1), 1)::DOUBLE, 6) AS pos_weight
      FROM train"""),
)
def a23(spark, sf_dir):
    train, _, _ = _sides(spark, sf_dir)
    return E.class_balance(train, "target").withColumn("pos_weight", F.round("pos_weight", 6))


@query(
    "m03_fold_local_encoding",
    over_reviews(
        f"""SELECT fold, {KEY_SQL}, round(CASE WHEN n IS NULL THEN g ELSE (s + 10 * g) / (n + 10) END, 6) AS critic_te
        FROM (SELECT f.fold, v.*, (SELECT avg(target) FROM train t WHERE t.review_year < f.val_year) AS g,
            st.s, st.n
          FROM folds f JOIN train v ON v.review_year = f.val_year
          LEFT JOIN (SELECT f2.fold, t.critic, sum(t.target) AS s, count(*) AS n FROM folds f2
            JOIN train t ON t.review_year < f2.val_year GROUP BY 1, 2) st ON st.fold = f.fold AND st.critic = v.critic)""",
        "folds AS (SELECT * FROM (VALUES (0, 1998), (1, 1999), (2, 2000)) t(fold, val_year))",
    ),
)
def m03(spark, sf_dir):
    train, _, _ = _sides(spark, sf_dir)
    folds = K.year_fold_table(spark, [1998, 1999, 2000])
    rows = train.join(F.broadcast(folds), F.col("review_year") == F.col("val_year")).drop("val_year")
    out = E.fold_target_encode(rows, train, folds, ["critic"], "target", "review_year", "critic_te")
    return out.select("fold", *KEY, F.round("critic_te", 6).alias("critic_te"))


_FOLDS_SQL = "folds AS (SELECT * FROM (VALUES (0, 1998), (1, 1999), (2, 2000)) t(fold, val_year))"
_FOLD_MEANS = {"critic": 10, "movie": 10, "publisher": 10, "production_company": 10}


def _fold_stats_sql(column):
    return (f"s_{column} AS (SELECT fold, {column}, sum(target) AS s, count(*) AS n FROM folds JOIN train t ON t.review_year < val_year GROUP BY 1, 2)")


def _fold_te_sql(column):
    return f"(coalesce(s_{column}.s, 0) + {_FOLD_MEANS[column]} * g) / (coalesce(s_{column}.n, 0) + {_FOLD_MEANS[column]})"


@query(
    "m03_fold_local_features",
    over_reviews(
        f"""SELECT fold, role, {KEY_SQL}, {", ".join(f"round({_fold_te_sql(c)}, 6) AS {c}_te" for c in _FOLD_MEANS)},
          coalesce(s_critic.n, 0) AS critic_review_count, coalesce(s_movie.n, 0) AS movie_review_count,
          round(coalesce(s_critic.s / s_critic.n, g), 6) AS critic_avg_fresh,
          round(coalesce({_fold_te_sql("movie")} / nullif(coalesce(s_critic.s / s_critic.n, g), 0), 1), 6) AS ratio_movie_te_to_critic,
          round({_fold_te_sql("movie")} / g, 6) AS ratio_movie_te_to_global, round({_fold_te_sql("critic")} / g, 6) AS ratio_critic_te_to_global
        FROM (SELECT fold, v.*, CASE WHEN review_year = val_year THEN 'validate' ELSE 'train' END AS role FROM folds JOIN train v ON v.review_year <= val_year) r
        JOIN (SELECT fold, avg(target) AS g FROM folds JOIN train t ON t.review_year < val_year GROUP BY fold) p USING (fold)
        {" ".join(f"LEFT JOIN s_{c} USING (fold, {c})" for c in _FOLD_MEANS)}""",
        _FOLDS_SQL, *[_fold_stats_sql(c) for c in _FOLD_MEANS],
    ),
)
def m03_features(spark, sf_dir):
    """Encodings, counts and ratios of all train and validation rows of every fold."""
    train, _, _ = _sides(spark, sf_dir)
    folds = K.year_fold_table(spark, [1998, 1999, 2000])
    rows = K.time_folds(train, "review_year", folds).drop("val_year")
    out = FF.fold_encodings(rows, train, folds, _FOLD_MEANS, ["critic", "movie"], "target", "review_year", ("critic", "movie"))
    names = [*(f"{c}_te" for c in _FOLD_MEANS), "critic_avg_fresh", "ratio_movie_te_to_critic", "ratio_movie_te_to_global", "ratio_critic_te_to_global"]
    return out.select("fold", "role", *KEY, "critic_review_count", "movie_review_count", *[F.round(n, 6).alias(n) for n in names])


@query(
    "j02_statistic_lookup",
    over_reviews(f"""SELECT {KEY_SQL}, round(coalesce(r, 0.25::DOUBLE), 6) AS rating_rate FROM reviews
      LEFT JOIN (SELECT content_rating, avg(target) AS r FROM train GROUP BY 1) USING (content_rating)"""),
)
def j02(spark, sf_dir):
    train, _, df = _sides(spark, sf_dir)
    stats = train.groupBy("content_rating").agg(F.avg("target").alias("rating_rate"))
    out = E.lookup(df, stats, ["content_rating"], {"rating_rate": 0.25})
    return out.select(*KEY, F.round("rating_rate", 6).alias("rating_rate"))


@query(
    "w1_time_ordered_encoding",
    over_reviews(f"SELECT {KEY_SQL}, round(te, 6) AS te FROM ts", _ts_sql("critic", "ts")),
)
def w1(spark, sf_dir):
    train, _, _ = _sides(spark, sf_dir)
    out = E.time_ordered_target_encode(train, "critic", "target", "review_date", tie(), "te")
    return out.select(*KEY, F.round("te", 6).alias("te"))


@query(
    "w1_time_ordered_encoding_with_null_keys",
    over_reviews(f"SELECT {KEY_SQL}, round(te, 6) AS te FROM ts", _ts_sql("production_company", "ts")),
)
def w1_null(spark, sf_dir):
    train, _, _ = _sides(spark, sf_dir)
    out = E.time_ordered_target_encode(train, "production_company", "target", "review_date", tie(), "te")
    return out.select(*KEY, F.round("te", 6).alias("te"))


@query(
    "w1_time_ordered_encoding_of_events",
    """WITH rows AS (SELECT *, CAST(value > 50 AS INTEGER) AS y FROM events)
      SELECT event_id, round(CASE WHEN n > 0 THEN (s + 10 * g) / (n + 10) ELSE g END, 6) AS te FROM (
        SELECT event_id, coalesce(sum(y) OVER w, 0) AS s, count(*) OVER w AS n, (SELECT avg(y) FROM rows) AS g FROM rows
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, md5(event_id::VARCHAR)
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
)
def w1_events(spark, sf_dir):
    rows = load(spark, sf_dir, "events").withColumn("y", (F.col("value") > 50).cast("int"))
    out = E.time_ordered_target_encode(rows, "user_id", "y", "ts", tie(["event_id"]), "te")
    return out.select("event_id", F.round("te", 6).alias("te"))


@query(
    "w2_time_ordered_encoding_with_bin",
    over_reviews(
        f"""SELECT {KEY_SQL}, is_train, year(review_date) AS review_year, month(review_date) AS review_month,
          isodow(review_date) - 1 AS review_dayofweek, round(te, 6) AS critic_te_ts, {_bin_sql('te')} AS critic_te_ts_bin
        FROM (SELECT {KEY_SQL}, is_train, te FROM ts UNION ALL
          SELECT {KEY_SQL}, is_train, coalesce(te, {GM}) AS te FROM test LEFT JOIN te USING (critic))""",
        _ts_sql("critic", "ts"),
        _stats_sql("te", "critic", 10),
    ),
)
def w2(spark, sf_dir):
    train, test, _ = _sides(spark, sf_dir)
    columns = [*KEY, "is_train", "critic_te_ts"]
    past = E.time_ordered_target_encode(train, "critic", "target", "review_date", tie(), "critic_te_ts")
    held_out = E.target_encode(test, train, ["critic"], "target", 10, "critic_te_ts")
    df = E.with_bin(past.select(*columns).unionByName(held_out.select(*columns)), "critic_te_ts")
    dates = [c.cast("bigint").alias(n) for n, c in C.date_parts("review_date", "review").items()]
    return df.select(
        *KEY, "is_train", *dates, F.round("critic_te_ts", 6).alias("critic_te_ts"), "critic_te_ts_bin"
    )


@query(
    "w3_prior_count_and_rate",
    over_reviews(
        f"""SELECT {KEY_SQL}, n AS prior_count, round(CASE WHEN n > 0 THEN s::DOUBLE / n ELSE {GM} END, 6) AS prior_rate FROM ts
        UNION ALL SELECT {KEY_SQL}, coalesce(n, 0), round(coalesce(r, {GM}), 6) FROM test
          LEFT JOIN (SELECT movie, count(*) AS n, avg(target) AS r FROM train GROUP BY 1) USING (movie)""",
        _ts_sql("movie", "ts"),
    ),
)
def w3(spark, sf_dir):
    train, test, _ = _sides(spark, sf_dir)
    columns = [*KEY, "prior_count", F.round("prior_rate", 6).alias("prior_rate")]
    past = E.prior_rate(train, "movie", "target", "review_date", tie())
    return past.select(*columns).unionByName(E.total_rate(test, train, "movie", "target").select(*columns))


@query(
    "w4_group_totals",
    over_reviews(f"""SELECT {KEY_SQL}, CAST(sum(target) OVER w AS BIGINT) AS group_sum, count(*) OVER w AS group_count
      FROM train WINDOW w AS (PARTITION BY critic)"""),
)
def w4(spark, sf_dir):
    train, _, _ = _sides(spark, sf_dir)
    return E.group_totals(train, ["critic"], "target").select(*KEY, "group_sum", "group_count")
