"""Queries of the row-wise operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens.functions import columns as C
from reviewlens.functions import vectors as V
from reviewlens.operators.encode import target_encode
from reviewlens.plans.registry import query
from reviewlens.plans.tables import KEY, KEY_SQL, load, over_reviews, reviews


@query(
    "p01_date_parts",
    over_reviews(f"""SELECT {KEY_SQL}, year(review_date) AS review_year, month(review_date) AS review_month,
      isodow(review_date) - 1 AS review_dayofweek, year(release_date) AS release_year,
      month(release_date) AS release_month, isodow(release_date) - 1 AS release_dayofweek FROM reviews"""),
)
def p01(spark, sf_dir):
    df = reviews(spark, sf_dir, release=True).select(*KEY, "release_date")
    texts = df.select(
        *KEY,
        C.to_date(F.col("review_date").cast("string")).alias("_review"),
        C.to_date(F.col("release_date").cast("string")).alias("_release"),
    )
    parts = {**C.date_parts("_review", "review"), **C.date_parts("_release", "release")}
    return texts.select(*KEY, *[c.cast("bigint").alias(n) for n, c in parts.items()])


@query(
    "p02_age_in_days",
    over_reviews(f"""SELECT {KEY_SQL},
      CASE WHEN review_date >= release_date THEN CAST(review_date - release_date AS BIGINT) END AS age_days
      FROM reviews"""),
)
def p02(spark, sf_dir):
    df = reviews(spark, sf_dir, release=True)
    return df.select(*KEY, C.age_days("review_date", "release_date").cast("bigint").alias("age_days"))


@query(
    "p03_genre_flags",
    over_reviews(
        f"SELECT {KEY_SQL}, "
        + ", ".join(f"CAST(coalesce(genres, '') ILIKE '%{g}%' AS INTEGER) AS genre_{g}" for g in C.GENRES)
        + " FROM reviews"
    ),
)
def p03(spark, sf_dir):
    return reviews(spark, sf_dir).select(*KEY, *[c.alias(n) for n, c in C.genre_flags("genres").items()])


@query(
    "p04_fill_missing_category",
    over_reviews(f"""SELECT {KEY_SQL}, coalesce(production_company, 'missing') AS production_company,
      coalesce(directors, 'missing') AS directors FROM reviews"""),
)
def p04(spark, sf_dir):
    return reviews(spark, sf_dir).select(
        *KEY, *[C.fill_missing(c).alias(c) for c in ("production_company", "directors")]
    )


@query(
    "p05_median_fill",
    over_reviews(f"""SELECT {KEY_SQL}, coalesce(runtime, (SELECT median(runtime) FROM train)) AS runtime
      FROM reviews"""),
)
def p05(spark, sf_dir):
    df = reviews(spark, sf_dir)
    return C.fill_train_median(df, df.filter("is_train"), "runtime").select(*KEY, "runtime")


@query(
    "p06_right_closed_bins",
    over_reviews(f"""SELECT {KEY_SQL},
      CASE WHEN pred > 0 AND pred <= 0.33 THEN 0.0::DOUBLE WHEN pred > 0.33 AND pred <= 0.67 THEN 1
           WHEN pred > 0.67 AND pred <= 1.01 THEN 2 ELSE 1 END AS pred_bin,
      CASE WHEN runtime > 0 AND runtime <= 90 THEN 0.0::DOUBLE WHEN runtime > 90 AND runtime <= 120 THEN 1
           WHEN runtime > 120 AND runtime <= 150 THEN 2 WHEN runtime > 150 AND runtime <= 1000 THEN 3
           ELSE 1 END AS runtime_bin FROM reviews"""),
)
def p06(spark, sf_dir):
    return reviews(spark, sf_dir).select(
        *KEY,
        C.right_closed_bin("pred", C.TARGET_MEAN_EDGES).alias("pred_bin"),
        C.right_closed_bin("runtime", C.RUNTIME_EDGES).alias("runtime_bin"),
    )


@query(
    "p07_age_bin",
    over_reviews(f"""SELECT {KEY_SQL}, CASE WHEN age < 0 THEN 0 WHEN age < 365 THEN 1 WHEN age < 1825 THEN 2
      WHEN age < 7300 THEN 3 ELSE 4 END AS age_bin
      FROM (SELECT *, review_date - release_date AS age FROM reviews)"""),
)
def p07(spark, sf_dir):
    df = reviews(spark, sf_dir, release=True).withColumn("_age", C.age_days("review_date", "release_date"))
    return df.select(*KEY, C.age_bin("_age").alias("age_bin"))


@query(
    "p08_decade",
    over_reviews(f"""SELECT {KEY_SQL}, CASE WHEN target = 1 THEN CAST(floor(year(release_date) / 10.0) * 10 AS INTEGER)
      ELSE 1990 END AS release_decade FROM reviews"""),
)
def p08(spark, sf_dir):
    df = reviews(spark, sf_dir, release=True)
    df = df.withColumn("_year", F.when(F.col("target") == 1, F.year("release_date")))
    return df.select(*KEY, C.decade("_year").alias("release_decade"))


@query(
    "p09_text_measures",
    r"""SELECT doc_id, length(text) AS text_len,
      len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda t: t <> '')) AS text_words
      FROM documents""",
)
def p09(spark, sf_dir):
    return load(spark, sf_dir, "documents").select(
        "doc_id",
        C.text_length("text").cast("bigint").alias("text_len"),
        C.word_count("text").cast("bigint").alias("text_words"),
    )


@query(
    "p09_title_and_info_measures",
    over_reviews(f"""SELECT {KEY_SQL}, length(coalesce(info, 'missing')) AS info_len,
      len(string_split(coalesce(info, 'missing'), ' ')) AS info_words, length(title) AS title_len,
      len(string_split(title, ' ')) AS title_words FROM reviews"""),
)
def p09_reviews(spark, sf_dir):
    columns = {}
    for name in ("info", "title"):
        columns[f"{name}_len"] = C.text_length(name)
        columns[f"{name}_words"] = C.word_count(name)
    return reviews(spark, sf_dir).select(*KEY, *[c.cast("bigint").alias(n) for n, c in columns.items()])


@query(
    "p10_missing_flags",
    over_reviews(f"""SELECT {KEY_SQL}, CAST(runtime IS NULL AS INTEGER) AS is_runtime_missing,
      CAST(review_date < release_date AS INTEGER) AS is_age_missing,
      CAST(info IS NULL AS INTEGER) AS is_info_missing,
      CAST(production_company IS NULL AS INTEGER) AS is_company_missing FROM reviews"""),
)
def p10(spark, sf_dir):
    df = reviews(spark, sf_dir, release=True).withColumn("_age", C.age_days("review_date", "release_date"))
    return df.select(
        *KEY,
        C.missing_flag("runtime").alias("is_runtime_missing"),
        C.missing_flag("_age").alias("is_age_missing"),
        C.missing_flag("info").alias("is_info_missing"),
        C.missing_flag("production_company").alias("is_company_missing"),
    )


_CRITIC_TE_SQL = """stats AS (SELECT critic, (sum(target) + 10 * (SELECT avg(target) FROM train)) / (count(*) + 10) AS te
  FROM train GROUP BY critic),
enc AS (SELECT r.*, coalesce(te, (SELECT avg(target) FROM train)) AS te FROM reviews r LEFT JOIN stats USING (critic))"""


@query(
    "p11_interactions",
    over_reviews(
        f"""SELECT {KEY_SQL},
      round(te * CAST(coalesce(genres, '') ILIKE '%documentary%' AS INTEGER), 6) AS documentary_x_te,
      round(te * CAST(top_critic AS INTEGER), 6) AS top_critic_x_te,
      round(te * CASE WHEN runtime <= 90 THEN 0 WHEN runtime <= 120 THEN 1 WHEN runtime <= 150 THEN 2
        WHEN runtime IS NULL THEN 1 ELSE 3 END, 6) AS runtime_bin_x_te FROM enc""",
        _CRITIC_TE_SQL,
    ),
)
def p11(spark, sf_dir):
    df = reviews(spark, sf_dir)
    df = target_encode(df, df.filter("is_train"), ["critic"], "target", 10, "te")
    flag = C.genre_flags("genres", ("Documentary",))["genre_Documentary"]
    return df.select(
        *KEY,
        F.round(C.product("te", flag), 6).alias("documentary_x_te"),
        F.round(C.product("te", F.col("top_critic").cast("int")), 6).alias("top_critic_x_te"),
        F.round(C.product("te", C.right_closed_bin("runtime", C.RUNTIME_EDGES)), 6).alias("runtime_bin_x_te"),
    )


@query(
    "p12_train_range_scale",
    over_reviews(
        f"""SELECT {KEY_SQL}, round((review_year - lo) / greatest(hi - lo, 1)::DOUBLE, 6) AS year_norm,
      round((review_year - lo) / greatest(hi - lo, 1)::DOUBLE * te, 6) AS year_norm_x_te
      FROM enc, (SELECT min(review_year) AS lo, max(review_year) AS hi FROM train)""",
        _CRITIC_TE_SQL,
    ),
)
def p12(spark, sf_dir):
    df = reviews(spark, sf_dir)
    train = df.filter("is_train")
    df = target_encode(df, train, ["critic"], "target", 10, "te")
    df = C.scale_by_train_range(df, train, "review_year", "year_norm")
    return df.select(
        *KEY, F.round("year_norm", 6).alias("year_norm"), F.round(C.product("year_norm", "te"), 6).alias("year_norm_x_te")
    )


@query(
    "p13_title_and_info_text",
    over_reviews("""SELECT DISTINCT movie, concat('Title: ', coalesce(title, ''), '. ', coalesce(info, '')) AS text
      FROM reviews"""),
)
def p13(spark, sf_dir):
    movies = reviews(spark, sf_dir).select("movie", "title", "info").distinct()
    return movies.select("movie", C.title_and_info("title", "info").alias("text"))


@query(
    "p14_tagged_row_text",
    over_reviews(f"""SELECT {KEY_SQL}, concat('[MOVIE] ', title, ' [INFO] ', coalesce(info, '[NO_INFO]'),
      ' [GENRES] ', coalesce(genres, '[NO_GENRES]'), ' [DIRECTORS] ', coalesce(directors, '[NO_DIRECTORS]'),
      ' [PRODUCTION] ', coalesce(production_company, '[NO_PRODUCTION]'), ' [CRITIC] ', critic,
      ' [TOP_CRITIC] ', CASE WHEN top_critic THEN 'True' ELSE 'False' END, ' [PUBLISHER] ', publisher,
      ' [CONTENT] ', content_rating) AS text FROM reviews"""),
)
def p14(spark, sf_dir):
    names = ("title", "info", "genres", "directors", "production_company", "critic", "top_critic", "publisher",
             "content_rating")
    return reviews(spark, sf_dir).select(*KEY, C.tagged_text({n: n for n in names}).alias("text"))


@query(
    "p15_list_size_and_first",
    over_reviews(f"""SELECT {KEY_SQL}, CASE WHEN directors IS NULL THEN 0 ELSE len(string_split(directors, ','))
      END AS n_directors, trim(string_split(directors, ',')[1]) AS first_director,
      CASE WHEN genres IS NULL THEN 0 ELSE len(string_split(genres, ',')) END AS n_genres FROM reviews"""),
)
def p15(spark, sf_dir):
    return reviews(spark, sf_dir).select(
        *KEY,
        C.list_size("directors").cast("bigint").alias("n_directors"),
        C.first_of_list("directors").alias("first_director"),
        C.list_size("genres").cast("bigint").alias("n_genres"),
    )


@query(
    "p16_token_estimate",
    """SELECT count(*) AS texts, CAST(sum(greatest(1, length(text) // 2)) AS BIGINT) AS tokens,
      CAST(ceil(count(*) / 200.0) AS BIGINT) AS batches,
      round(CAST(sum(greatest(1, length(text) // 2)) AS BIGINT) / 1e6::DOUBLE * 0.02::DOUBLE, 6) AS cost
      FROM documents""",
)
def p16(spark, sf_dir):
    out = C.embedding_cost(load(spark, sf_dir, "documents"), "text", 0.02)
    return out.withColumn("cost", F.round("cost", 6))


_RAW_SCORE = """CASE WHEN l_linenumber = 1 THEN 'nan'::DOUBLE WHEN l_linenumber = 2 THEN 'inf'::DOUBLE
  WHEN l_linenumber = 3 THEN '-inf'::DOUBLE WHEN l_linenumber = 4 THEN NULL ELSE l_discount * 20 - 0.5 END"""


@query(
    "p17_clean_score",
    f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate::DATE AS l_shipdate,
      round(CASE WHEN x IS NULL OR isnan(x) THEN 0.5 ELSE least(1, greatest(0, x)) END, 6) AS score
      FROM (SELECT *, {_RAW_SCORE} AS x FROM lineitem)""",
)
def p17(spark, sf_dir):
    number = F.col("l_linenumber")
    raw = (
        F.when(number == 1, float("nan"))
        .when(number == 2, float("inf"))
        .when(number == 3, float("-inf"))
        .when(number == 4, None)
        .otherwise(F.col("l_discount") * 20 - 0.5)
    )
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("l_shipdate"),
        F.round(C.clean_score(raw), 6).alias("score"),
    )


@query(
    "p18_outcomes",
    over_reviews(f"""SELECT {KEY_SQL}, CAST(pred >= 0.5 AS INTEGER) AS pred_label,
      CAST((pred >= 0.5) = (target = 1) AS INTEGER) AS correct,
      CASE WHEN target = 1 AND pred >= 0.5 THEN 'TP' WHEN target = 1 THEN 'FN' WHEN pred >= 0.5 THEN 'FP'
           ELSE 'TN' END AS outcome FROM reviews"""),
)
def p18(spark, sf_dir):
    return reviews(spark, sf_dir).select(*KEY, *[c.alias(n) for n, c in C.outcome_columns("target", "pred").items()])


@query(
    "p19_vector_dot",
    over_reviews(f"""SELECT {KEY_SQL}, round(list_dot_product(u.embedding::DOUBLE[], i.embedding::DOUBLE[]), 6) AS dot
      FROM reviews JOIN embeddings u ON u.vec_id = critic JOIN embeddings i ON i.vec_id = movie"""),
)
def p19(spark, sf_dir):
    vectors = load(spark, sf_dir, "embeddings")
    users = vectors.select(F.col("vec_id").alias("critic"), F.col("embedding").alias("_u"))
    items = vectors.select(F.col("vec_id").alias("movie"), F.col("embedding").alias("_i"))
    df = reviews(spark, sf_dir).select(*KEY).join(users, "critic").join(items, "movie")
    return df.select(*KEY, F.round(V.dot("_u", "_i"), 6).alias("dot"))


@query(
    "p20_unit_vectors",
    """SELECT vec_id, list_transform(embedding::DOUBLE[],
      lambda x: round(x / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-9), 6)) AS unit
      FROM embeddings""",
)
def p20(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select(
        "vec_id", V.rounded(V.unit("embedding"), 6).alias("unit")
    )


@query("p21_first_dims", "SELECT vec_id, embedding[1:32] AS head FROM embeddings")
def p21(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select("vec_id", V.first_dims("embedding", 32).alias("head"))


@query(
    "p22_clip_ratio",
    over_reviews(f"""SELECT {KEY_SQL}, round(least(1e6::DOUBLE, greatest(0, coalesce(
      CASE WHEN pred_b <> 0 THEN (pred - 0.2) * 1e6 / pred_b END, 1))), 6) AS ratio FROM reviews"""),
)
def p22(spark, sf_dir):
    ratio = C.safe_ratio((F.col("pred") - 0.2) * 1e6, F.col("pred_b"))
    return reviews(spark, sf_dir).select(*KEY, F.round(C.clip_ratio(ratio), 6).alias("ratio"))


@query(
    "p23_repair_non_finite",
    """WITH broken AS (SELECT vec_id, label, list_transform(embedding, lambda x:
        CASE WHEN abs(x) < 0.01 THEN NULL WHEN abs(x) > 0.3 THEN 'nan'::FLOAT ELSE x END)::DOUBLE[] AS v FROM embeddings),
      cells AS (SELECT vec_id, label, unnest(range(1, 65)) AS d, unnest(v) AS x FROM broken),
      med AS (SELECT d, coalesce(median(x) FILTER (WHERE NOT isnan(x)), 0) AS m FROM cells WHERE label < 8 GROUP BY d)
      SELECT vec_id, list(round(CASE WHEN x IS NULL OR isnan(x) THEN m ELSE x END, 6) ORDER BY d) AS repaired
      FROM cells JOIN med USING (d) GROUP BY vec_id""",
)
def p23(spark, sf_dir):
    broken = load(spark, sf_dir, "embeddings").withColumn(
        "embedding",
        F.transform(
            "embedding",
            lambda x: F.when(F.abs(x) < 0.01, None).when(F.abs(x) > 0.3, float("nan")).otherwise(x).cast("double"),
        ),
    )
    fixed = V.repair_non_finite(broken, broken.filter("label < 8"), "embedding", 64)
    return fixed.select("vec_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("repaired"))


@query(
    "p24_row_filters",
    over_reviews(f"""SELECT {KEY_SQL} FROM train WHERE review_year < 2000 AND (pred >= 0.9 OR pred <= 0.1)
      AND critic IN (SELECT critic FROM train GROUP BY critic HAVING count(*) >= 50)"""),
)
def p24(spark, sf_dir):
    train = reviews(spark, sf_dir).filter("is_train")
    large = train.groupBy("critic").agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 50").select("critic")
    rows = train.filter("review_year < 2000").filter(C.is_confident("pred", 0.9, 0.1))
    return rows.join(large, "critic", "left_semi").select(*KEY)
