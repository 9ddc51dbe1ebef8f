"""Queries of factorization and vector reduction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from reviewlens.functions.vectors import rounded
from reviewlens.operators import factor as X
from reviewlens.operators.keys import number_keys
from reviewlens.plans.registry import query
from reviewlens.plans.tables import KEY, load, over_reviews, reviews
from reviewlens.session import cut_lineage


def _pairs(spark, sf_dir, train_only=False):
    df = reviews(spark, sf_dir)
    frames = [df.filter("is_train")] if train_only else [df.filter("is_train"), df.filter("NOT is_train")]
    return X.interactions(frames, "critic", "movie")


def _vectors(spark, sf_dir):
    return load(spark, sf_dir, "embeddings")


def _zeros(k):
    return F.array_repeat(F.lit(0.0), k)


def _show(df, vector):
    return df.withColumn(vector, rounded(vector, 6))


def _attach(df, factors, key, out, default):
    """Rows with the rounded factors of their key; they are rounded once a key, not once a row."""
    shown = factors.select(key, rounded(F.col("vector").cast("array<double>"), 6).alias("vector"))
    rest = df.sparkSession.range(1).select(default.alias("d")).select(rounded("d", 6).alias("d")).scalar()
    return X.attach_factors(df, shown, key, "vector", out, rest)


@query(
    "f01_interaction_matrix",
    over_reviews("SELECT critic, movie, count(*) AS value FROM reviews GROUP BY critic, movie"),
)
def f01(spark, sf_dir):
    return _pairs(spark, sf_dir)


_TOP_SQL = """pairs AS (SELECT {key}, {other}, count(*) AS value FROM train GROUP BY 1, 2),
  top AS (SELECT {other}, row_number() OVER (ORDER BY {other}) - 1 AS index FROM (SELECT {other}, sum(value) AS t FROM pairs
    GROUP BY 1 ORDER BY t DESC, {other} LIMIT {n}))"""


@query(
    "a19_neighbour_documents",
    over_reviews(
        "SELECT critic, movie, value FROM pairs JOIN top USING (movie)", _TOP_SQL.format(key="critic", other="movie", n=2000)
    ),
)
def a19(spark, sf_dir):
    pairs = _pairs(spark, sf_dir, train_only=True)
    return X.neighbour_counts(pairs, "critic", "movie", 2000).select("critic", "movie", "value")


@query(
    "f05_neighbour_document_counts",
    over_reviews(
        "SELECT movie, CAST(index AS INTEGER) AS index, value FROM pairs JOIN top USING (critic)",
        _TOP_SQL.format(key="movie", other="critic", n=2000),
    ),
)
def f05_counts(spark, sf_dir):
    pairs = _pairs(spark, sf_dir, train_only=True)
    return X.neighbour_counts(pairs, "movie", "critic").select("movie", "index", "value")


@query(
    "a20_column_means",
    "SELECT " + ", ".join(f"round(avg(embedding[{i + 1}])::DOUBLE, 6) AS mean_{i}" for i in range(64)) + " FROM embeddings",
)
def a20(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    means = spark.range(1).select(X.column_means(vectors, "embedding").alias("m"))
    return means.select(*[F.round(F.col("m")[i], 6).alias(f"mean_{i}") for i in range(64)])


@query("f02_implicit_factors")
def f02(spark, sf_dir):
    df = reviews(spark, sf_dir)
    users, items = X.implicit_factors(_pairs(spark, sf_dir), "critic", "movie", 8)
    out = _attach(df.select(*KEY), users, "critic", "critic_factors", _zeros(8))
    return _attach(out, items, "movie", "movie_factors", _zeros(8))


@query(
    "f03_negative_samples",
    """WITH pairs AS (SELECT DISTINCT l_suppkey AS critic, l_partkey AS movie FROM lineitem),
      items AS (SELECT movie, row_number() OVER (ORDER BY md5(movie::VARCHAR)) - 1 AS number FROM (SELECT DISTINCT movie FROM pairs)),
      picked AS (SELECT p.critic, p.movie, i.movie AS negative FROM pairs p JOIN items i ON i.number =
        CAST(('0x' || substr(md5(concat_ws('|', p.critic, p.movie, '0')), 1, 8)) AS BIGINT) % (SELECT count(*) FROM items))
      SELECT * FROM picked WHERE NOT EXISTS (SELECT 1 FROM pairs q WHERE q.critic = picked.critic AND q.movie = picked.negative)""",
)
def f03_sampler(spark, sf_dir):
    pairs = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("critic"), F.col("l_partkey").alias("movie")).distinct()
    items = number_keys(pairs.select("movie").distinct(), "movie", "number")
    return X.sample_negatives(pairs, items, "critic", "movie", 0)


@query("f03_ranking_factors")
def f03(spark, sf_dir):
    users, items = X.ranking_factors(_pairs(spark, sf_dir), "critic", "movie", 8)
    out = _attach(reviews(spark, sf_dir).select(*KEY), users, "critic", "critic_factors", _zeros(8))
    return _attach(out, items, "movie", "movie_factors", _zeros(8))


@query(
    "f03_ranking_properties",
    """WITH pairs AS (SELECT DISTINCT l_suppkey AS critic, l_partkey AS movie FROM lineitem)
      SELECT (SELECT count(DISTINCT critic) FROM pairs) AS critics, (SELECT count(DISTINCT movie) FROM pairs) AS movies,
             CAST(8 AS INTEGER) AS shortest, CAST(8 AS INTEGER) AS longest, true AS finite, true AS ranks_own_items_first""",
)
def f03_properties(spark, sf_dir):
    """Every key has a finite vector of full length, and pairs score above items that their critic does not have."""
    pairs = _pairs(spark, sf_dir).select("critic", "movie")
    users, movies = X.ranking_factors(pairs, "critic", "movie", 8)
    both = users.select("vector").union(movies.select("vector"))
    shape = both.agg(F.min(F.size("vector")).alias("shortest"), F.max(F.size("vector")).alias("longest"),
                     F.min(F.forall("vector", lambda x: F.abs(x) < 1e6)).alias("finite"))
    numbers = number_keys(pairs.select("movie").distinct(), "movie", "number")
    accuracy = X.ranking_accuracy(X.sample_negatives(pairs, numbers, "critic", "movie", 999), users, movies, "critic", "movie")
    return shape.select(users.agg(F.count(F.lit(1))).scalar().alias("critics"), movies.agg(F.count(F.lit(1))).scalar().alias("movies"),
                        "shortest", "longest", "finite", (accuracy.scalar() > 0.5).alias("ranks_own_items_first"))


@query("f04_non_negative_factors")
def f04(spark, sf_dir):
    """0/1 matrix of train. Unseen critics get zeros, unseen movies the overall mean of the movie factors."""
    pairs = _pairs(spark, sf_dir, train_only=True).withColumn("value", F.lit(1.0))
    users, items = X.non_negative_factors(pairs, "critic", "movie", "value", 8)
    overall = items.select(F.explode("vector").alias("x")).agg(F.avg("x")).scalar()
    out = _attach(reviews(spark, sf_dir).select(*KEY), users, "critic", "critic_factors", _zeros(8))
    return _attach(out, items, "movie", "movie_factors", F.array_repeat(overall, 8))


@query("f05_neighbour_factors")
def f05(spark, sf_dir):
    """Unseen critics get zeros, unseen movies the column means."""
    pairs = cut_lineage(_pairs(spark, sf_dir, train_only=True))
    critics = X.neighbour_factors(pairs, "critic", "movie")
    movies = cut_lineage(X.neighbour_factors(pairs, "movie", "critic"))
    out = _attach(reviews(spark, sf_dir).select(*KEY), critics, "critic", "critic_factors", _zeros(32))
    return _attach(out, movies, "movie", "movie_factors", X.column_means(movies, "vector"))


def _weighted(spark, sf_dir):
    """Each movie vector with the number of train rows it appears on."""
    counts = reviews(spark, sf_dir).filter("is_train").groupBy(F.col("movie").alias("vec_id")).agg(F.count(F.lit(1)).alias("weight"))
    return _vectors(spark, sf_dir).join(counts, "vec_id")


@query("f06_principal_components")
def f06(spark, sf_dir):
    projection = X.fit_projection(_weighted(spark, sf_dir), "embedding", 16, centre=True, weight="weight")
    return _show(X.project(_vectors(spark, sf_dir).select("vec_id", "embedding"), "embedding", projection), "embedding")


@query("f07_truncated_svd")
def f07(spark, sf_dir):
    projection = X.fit_projection(_weighted(spark, sf_dir), "embedding", 16, centre=False, weight="weight")
    return _show(X.project(_vectors(spark, sf_dir).select("vec_id", "embedding"), "embedding", projection), "embedding")


def _all_components(spark, sf_dir, centre):
    """(place, x): all 64 components of every vector. Components are a rotation, so sums over all of them are kept."""
    vectors = _vectors(spark, sf_dir).select("vec_id", "embedding")
    projection = X.fit_projection(vectors, "embedding", 64, centre=centre)
    return X.project(vectors, "embedding", projection).select(F.posexplode("embedding").alias("place", "x"))


_CELLS = "FROM (SELECT i, embedding[i]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"


@query(
    "f06_variance_of_all_components",
    f"SELECT round(sum(v), 4) AS variance, true AS ordered, true AS uncorrelated FROM (SELECT var_pop(x) AS v {_CELLS} GROUP BY i)",
)
def f06_variance(spark, sf_dir):
    """Component variances add up to the trace, fall with the place, and components do not correlate."""
    cells = _all_components(spark, sf_dir, True)
    per_place = cells.groupBy("place").agg(F.var_pop("x").alias("v"))
    listed = per_place.agg(F.sort_array(F.collect_list(F.struct("place", "v"))).alias("l")).select(F.transform("l", lambda s: s["v"]).alias("v"))
    falls = F.forall(F.zip_with(F.slice("v", 1, 63), F.slice("v", 2, 63), lambda a, b: a >= b - 1e-9), lambda ok: ok)
    vectors = _vectors(spark, sf_dir).select("vec_id", "embedding")
    parts = X.project(vectors, "embedding", X.fit_projection(vectors, "embedding", 64, centre=True))
    # The components are centred, so their products are their covariances; all 2,016 pairs are looked at.
    products = X.gram(parts, "embedding") / parts.count()
    related = float(np.abs(products - np.diag(np.diag(products))).max())
    return listed.select(
        F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4).alias("variance"), falls.alias("ordered"),
        F.lit(related < 1e-6).alias("uncorrelated"),
    )


@query("f07_square_of_all_components", f"SELECT round(sum(x * x), 4) AS square {_CELLS}")
def f07_square(spark, sf_dir):
    return _all_components(spark, sf_dir, False).agg(F.round(F.sum(F.col("x") * F.col("x")), 4).alias("square"))


_RANDOM = X.random_projection(64, 8)


@query(
    "f08_random_projection",
    "SELECT vec_id, ["
    + ", ".join(
        f"round(list_dot_product(embedding::DOUBLE[], [{', '.join(repr(float(x)) for x in _RANDOM.matrix[:, j])}]::DOUBLE[]), 6)"
        for j in range(8)
    )
    + "] AS embedding FROM embeddings",
)
def f08(spark, sf_dir):
    return _show(X.project(_vectors(spark, sf_dir).select("vec_id", "embedding"), "embedding", _RANDOM), "embedding")


@query(
    "f09_scale_non_negative",
    """WITH s AS (SELECT min(list_min(embedding))::DOUBLE AS lo, max(list_max(embedding))::DOUBLE AS hi FROM embeddings WHERE label < 8)
      SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: round(least(1, greatest(0, (x - lo) / (hi - lo))), 4)) AS embedding
      FROM embeddings, s""",
)
def f09(spark, sf_dir):
    vectors = _vectors(spark, sf_dir).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    out = X.scale_non_negative(vectors, vectors.filter("label < 8"), "embedding")
    return out.select("vec_id", F.transform("embedding", lambda x: F.round(x, 4)).alias("embedding"))


@query("f09_non_negative_vectors")
def f09_nmf(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    scaled = X.scale_non_negative(vectors, vectors.filter("label < 8"), "embedding")
    long = X.to_long(scaled, "vec_id", "embedding")
    train = long.join(vectors.filter("label < 8").select("vec_id"), "vec_id", "left_semi")
    _, parts = X.non_negative_factors(train, "vec_id", "index", "value", 8)
    return _show(X.project_rows(long, "vec_id", "index", "value", parts, 8), "vector")
