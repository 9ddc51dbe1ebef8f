"""The given tables read as review data, in Spark and as SQL text for the checks.

One lineitem row is one review: supplier = critic, part = movie. Rows of 2001 are held out. So are
documentaries and the critics of one nation, which makes unseen movies and unseen critics appear in
the held-out side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["order_id", "movie", "critic", "line", "review_date"]
KEY_SQL = ", ".join(KEY)
TIE_SQL = "md5(concat_ws('|', order_id, movie, critic, line, review_date))"

GENRES_OF_TYPE = {
    "STANDARD": "Drama, Romance",
    "ECONOMY": "Comedy",
    "MEDIUM": "action & adventure, Mystery",
    "PROMO": "Documentary",
    "LARGE": "Horror, Science Fiction & FANTASY",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tie(columns: list[str] | None = None) -> Column:
    """Hash of the row key: breaks ties in a fixed way and spreads a hot key evenly."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in (columns or KEY)]))


def reviews(spark: SparkSession, sf_dir: str, release: bool = False) -> DataFrame:
    """Review rows. ``release`` adds the release date, which costs the join to orders."""
    part = load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("movie"),
        F.col("p_name").alias("title"),
        F.when(F.col("p_size") <= 45, F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("info"),
        F.col("p_type").alias("movie_type"),
        F.col("p_brand").alias("content_rating"),
        F.when(F.col("p_size") > 5, F.col("p_brand")).alias("production_company"),
        F.when(F.col("p_size") > 25, F.concat_ws(", ", "p_brand", "p_type"))
        .when(F.col("p_size") > 5, F.col("p_brand"))
        .alias("directors"),
        F.when(F.col("p_size") % 10 != 0, (F.col("p_size") * 4).cast("double")).alias("runtime"),
    )
    genres = F.lit(None).cast("string")
    for movie_type, text in GENRES_OF_TYPE.items():
        genres = F.when(F.col("movie_type") == movie_type, text).otherwise(genres)
    critics = load(spark, sf_dir, "supplier").join(
        load(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    ).select(
        F.col("s_suppkey").alias("critic"),
        F.col("n_name").alias("publisher"),
        (F.col("s_acctbal") > 5000).alias("top_critic"),
    )
    rows = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("movie"),
        F.col("l_suppkey").alias("critic"),
        F.col("l_linenumber").alias("line"),
        F.col("l_shipdate").cast("date").alias("review_date"),
        (F.col("l_returnflag") != "A").cast("int").alias("target"),
        F.round(F.col("l_discount") * 10, 6).alias("pred"),
        F.round(F.col("l_tax") * 12.5, 6).alias("pred_b"),
        ((F.col("l_quantity") - 1) / 49).alias("pred_c"),
    )
    # The date comes before what describes a movie, so that rows are still narrow when they travel to the orders.
    dates = []
    if release:
        orders = load(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").cast("date").alias("release_date")
        )
        rows, dates = rows.join(orders, "order_id"), ["release_date"]
    rows = rows.join(part, "movie").join(critics, "critic")
    first = ["order_id", "critic", "movie"] if release else ["critic", "movie"]
    rows = rows.select(*first, *[c for c in rows.columns if c not in (*first, *dates)], *dates)
    return (
        rows.withColumn("genres", genres)
        .withColumn("review_year", F.year("review_date"))
        .withColumn(
            "is_train",
            (F.col("review_year") <= 2000)
            & (F.col("movie_type") != "PROMO")
            & (F.col("publisher") != "NATION_20"),
        )
    )


_GENRES_SQL = "CASE p_type " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in GENRES_OF_TYPE.items()
) + " END"

REVIEWS_SQL = f"""reviews AS (
  SELECT *, review_year <= 2000 AND movie_type <> 'PROMO' AND publisher <> 'NATION_20' AS is_train
  FROM (
    SELECT l_orderkey AS order_id, l_partkey AS movie, l_suppkey AS critic, l_linenumber AS line,
      CAST(l_shipdate AS DATE) AS review_date, CAST(year(l_shipdate) AS INTEGER) AS review_year,
      CAST(o_orderdate AS DATE) AS release_date,
      CAST(l_returnflag <> 'A' AS INTEGER) AS target,
      round(l_discount * 10, 6) AS pred, round(l_tax * 12.5, 6) AS pred_b,
      (l_quantity - 1) / 49 AS pred_c,
      p_name AS title, CASE WHEN p_size <= 45 THEN concat_ws(' ', p_name, p_type, p_brand) END AS info,
      p_type AS movie_type, p_brand AS content_rating,
      CASE WHEN p_size > 5 THEN p_brand END AS production_company,
      CASE WHEN p_size > 25 THEN concat_ws(', ', p_brand, p_type) WHEN p_size > 5 THEN p_brand END AS directors,
      CASE WHEN p_size % 10 <> 0 THEN CAST(p_size * 4 AS DOUBLE) END AS runtime,
      {_GENRES_SQL} AS genres, n_name AS publisher, s_acctbal > 5000 AS top_critic
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
      JOIN nation ON s_nationkey = n_nationkey JOIN orders ON l_orderkey = o_orderkey))"""


def over_reviews(body: str, *ctes: str) -> str:
    """Check SQL that starts from the review rows; ``train`` and ``test`` are predefined."""
    parts = [
        REVIEWS_SQL,
        "train AS (SELECT * FROM reviews WHERE is_train)",
        "test AS (SELECT * FROM reviews WHERE NOT is_train)",
        *ctes,
    ]
    return "WITH " + ",\n".join(parts) + "\n" + body
