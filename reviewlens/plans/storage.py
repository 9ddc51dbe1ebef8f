"""Queries of readers and writers (IO1-IO8, M13). Writers write to a new scratch path and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens.operators import analyze as A
from reviewlens.functions.columns import outcome_columns
from reviewlens.plans.blending import SETS_SQL, _sets
from reviewlens.plans.registry import query
from reviewlens.plans.tables import KEY, KEY_SQL, load, over_reviews, reviews
from reviewlens.session import scratch_path
from reviewlens.sources import io as IO

_CSV = "critic bigint, movie bigint, title string, info string, directors string, runtime double, review_date string, target int"
_TEXT = """title || ', "' || directors || '"' || chr(10) || info"""


@query(
    "io1_read_review_csv",
    over_reviews(f"""SELECT critic, movie, title, {_TEXT} AS info, directors, runtime,
      review_date, target FROM reviews"""),
)
def io1(spark, sf_dir):
    """Texts with quotes, separators, line breaks and nulls survive the round trip."""
    rows = reviews(spark, sf_dir)
    text = F.concat("title", F.lit(', "'), "directors", F.lit('"\n'), "info")
    rows = rows.withColumn("info", text).select(
        "critic", "movie", "title", "info", "directors", "runtime", F.col("review_date").cast("string"), "target"
    )
    root = scratch_path(spark, "reviews")
    IO.write_reviews(rows, f"{root}/train.csv")
    df = IO.read_reviews(spark, [f"{root}-elsewhere", root], "train.csv", _CSV)
    return df.withColumn("review_date", F.to_date("review_date"))


@query("io2_pruned_scan", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def io2(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select("l_suppkey").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("io3_read_vectors", "SELECT vec_id, embedding FROM embeddings")
def io3(spark, sf_dir):
    return IO.read_vectors(spark, f"{sf_dir}/embeddings.parquet", "vec_id").select("vec_id", "embedding")


@query("io3_read_wide_vectors", "SELECT vec_id, embedding FROM embeddings")
def io3_wide(spark, sf_dir):
    wide = load(spark, sf_dir, "embeddings").select("vec_id", *[F.col("embedding")[i].alias(f"emb_{i}") for i in range(64)])
    path = scratch_path(spark, "vectors")
    wide.write.parquet(path)
    return IO.read_vectors(spark, path, "vec_id", "emb_")


@query("io4_write_vectors", "SELECT vec_id, embedding FROM embeddings")
def io4(spark, sf_dir):
    path = IO.write_vectors(load(spark, sf_dir, "embeddings"), scratch_path(spark, "vectors"), "vec_id")
    return IO.read_vectors(spark, path, "vec_id")


@query("io5_write_predictions", over_reviews("SELECT ID, round(target, 6) AS target FROM a", *SETS_SQL))
def io5(spark, sf_dir):
    ids, sets = _sets(spark, sf_dir)
    path = IO.write_predictions(ids, sets["a"], scratch_path(spark, "predictions"))
    df, _ = IO.read_predictions(spark, {"a": path}, key_type="string")
    return df.select("ID", F.round("target", 6).alias("target"))


@query(
    "io6_read_prediction_sets",
    over_reviews(
        """SELECT 'a' AS source, 'ok' AS status, count(*) AS n FROM a UNION ALL SELECT 'b', 'ok', count(*) FROM b
        UNION ALL SELECT 'gone', 'missing', 0 UNION ALL SELECT 'none', 'no rows', 0""",
        *SETS_SQL,
    ),
)
def io6(spark, sf_dir):
    _, sets = _sets(spark, sf_dir)
    root = scratch_path(spark, "predictions")
    for name in ("a", "b"):
        sets[name].write.option("header", True).csv(f"{root}/set_{name}")
    sets["a"].limit(0).write.option("header", True).csv(f"{root}/set_none")
    paths = {p.rsplit("set_", 1)[1]: p for p in IO.list_predictions(spark, root, "set_*")}
    df, status = IO.read_predictions(spark, {**paths, "gone": f"{root}/set_gone"}, key_type="string")
    counts = df.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return status.join(counts, "source", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


@query(
    "io7_pending_configs",
    over_reviews("""SELECT DISTINCT content_rating, publisher FROM reviews
      EXCEPT SELECT content_rating, publisher FROM reviews WHERE review_year = 2001"""),
)
def io7(spark, sf_dir):
    df = reviews(spark, sf_dir).withColumn("config", F.concat_ws("/", "content_rating", "publisher"))
    configs = df.select("config", "content_rating", "publisher").distinct()
    done = df.filter("review_year = 2001").select("config").distinct()
    return IO.pending(configs, done, "config").select("content_rating", "publisher")


@query(
    "io8_write_analysis",
    over_reviews(f"""SELECT {KEY_SQL}, target, pred, CAST(pred >= 0.5 AS INTEGER) AS pred_label,
      CASE WHEN target = 1 AND pred >= 0.5 THEN 'TP' WHEN target = 1 THEN 'FN' WHEN pred >= 0.5 THEN 'FP' ELSE 'TN' END AS outcome,
      content_rating FROM test"""),
)
def io8(spark, sf_dir):
    test = reviews(spark, sf_dir).filter("NOT is_train")
    columns = outcome_columns("target", "pred")
    rows = test.withColumns(columns).select(*KEY, "target", "pred", "pred_label", "outcome", "content_rating")
    path = IO.write_analysis(rows, scratch_path(spark, "analysis"), "content_rating")
    return spark.read.parquet(path)


@query(
    "m13_rerun_failed_configs",
    over_reviews("""SELECT publisher AS config, round(coalesce(
      avg((pred - target) * (pred - target)) FILTER (WHERE review_year = 1995 AND top_critic),
      avg((pred - target) * (pred - target))), 6) AS score, CAST(NULL AS VARCHAR) AS error FROM train GROUP BY publisher"""),
)
def m13(spark, sf_dir):
    """Configurations that fail for lack of rows are run again on all rows and replaced."""
    train = reviews(spark, sf_dir).filter("is_train")
    sample = train.filter("review_year = 1995 AND top_critic")

    def run(rows):
        return A.probability_metrics(rows, ["config"], "target", "pred").select("config", F.round("brier", 6).alias("score"))

    configs = train.select(F.col("publisher").alias("config")).distinct()
    done = run(sample.withColumn("config", F.col("publisher")))
    first = configs.join(done, "config", "left").withColumn("error", F.when(F.col("score").isNull(), "no rows"))
    failed = IO.failed_configs(first)
    again = train.withColumn("config", F.col("publisher")).join(failed, "config", "left_semi")
    rerun = run(again).withColumn("error", F.lit(None).cast("string"))
    return IO.splice_results(first, rerun)
