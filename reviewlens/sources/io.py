"""Review files, vector tables and prediction files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.functions.columns import clean_score
from reviewlens.operators.blend import align_strict, require_aligned

# Columns of a review file.
REVIEW_SCHEMA = (
    "ID bigint, rotten_tomatoes_link string, critic_name string, top_critic boolean, publisher_name string, "
    "review_date string, movie_title string, movie_info string, content_rating string, genres string, "
    "directors string, authors string, actors string, original_release_date string, runtime double, "
    "production_company string, target int"
)
CSV_OPTIONS = {"header": True, "multiLine": True, "escape": '"'}


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def read_reviews(spark: SparkSession, roots: list[str], name: str, schema: str = REVIEW_SCHEMA) -> DataFrame:
    """Review CSV from the first root that holds it. Quoted fields may span lines.

    Such a file cannot be split, so each file is one task: convert large ones to Parquet once.
    """
    for root in roots:
        path = f"{root}/{name}"
        if exists(spark, path):
            return spark.read.options(**CSV_OPTIONS).schema(schema).csv(path)
    raise FileNotFoundError(f"{name} is in none of {roots}")


def write_reviews(df: DataFrame, path: str) -> str:
    df.write.options(header=True, escape='"').csv(path)
    return path


def read_vectors(spark: SparkSession, path: str, key: str, prefix: str | None = None) -> DataFrame:
    """Vector table with one array column. Wide tables are folded by ``prefix`` in number order.

    A damaged file stops the read; nothing is skipped.
    """
    df = spark.read.option("ignoreCorruptFiles", False).parquet(path)
    if prefix is None:
        return df
    wide = sorted((c for c in df.columns if c.startswith(prefix)), key=lambda c: int(c[len(prefix):]))
    if not wide:
        raise ValueError(f"{path} has no column named {prefix}*")
    return df.select(key, F.array(*[F.col(c).cast("float") for c in wide]).alias("embedding"))


def write_vectors(df: DataFrame, path: str, key: str, vector: str = "embedding") -> str:
    df.select(key, F.col(vector).cast("array<float>").alias(vector)).write.parquet(path)
    return path


def write_predictions(
    ids: DataFrame, predictions: DataFrame, path: str, inputs: tuple[str, ...] = (), key: str = "ID",
    score: str = "target", sanitize: bool = True,
) -> str:
    """Write (id, score) as CSV. Every id must have exactly one score; inputs are never overwritten."""
    if key not in ids.columns:
        raise ValueError(f"there is no column {key} among {ids.columns}")
    if path.rstrip("/") in {p.rstrip("/") for p in inputs}:
        raise ValueError(f"{path} is an input of this job")
    require_aligned(predictions, ids, key)
    out = align_strict(predictions, ids, key, score)
    if sanitize:
        out = out.withColumn(score, clean_score(score))
    out.select(key, score).write.option("header", True).csv(path)
    return path


def read_predictions(
    spark: SparkSession, paths: dict[str, str], key: str = "ID", score: str = "target", key_type: str = "bigint"
) -> tuple[DataFrame, DataFrame]:
    """All readable prediction files as (source, key, score), and a status row per file.

    Status is ``missing``, ``empty`` (no columns), ``no rows`` or ``ok``.
    """
    status, found = [], None
    for source, path in paths.items():
        if not exists(spark, path):
            status.append((source, "missing"))
            continue
        try:
            header = spark.read.option("header", True).csv(path).columns
        except AnalysisException:
            header = []
        if key not in header or score not in header:
            status.append((source, "empty"))
            continue
        df = spark.read.option("header", True).csv(path).select(
            F.lit(source).alias("source"), F.col(key).cast(key_type).alias(key), F.col(score).cast("double").alias(score)
        )
        status.append((source, "ok" if df.take(1) else "no rows"))
        found = df if found is None else found.unionByName(df)
    if found is None:
        found = spark.createDataFrame([], f"source string, {key} {key_type}, {score} double")
    return found, spark.createDataFrame(status, "source string, status string")


def list_predictions(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Paths in the folder that match a glob pattern, sorted."""
    glob = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob)
    return sorted(s.getPath().toString() for s in (found or []))


def write_analysis(df: DataFrame, path: str, segment: str | None = None) -> str:
    """Analysis rows, one folder per segment value when ``segment`` is given."""
    writer = df.write
    (writer.partitionBy(segment) if segment else writer).parquet(path)
    return path


def pending(configs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Configurations without a finished output."""
    return configs.join(done.select(key), key, "left_anti")


def splice_results(previous: DataFrame, rerun: DataFrame, key: str = "config") -> DataFrame:
    """Previous results with the rerun configurations replaced."""
    return previous.join(rerun.select(key), key, "left_anti").unionByName(rerun)


def failed_configs(results: DataFrame, key: str = "config", error: str = "error") -> DataFrame:
    return results.filter(F.col(error).isNotNull()).select(key)
