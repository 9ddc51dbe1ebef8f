"""Corpus preparation: quality rules, toxicity, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet and reads it again as the
next stage's documents. All stages but the last return the columns of ``documents`` unchanged, whatever they are called.

Null or empty texts are rejected by the quality rules. The near-duplicate stage goes by texts: one row of each component
stays, the one with the smallest id, whether ids are repeated or null. Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.llm import common, op1_toxicity, op2_minhash, op8_quality, op10_packing

SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def _free(docs: DataFrame, name: str) -> str:
    """``name``, made longer until no column has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and all thresholds."""
    return op8_quality.passing(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model learns from labelled ones among them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    name = _free(docs, "_toxicity")
    scored = op1_toxicity.score(docs, op1_toxicity.fit(docs, labels), out=name)
    return scored.filter(F.col(name) < op1_toxicity.THRESHOLD).drop(name)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group of texts, with the smallest id (null last); rows without words each stay, repeated ones once."""
    groups = common.saved(op2_minhash.text_groups(docs, SHINGLE_WORDS, SIMILAR_PERCENT), "groups")
    first = groups.filter("label IS NOT NULL").groupBy("label").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("s")).select("s.row")
    name = _free(docs, "_row")
    stay = first.union(groups.filter("label IS NULL AND doc_id IS NOT NULL").select("row")).distinct().withColumnRenamed("row", name)
    one_each = docs.withColumn(name, op2_minhash.row_key()).join(stay, name, "left_semi").dropDuplicates([name])
    blank = groups.filter("label IS NULL AND doc_id IS NULL").select(F.col("row").alias(name)).distinct()
    blanks = docs.filter("doc_id IS NULL").withColumn(name, op2_minhash.row_key()).join(blank, name, "left_semi")
    return common.saved(one_each.select(docs.columns).unionByName(blanks.select(docs.columns)), "first")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in token sequences."""
    packed = op10_packing.pack(op10_packing.pieces(docs))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_dedup", near_dedup), ("packing", packing)]

#: SQL cannot express the trained stage; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
