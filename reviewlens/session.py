"""Session defaults, scratch paths and lineage cutting."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "reviewlens", **conf: str) -> SparkSession:
    """Session with the settings the operators are written for; any of them can be overridden."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_folder: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for intermediate output, in the shared folder that ``spark.checkpoint.dir`` names.

    Only where the session names none and runs on a single machine (tests) a local folder is made; elsewhere it is an
    error, since every executor would write to a disk of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _local_folder:
            _local_folder.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        base = _local_folder[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame to the shared folder and read it back.

    Iterative jobs do this once per step, so that a lost executor costs a re-read and not a replay of
    all steps, and the plan does not grow. Unlike a checkpoint the frame is computed once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
