"""All registered queries."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from reviewlens.plans.registry import CHECK_SQL, QUERIES

FAMILIES = ("columns", "encoding", "folding", "keysets", "blending", "analysis", "storage", "similarity", "texts", "factors", "models")

for _family in FAMILIES:
    importlib.import_module(f"reviewlens.plans.{_family}")

__all__ = ["CHECK_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["w2_time_ordered_encoding_with_bin"](spark, sf_dir)
