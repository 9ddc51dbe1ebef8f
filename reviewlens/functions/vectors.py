"""Expressions on dense vectors stored as arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.medians import finite, medians


def dot(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column | str) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def unit(v: str, eps: float = 1e-9) -> Column:
    """Vector over (length + eps), so that a zero vector stays zero."""
    held = F.array(F.struct(F.col(v).alias("v"), (norm(v) + eps).alias("n")))  # the length is taken once, not for every entry
    return F.transform(held, lambda s: F.transform(s["v"], lambda x: x.cast("double") / s["n"]))[0]


def rounded(v: Column | str, digits: int) -> Column:
    """Entries rounded; what rounds to zero keeps its sign, as in SQL, which ``round`` alone would drop."""
    return F.transform(v, lambda x: F.when(F.round(x, digits) == 0, x * 0.0).otherwise(F.round(x, digits)))


def first_dims(v: str, n: int) -> Column:
    return F.slice(v, 1, n)


def repair_non_finite(df: DataFrame, train: DataFrame, vector: str, dims: int) -> DataFrame:
    """Replace NaN, infinities and NULL entries by the train median of their dimension (0 if it has none)."""
    found = medians(train.select(F.slice(vector, 1, dims).alias("x")), "x")
    listed = F.array(*[F.lit(float(found.get(i, 0.0))) for i in range(dims)])
    return df.withColumn(vector, F.zip_with(F.col(vector), listed, lambda x, m: F.coalesce(finite(x), m)))
