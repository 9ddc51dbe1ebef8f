"""Whitening of embeddings with MLlib's distributed block matrices.

Rows are centred exactly (whole numbers, one division), indexed and dealt into blocks. The transposed block matrix times itself
gives the scatter matrix; its middle dimension is split over the tasks, so no task meets all blocks. A dims x dims matrix
alone reaches the driver, where ``eigh`` gives the components. The blocks times the whitening matrix project the rows, and the
projected blocks times themselves give the covariance that is compared with the identity.

Rows whose vector is null, empty or has a null or non-finite entry are dropped, so are those with an entry of 2**46 or more
(its whole number would not be exact) and those whose vector has another length than most rows have (of equally common lengths
the longest counts). Components whose eigenvalue is zero up to rounding have no
whitened values and are not returned, so one row or only equal rows give no result. Null ids stay, repeated rows each count,
an empty table gives no rows, further columns are not looked at, whatever their names. A deviation beyond 64 bits is null.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.llm import common as C

#: Fixed values of the whole numbers that stand for the entries.
FACTOR, SHIFT, LARGEST = 64, 1_000_000, 2**46
COMPONENTS = 32
BLOCK_ROWS, BLOCK_COLS = 1024, 1024
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, x, index) of usable rows, stored; ``index`` differs for all rows and leaves few numbers out."""
    usable = f"embedding IS NOT NULL AND size(embedding) > 0 AND NOT exists(embedding, c -> c IS NULL OR isnan(c) OR abs(c) >= {LARGEST})"
    x = F.expr(f"transform(embedding, c -> cast(floor({FACTOR} * cast(c AS double)) AS bigint) + {SHIFT})")
    rows = vectors.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    rows = C.saved(rows.withColumn("id", F.monotonically_increasing_id()), "vectors")
    usual = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    longest = rows.agg(F.max(F.col("id").bitwiseAND((1 << 33) - 1))).first()[0]
    width = ((longest or 0) // BLOCK_ROWS + 1) * BLOCK_ROWS
    index = F.shiftright("id", 33) * width + F.col("id").bitwiseAND((1 << 33) - 1)
    return rows.filter(F.size("x") == (usual.dims if usual else 0)).select("vec_id", "x", index.alias("index"))


def block_matrix(rows: DataFrame, vector: str, n_rows: int, n_cols: int, block_cols: int) -> BlockMatrix:
    """Blocks of (index, array of doubles)."""
    indexed = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector(vector).alias("vector")), "vector")
    return IndexedRowMatrix(indexed, n_rows, n_cols).toBlockMatrix(BLOCK_ROWS, block_cols)


def gram(blocks: BlockMatrix, splits: int) -> np.ndarray:
    """The transposed matrix times itself; ``splits`` tasks take a share of the rows each, and their sums are added."""
    turned = blocks.transpose()
    # The Python method has no parameter for the number of splits that the method below it has.
    product = turned._java_matrix_wrapper.call("multiply", blocks._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, turned.rowsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()


def rows_of(blocks: BlockMatrix) -> DataFrame:
    """(index, values array<double>) of a block matrix."""
    found = callMLlibFunc("getIndexedRows", blocks.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return found.toDF("index", "vector").select("index", vector_to_array("vector").alias("values"))


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each row of (vec_id, embedding) and component: see ``RESULT``."""
    spark = vectors.sparkSession
    rows = whole_numbers(vectors)
    sums = rows.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("s"), F.count(F.lit(1)).alias("n")).collect()
    if not sums:
        return spark.createDataFrame([], RESULT)
    n, dims = sums[0].n, len(sums)
    whole, left = zip(*(divmod(int(r.s), n) for r in sorted(sums, key=lambda r: r.at)))
    mean = ", ".join(f"named_struct('q', {q}L, 'r', {r}L)" for q, r in zip(whole, left))
    off = f"zip_with(x, array({mean}), (a, m) -> try_subtract(try_multiply({n}L, a - m.q), m.r))"
    deviation = f"aggregate({off}, 0L, (t, d) -> try_add(t, try_multiply(d, d)))"
    centred = C.saved(rows.select(
        "vec_id", "index", F.expr(deviation).alias("deviation"),
        F.expr(f"zip_with(x, array({mean}), (a, m) -> cast(a - m.q AS double) - m.r / {n}D)").alias("centred")), "centred")
    n_rows = rows.agg(F.max("index")).first()[0] + 1
    splits = max(1, min(C.shuffle_parts(spark), -(-n_rows // BLOCK_ROWS)))
    columns = min(dims, BLOCK_COLS)
    blocks = block_matrix(centred, "centred", n_rows, dims, columns)
    covariance = gram(blocks, splits) / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, int((values > max(values[0], 0) * dims * np.finfo(float).eps * 16).sum()))
    if not k:
        return spark.createDataFrame([], RESULT)
    scaled = axes[:, :k] / np.sqrt(values[:k])
    local = spark.createDataFrame([(i, r) for i, r in enumerate(scaled.tolist())], "index long, w array<double>")
    weights = IndexedRowMatrix(
        MLUtils.convertVectorColumnsFromML(local.select("index", array_to_vector("w").alias("vector")), "vector"), dims, k).toBlockMatrix(columns, k)
    projected = blocks.multiply(weights)
    error = float(np.abs(gram(projected, splits) / n - np.eye(k)).max())
    explained = ", ".join(f"{e!r}D" for e in (values[:k] / np.trace(covariance)).tolist())
    joined = centred.select("vec_id", "index", "deviation").join(rows_of(projected), "index")
    return joined.select("vec_id", "deviation", F.posexplode("values").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.expr(f"array({explained})[at]").alias("explained"), F.lit(error).alias("identity_error"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
