"""Matrix factorization and vector reduction.

Matrices are long tables (row, column, value); factors are tables of one array per key. What reaches
the driver is a Gram matrix or a projection, whose size is the number of factors or dimensions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.recommendation import ALS
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.functions.vectors import dot
from reviewlens.operators.folds import hash_bucket
from reviewlens.operators.keys import number_keys
from reviewlens.operators.ranking import ranking_factors  # noqa: F401  one name for all factorizations
from reviewlens.session import cut_lineage

# --- reduction ------------------------------------------------------------------------------------


@dataclass
class Projection:
    """x -> (x - mean) . matrix"""

    mean: np.ndarray
    matrix: np.ndarray


def gram(df: DataFrame, vector: str) -> np.ndarray:
    """Sum over rows of the outer product of the vector with itself, added up as a tree."""
    return _gram(df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("_g")))


def _gram(rows: DataFrame) -> np.ndarray:
    return RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "_g")).computeGramianMatrix().toArray()


def _axes(g: np.ndarray, k: int) -> np.ndarray:
    """The leading eigenvectors; the sign of each is that of its largest loading."""
    axes = np.linalg.eigh(g)[1][:, ::-1][:, :k]
    return axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])


def fit_projection(df: DataFrame, vector: str, k: int, centre: bool, weight: str | None = None) -> Projection:
    """Principal axes (``centre``) or leading singular vectors of the rows.

    Rows are centred before they are multiplied: taking the means off the products would cancel most digits of large values.
    ``weight`` counts a row several times, so that a vector shared by many review rows is read once.
    The sign of an axis is that of its largest loading.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(F.col(vector).cast("array<double>").alias("_v"), w.alias("_w"))
    mean = None
    if centre:
        mean = np.array(rows.agg(vector_to_array(Summarizer.mean(array_to_vector("_v"), F.col("_w"))).alias("m")).first().m)
        listed = F.array(*[F.lit(float(m)) for m in mean])
        rows = rows.withColumn("_v", F.zip_with("_v", listed, lambda x, m: x - m))
    g = gram(rows.select(F.transform("_v", lambda x: x * F.sqrt("_w")).alias("_s")), "_s")
    mean = np.zeros(len(g)) if mean is None else mean
    return Projection(mean, _axes(g, k))


def random_projection(dims: int, k: int, seed: int = 42) -> Projection:
    """Gaussian matrix with variance 1 / k."""
    matrix = np.random.default_rng(seed).normal(0.0, 1.0 / np.sqrt(k), (dims, k))
    return Projection(np.zeros(dims), matrix)


def project(df: DataFrame, vector: str, projection: Projection) -> DataFrame:
    """Replace the vector column by its projection."""
    mean, matrix = projection.mean, projection.matrix

    @F.pandas_udf("array<double>")
    def apply(v: pd.Series) -> pd.Series:
        return pd.Series(list((np.stack(v.to_numpy()) - mean) @ matrix))

    return df.withColumn(vector, apply(F.col(vector).cast("array<double>")))


def scale_non_negative(df: DataFrame, train: DataFrame, vector: str) -> DataFrame:
    """(x - min) / (max - min) with the range of all train entries, clipped to [0, 1]."""
    span = train.agg(
        F.struct(F.min(F.array_min(vector)).alias("lo"), F.max(F.array_max(vector)).alias("hi")).alias("s")
    ).scalar()
    df = df.withColumn("_span", span)
    width = (F.col("_span.hi") - F.col("_span.lo")).cast("double")

    def scaled(x: Column) -> Column:
        share = F.coalesce(F.try_divide((x - F.col("_span.lo")).cast("double"), width), F.lit(0.0))
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), share))

    return df.withColumn(vector, F.transform(vector, scaled)).drop("_span")


def to_long(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, index, value) of the entries that are not zero."""
    return df.select(key, F.posexplode(vector).alias("index", "value")).filter(F.col("value") != 0)


def column_means(df: DataFrame, vector: str) -> Column:
    """Mean vector as a scalar subquery: the default for keys without a factor."""
    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    return df.agg(vector_to_array(mean).alias("m")).scalar()


def attach_factors(df: DataFrame, factors: DataFrame, key: str, vector: str, out: str, default: Column) -> DataFrame:
    named = factors.select(key, F.col(vector).cast("array<double>").alias(out))
    return df.join(named, key, "left").withColumn(out, F.coalesce(F.col(out), default))


# --- interactions -----------------------------------------------------------------------------------


def interactions(frames: list[DataFrame], user: str, item: str) -> DataFrame:
    """(user, item, value): number of rows of the pair over all frames."""
    rows = frames[0].select(user, item)
    for frame in frames[1:]:
        rows = rows.unionByName(frame.select(user, item))
    return rows.dropna().groupBy(user, item).agg(F.count(F.lit(1)).alias("value"))


def neighbour_counts(pairs: DataFrame, key: str, neighbour: str, size: int = 2000) -> DataFrame:
    """(key, neighbour, index, value): counts of the ``size`` most frequent neighbours per key.

    The neighbour document of a key in long form; the whole key is the token.
    """
    totals = pairs.groupBy(neighbour).agg(F.sum("value").alias("_t"))
    chosen = totals.orderBy(F.col("_t").desc(), neighbour).limit(size)
    # ``size`` entries in one array: the position is the column number.
    listed = chosen.agg(F.sort_array(F.collect_list(neighbour)).alias("_l")).select(
        F.posexplode("_l").alias("index", neighbour)
    )
    return pairs.join(F.broadcast(listed), neighbour).select(key, neighbour, "index", "value")


def neighbour_factors(pairs: DataFrame, key: str, neighbour: str, k: int = 32, size: int = 2000) -> DataFrame:
    """(key, vector): reduced neighbour documents of all keys in ``pairs``.

    A document is kept by its entries: their products, not those of all ``size`` columns, add up to the Gram matrix.
    """
    # At most ``size`` entries per key.
    entries = neighbour_counts(pairs, key, neighbour, size).groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(F.col("index").cast("int").alias("index"), F.col("value").cast("double").alias("value")))).alias("_e"))
    rows = cut_lineage(entries.select(key, F.transform("_e", lambda e: e["index"]).alias("_i"), F.transform("_e", lambda e: e["value"]).alias("_x")))
    sparse = F.udf(lambda i, x: Vectors.sparse(size, i, x), VectorUDT())
    axes = _axes(_gram(rows.select(sparse("_i", "_x").alias("_g"))), k)

    @F.pandas_udf("array<double>")
    def reduce_(places: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([x @ axes[i] for i, x in zip(places, values)])

    reduced = rows.select(key, reduce_("_i", "_x").alias("vector"))
    zeros = F.array_repeat(F.lit(0.0), axes.shape[1])
    return pairs.select(key).distinct().join(reduced, key, "left").withColumn("vector", F.coalesce("vector", zeros))


def implicit_factors(
    pairs: DataFrame, user: str, item: str, k: int, iterations: int = 15, regularization: float = 0.01,
    alpha: float = 1.0, seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """(user, vector) and (item, vector) by alternating least squares on implicit counts."""
    users = number_keys(pairs.select(user).distinct(), user, "_u")
    items = number_keys(pairs.select(item).distinct(), item, "_i")
    rows = pairs.join(users, user).join(items, item).select(
        F.col("_u").cast("int"), F.col("_i").cast("int"), F.col("value").cast("float").alias("_r")
    )
    model = ALS(
        rank=k, maxIter=iterations, regParam=regularization, alpha=alpha, implicitPrefs=True, userCol="_u",
        itemCol="_i", ratingCol="_r", seed=seed, checkpointInterval=5,
    ).fit(rows)
    return (
        users.join(model.userFactors, F.col("_u") == F.col("id")).select(user, F.col("features").alias("vector")),
        items.join(model.itemFactors, F.col("_i") == F.col("id")).select(item, F.col("features").alias("vector")),
    )


# --- non-negative factorization -----------------------------------------------------------------------


SLICE_KEYS, CELL_ENTRIES = 65_536, 2_000_000


def _start(keys: DataFrame, key: str, k: int, scale: Column, seed: int, *keep: str) -> DataFrame:
    """Start values from a hash of key and position: the same on every run and every partitioning."""
    unit = lambda i: F.pmod(F.xxhash64(F.col(key), i, F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    vector = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: (unit(i) + 0.01) * F.col("_scale"))
    return keys.withColumn("_scale", scale).select(key, *keep, vector.alias("vector"))


def _grid(entries: int, rows: int, columns: int) -> tuple[int, int]:
    """Row and column blocks: at most about ``SLICE_KEYS`` keys in a block and ``CELL_ENTRIES`` entries in a cell."""
    r, c = max(1, math.ceil(rows / SLICE_KEYS)), max(1, math.ceil(columns / SLICE_KEYS))
    while r * c * CELL_ENTRIES < entries:
        r, c = (r + 1, c) if rows / r >= columns / c else (r, c + 1)
    return r, c


def _placed(start: DataFrame, key: str, blocks: int) -> DataFrame:
    """(key, vector, block, place): the block of a key by hash, and its place there in the order of keys."""
    block = F.pmod(F.xxhash64(F.col(key), F.lit("block")), F.lit(blocks)).cast("int")
    place = F.row_number().over(Window.partitionBy("block").orderBy(key)) - 1
    return cut_lineage(start.withColumn("block", block).withColumn("place", place.cast("int")))


def _slices(placed: DataFrame) -> DataFrame:
    """(block, factors): the vectors of a block in one value."""

    def pack(table: pa.Table) -> pa.Table:
        vectors = np.array(table.sort_by("place")["vector"].to_pylist())
        return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int32()), "factors": [vectors.astype("<f8").tobytes()]})

    return placed.select("block", "place", "vector").groupBy("block").applyInArrow(pack, "block int, factors binary")


def _unpacked(slices: DataFrame, placed: DataFrame, key: str, k: int) -> DataFrame:
    def rows(batches):
        for batch in batches:
            for r in batch.to_pylist():
                n = len(r["factors"]) // (8 * k)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)), pa.array(np.frombuffer(r["factors"], "<f8")))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, r["block"], np.int32)), pa.array(np.arange(n, dtype=np.int32)), vectors], ["block", "place", "vector"])

    found = slices.mapInArrow(rows, "block int, place int, vector array<double>")
    return placed.select(key, "block", "place").join(found, ["block", "place"]).select(key, "vector")


def _cells(matrix: DataFrame, row: str, column: str, value: str, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """(rb, cb, r, c, v): the entries of a cell as places and values, in the order of places."""
    placed = matrix.join(rows.select(row, F.col("block").alias("_rb"), F.col("place").alias("_r")), row).join(
        columns.select(column, F.col("block").alias("_cb"), F.col("place").alias("_c")), column)

    def pack(table: pa.Table) -> pa.Table:
        r, c, v = (table[name].to_numpy() for name in ("r", "c", "v"))
        order = np.lexsort((v, c, r))
        return pa.table({"rb": table["rb"][:1], "cb": table["cb"][:1], "r": [r[order].astype("<i4").tobytes()],
                         "c": [c[order].astype("<i4").tobytes()], "v": [v[order].astype("<f8").tobytes()]})

    entries = placed.select(F.col("_rb").alias("rb"), F.col("_cb").alias("cb"), F.col("_r").alias("r"), F.col("_c").alias("c"),
                            F.col(value).cast("double").alias("v"))
    return cut_lineage(entries.groupBy("rb", "cb").applyInArrow(pack, "rb int, cb int, r binary, c binary, v binary"))


def _products(cells: DataFrame, fixed: DataFrame, side: str, blocks: int, k: int) -> DataFrame:
    """(block, part, top, gram): for every block of the ``side`` ("r" or "c") that moves, the product of a cell with the fixed
    factors, and their Gram matrix. Cells of one block are summed where its factors are."""
    other = "c" if side == "r" else "r"
    none = F.lit(None).cast("binary")
    held = cells.select(F.col(f"{other}b").alias("part"), F.col(f"{side}b").alias("block"), F.col(other).alias("f"), F.col(side).alias("m"),
                        "v", none.alias("factors"))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    factors = fixed.select(F.col("block").alias("part"), everywhere, *[none.alias(x) for x in ("f", "m", "v")], "factors")

    def multiply(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        x = next(np.frombuffer(r["factors"], "<f8").reshape(-1, k) for r in rows if r["factors"] is not None)
        top = np.zeros((0, k))
        for r in rows:
            if r["factors"] is None:
                f, m, v = (np.frombuffer(r[name], kind) for name, kind in (("f", "<i4"), ("m", "<i4"), ("v", "<f8")))
                top = np.stack([np.bincount(m, v * x[f, j]) for j in range(k)], axis=1)
        return pa.table({"block": table["block"][:1], "part": table["part"][:1], "top": [top.astype("<f8").tobytes()],
                         "gram": [(x.T @ x).astype("<f8").tobytes()]})

    return held.unionByName(factors).groupBy("part", "block").applyInArrow(multiply, "block int, part int, top binary, gram binary")


def _moved(products: DataFrame, moving: DataFrame, k: int, steps: int = 1) -> DataFrame:
    """New slices of ``moving``: ``steps`` times entry * (matrix . fixed) / (entry . gram)."""
    none = F.lit(None).cast("binary")
    old = moving.select("block", F.lit(-1).alias("part"), none.alias("top"), none.alias("gram"), "factors")

    def update(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        x = np.frombuffer(rows[0]["factors"], "<f8").reshape(-1, k)
        top, gram_ = np.zeros(x.shape), np.zeros((k, k))
        for r in rows[1:]:
            part = np.frombuffer(r["top"], "<f8").reshape(-1, k)
            top[:len(part)] += part
            gram_ += np.frombuffer(r["gram"], "<f8").reshape(k, k)
        for _ in range(steps):
            x = x * top / (x @ gram_ + 1e-12)
        return pa.table({"block": table["block"][:1], "factors": [x.astype("<f8").tobytes()]})

    both = old.unionByName(products.withColumn("factors", none))
    return both.groupBy("block").applyInArrow(update, "block int, factors binary")


def non_negative_factors(
    matrix: DataFrame, row: str, column: str, value: str, k: int, iterations: int = 50, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(row, vector), (column, vector) with matrix ~ row . column and no negative entry.

    Multiplicative updates on a grid of blocks: entries are packed once into cells of places and values, factors into slices. A half
    step multiplies every cell with the fixed slice of its block and sums the products where the moving slice is. Entries without a
    row or column key are left out.
    """
    matrix = cut_lineage(matrix.select(row, column, value).filter(F.col(value) > 0).dropna())
    rows, columns = matrix.select(row).distinct(), matrix.select(column).distinct()
    n, total = matrix.agg(F.count(F.lit(1)), F.sum(value).cast("double")).first()
    if n == 0:
        return tuple(keys.withColumn("vector", F.lit(None).cast("array<double>")) for keys in (rows, columns))
    n_rows, n_columns = rows.count(), columns.count()
    scale = F.lit(math.sqrt(total / (n_rows * n_columns) / k) * 2)
    r, c = _grid(n, n_rows, n_columns)
    rows = _placed(_start(rows, row, k, scale, seed), row, r)
    columns = _placed(_start(columns, column, k, scale, seed + 1), column, c)
    cells = _cells(matrix, row, column, value, rows, columns)
    w, h = cut_lineage(_slices(rows)), cut_lineage(_slices(columns))
    for _ in range(iterations):
        h = cut_lineage(_moved(_products(cells, w, "c", c, k), h, k))
        w = cut_lineage(_moved(_products(cells, h, "r", r, k), w, k))
    return _unpacked(w, rows, row, k), _unpacked(h, columns, column, k)


def project_rows(
    matrix: DataFrame, row: str, column: str, value: str, columns: DataFrame, k: int, iterations: int = 50,
    seed: int = 42,
) -> DataFrame:
    """(row, vector) of new rows for fixed column factors.

    With fixed columns neither the product of the matrix with them nor their Gram matrix changes, so both are made once.
    """
    matrix = cut_lineage(matrix.select(row, column, value).filter(F.col(value) > 0).dropna())
    g = gram(columns, "vector")
    weighted = matrix.join(columns.select(column, F.col("vector").alias("_f")), column)
    top = weighted.groupBy(row).agg(F.array(*[F.sum(F.col("_f")[i] * F.col(value).cast("double")) for i in range(k)]).alias("_top"))

    @F.pandas_udf("array<double>")
    def settle(old: pd.Series, numerator: pd.Series) -> pd.Series:
        w, t = np.stack(old.to_numpy()), np.stack(numerator.to_numpy())
        for _ in range(iterations):
            w = w * t / (w @ g + 1e-12)
        return pd.Series(list(w))

    started = _start(top, row, k, F.lit(0.5), seed, "_top")
    return cut_lineage(started.select(row, settle("vector", "_top").alias("vector")))


def factor_loss(matrix: DataFrame, w: DataFrame, h: DataFrame, row: str, column: str, value: str) -> float:
    """Squared error of the factorization over all cells, without visiting the empty ones."""
    joined = matrix.join(w.withColumnRenamed("vector", "_w"), row).join(h.withColumnRenamed("vector", "_h"), column)
    x = F.col(value).cast("double")
    fit = joined.agg(F.sum(x * x - 2 * x * dot("_w", "_h"))).first()[0]
    return float(fit + np.sum(gram(w, "vector") * gram(h, "vector")))


# --- pairwise ranking -----------------------------------------------------------------------------------


def sample_negatives(pairs: DataFrame, items: DataFrame, user: str, item: str, epoch: int) -> DataFrame:
    """(user, item, negative): one item per pair, picked by hash, that the user does not have.

    ``items`` numbers the items from 0. Pairs whose pick is one of the user's own items are left out
    of this epoch; the next epoch picks again.
    """
    n = items.agg(F.count(F.lit(1))).scalar()
    picked = pairs.withColumn(
        "_n", hash_bucket(F.md5(F.concat_ws("|", user, item, F.lit(str(epoch)))), n)
    )
    named = picked.join(items.select(F.col(item).alias("negative"), F.col("number").alias("_n")), "_n")
    own = pairs.select(user, F.col(item).alias("negative"))
    return named.select(user, item, "negative").join(own, [user, "negative"], "left_anti").select(user, item, "negative")


def ranking_accuracy(sampled: DataFrame, u: DataFrame, v: DataFrame, user: str, item: str) -> DataFrame:
    """Share of sampled comparisons in which the user's own item scores higher."""
    rows = (
        sampled.join(u.withColumnRenamed("vector", "_u"), user)
        .join(v.withColumnRenamed("vector", "_p"), item)
        .join(v.select(F.col(item).alias("negative"), F.col("vector").alias("_q")), "negative")
    )
    return rows.agg(F.avg((dot("_u", "_p") > dot("_u", "_q")).cast("double")).alias("accuracy"))
