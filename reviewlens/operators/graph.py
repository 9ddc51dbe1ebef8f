"""Bipartite graph of critics and movies: nodes, edges, neighbourhood means, edge scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.columns import sigmoid
from reviewlens.functions.vectors import dot
from reviewlens.operators.keys import number_keys
from reviewlens.session import cut_lineage

BLOCK_NODES = 50_000  # nodes that a task sums
EDGES_AT_ONCE = 20_000  # edges whose products are held


def graph_nodes(pairs: DataFrame, critic: str, movie: str) -> tuple[DataFrame, DataFrame]:
    """(critic, node) with nodes 0..n_c-1 and (movie, node) with nodes from n_c on."""
    critics = number_keys(pairs.select(critic).dropna().distinct(), critic, "node")
    movies = number_keys(pairs.select(movie).dropna().distinct(), movie, "node")
    n_critics = pairs.agg(F.count_distinct(critic)).scalar()
    return critics, movies.withColumn("node", F.col("node") + n_critics)


def bipartite_edges(pairs: DataFrame, critics: DataFrame, movies: DataFrame, critic: str, movie: str) -> DataFrame:
    """(src, dst) in both directions for every row of ``pairs``; repeated pairs stay repeated."""
    numbered = pairs.join(critics.withColumnRenamed("node", "_c"), critic).join(
        movies.withColumnRenamed("node", "_m"), movie
    )
    both = F.array(
        F.struct(F.col("_c").alias("src"), F.col("_m").alias("dst")),
        F.struct(F.col("_m").alias("src"), F.col("_c").alias("dst")),
    )
    return numbered.select(F.inline(both))


def neighbour_mean(edges: DataFrame, vectors: DataFrame, node: str, vector: str, dims: int, hops: int = 1) -> DataFrame:
    """(node, vector): mean vector of the neighbours, repeated ``hops`` times.

    Parallel edges are counted once per hop as weights. Nodes are summed in blocks, and a neighbour's vector goes once to each block
    in which it has an edge, not once for each edge; so a node with very many edges costs no more than all vectors once. Nodes without a vector count as zero: they add to the number of neighbours, but no zeros are joined or shuffled for
    them, in the first hop as in those that follow.
    """
    # Written once, as are the cells made of it: every hop reads them.
    weighted = cut_lineage(edges.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("_w")))
    given = vectors.select(F.col(node).alias("src"), F.col(vector).cast("array<double>").alias("_v"))
    # A node that is given twice counts twice in the first hop, with a vector or without.
    times = given.groupBy("src").agg(F.count(F.lit(1)).alias("_times"))
    n = [(F.col("_w") * F.coalesce("_times", F.lit(1))).alias("_first"), F.col("_w").alias("_later")]
    totals = weighted.join(times, "src", "left").select("dst", *n).groupBy("dst").agg(F.sum("_first").alias("_first"), F.sum("_later").alias("_later"))
    totals = cut_lineage(totals)
    blocks = max(edges.sparkSession.sparkContext.defaultParallelism, -(-totals.count() // BLOCK_NODES))
    block = F.pmod(F.xxhash64("dst"), F.lit(blocks)).alias("_block")
    cells = cut_lineage(weighted.groupBy("src", block).agg(F.collect_list(F.struct("dst", "_w")).alias("_e")))
    known = given.filter("_v IS NOT NULL")
    for hop in range(hops):
        sums = _summed(cells, known, blocks, dims).join(totals, "dst")
        count = F.col("_later" if hop else "_first")
        known = cut_lineage(sums.select(F.col("dst").alias("src"), F.transform("_s", lambda x: x / count).alias("_v")))
    zeros = F.array_repeat(F.lit(0.0), dims)
    out = totals.select(F.col("dst").alias("src")).join(known, "src", "left") if hops else known
    return out.select(F.col("src").alias(node), F.coalesce("_v", zeros).alias(vector))


def _summed(cells: DataFrame, known: DataFrame, blocks: int, dims: int) -> DataFrame:
    """(dst, _s): for every node with a neighbour in ``known`` (src, _v), the sum of weight times vector over these.

    ``cells`` holds the edges (dst, _w) of a node into a block as one row (src, _block, _e).
    """
    kind = cells.schema["_e"].dataType.elementType["dst"].dataType.simpleString()
    met = cells.join(known, "src").select("_block", "_e.dst", "_e._w", "_v").repartition(blocks, "_block")

    def add(keys: pa.Array, values: np.ndarray) -> pa.RecordBatch:
        coded = keys.dictionary_encode()
        at = coded.indices.to_numpy()
        order = np.argsort(at, kind="stable")
        sums = np.add.reduceat(values[order], np.flatnonzero(np.diff(at[order], prepend=-1)), axis=0)
        offsets = pa.array(np.arange(0, sums.size + 1, dims, dtype=np.int32))
        return pa.RecordBatch.from_arrays([coded.dictionary, pa.ListArray.from_arrays(offsets, pa.array(sums.ravel()))], ["dst", "_s"])

    def merged(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        return add(table["dst"].combine_chunks(), table["_s"].combine_chunks().flatten().to_numpy().reshape(-1, dims))

    def total(batches):
        held, size = [], 0
        for batch in batches:
            keys, weights = batch.column(1).flatten(), batch.column(2).flatten().to_numpy()
            edges = np.diff(batch.column(1).offsets.to_numpy())
            row, vectors = np.repeat(np.arange(batch.num_rows), edges), batch.column(3).flatten().to_numpy().reshape(-1, dims)
            for lo in range(0, len(row), EDGES_AT_ONCE):
                own = slice(lo, lo + EDGES_AT_ONCE)
                held.append(add(keys.slice(lo, EDGES_AT_ONCE), vectors[row[own]] * weights[own, None]))
                if sum(b.num_rows for b in held) > 2 * size + EDGES_AT_ONCE:
                    held = [merged(held)]
                    size = held[0].num_rows
        if held:
            last = merged(held)
            for lo in range(0, last.num_rows, EDGES_AT_ONCE):
                yield last.slice(lo, EDGES_AT_ONCE)

    return met.mapInArrow(total, f"dst {kind}, _s array<double>")


def edge_scores(pairs: DataFrame, left: DataFrame, right: DataFrame, left_key: str, right_key: str, vector: str) -> DataFrame:
    """Sigmoid of the dot product of the end points; 0.5 where one of them has no vector."""
    a = left.select(left_key, F.col(vector).alias("_a"))
    b = right.select(right_key, F.col(vector).alias("_b"))
    joined = pairs.join(a, left_key, "left").join(b, right_key, "left")
    return joined.withColumn("score", F.coalesce(sigmoid(dot("_a", "_b")), F.lit(0.5))).drop("_a", "_b")
