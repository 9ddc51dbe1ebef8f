"""Near-duplicate groups by MinHash with tensored banding.

Two small collections of ``SIDE`` keys each (a key combines ``PER_SIDE`` minhashes) take the place of ``SIDE**2`` tables:
table (i, j) is keyed by key i of the first collection together with key j of the second. Only ``2 * SIDE * PER_SIDE``
minhashes are computed for as many tables of ``2 * PER_SIDE`` minhashes, about the square root of the usual number. A
pair of similarity s is in no common table with probability 1 - (1 - (1 - s**PER_SIDE)**SIDE)**2: 9e-5 at s = 0.8 and
3e-6 at 0.85 for the defaults.

Steps: equal shingle sets become one node; tables with two nodes or more are kept; in each, every node is compared with the
smallest one, so that a large group meets the same few leaders in all its tables. Nodes of one component are not compared
again, nor is the smallest node of a table, which has met all others: where the rest of a table still holds several
components, ``LEADERS`` more leaders are picked by a hash of node and table, so that a pair meets in many of its common
tables. The number of these pairs is linear in the table sizes; more leaders than one mostly bring pairs of a large group of
near copies that are no links, and these the blocks compare anyway, without a row for each. What is still unmet, nodes of
different components in one table, is compared in full: blocks of such nodes meet inside tasks, and only links leave them.
Every link is confirmed on the full shingle sets, and no two components that share a table are left unmet.

Null or empty text, and text without words: no shingles, linked with nothing, a component of its own. Repeated rows (also
those of one document id) are each returned, in the same component. An empty table gives no rows. Extra columns stay;
names that this operator returns are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlens.llm import common as C
from reviewlens.llm import graph

WIDTH, PERCENT = 4, 80
SIDE, PER_SIDE, LEADERS = 14, 3, 1
BLOCK, PER_NODE = 1 << 18, 256  # shingles of a block; each node counts as that many more
SEED = 20_011


def _shingles(batch_column: pa.Array, width: int):
    """Rows (first row, hashes of all shingles, places) in runs of bounded size; A-Z are lower-cased."""
    data, at = C.text_bytes(batch_column)
    for i, j in C.row_blocks(at):
        words, begins = C.word_hashes(data[at[i]:at[j]], at[i:j + 1] - at[i], lower=True)
        yield i, *C.shingle_hashes(words, begins, width)


def _digest(distinct: np.ndarray) -> bytes:
    return hashlib.blake2b(distinct.tobytes(), digest_size=16).digest()


def half_keys(hashes: np.ndarray, at: np.ndarray, side: int = SIDE, per_side: int = PER_SIDE) -> np.ndarray:
    """Keys of both collections, (rows, 2 * side); all rows must have shingles."""
    rng = np.random.default_rng(SEED)
    factors = rng.integers(0, 1 << 31, 2 * side * per_side, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = rng.integers(0, 1 << 32, 2 * side * per_side, dtype=np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    keys = np.zeros((len(at) - 1, 2 * side), np.uint64)
    for k in range(2 * side * per_side):
        low = np.minimum.reduceat((short ^ shifts[k]) * factors[k], at[:-1])
        keys[:, k // per_side] = C.mix(keys[:, k // per_side] * np.uint64(C._BASE) + low + np.uint64(1))
    return keys


def row_key() -> Column:
    """Names a row by id and text: ids may be null or stand for several texts."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def signatures(docs: DataFrame, width: int = WIDTH, side: int = SIDE, per_side: int = PER_SIDE) -> DataFrame:
    """(doc_id, n_shingles, digest, keys, row) of each document, stored; ``digest`` names the set (null if empty)."""

    def sign(batches):
        for batch in batches:
            for first, hashes, at in _shingles(batch.column(1), width):
                n = len(at) - 1
                sizes = np.zeros(n, np.int64)
                digests: list[bytes | None] = [None] * n
                for r in np.flatnonzero(np.diff(at)).tolist():
                    own = np.unique(hashes[at[r]:at[r + 1]])
                    sizes[r] = len(own)
                    digests[r] = _digest(own)
                full = np.diff(at) > 0
                keys = np.zeros((0, 2 * side), np.uint64)
                if full.any():
                    starts = np.concatenate([at[:-1][full], at[-1:]])
                    keys = half_keys(hashes, starts, side, per_side)
                offsets = np.concatenate([[0], np.cumsum(full * 2 * side)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(sizes), pa.array(digests, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64))), batch.column(2).slice(first, n)],
                    ["doc_id", "n_shingles", "digest", "keys", "row"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("row"))
    return C.saved(read.mapInArrow(sign, "doc_id long, n_shingles long, digest binary, keys array<long>, row long"), "signatures")


def shingle_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(node, digest, shingles, found): distinct shingles and their digest for the texts in (node, digest, text)."""

    def read(batches):
        for batch in batches:
            for first, hashes, at in _shingles(batch.column(2), width):
                n = len(at) - 1
                sets = [np.unique(hashes[at[r]:at[r + 1]]) for r in range(n)]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), batch.column(1).slice(first, n),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64))),
                     pa.array([_digest(s) for s in sets], pa.binary())],
                    ["node", "digest", "shingles", "found"])

    kinds = "node long, digest binary, shingles array<long>, found binary"
    return docs.select("node", "digest", "text").mapInArrow(read, kinds)


def _pairs(members: DataFrame, picks: list[int], percent: int) -> DataFrame:
    """(a, b) of each member and the leaders of its table, if their sizes allow a link; pick 0 is the smallest node."""
    window = Window.partitionBy("key")
    node = F.struct("node", "n", *(["label"] if "label" in members.columns else []))
    led = members
    for p in picks:
        order = F.xxhash64("node", "key", F.lit(p)) if p else F.col("node")
        pick = F.min(F.struct(order.alias("h"), node.alias("who"))).over(window)
        led = led.withColumn(f"lead{p}", pick.getField("who"))
    found = None
    for p in picks:
        lead = F.col(f"lead{p}")
        apart = lead["label"] != F.col("label") if "label" in members.columns else lead["node"] != F.col("node")
        near = 100 * F.least(lead["n"], "n") >= percent * F.greatest(lead["n"], "n")
        some = led.filter(apart & near).select(F.least(lead["node"], "node").alias("a"), F.greatest(lead["node"], "node").alias("b"))
        found = some if found is None else found.union(some)
    return found.distinct()


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _meet(table: pa.Table, percent: int) -> pa.Table:
    """Links between components of two blocks (side 0 and 1) or inside one (side 2), enough of them to join all that are linked."""
    node, label, side = (table[c].to_numpy() for c in ("node", "label", "side"))
    lists = table["shingles"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    row = np.repeat(np.arange(len(node)), sizes)
    _, place, count = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    shared = count > 1
    row, place = row[shared[place]], (np.cumsum(shared) - 1)[place[shared[place]]]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    common = np.zeros((len(left), len(right)), np.float32)
    step = 4096
    for lo in range(0, int(shared.sum()), step):
        i, j = np.searchsorted(place, [lo, lo + step])
        has = np.zeros((len(node), step), np.float32)
        has[row[i:j], place[i:j] - lo] = 1
        common += has[left] @ has[right].T
    both = common.astype(np.int64)
    linked = (100 * both >= percent * (sizes[left][:, None] + sizes[right] - both)) & (label[left][:, None] != label[right])
    x, y = np.nonzero(linked)
    x, y = left[x], right[y]
    _, one = np.unique(np.stack([np.minimum(label[x], label[y]), np.maximum(label[x], label[y])]), axis=1, return_index=True)
    top: dict[int, int] = {}

    def root(v: int) -> int:
        while v in top:
            v = top[v]
        return v

    joined = []
    for k in one.tolist():
        u, v = sorted((root(int(label[x[k]])), root(int(label[y[k]]))))
        if u < v:
            top[v] = u
            joined.append(k)
    return pa.table({"a": pa.array(node[x[joined]], pa.int64()), "b": pa.array(node[y[joined]], pa.int64())})


def _rest(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between nodes of (node, n, key) that share a table, have not met and are in different components.

    The leaders have met all others of their table. Tables that then hold several components are brought together where they
    share nodes; the nodes of such a group are dealt into blocks, and every two blocks meet in a task, but for two of the
    same large component.
    """
    named = members.select("node", "n", "key").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # One shuffle by table, and no join back to it: all that a table has to know of itself comes from windows.
    table = Window.partitionBy("key")
    led = named
    for p in range(1, LEADERS + 1):
        pick = F.min(F.struct(F.xxhash64("node", "key", F.lit(p)).alias("h"), "node")).over(table)
        led = led.withColumn(f"lead{p}", pick.getField("node"))
    unmet = led.filter(~F.col("node").isin(*[F.col(f"lead{p}") for p in range(1, LEADERS + 1)]))
    unmet = unmet.withColumn("first", F.min("node").over(table)).withColumn("lo", F.min("label").over(table))
    unmet = unmet.withColumn("hi", F.max("label").over(table)).filter("lo <> hi")
    unmet = C.saved(unmet.select("node", "n", "label", "first"), "unmet")
    groups = graph.components(unmet, "node", "first").withColumnRenamed("label", "group")
    load = (F.col("n") + PER_NODE).alias("load")
    nodes = C.saved(unmet.select("node", "label", load).distinct().join(groups, "node"), "unmet")
    own = F.when(F.sum("load") >= BLOCK, F.col("label")).otherwise(F.lit(-1)).alias("own")
    owns = nodes.groupBy("group", "label").agg(own)
    nodes = nodes.join(owns, ["group", "label"])
    counts = nodes.groupBy("group", "own").agg(F.ceil(F.sum("load") / BLOCK).alias("blocks"))
    dealt = nodes.join(counts, ["group", "own"]).withColumn("place", F.pmod(F.xxhash64("node"), "blocks")).drop("blocks", "load")
    blocks = counts.select("group", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("place"))
    others = blocks.select("group", F.col("own").alias("own2"), F.col("place").alias("place2"))
    two = blocks.join(others, "group").filter(
        "struct(own, place) <= struct(own2, place2) AND NOT (own = own2 AND own >= 0)").withColumn(
        "sides", F.expr("""if(own = own2 AND place = place2, array(struct(own AS o, place AS p, 2 AS side)),
            array(struct(own AS o, place AS p, 0 AS side), struct(own2 AS o, place2 AS p, 1 AS side)))"""))
    pair = F.struct("own", "place", "own2", "place2").alias("pair")
    sides = two.select("group", pair, F.explode("sides").alias("s")).select(
        "group", "pair", F.col("s.o").alias("own"), F.col("s.p").alias("place"), "s.side")
    met = dealt.join(sides, ["group", "own", "place"]).join(sets, "node")
    met = met.select("group", "pair", "node", "label", "side", "shingles").groupBy("group", "pair")
    return met.applyInArrow(lambda t: _meet(t, percent), "a long, b long")


def text_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, row, label) of each row; ``label`` names the component of its text, whatever the ids (null: no shingles)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = signatures(docs, width)
    # One node for each set of shingles; copies never become pairs.
    nodes = C.saved(
        signed.filter("n_shingles > 0").groupBy("digest")
        .agg(F.min("row").alias("row"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
        .withColumn("node", F.monotonically_increasing_id()), "nodes")
    first, second = F.slice("keys", 1, SIDE), F.slice("keys", SIDE + 1, SIDE)
    tables = F.flatten(F.transform(first, lambda x, i: F.transform(second, lambda y, j: F.xxhash64(i * SIDE + j, x, y))))
    members = nodes.select("node", "n", F.explode(tables).alias("key"))
    shared = C.saved(
        members.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("size > 1").drop("size"), "tables")
    met = shared.select("node").distinct()
    one_each = nodes.join(met, "node", "left_semi").select("node", "row", "digest")
    # Rows that share a key by chance: the digest of the row has to be the node's, too.
    texts = docs.withColumn("row", row_key()).join(one_each, "row")
    sets = C.saved(shingle_sets(texts, width).filter("digest = found").dropDuplicates(["node"]).select("node", "shingles"), "sets")
    links = C.saved(_links(_pairs(shared, [0], percent), sets, percent), "links")
    labels = graph.components(links)
    named = shared.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = Window.partitionBy("key")
    rest = named.withColumn("_first", F.min("node").over(several)).filter("node <> _first").drop("_first")
    apart = C.saved(rest.withColumn("_lo", F.min("label").over(several)).withColumn("_hi", F.max("label").over(several))
                    .filter("_lo <> _hi").drop("_lo", "_hi"), "tables")
    more = C.saved(_links(_pairs(apart, list(range(1, LEADERS + 1)), percent), sets, percent), "links")
    links = links.union(more)
    labels = graph.components(links)
    last = C.saved(_rest(apart, labels, sets, percent), "links")
    labels = graph.components(links.union(last))
    labelled = nodes.select("node", "digest").join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("label"))
    return signed.select("doc_id", "n_shingles", "row", "digest").join(labelled, "digest", "left").drop("digest")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of (doc_id, text)."""
    groups = C.saved(text_groups(docs, width, percent), "groups")
    smallest = groups.filter("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return groups.join(smallest, "label", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def check_sql(table: str = "documents", width: int = WIDTH, percent: int = PERCENT) -> str:
    """DuckDB query for the rows of ``query``; it meets all pairs that share a shingle."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS ws
                     FROM {table}),
p AS (SELECT doc_id, ws, unnest(CASE WHEN len(ws) = 0 THEN [] ELSE range(1, greatest(len(ws) - {width - 2}, 2)) END) AS i FROM w),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {width - 1}], ' ') AS k FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (k) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= {percent} * (x.n + y.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
m AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, m.b) AS component_id, w.doc_id <= coalesce(m.b, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON w.doc_id = m.a"""
