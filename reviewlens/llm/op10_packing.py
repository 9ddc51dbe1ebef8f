"""Best-fit packing by linear grouping of lengths.

Only numbers of items per length reach the driver (at most ``capacity`` rows, whatever the size of the corpus):

1. Large items, in order of length, are cut into groups of equal cardinality; lengths are rounded up to the group's
   largest one.
2. Configurations (multisets of the few rounded lengths that fit a sequence) are optimised by column generation; each is
   used a whole number of times.
3. Actual lengths take the places of the rounded ones. Sequences with equal contents stay one class with a count, so the
   plan's size depends on the numbers of groups and lengths, not on the number of documents.
4. Items left over by rounding down, then the small ones, are placed by best fit, longest first, into the free room of
   the classes, new sequences where nothing fits.

The plan says for every (length, range of ranks) where these items go. Items are numbered within their length (hot
lengths in buckets), and each finds its place by binary search in the plan.

Null or empty text: one piece with the end id only. Repeated rows and document ids are packed each on their own; a null
document id passes through. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.llm import common as C
from reviewlens.llm import tokens

CAPACITY, GROUPS = 2048, 48
#: Items longer than this share of a sequence are large.
LARGE_SHARE = 1 / 8
#: Column generation ends when the bound of the best solution is this near.
GAP = 5e-4


# ---------------------------------------------------------------- pieces of documents


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """(item, doc_id, piece, start, length, ids_crc32): encoded documents, only those over ``capacity`` cut. Stored."""
    tokenizer = tokenizer or tokens.default_tokenizer()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def cut(batches):
        enc = tokens.encoder(tokenizer, end_id)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, ids, at in enc.encode_column(batch.column(1)):
                raw = ids.astype("<u4")
                rows = []
                for i in range(len(at) - 1):
                    for k, lo in enumerate(range(int(at[i]), int(at[i + 1]), capacity)):
                        hi = min(lo + capacity, int(at[i + 1]))
                        rows.append((doc_ids[first + i], k, lo - int(at[i]), hi - lo, zlib.crc32(raw[lo:hi].tobytes())))
                names = ("doc_id", "piece", "start", "length", "ids_crc32")
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    found = docs.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")
    return C.saved(found.withColumn("item", F.monotonically_increasing_id()), "pieces")


# ---------------------------------------------------------------- plan on numbers per length


def best_configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Configurations (rows: items of each size) and how often to use each, as a fractional optimum up to ``GAP``."""
    k = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    x = demand * np.diag(inverse)
    room = np.arange(capacity + 1)[None, :] - sizes[:, None]
    fits = room >= 0
    room = np.where(fits, room, 0)
    most = int(capacity // sizes.min())
    best_bound = 0.0
    for _ in range(40 * k):
        price = inverse.sum(axis=0)
        value, choice = np.zeros(capacity + 1), []
        for _level in range(most):
            gain = np.where(fits, value[room] + price[:, None], -1.0)
            pick = gain.argmax(axis=0)
            new = gain[pick, np.arange(capacity + 1)]
            better = new > value + 1e-12
            if not better.any():
                break
            choice.append(np.where(better, pick, -1))
            value = np.where(better, new, value)
        total = value[capacity]
        best_bound = max(best_bound, x.sum() / max(total, 1.0))
        if total <= 1 + 1e-9 or x.sum() <= best_bound * (1 + GAP):
            break
        column, at = np.zeros(k), capacity
        for picks in reversed(choice):
            if picks[at] >= 0:
                column[picks[at]] += 1
                at -= sizes[picks[at]]
        way = inverse @ column
        ratio = np.where(way > 1e-11, x / np.where(way > 1e-11, way, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x = np.maximum(x - step * way, 0)
        x[out] = step
        row = inverse[out] / way[out]
        inverse -= np.outer(way, row)
        inverse[out] = row
        columns[:, out] = column
    return columns.T.astype(np.int64), x


def _grouped(lengths: np.ndarray, counts: np.ndarray, groups: int) -> list[list[tuple[int, int, int]]]:
    """Large items, longest first, in groups of equal cardinality: runs (length, first rank in the length, number)."""
    total = int(counts.sum())
    limits = [total * (g + 1) // groups for g in range(groups)]
    out: list[list[tuple[int, int, int]]] = [[]]
    seen = 0
    for length, count in sorted(zip(lengths.tolist(), counts.tolist()), reverse=True):
        rank = 0
        while count:
            while seen >= limits[len(out) - 1]:
                out.append([])
            n = min(count, limits[len(out) - 1] - seen)
            out[-1].append((length, rank, n))
            seen, rank, count = seen + n, rank + n, count - n
    return [g for g in out if g]


class _Runs:
    """Takes items of a group, longest first, as runs of (length, first rank, number)."""

    def __init__(self, runs: list[tuple[int, int, int]]):
        self.runs = runs[::-1]

    def take(self, n: int) -> list[tuple[int, int, int]]:
        got = []
        while n:
            length, rank, count = self.runs.pop()
            use = min(n, count)
            got.append((length, rank, use))
            if use < count:
                self.runs.append((length, rank + use, count - use))
            n -= use
        return got


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS) -> dict[str, np.ndarray]:
    """Places for all items: arrays (length, rank, seq, offset), sorted; a row holds from its rank to the next row's.

    Item ``rank + d`` of that length goes to sequence ``seq + d``, at ``offset``.
    """
    large = lengths > capacity * LARGE_SHARE
    classes: list[tuple[int, list[tuple[int, int]]]] = []  # (number of sequences, [(length, first rank)])
    left: dict[int, list[tuple[int, int]]] = defaultdict(list)  # length: [(first rank, number)]
    if large.any():
        grouped = _grouped(lengths[large], counts[large], min(groups, int(counts[large].sum())))
        by_size: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for g in grouped:  # groups that are rounded to one length are one size
            by_size[g[0][0]] += g
        sizes = np.array(sorted(by_size, reverse=True))
        demand = np.array([sum(n for _, _, n in by_size[s]) for s in sizes.tolist()], float)
        configurations, times = best_configurations(sizes, demand, capacity)
        stock = [_Runs(by_size[s]) for s in sizes.tolist()]
        for items, uses in zip(configurations, np.floor(times + 1e-9).astype(np.int64).tolist()):
            if not uses:
                continue
            slots = [stock[g].take(uses) for g in np.repeat(np.arange(len(sizes)), items).tolist()]
            cuts = sorted({0, uses} | {int(c) for s in slots for c in np.cumsum([n for _, _, n in s])})
            at = [0] * len(slots)
            used = [0] * len(slots)
            for lo, hi in zip(cuts, cuts[1:]):
                content = []
                for j, s in enumerate(slots):
                    length, rank, n = s[at[j]]
                    content.append((length, rank + used[j]))
                    used[j] += hi - lo
                    if used[j] == n:
                        at[j], used[j] = at[j] + 1, 0
                classes.append((hi - lo, content))
        for s in stock:
            for length, rank, n in s.runs:
                left[length].append((rank, n))
    for length, n in zip(lengths[~large].tolist(), counts[~large].tolist()):
        left[length].append((0, n))

    by_room: list[list[tuple[int, list[tuple[int, int]]]]] = [[] for _ in range(capacity + 1)]
    for n, content in classes:
        by_room[capacity - sum(length for length, _ in content)].append((n, content))
    for length in sorted(left, reverse=True):
        for rank, count in left[length]:
            room = length
            while count:
                while room <= capacity and not by_room[room]:
                    room += 1
                if room > capacity:
                    n, content, free = -(-count // (capacity // length)), [], capacity
                else:
                    (n, content), free = by_room[room].pop(), room
                each = free // length
                full = min(n, count // each)
                if full:  # these sequences take as many as fit
                    more = [(length, rank + k * full) for k in range(each)]
                    by_room[free - each * length].append((full, content + more))
                    rank, count = rank + each * full, count - each * full
                rest = n - full
                if rest and count and count < each:  # one takes what remains
                    shifted = [(a, r + full) for a, r in content]
                    by_room[free - count * length].append((1, shifted + [(length, rank + k) for k in range(count)]))
                    rank, count, full, rest = rank + count, 0, full + 1, rest - 1
                if rest and free < capacity:
                    by_room[free].append((rest, [(a, r + full) for a, r in content]))
    rows, seq = [], 0
    for room in by_room:
        for n, content in room:
            offset = 0
            for length, rank in content:
                rows.append((length, rank, seq, offset, n))
                offset += length
            seq += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {"length": table[:, 0], "rank": table[:, 1], "seq": table[:, 2], "offset": table[:, 3], "sequences": np.array([seq])}


# ---------------------------------------------------------------- packing


def pack(items: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """The input with ``sequence_id`` and ``offset``; it has a unique ``item`` and a ``length`` from 1 to ``capacity``.

    The input has to be stored, as it is read twice.
    """
    spark = items.sparkSession
    rows = items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most `capacity` rows
    if any(r.length is None or not 1 <= r.length <= capacity for r in rows):
        raise ValueError("lengths must lie between 1 and the capacity")
    rows.sort(key=lambda r: r.length)
    places = plan(np.array([r.length for r in rows], np.int64), np.array([r.n for r in rows], np.int64), capacity, groups)
    shared = spark.sparkContext.broadcast(places)  # its size depends on groups and capacity only
    columns = items.columns

    def place(batches):
        p = shared.value
        begin = np.searchsorted(p["length"], np.arange(capacity + 2))
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            row = np.empty(len(length), np.int64)
            for one in np.unique(length):
                own = length == one
                lo, hi = begin[one], begin[one + 1]
                row[own] = lo + np.searchsorted(p["rank"][lo:hi], rank[own], side="right") - 1
            seq = p["seq"][row] + rank - p["rank"][row]
            out = [batch.column(c) for c in columns] + [pa.array(seq), pa.array(p["offset"][row])]
            yield pa.RecordBatch.from_arrays(out, [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    ranked = C.rank_within(items, "length", "item", "_rank").select(*columns, "_rank")
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = pack(pieces(docs))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
