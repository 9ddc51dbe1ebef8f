"""Exact medians by narrowing histograms.

A pass counts the values of every dimension in ``BUCKETS`` ranges, with the least and greatest value of each; only the range that
holds the middle is cut again. So no task ever holds all distinct values: a pass sends at most ``BUCKETS`` rows per dimension to the
driver, whatever the number of rows, and all dimensions share it. Where the two middle values lie in different ranges, or a
range holds a single value, its bounds are the answer. A pass divides the range by ``BUCKETS``: even values spread over nine orders
of magnitude need three or four of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.session import cut_lineage

BUCKETS = 1024


def finite(x: Column) -> Column:
    """The value as a double, NULL for NaN and infinities."""
    x = x.cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)


@dataclass
class _Open:
    """A range that holds the values of ranks ``first`` and ``last`` (from 0 inside the range)."""

    low: float
    high: float
    first: int
    last: int


def _step(open_: _Open, ranges: list) -> tuple[float | None, _Open | None]:
    """The median if these (count, low, high) in order show it, else the range to cut next."""
    seen, found = 0, []
    for n, low, high in ranges:
        for rank in sorted({open_.first, open_.last}):
            if seen <= rank < seen + n:
                found.append((seen, n, low, high, rank))
        seen += n
    one, other = found[0], found[-1]
    if one[2:4] != other[2:4]:  # the last value of one range and the first of the next
        return 0.5 * one[3] + 0.5 * other[2], None
    before, _, low, high, _ = one
    if low == high:
        return low, None
    return None, _Open(low, high, open_.first - before, open_.last - before)


def medians(df: DataFrame, vector: str) -> dict[int, float]:
    """Median of the finite entries at each place of an array column; a place without any is left out."""
    rows = cut_lineage(df.select(F.posexplode(F.transform(vector, finite)).alias("dim", "x")).dropna())
    ends = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
    done, todo = {}, {}
    for r in ends:
        if r.low == r.high:
            done[r.dim] = r.low
        else:
            todo[r.dim] = _Open(r.low, r.high, (r.n - 1) // 2, r.n // 2)
    while todo:
        listed = ", ".join(f"{d}, named_struct('low', double('{o.low!r}'), 'high', double('{o.high!r}'))" for d, o in sorted(todo.items()))
        inside = rows.withColumn("o", F.expr(f"element_at(map({listed}), dim)")).filter("x BETWEEN o.low AND o.high")
        # Halves keep the difference of very large values finite; the number never falls when the value grows.
        share = F.coalesce(F.try_divide(F.col("x") / 2 - F.col("o.low") / 2, F.col("o.high") / 2 - F.col("o.low") / 2), F.lit(0.0))
        # The greatest value stands alone, so every range is smaller than the one that was cut.
        bucket = F.when(F.col("x") == F.col("o.high"), F.lit(BUCKETS)).otherwise(F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)))
        counted = inside.groupBy("dim", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        by_dim: dict[int, list] = {}
        for r in sorted(counted.collect(), key=lambda r: (r.dim, r.bucket)):
            by_dim.setdefault(r.dim, []).append((r.n, r.low, r.high))
        for dim, ranges in by_dim.items():
            value, further = _step(todo[dim], ranges)
            if further is None:
                done[dim] = value
                del todo[dim]
            else:
                todo[dim] = further
    return done
