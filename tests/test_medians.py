"""Medians by narrowing histograms against the plain definition."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from reviewlens.functions import columns as C
from reviewlens.functions import vectors as V
from reviewlens.functions.medians import BUCKETS, _Open, _step, medians

INF, NAN = float("inf"), float("nan")


def test_equals_plain_medians(spark):
    rng = random.Random(2)
    columns = [
        [rng.gauss(0, 1) for _ in range(5000)],
        [rng.choice([1.0, 2.0, 2.0, 7.5]) for _ in range(5000)],
        [10 ** rng.uniform(-300, 300) * rng.choice([-1, 1]) for _ in range(5000)],
        [1.0] * 2500 + [3.0] * 2500,
        [5e-324, 1e-323] * 2500,
        [1.7e308] * 2499 + [-1.7e308] * 2501,
        [rng.choice([NAN, INF, -INF, None, 4.0, 9.0]) for _ in range(5000)],
        [None, NAN] * 2500,
        [3.25] + [None] * 4999,
        [1.0 + i * 2**-52 for i in range(5000)],
    ]
    rows = [([c[i] for c in columns],) for i in range(5000)] + [(None,), ([],)]
    found = medians(spark.createDataFrame(rows, "v array<double>").repartition(5), "v")
    for dim, column in enumerate(columns):
        kept = [x for x in column if x is not None and x == x and abs(x) != INF]
        if kept:
            low, high = sorted(kept)[(len(kept) - 1) // 2], sorted(kept)[len(kept) // 2]
            assert found[dim] == 0.5 * low + 0.5 * high
            assert abs(high) > 1e300 or found[dim] == pytest.approx(statistics.median(kept), rel=1e-12)
        else:
            assert dim not in found


def test_step_between_ranges():
    assert _step(_Open(0, 9, 2, 3), [(3, 0, 4), (5, 6, 9)]) == (5.0, None)
    assert _step(_Open(0, 9, 1, 1), [(3, 0, 4), (5, 6, 9)]) == (None, _Open(0, 4, 1, 1))
    assert _step(_Open(0, 9, 4, 5), [(3, 0, 4), (5, 6, 6)]) == (6, None)
    assert BUCKETS > 1


def test_fills(spark):
    df = spark.createDataFrame([(1, 4.0), (2, None), (3, 10.0), (4, 5.0), (5, 5.5)], "id int, x double")
    assert [r.x for r in C.fill_train_median(df, df, "x").orderBy("id").collect()] == [4.0, 5.25, 10.0, 5.0, 5.5]
    assert C.fill_train_median(df, df.filter("x IS NOT NULL"), "x").filter("x IS NULL").count() == 1
    none = df.withColumn("x", F.lit(None).cast("double"))
    assert C.fill_train_median(none, none, "x").filter("x IS NULL").count() == 5
    vectors = spark.createDataFrame([(1, [1.0, NAN]), (2, [None, 2.0]), (3, [5.0, INF])], "id int, v array<double>")
    assert [r.v for r in V.repair_non_finite(vectors, vectors, "v", 2).orderBy("id").collect()] == [[1.0, 2.0], [3.0, 2.0], [5.0, 2.0]]
