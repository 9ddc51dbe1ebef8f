"""Findings of the fourth review: each test fails on the code before it."""

import datetime
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlens.operators import encode as E
from reviewlens.operators import factor as X
from reviewlens.operators import feature_sets as S
from reviewlens.operators import model as M
from reviewlens.operators import ranking as R
from reviewlens.operators import running as W


def test_neighbour_factors_equal_plain_axes(spark):
    cells = {(a, b): 1 + (a * a + 3 * b + a * b) % 5 for a in range(12) for b in range(7) if (a + 2 * b) % 3}
    pairs = spark.createDataFrame([(f"c{a:02d}", b, n) for (a, b), n in cells.items()] + [("far", 99, 1)], "c string, m int, value bigint")
    got = {r.c: r.vector for r in X.neighbour_factors(pairs, "c", "m", 3, 7).collect()}
    plain = np.zeros((12, 7))
    for (a, b), n in cells.items():
        plain[a, b] = n
    axes = np.linalg.svd(plain)[2][:3].T
    axes *= np.sign(axes[np.abs(axes).argmax(axis=0), range(3)])
    assert np.allclose([got[f"c{a:02d}"] for a in range(12)], plain @ axes, atol=1e-9) and got["far"] == [0, 0, 0]


def _tables(spark):
    day = datetime.date(2000, 1, 1)
    rows = [(i, i % 9 if i % 10 else None, i % 4 if i % 7 else None, f"p{i % 3}", f"title {i % 5}", f"some info {i % 6}", "R" if i % 2 else None,
             f"d{i % 4}", f"house {i % 3}" if i % 8 else None, float(60 + i) if i % 5 else None, i % 3 == 0, "Drama, Documentary" if i % 2 else "Comedy",
             day + datetime.timedelta(days=i % 6), day - datetime.timedelta(days=i), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, movie int, critic int, publisher string, title string, info string, content_rating string, directors string, "
                               "production_company string, runtime double, top_critic boolean, genres string, review_date date, release_date date, target int")
    return S.Tables(df.filter("id < 45"), df.filter("id >= 45").withColumn("movie", F.col("movie") + 3))


@pytest.mark.parametrize("few", [0, 4, 1000])
def test_baseline_moves_rows_once(spark, monkeypatch, few):
    tables, tie = _tables(spark), F.md5(F.col("id").cast("string"))
    plain = S.add_row_features(tables).written()
    train, test = plain.train, plain.test
    for n in S.TIME_ORDERED:
        train = E.with_bin(E.time_ordered_target_encode(train, n, "target", "review_date", tie, f"{n}_te_ts"), f"{n}_te_ts")
        test = E.with_bin(E.target_encode(test, plain.train, [n], "target", 10, f"{n}_te_ts"), f"{n}_te_ts")
    for n in S.CATEGORIES:
        if n in plain.train.columns:
            train, test = (E.frequency_encode(df, plain.train, n) for df in (train, test))
    written = []
    for module in (S, W):
        monkeypatch.setattr(module, "cut_lineage", lambda df, real=module.cut_lineage: written.append(df.columns) or real(df))
    monkeypatch.setattr(S, "FEW", few, raising=False)
    found = S.add_baseline(tables, tie)
    for got, wanted in ((found.train, train), (found.test, test)):
        names = sorted(set(wanted.columns))
        got_rows, wanted_rows = (sorted(map(str, df.select(names).collect())) for df in (got, wanted))
        assert got_rows == wanted_rows and set(got.columns) == {*names, S.DOCUMENTARY}
    # Row features and the result of both sides; nothing else carries a text along.
    assert sum("info" in c and "title" in c for c in written) == 4


def test_every_task_of_a_stratum_has_a_partition(spark, monkeypatch):
    for n in (1, 3, 8, 12, 32):
        tasks = spark.createDataFrame([(x,) for x in R._slots(spark, n)], "slot int").repartition(n, "slot")
        assert sorted(len(part) for part in tasks.rdd.glom().collect()) == [1] * n
    spread = []
    monkeypatch.setattr(R, "cut_lineage", lambda df, real=R.cut_lineage: (
        "factors" in df.columns and spread.append(df.rdd.mapPartitions(lambda rows: [any(True for _ in rows)]).collect())) or real(df))
    pairs = spark.createDataFrame([(a, b) for a in range(40) for b in range(30) if (a + b) % 3], "u int, i int")
    R.ranking_factors(pairs, "u", "i", 3, epochs=10, task_pairs=60)
    # Four tasks after each of the two visits, none of them beside another.
    assert [sum(parts) for parts in spread[1:]] == [R.block_count(800, 60)] * 2


def test_mean_step_of_repeated_rows():
    rng = np.random.default_rng(3)
    for n, m in ((50, 400), (400, 50), (3, 1)):
        rows, moves, factors = rng.integers(0, n, m), rng.normal(size=(m, 4)), rng.normal(size=(n, 4))
        wanted = factors.copy()
        for r in set(rows.tolist()):
            wanted[r] += 0.5 * (moves[rows == r].mean(axis=0) - 0.01 * wanted[r])
        R.mean_step(factors, rows, moves.copy(), 0.5, 0.01)
        assert np.allclose(factors, wanted)


def test_fits_of_many_rows_wait_for_each_other(spark, monkeypatch):
    running, most, lock = 0, 0, threading.Lock()

    def job():
        nonlocal running, most
        with lock:
            running += 1
            most = max(most, running)
        time.sleep(0.3)
        with lock:
            running -= 1

    rows = spark.range(800)
    for held, wanted in ((1000, 4), (200, 2), (100, 1), (1, 1)):
        monkeypatch.setattr(M, "ROWS_PER_CORE", held, raising=False)
        most = 0
        M.fits([job] * 6, rows)
        assert most == max(1, min(4, held * spark.sparkContext.defaultParallelism // 800)) == wanted
