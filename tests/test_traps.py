"""Hand-made frames for the rules that are easy to get wrong."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlens.functions import columns as C
from reviewlens.operators import analyze as A
from reviewlens.operators import blend as B
from reviewlens.operators import encode as E
from reviewlens.operators import factor as X
from reviewlens.operators import folds as K
from reviewlens.operators import keys as S
from reviewlens.operators import similar as N
from reviewlens.operators.running import running_totals
from reviewlens.sources import io as IO


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


@pytest.fixture(scope="module")
def reviews(spark):
    rnd = random.Random(7)
    data = []
    for i in range(400):
        # One critic holds over a third of the rows, some have no name, dates repeat and are missing.
        critic = "hot" if i % 5 < 2 else rnd.choice(["a", "b", "c", None])
        date = None if i % 17 == 0 else f"2000-01-{1 + rnd.randrange(4):02d}"
        data.append((i, critic, rnd.randrange(12), date, rnd.randrange(2)))
    df = spark.createDataFrame(data, "id int, critic string, movie int, date string, target int")
    return df.withColumn("date", F.to_date("date")).repartition(5)


def expected_time_ordered(df, m=10):
    import hashlib

    data = [r.asDict() for r in df.collect()]
    prior = np.mean([r["target"] for r in data])
    out = {}
    far = "9999"
    data.sort(key=lambda r: (str(r["date"] or far), hashlib.md5(str(r["id"]).encode()).hexdigest()))
    sums = {}
    for r in data:
        s, n = sums.get(r["critic"], (0, 0))
        out[r["id"]] = prior if r["critic"] is None or n == 0 else (s + m * prior) / (n + m)
        sums[r["critic"]] = (s + r["target"], n + 1)
    return out


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_time_ordered_encoding_in_pieces(reviews, parts):
    tie = F.md5(F.col("id").cast("string"))
    got = E.time_ordered_target_encode(reviews, "critic", "target", "date", tie, "te", parts=parts)
    want = expected_time_ordered(reviews)
    for r in got.collect():
        assert abs(r["te"] - want[r["id"]]) < 1e-12


def test_running_totals_along_a_piece_column(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") * 7 % 500).alias("at"))
    tie = F.md5(F.col("id").cast("string"))
    got = running_totals(df, [], "at", tie, {"n": F.lit(1)}, parts=5)
    assert all(r["n"] == r["at"] for r in got.collect())


def test_own_label_does_not_leak(reviews):
    tie = F.md5(F.col("id").cast("string"))
    flipped = reviews.withColumn("target", F.when(F.col("id") == 8, 1 - F.col("target")).otherwise(F.col("target")))
    prior = F.lit(0.5)
    encoders = [
        lambda df: E.time_ordered_target_encode(df, "critic", "target", "date", tie, "te", prior=prior),
        lambda df: E.leave_one_out_encode(df, ["critic"], "target", "te", prior=prior),
        lambda df: E.out_of_fold_encode(K.hash_folds(df, tie, 5), ["critic"], "target", "fold", "te", prior=prior),
    ]
    for encode in encoders:
        a, b = (encode(df).filter("id = 8").first()["te"] for df in (reviews, flipped))
        assert a == b


def test_single_member_category(spark):
    df = spark.createDataFrame([("x", 1), ("y", 0), ("y", 1)], "k string, target int")
    got = dict(rows(E.leave_one_out_encode(df.filter("k = 'x'").unionByName(df.filter("k = 'y'")), ["k"], "target", "te")
                    .filter("k = 'x'").select("k", "te")))
    assert got["x"] == pytest.approx(2 / 3)


def test_right_closed_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.33,), (0.34,), (0.67,), (1.0,), (2.0,), (None,)], "x double")
    got = [r[0] for r in df.select(C.right_closed_bin("x", C.TARGET_MEAN_EDGES)).collect()]
    assert got == [1.0, 0.0, 1.0, 1.0, 2.0, 1.0, 1.0]


def test_scores_dates_and_texts(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,), (0.3,)], "x double")
    assert [r[0] for r in df.select(C.clean_score("x")).collect()] == [0.5, 1.0, 0.0, 0.5, 0.3]
    dates = spark.createDataFrame([("2020-02-30",), ("2020-03-01",), (None,), ("soon",)], "d string")
    assert [str(r[0]) for r in dates.select(C.to_date("d")).collect()] == ["None", "2020-03-01", "None", "None"]
    texts = spark.createDataFrame([("",), (None,), (" two  words ",)], "t string")
    assert [tuple(r) for r in texts.select(C.text_length("t"), C.word_count("t")).collect()] == [(0, 0), (7, 1), (12, 2)]


def test_zero_denominators(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (None, 2.0), (3.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(C.safe_ratio(F.col("a"), F.col("b"))).collect()] == [1.0, 1.0, 1.0, 1.5]
    assert [r["r"] for r in E.two_hop_ratio(df, "a", "b", "r").collect()] == [1.0, 1.0, 1.0, 1.5]


def brute_jaccard(sets, k):
    out = {}
    for a in sets:
        scored = [(-(len(sets[a] & sets[b]) + 1) / (len(sets[a] | sets[b]) + 1e-9), b) for b in sets if b != a]
        out[a] = [b for _, b in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("sizes", [dict(), dict(block_rows=7), dict(block_rows=7, hot_items=6)])
@pytest.mark.parametrize("dense", [True, False])
def test_jaccard_neighbours_are_exact(spark, sizes, dense):
    rnd = random.Random(3)
    items = 15 if dense else 200
    sets = {a: {rnd.randrange(items) for _ in range(rnd.choice([1, 2, 3, 9]))} for a in range(40)}
    edges = spark.createDataFrame([(a, i) for a, s in sets.items() for i in s], "a int, i int")
    got = {}
    for a, b, _, rank in rows(N.jaccard_neighbours(edges, "a", "i", 5, **sizes), "a", "rank"):
        got.setdefault(a, []).append(b)
    assert got == brute_jaccard(sets, 5)


def test_cosine_neighbours_with_zero_and_equal_vectors(spark):
    vectors = {0: [0.0, 0.0], 1: [1.0, 0.0], 2: [1.0, 0.0], 3: [0.0, 2.0], 4: [-1.0, 0.0], 5: [1.0, 1.0]}
    df = spark.createDataFrame(list(vectors.items()), "k int, v array<double>")

    def sim(a, b):
        x, y = np.array(vectors[a]), np.array(vectors[b])
        return round(float(x / (np.linalg.norm(x) + 1e-9) @ (y / (np.linalg.norm(y) + 1e-9))), 9)

    want = {a: [b for _, b in sorted((-sim(a, b), b) for b in vectors if b != a)[:3]] for a in vectors}
    for size in (2, 100):
        got = {}
        for a, b, _, _ in rows(N.cosine_neighbours(df, "k", "v", 3, block_rows=size), "a", "rank"):
            got.setdefault(a, []).append(b)
        assert got == want


def test_overlap_pairs_of_a_hot_entity(spark):
    edges = spark.createDataFrame([("h", i) for i in range(20)] + [("a", 1), ("a", 2), ("b", 30)], "e string, i int")
    got = {(r[0], r[1]): r[2] for r in N.overlap_pairs(edges, "e", "i", hot_items=5).collect()}
    assert got == {("a", "h"): 2, ("h", "a"): 2}


def brute_auc(data):
    pos = [s for s, y in data if y == 1]
    neg = [s for s, y in data if y == 0]
    if not pos or not neg:
        return None
    return np.mean([(p > n) + 0.5 * (p == n) for p, n in itertools.product(pos, neg)])


def test_auc_with_ties_and_one_class(spark):
    rnd = random.Random(5)
    data = [("x", round(rnd.random(), 2), rnd.randrange(2)) for _ in range(500)] + [("one", 0.4, 1), (None, 0.1, 0), (None, 0.9, 1)]
    df = spark.createDataFrame(data, "g string, s double, y int")
    got = dict(rows(A.auc(df, ["g"], "y", "s")))
    assert got["one"] is None and got[None] == 1.0
    assert got["x"] == pytest.approx(brute_auc([(s, y) for g, s, y in data if g == "x"]))
    summary = {r["value"]: r for r in A.segment_summary(df, ["g"], "y", "s", min_count=2).collect()}
    assert set(summary) == {"x", None}


def test_time_folds_skip_empty_years_and_null_dates(spark):
    df = spark.createDataFrame([(2000,), (2001,), (2003,), (None,)], "y int")
    got = K.time_folds(df, "y", K.year_fold_table(spark, [2001, 2002, 2003]))
    assert rows(got.select("fold", "y", "role")) == [
        (0, 2000, "train"), (0, 2001, "validate"), (2, 2000, "train"), (2, 2001, "train"), (2, 2003, "validate")
    ]


def test_group_folds_are_balanced_in_pieces(spark):
    df = spark.range(3000).select((F.col("id") % 97).alias("k"))
    whole = {r["k"]: r["fold"] for r in K.group_folds(df, "k", 5).collect()}
    pieces = {r["k"]: r["fold"] for r in K.group_folds(df, "k", 5, parts=3).collect()}
    assert whole == pieces
    counts = [list(whole.values()).count(i) for i in range(5)]
    assert max(counts) - min(counts) <= 1


def test_numbers_are_dense_in_pieces(spark):
    keys = spark.range(300).select(F.col("id").alias("k"))
    a, b = (dict(rows(S.number_keys(keys, "k", "n", parts=h))) for h in (10, 1))
    assert a == b and sorted(a.values()) == list(range(300))


def test_blend_rules(spark):
    a = spark.createDataFrame([(1, 0.2), (2, 0.8)], "ID bigint, target double")
    b = spark.createDataFrame([(2, 0.4), (3, 0.1)], "ID bigint, target double")
    assert rows(B.blend({"a": a, "b": b}, {"a": 3, "b": 1}, "ID", "target")) == [(2, pytest.approx(0.7))]
    with pytest.raises(ValueError):
        B.blend({"a": a, "b": b}, {"a": 1, "b": -1}, "ID", "target")
    ids = spark.createDataFrame([(1,), (2,), (4,)], "ID bigint")
    assert rows(B.align(a, ids, "ID", "target")) == [(1, 0.2), (2, 0.8), (4, 0.5)]
    with pytest.raises(Exception, match="do not match"):
        B.align_strict(a, ids, "ID", "target").collect()
    twice = a.unionByName(a.limit(1))
    bad = B.verify(twice, ids).first()
    assert not bad["ok"] and bad["rows_ok"] and bad["message"] == "id_ok"
    assert B.verify(a, ids.filter("ID < 4")).first()["message"] == "OK"
    assert not B.verify(a.withColumn("target", F.lit(None).cast("double")), ids.filter("ID < 4")).first()["target_ok"]


def test_prediction_files(spark, tmp_path):
    ids = spark.createDataFrame([(1,), (2,)], "ID bigint")
    scores = spark.createDataFrame([(2, 1.5), (1, float("nan"))], "ID bigint, target double")
    path = IO.write_predictions(ids, scores, f"{tmp_path}/sub_a")
    with pytest.raises(ValueError):
        IO.write_predictions(ids, scores, path, inputs=(path,))
    (tmp_path / "sub_b").mkdir()
    (tmp_path / "sub_b" / "part.csv").write_text("")
    paths = {p.rsplit("/", 1)[1]: p for p in IO.list_predictions(spark, str(tmp_path), "sub_*")}
    df, status = IO.read_predictions(spark, {**paths, "gone": f"{tmp_path}/gone"})
    assert rows(df) == [("sub_a", 1, 0.5), ("sub_a", 2, 1.0)]
    assert rows(status) == [("gone", "missing"), ("sub_a", "ok"), ("sub_b", "empty")]


def test_damaged_vector_file_is_an_error(spark, tmp_path):
    (tmp_path / "v.parquet").write_bytes(b"PAR1 not a table PAR1")
    with pytest.raises(Exception):
        IO.read_vectors(spark, f"{tmp_path}/v.parquet", "k").collect()


def test_projection_equals_numpy(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 6)) @ np.diag([5, 4, 3, 1, 0.5, 0.1])
    w = rng.integers(1, 4, size=60)
    df = spark.createDataFrame([(i, [float(x) for x in r], int(n)) for i, (r, n) in enumerate(zip(m, w))],
                               "i int, v array<double>, w int")
    repeated = np.repeat(m, w, axis=0)
    for centre in (True, False):
        p = X.fit_projection(df, "v", 3, centre, "w")
        ref = repeated - repeated.mean(axis=0) if centre else repeated
        axes = np.linalg.svd(ref, full_matrices=False)[2][:3]
        assert np.allclose(np.abs(np.sum(p.matrix.T * axes, axis=1)), 1)
        got = np.array([r["v"] for r in X.project(df, "v", p).orderBy("i").collect()])
        assert np.allclose(got, (m - p.mean) @ p.matrix)


def test_non_negative_factors_get_better(spark):
    rnd = random.Random(2)
    cells = {(i, j): float(1 + (i + j) % 3) for i in range(12) for j in range(9) if rnd.random() < 0.6}
    df = spark.createDataFrame([(i, j, v) for (i, j), v in cells.items()], "r int, c int, v double")
    losses = []
    for steps in (1, 3):
        w, h = X.non_negative_factors(df, "r", "c", "v", 3, steps)
        losses.append(X.factor_loss(df, w, h, "r", "c", "v"))
        full = np.zeros((12, 9))
        for (i, j), v in cells.items():
            full[i, j] = v
        wm = np.array([r["vector"] for r in w.orderBy("r").collect()])
        hm = np.array([r["vector"] for r in h.orderBy("c").collect()])
        assert wm.min() >= 0 and hm.min() >= 0
        assert losses[-1] == pytest.approx(((full - wm @ hm.T) ** 2).sum())
    assert losses[1] < losses[0]


def test_ranking_factors_learn_and_repeat(spark):
    pairs = spark.createDataFrame([(u, i) for u in range(8) for i in range(10) if (u < 4) == (i < 5) and (u + i) % 4], "u int, i int")
    u, v = X.ranking_factors(pairs, "u", "i", 3, epochs=4, rate=2.0)
    again, _ = X.ranking_factors(pairs, "u", "i", 3, epochs=4, rate=2.0)
    assert np.allclose(*[[r["vector"] for r in t.orderBy("u").collect()] for t in (u, again)])
    items = S.number_keys(pairs.select("i").distinct(), "i", "number")
    sampled = X.sample_negatives(pairs, items, "u", "i", 99)
    assert X.ranking_accuracy(sampled, u, v, "u", "i").first()[0] > 0.6


def test_row_order_does_not_matter(reviews):
    tie = F.md5(F.col("id").cast("string"))
    for df in (reviews.orderBy("id"), reviews.orderBy(F.desc("target"))):
        got = rows(E.time_ordered_target_encode(df, "critic", "target", "date", tie, "te").select("id", "te"))
        assert got == rows(E.time_ordered_target_encode(reviews, "critic", "target", "date", tie, "te").select("id", "te"))


@pytest.mark.parametrize("given", [[(7, 0.1), (8, 0.2)], [(1, 0.1), (2, 0.2)], [(1, 0.1), (2, 0.2), (3, 0.3), (4, 0.4)], [(1, 0.1), (2, 0.2), (3, 0.3), (3, 0.3)]])
def test_strict_alignment_fails_when_it_must(spark, given, tmp_path):
    """No common id, a missing, an extra, a repeated one: also under count(), which needs no column."""
    from reviewlens.operators.blend import align_strict
    from reviewlens.sources.io import write_predictions

    ids = spark.createDataFrame([(1,), (2,), (3,)], "ID long")
    predictions = spark.createDataFrame(given, "ID long, target double")
    for action in ("count", "collect"):
        with pytest.raises(Exception, match="do not match"):
            getattr(align_strict(predictions, ids, "ID", "target"), action)()
    with pytest.raises(ValueError, match="do not match"):
        write_predictions(ids, predictions, f"{tmp_path}/out")
    assert not (tmp_path / "out").exists()


def test_strict_alignment_passes(spark, tmp_path):
    from reviewlens.sources.io import write_predictions

    ids = spark.createDataFrame([(2,), (1,)], "ID long")
    predictions = spark.createDataFrame([(1, 0.1), (2, 0.2)], "ID long, target double")
    path = write_predictions(ids, predictions, f"{tmp_path}/out")
    assert sorted(tuple(r) for r in spark.read.csv(path, header=True, inferSchema=True).collect()) == [(1, 0.1), (2, 0.2)]


def test_no_wanted_ids_but_predictions(spark, tmp_path):
    from reviewlens.sources.io import write_predictions

    with pytest.raises(ValueError, match="do not match"):
        write_predictions(spark.createDataFrame([], "ID long"), spark.createDataFrame([(1, 0.5)], "ID long, target double"), f"{tmp_path}/out")


def test_dense_fills_zeros(spark):
    from reviewlens.operators.text import dense

    long = spark.createDataFrame([(1, 0, 2.0), (1, 3, 4.0)], "k long, index int, value double")
    keys = spark.createDataFrame([(1,), (2,)], "k long")
    assert {r.k: list(r.vector) for r in dense(long, keys, "k", 4).collect()} == {1: [2.0, 0, 0, 4.0], 2: [0.0] * 4}


def test_topics_do_not_depend_on_files(spark):
    """Texts are partitioned by id before they are learned from."""
    from reviewlens.plans import texts

    docs = texts._documents(spark, "/root/testdata/sf0.001")
    assert docs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_learners_keep_their_own_settings(spark):
    """The registered queries pass no setting, so a smaller default would cut all of them."""
    import inspect

    from reviewlens.operators import factor, feature_sets, model, text

    def default(f, name):
        return inspect.signature(f).parameters[name].default

    assert model.boosted_trees().getMaxIter() == 100
    assert model.VARIANTS["forest"]().getNumTrees() == 100
    assert [default(f, "iterations") for f in (factor.non_negative_factors, factor.project_rows)] == [50, 50]
    assert [default(f, "iterations") for f in (feature_sets.add_nmf, feature_sets.add_rest)] == [50, 50]
    assert [default(f, "epochs") for f in (factor.ranking_factors, feature_sets.add_ranking)] == [100, 100]
    assert default(text._parts, "iterations") == 20


def test_axes_of_vectors_far_from_zero(spark):
    """Means of 1e8 against deviations of 1: products of uncentred rows would leave no digit of them."""
    rng = np.random.default_rng(8)
    x = 1e8 + rng.normal(size=(200, 3)) * np.array([3.0, 1.0, 0.2])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id int, v array<double>")
    found = X.fit_projection(df, "v", 2, centre=True).matrix
    axes = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :2]
    assert np.allclose(np.abs((found * axes).sum(axis=0)), 1, atol=1e-9)


def test_running_totals_of_one_group_of_distinct_times(spark):
    """One group, no ties in time: every range holds its share of it."""
    df = spark.range(20_000).select(F.lit("one").alias("k"), F.timestamp_micros(F.pmod(F.xxhash64("id"), F.lit(1 << 50))).alias("at"), "id")
    got = running_totals(df, ["k"], "at", F.lpad(F.col("id").cast("string"), 8, "0"), {"n": F.lit(1), "s": F.col("id")}, parts=8).orderBy("at", "id").collect()
    total = 0
    for i, r in enumerate(got):
        assert (r.n, r.s) == (i, total)
        total += r.id
    shares = df.repartitionByRange(8, "k", "at").groupBy(F.spark_partition_id()).count().collect()
    assert len(shares) == 8 and max(r["count"] for r in shares) < 5000
