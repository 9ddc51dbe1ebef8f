"""Fold-local features: no label of a validation year or later reaches a fold."""

import random

import numpy as np
from pyspark.sql import functions as F

from reviewlens.operators import fold_features as FF
from reviewlens.operators import folds as K


def reviews(spark):
    rng = random.Random(6)
    rows = [(i, f"c{rng.randrange(6)}" if i % 9 else None, rng.randrange(12), 2000 + i % 5 if i % 17 else None, rng.randrange(2)) for i in range(400)]
    rows += [(500 + i, "hot", i, 2000 + i % 5, i % 2) for i in range(200)]
    return rows, spark.createDataFrame(rows, "id int, critic string, movie int, year int, target int")


def features(spark, df, folds):
    rows = K.time_folds(df, "year", folds).drop("val_year")
    out = FF.fold_encodings(rows, df, folds, {"critic": 10, "movie": 5}, ["critic", "movie"], "target", "year", ("critic", "movie"))
    return {(r.fold, r.id): r for r in out.collect()}


def test_equals_plain_sums_and_does_not_leak(spark):
    rows, df = reviews(spark)
    folds = K.year_fold_table(spark, [2002, 2004])
    found = features(spark, df, folds)
    for fold, last in ((0, 2002), (1, 2004)):
        past = [r for r in rows if r[3] is not None and r[3] < last]
        prior = sum(r[4] for r in past) / len(past)
        own = [r for r in rows if r[3] is not None and r[3] <= last]
        assert len(own) == sum(f == fold for f, _ in found)
        for i, critic, movie, _, _ in own:
            r = found[fold, i]
            of = lambda k, v: [x[4] for x in past if x[k] == v and v is not None]
            c, m = of(1, critic), of(2, movie)
            assert np.isclose(r.critic_te, (sum(c) + 10 * prior) / (len(c) + 10)) and np.isclose(r.movie_te, (sum(m) + 5 * prior) / (len(m) + 5))
            assert (r.critic_review_count, r.movie_review_count) == (len(c), len(m))
            assert np.isclose(r.critic_avg_fresh, sum(c) / len(c) if c else prior)
            assert np.isclose(r.ratio_movie_te_to_global, r.movie_te / prior)
            assert np.isclose(r.ratio_movie_te_to_critic, r.movie_te / r.critic_avg_fresh if r.critic_avg_fresh else 1)
    turned = features(spark, df.withColumn("target", F.when(F.col("year") >= 2002, 1 - F.col("target")).otherwise(F.col("target"))), folds)
    same = [c for c in next(iter(found.values())).asDict() if c not in ("target",)]
    assert all(found[k][c] == turned[k][c] for k in found if k[0] == 0 for c in same)
    assert any(found[k].critic_te != turned[k].critic_te for k in found if k[0] == 1)


def test_factors_per_fold(spark):
    _, df = reviews(spark)
    df = df.filter("critic IS NOT NULL")
    folds = K.year_fold_table(spark, [2001, 2003])
    rows = K.time_folds(df, "year", folds).drop("val_year")
    found = FF.fold_factors(rows, df, folds, "critic", "movie", "year", FF.svd_fit(2, 50), ("of_critic", "of_movie"))
    assert found.count() == rows.count() and found.filter("size(of_critic) <> 2 OR size(of_movie) <> 2").count() == 0
    one = found.filter("fold = 0 AND critic = 'hot'").select("of_critic").distinct().count()
    both = found.filter("critic = 'hot'").select("of_critic").distinct().count()
    assert (one, both) == (1, 2)
    late = df.unionByName(df.limit(1).withColumn("year", F.lit(2003)).withColumn("movie", F.lit(999)))
    rows = K.time_folds(late, "year", folds).drop("val_year")
    unseen = FF.fold_factors(rows, late, folds, "critic", "movie", "year", FF.svd_fit(2, 50), ("of_critic", "of_movie"))
    assert unseen.filter("movie = 999 AND fold = 1").first().of_movie is not None
