"""Queries of learning, ensembling and experiment tables (M1-M14, A22), with the operators' own settings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.operators import feature_sets as S
from reviewlens.operators import folds as K
from reviewlens.operators import model as M
from reviewlens.operators.factor import fit_projection, project, random_projection
from reviewlens.operators.similar import join_vectors
from reviewlens.plans.registry import query
from reviewlens.plans.tables import KEY, KEY_SQL, load, over_reviews, reviews, tie
from reviewlens.session import cut_lineage, scratch_path
from reviewlens.sources.io import exists

YEARS = [1998, 1999, 2000]


def _raw(spark, sf_dir):
    # Both sides and the median of train read the joined rows.
    df = cut_lineage(reviews(spark, sf_dir, release=True))
    return S.Tables(df.filter("is_train"), df.filter("NOT is_train"))


_written: dict[tuple[str, str], str] = {}


def _baseline(spark, sf_dir):
    """Feature table of all models. It is written once per application and data set."""
    at = (spark.sparkContext.applicationId, sf_dir)
    path = _written.get(at)
    if path is None or not all(exists(spark, f"{path}/{side}/_SUCCESS") for side in ("train", "test")):
        path = scratch_path(spark, "features")
        tables = S.baseline(_raw(spark, sf_dir), tie())
        tables.train.write.parquet(f"{path}/train")
        tables.test.write.parquet(f"{path}/test")
        _written[at] = path
    tables = S.Tables(spark.read.parquet(f"{path}/train"), spark.read.parquet(f"{path}/test"))
    return tables, S.feature_sets(tables.train.columns)["baseline"]


def _vectors(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("movie"), F.col("embedding").alias("vector"))


def _shown(df):
    return df.select(*KEY, F.round("score", 6).alias("score"))


@query("m01_fit_and_score")
def m01(spark, sf_dir):
    tables, names = _baseline(spark, sf_dir)
    return _shown(M.fit_score(tables.train, tables.test, names, KEY, M.boosted_trees()))


@query("m02_cross_validation")
def m02(spark, sf_dir):
    """Validation scores of the time folds and test scores of every fold, in one long table."""
    tables, names = _baseline(spark, sf_dir)
    valid, test, _ = M.cross_validate(
        tables.train, M.year_conditions(YEARS), names, KEY, M.boosted_trees(), test=tables.test
    )
    return valid.select("fold", *KEY, F.round("score", 6).alias("score"), F.lit("validate").alias("side")).unionByName(
        test.select("fold", *KEY, F.round("score", 6).alias("score"), F.lit("test").alias("side"))
    )


@query("m02_group_cross_validation_auc")
def m02_group(spark, sf_dir):
    tables, names = _baseline(spark, sf_dir)
    folds = K.group_folds(tables.train, "movie", 4).select("movie", "fold")
    valid, _, _ = M.cross_validate(
        tables.train.join(folds, "movie"), M.fold_conditions(4), names, KEY, M.boosted_trees(), keep=("fold",)
    )
    return M.fold_scores(valid)


@query("m04_seed_average")
def m04(spark, sf_dir):
    tables, names = _baseline(spark, sf_dir)
    return _shown(M.seed_average(tables.train, tables.test, names, KEY, lambda s: M.boosted_trees(seed=s)))


@query("m05_seen_unseen_models")
def m05(spark, sf_dir):
    tables, names = _baseline(spark, sf_dir)
    groups = K.group_folds(tables.train, "movie", 2)
    out = M.seen_unseen_scores(
        tables.train, tables.test, names, KEY, M.boosted_trees(), "movie", YEARS, groups, 2
    )
    return _shown(out)


@query("m06_stacking")
def m06(spark, sf_dir):
    tables, names = _baseline(spark, sf_dir)
    learners = [M.VARIANTS[v]() for v in ("standard", "forest", "linear")]
    return _shown(M.stack(tables.train, tables.test, YEARS, names, KEY, learners))


@query("m06_stacking_seeds")
def m06_seeds(spark, sf_dir):
    tables, names = _baseline(spark, sf_dir)
    learners = lambda seed: [M.VARIANTS[v](seed=seed) for v in ("standard", "forest")]
    return _shown(M.stack_seeds(tables.train, tables.test, YEARS, names, KEY, learners, [1, 2]))


@query("m07_pseudo_label_retrain")
def m07(spark, sf_dir):
    tables, names = _baseline(spark, sf_dir)
    out = M.pseudo_label_scores(tables.train, tables.test, names, KEY, M.boosted_trees(), 0.8, 0.2)
    return _shown(out)


@query("m08_class_weighted_fit")
def m08(spark, sf_dir):
    tables, names = _baseline(spark, sf_dir)
    return _shown(
        M.fit_score(M.balanced(tables.train), tables.test, names, KEY, M.boosted_trees(), weight="weight")
    )


@query("a22_summed_importances")
def a22(spark, sf_dir):
    tables, names = _baseline(spark, sf_dir)
    _, _, models = M.cross_validate(tables.train, M.year_conditions(YEARS), names, KEY, M.boosted_trees())
    return M.importances(models, names).withColumn("importance", F.round("importance", 6))


@query("m09_feature_selected_refit")
def m09(spark, sf_dir):
    tables, names = _baseline(spark, sf_dir)
    _, _, models = M.cross_validate(tables.train, M.year_conditions(YEARS), names, KEY, M.boosted_trees())
    kept = M.kept_features(M.importances(models, names), names)
    return _shown(M.fit_score(tables.train, tables.test, kept, KEY, M.boosted_trees()))


@query("m10_learner_variants")
def m10(spark, sf_dir):
    tables, names = _baseline(spark, sf_dir)
    variants = ("deep", "shallow", "forest", "linear")
    jobs = [lambda name=name: M.fit_score(tables.train, tables.test, names, KEY, M.VARIANTS[name]()) for name in variants]
    scores = M.fits(jobs, tables.train)
    return reduce(DataFrame.unionByName, [_shown(part).withColumn("variant", F.lit(name)) for name, part in zip(variants, scores)])


@query("m11_all_feature_sets")
def m11(spark, sf_dir):
    """Inputs of the largest set on the held-out rows."""
    tables = S.add_rest(_baseline(spark, sf_dir)[0], tie())
    names = S.feature_sets(tables.test.columns)["v2_all"]
    types = dict(tables.test.dtypes)
    rounded = [
        F.transform(n, lambda x: F.round(x, 6)).alias(n) if types[n].startswith("array") else F.col(n) for n in names
    ]
    return tables.test.select(*[F.col(k).alias(f"key_{k}") for k in KEY], *rounded)


@query("m11_best_base")
def m11_best(spark, sf_dir):
    tables, _ = _baseline(spark, sf_dir)
    tables = S.add_vector_pca(tables, _vectors(spark, sf_dir), 64)
    names = S.feature_sets(tables.test.columns)["best"]
    return _shown(M.fit_score(tables.train, tables.test, names, KEY, M.boosted_trees()))


_UNSEEN = "movie % 10 = 0"  # every movie of the held-out year is in train, so these are taken out of it


@query(
    "m11_unknown_movie_inputs",
    over_reviews(f"""SELECT {KEY_SQL}, round(coalesce((t.s + 10 * g.m) / (t.n + 10), g.m), 6) AS critic_te, 1 AS distinct_movie_vectors, 0 AS known_only
      FROM reviews LEFT JOIN (SELECT critic, sum(target) AS s, count(*) AS n FROM train WHERE movie % 10 <> 0 GROUP BY critic) t USING (critic),
      (SELECT avg(target) AS m FROM train WHERE movie % 10 <> 0) g WHERE NOT is_train AND movie % 10 = 0"""),
)
def m11_unknown(spark, sf_dir):
    """Held-out rows of movies that train lacks, with the set for unknown movies: all have the same default movie vectors."""
    raw = _raw(spark, sf_dir)
    tables = S.Tables(raw.train.filter(f"NOT ({_UNSEEN})"), raw.test.filter(_UNSEEN))
    tables = S.add_rest(S.add_baseline(tables, tie()), tie())
    sets = S.feature_sets(tables.test.columns)
    rows = cut_lineage(tables.test.select(*KEY, *[n for n in sets["unknown"] if n not in KEY]))
    vectors = rows.select(F.struct(*[F.transform(v, lambda x: F.round(x, 9)) for v in S.MOVIE_VECTORS]).alias("v")).distinct()
    known_only = len(set(sets["unknown"]) & set(S.MOVIE_IDENTITY)) + len(set(sets["unknown"]) - set(sets["known"]))
    return rows.select(*KEY, F.round("critic_te", 6).alias("critic_te"), vectors.agg(F.count(F.lit(1)).cast("int")).scalar().alias("distinct_movie_vectors"),
                       F.lit(known_only).alias("known_only"))


@query("m11_best_with_ranking")
def m11_best_ranking(spark, sf_dir):
    """The largest base: baseline, vector components, and 64 ranking factors of both sides."""
    tables, _ = _baseline(spark, sf_dir)
    tables = S.add_ranking(S.add_vector_pca(tables, _vectors(spark, sf_dir), 64)).written()
    names = S.feature_sets(tables.test.columns)["best_ranking"]
    return _shown(M.fit_score(tables.train, tables.test, names, KEY, M.boosted_trees()))


@query("m12_ranking_dot_only")
def m12_dot(spark, sf_dir):
    """The best base with the product of the ranking factors, and without the factors."""
    tables, _ = _baseline(spark, sf_dir)
    tables = S.add_ranking(S.add_vector_pca(tables, _vectors(spark, sf_dir), 64), dot_only=True).written()
    names = [*S.feature_sets(tables.test.columns)["best"], "ranking_dot"]
    return _shown(M.fit_score(tables.train, tables.test, names, KEY, M.boosted_trees()))


@query("m12_two_hop_and_ranking_experiment")
def m12(spark, sf_dir):
    tables, names = _baseline(spark, sf_dir)
    tables = S.add_two_hop(S.add_ranking(tables), ratio=True).written()
    names = [*names, "ranking_critic", "ranking_movie", "ranking_dot", "movie_critic_te_mean", "critic_te_div_movie_te"]
    return _shown(M.fit_score(tables.train, tables.test, names, KEY, M.boosted_trees()))


@query("m13_experiment_table")
def m13(spark, sf_dir):
    """One configuration fails and is recorded as such."""
    tables, _ = _baseline(spark, sf_dir)
    tables = S.add_ratios(S.add_v2(tables, tie()).written()).written()
    sets = S.feature_sets(tables.train.columns)

    def config(names):
        def run():
            valid, _, _ = M.cross_validate(tables.train, M.year_conditions(YEARS), names, KEY, M.boosted_trees())
            return len(names), valid

        return run

    configs = {n: config(sets[n]) for n in ("baseline", "v2", "v2_ratio")}
    configs["broken"] = config(["no_such_column"])
    table, _ = M.run_experiments(configs)
    return table.select("config", "n_features", "cv_auc_mean", "cv_auc_std", F.col("error").isNotNull().alias("failed"))


@query("m14_vector_reduction_grid")
def m14(spark, sf_dir):
    """Reduction method x dimensions x validation scheme. Reductions are fitted on the train rows of each fold."""
    tables, names = _baseline(spark, sf_dir)
    vectors = _vectors(spark, sf_dir)
    movies = join_vectors(tables.train.select("movie").distinct(), vectors, "movie", "vector", 64)
    folds = K.group_folds(tables.train, "movie", 2).select("movie", "fold")
    rows = tables.train.join(folds, "movie")
    schemes = {"time": (M.year_conditions(YEARS), "review_year"), "group": (M.fold_conditions(2), "fold")}

    def fitted(method, dims, train):
        if method == "random":
            return random_projection(64, dims)
        counts = train.groupBy("movie").agg(F.count(F.lit(1)).alias("_rows"))
        seen = join_vectors(counts, vectors, "movie", "vector", 64)
        return fit_projection(seen, "vector", dims, centre=method == "pca", weight="_rows")

    def part(method, dims, scheme, number):
        def run():
            conditions, column = schemes[scheme]
            in_train, in_valid = conditions[number]
            reduced = project(movies, "vector", fitted(method, dims, rows.filter(in_train)))
            used = rows.filter(in_train | in_valid).join(reduced, "movie")
            valid, _, _ = M.cross_validate(used, [(in_train, in_valid)], [*names, "vector"], KEY, M.boosted_trees(), keep=(column,))
            return valid.withColumn("fold", F.lit(number))

        return run

    grid = [(method, dims, scheme) for method, dims in (("pca", 4), ("svd", 4), ("random", 8)) for scheme in schemes]
    jobs = [(cell, number) for cell in grid for number in range(len(schemes[cell[2]][0]))]
    # No fold waits for another one; an error belongs to its configuration.
    found = dict(zip(jobs, M.fits([M.or_error(part(*cell, number)) for cell, number in jobs], tables.train)))

    def config(cell):
        def run():
            parts = [found[job] for job in jobs if job[0] == cell]
            for outcome in parts:
                if isinstance(outcome, Exception):
                    raise outcome
            return len(names) + cell[1], reduce(DataFrame.unionByName, parts)

        return run

    configs = {"_".join(map(str, cell)): config(cell) for cell in grid}
    table, _ = M.run_experiments(configs)
    return table.drop("path")
