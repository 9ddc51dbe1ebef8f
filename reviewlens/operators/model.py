"""Training and scoring on feature tables.

Learners are those of Spark ML. The driver loops only over folds, seeds and configurations, a fixed
handful; every fit, score and summary runs on the cluster. Scores of all folds go into one long table.
"""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from reviewlens.operators import analyze as A
from reviewlens.operators import blend as B
from reviewlens.operators import encode as E
from reviewlens.operators.feature_sets import without_movie_identity
from reviewlens.operators.keys import flag_seen
from reviewlens.session import cut_lineage, scratch_path

UNKNOWN = -1.0  # value of a missing number; trees split it off
EARLY_STOP = 0.01  # least relative gain on the validation rows
AT_ONCE = 4  # fits that run at the same time
ROWS_PER_CORE = 1_000_000  # rows that these may hold for each core


def boosted_trees(trees: int = 100, depth: int = 5, rate: float = 0.1, least: int = 46, seed: int = 42, **extra) -> GBTClassifier:
    return GBTClassifier(
        featuresCol="_features", maxIter=trees, maxDepth=depth, stepSize=rate, minInstancesPerNode=least,
        # Walking down a shallow tree costs less than writing every row's node to memory once a level; the trees are the same.
        featureSubsetStrategy="0.75", seed=seed, cacheNodeIds=False, **extra,
    )


# Learner variants by name; ``trees`` and ``seed`` are set by the caller.
VARIANTS: dict[str, Callable[..., Estimator]] = {
    "standard": boosted_trees,
    "deep": lambda **k: boosted_trees(depth=10, least=30, **k),
    "shallow": lambda **k: boosted_trees(depth=4, least=80, **k),
    "forest": lambda trees=100, seed=42: RandomForestClassifier(
        featuresCol="_features", numTrees=trees, maxDepth=8, seed=seed
    ),
    "linear": lambda trees=100, seed=42: LogisticRegression(featuresCol="_features", maxIter=trees, regParam=0.01),
}


def assemble(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """``keep`` columns and one feature vector; arrays become part of it, missing numbers ``UNKNOWN``."""
    types = dict(df.dtypes)
    columns = [
        (array_to_vector(F.col(f).cast("array<double>")) if types[f].startswith("array") else
         F.coalesce(F.col(f).cast("double"), F.lit(UNKNOWN))).alias(f"_x{i}")
        for i, f in enumerate(features)
    ]
    wide = df.select(*keep, *columns)
    inputs = [f"_x{i}" for i in range(len(features))]
    return VectorAssembler(inputCols=inputs, outputCol="_features").transform(wide).drop(*inputs)


def fit(rows: DataFrame, learner: Estimator, label: str = "target", weight: str | None = None) -> Model:
    params = {learner.labelCol: label}
    if weight:
        params[learner.weightCol] = weight
    # Trees shuffle the statistics of all their nodes once for every partition and level, so there is one partition for each core.
    return learner.copy(params).fit(rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism))


def fits(jobs: list[Callable], rows: DataFrame) -> list:
    """Results of independent fits, run at the same time: the short stages of one fit leave cores idle that others can use.

    Every fit keeps its rows, about as many as ``rows`` has. Where those of one are enough for the cores the next one waits, as they
    would only push each other out of memory.
    """
    room = ROWS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism // max(1, rows.count()) if len(jobs) > 1 else 1
    jobs = [inheritable_thread_target(rows.sparkSession)(job) for job in jobs]
    with ThreadPool(max(1, min(AT_ONCE, len(jobs), room))) as pool:
        return pool.map(lambda job: job(), jobs, chunksize=1)


def or_error(job: Callable) -> Callable:
    """The job, which returns its error instead of raising it, so that those beside it go on."""

    def run():
        try:
            return job()
        except Exception as exc:
            return exc

    return run


def score(model: Model, rows: DataFrame, keep: list[str], out: str = "score") -> DataFrame:
    """``keep`` columns and the probability of class 1."""
    return model.transform(rows).select(*keep, vector_to_array("probability")[1].alias(out))


def fit_score(
    train: DataFrame, test: DataFrame, features: list[str], key: list[str], learner: Estimator, label: str = "target",
    weight: str | None = None,
) -> DataFrame:
    """Scores of ``test`` by a model of all train rows."""
    keep = [label, *([weight] if weight else [])]
    model = fit(assemble(train, features, keep), learner, label, weight)
    return score(model, assemble(test, features, key), key)


def cross_validate(
    train: DataFrame, folds: list[tuple[object, object]], features: list[str], key: list[str], learner: Estimator,
    label: str = "target", test: DataFrame | None = None, keep: tuple[str, ...] = ("review_year",),
    early_stop: bool = True, assembled: tuple[DataFrame, DataFrame | None] | None = None,
) -> tuple[DataFrame, DataFrame | None, list[Model]]:
    """Fold models: scores of the validation rows, scores of ``test`` by every fold, and the models.

    ``folds`` holds a (train condition, validation condition) pair per fold on the ``keep`` columns. With early stopping the
    validation rows also end the boosting. Features are assembled and written once for all folds; ``assembled`` passes
    in the result of ``assembled_sides`` where several learners share it.
    """
    rows, held_out = assembled or assembled_sides(train, test, features, key, label, keep)
    valid_scores, test_scores = None, None
    sides = [rows.filter(in_train | in_valid).withColumn("_valid", F.coalesce(in_valid, F.lit(False))) for in_train, in_valid in folds]

    def job(used: DataFrame) -> Callable[[], Model]:
        if isinstance(learner, GBTClassifier) and early_stop:
            params = {learner.validationIndicatorCol: "_valid", learner.validationTol: EARLY_STOP}
            return lambda: fit(used, learner.copy(params), label)
        return lambda: fit(used.filter(~F.col("_valid")), learner, label)

    models = fits([job(used) for used in sides], rows)
    for number, (used, model) in enumerate(zip(sides, models)):
        part = score(model, used.filter("_valid"), [*key, label]).withColumn("fold", F.lit(number))
        valid_scores = part if valid_scores is None else valid_scores.unionByName(part)
        if held_out is not None:
            part = score(model, held_out, key).withColumn("fold", F.lit(number))
            test_scores = part if test_scores is None else test_scores.unionByName(part)
    return valid_scores, test_scores, models


def assembled_sides(
    train: DataFrame, test: DataFrame | None, features: list[str], key: list[str], label: str = "target",
    keep: tuple[str, ...] = ("review_year",),
) -> tuple[DataFrame, DataFrame | None]:
    """Train and test rows with their feature vectors, written."""
    rows = cut_lineage(assemble(train, features, list(dict.fromkeys([*key, label, *keep]))))
    return rows, None if test is None else cut_lineage(assemble(test, features, key))


def year_conditions(years: list[int], year: str = "review_year") -> list[tuple[object, object]]:
    return [(F.col(year) < y, F.col(year) == y) for y in years]


def fold_conditions(k: int, fold: str = "fold") -> list[tuple[object, object]]:
    return [(F.col(fold) != i, F.col(fold) == i) for i in range(k)]


def fold_scores(valid: DataFrame, label: str = "target") -> DataFrame:
    """(fold, auc) of validation scores."""
    return A.auc(valid, ["fold"], label, "score")


def importances(models: list[Model], names: list[str], vectors: dict[str, int] | None = None) -> DataFrame:
    """(feature, importance) summed over the models. ``vectors`` gives the length of array features."""
    from pyspark.sql import SparkSession

    slots = [n for n in names for _ in range((vectors or {}).get(n, 1))]
    rows = [(i, n, float(m.featureImportances[j])) for i, m in enumerate(models) for j, n in enumerate(slots)]
    long = SparkSession.getActiveSession().createDataFrame(rows, "fold int, feature string, importance double")
    return long.groupBy("feature").agg(F.sum("importance").alias("importance"))


def kept_features(table: DataFrame, names: list[str]) -> list[str]:
    """Features that any fold used, in their order. The table has one row per feature."""
    used = {r["feature"] for r in table.filter("importance > 0").collect()}
    return [n for n in names if n in used]


def seed_average(
    train: DataFrame, test: DataFrame, features: list[str], key: list[str], learner: Callable[[int], Estimator],
    seeds: tuple[int, ...] = (42, 43, 44), label: str = "target",
) -> DataFrame:
    """Mean score of one model per seed."""
    rows, held_out = cut_lineage(assemble(train, features, [label])), cut_lineage(assemble(test, features, key))
    out = None
    for model in fits([lambda seed=seed: fit(rows, learner(seed), label) for seed in seeds], rows):
        part = score(model, held_out, key)
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*key).agg(F.avg("score").alias("score"))


def stack(
    train: DataFrame, test: DataFrame, years: list[int], features: list[str], key: list[str],
    learners: list[Estimator], label: str = "target", ridge: float = 1.0,
) -> DataFrame:
    """Per time fold: base learners, a ridge model of their validation scores, its test scores; fold mean."""
    names = [f"_s{i}" for i in range(len(learners))]
    valid, held_out = None, None
    sides = assembled_sides(train, test, features, key, label)
    for name, learner in zip(names, learners):
        v, t, _ = cross_validate(train, year_conditions(years), features, key, learner, label, test, assembled=sides)
        v, t = v.withColumnRenamed("score", name), t.withColumnRenamed("score", name)
        valid = v if valid is None else valid.join(v.drop(label), ["fold", *key])
        held_out = t if held_out is None else held_out.join(t, ["fold", *key])
    valid, held_out = cut_lineage(valid), cut_lineage(held_out)
    combine = VectorAssembler(inputCols=names, outputCol="_features")
    meta = None
    for number in range(len(years)):
        rows = combine.transform(valid.filter(F.col("fold") == number))
        # The learner's penalty is per row, the usual ridge penalty is on the sum over rows.
        n = rows.count()
        if n == 0:
            continue
        model = LinearRegression(
            featuresCol="_features", labelCol=label, regParam=ridge / n, elasticNetParam=0.0, standardization=False
        ).fit(rows)
        part = model.transform(combine.transform(held_out.filter(F.col("fold") == number))).select(*key, "prediction")
        meta = part if meta is None else meta.unionByName(part)
    return meta.groupBy(*key).agg(F.avg("prediction").alias("score"))


def stack_seeds(
    train: DataFrame, test: DataFrame, years: list[int], features: list[str], key: list[str],
    learners: Callable[[int], list[Estimator]], seeds: list[int], label: str = "target",
) -> DataFrame:
    """Mean of stacks that differ in the seed of their base learners."""
    out = None
    for seed in seeds:
        part = cut_lineage(stack(train, test, years, features, key, learners(seed), label))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*key).agg(F.avg("score").alias("score"))


def balanced(train: DataFrame, label: str = "target", out: str = "weight") -> DataFrame:
    """Weight of a positive row = negatives / positives, of a negative row 1."""
    weight = E.class_balance(train, label).select("pos_weight").scalar()
    return train.withColumn(out, F.when(F.col(label) == 1, weight).otherwise(F.lit(1.0)))


def pseudo_label_scores(
    train: DataFrame, test: DataFrame, features: list[str], key: list[str], learner: Estimator, high: float = 0.95,
    low: float = 0.05, cap: int | None = 1500, weight: float = 0.3,
) -> DataFrame:
    """Score, take the surest rows as labelled at a lower weight, fit again, score again."""
    first = cut_lineage(fit_score(train, test, features, key, learner))
    extra = test.drop("target").join(B.pseudo_labels(first, key, "score", high, low, cap, weight).drop("score"), key)
    return fit_score(B.with_pseudo_rows(train, extra, features), test, features, key, learner, weight="weight")


def seen_unseen_scores(
    train: DataFrame, test: DataFrame, features: list[str], key: list[str], learner: Estimator, movie: str,
    years: list[int], group_folds: DataFrame, k: int,
) -> DataFrame:
    """Seen movies by the mean of the time-fold models, unseen ones by the mean of models that are
    validated on movies they were not trained on and use nothing tied to the movie's identity."""
    grouped = train.join(group_folds.select(movie, F.col("fold").alias("_group")), movie)
    plain = without_movie_identity(features)
    _, known, _ = cross_validate(train, year_conditions(years), features, key, learner, test=test)
    _, unknown, _ = cross_validate(grouped, fold_conditions(k, "_group"), plain, key, learner, test=test, keep=("_group",))
    known = known.groupBy(*key).agg(F.avg("score").alias("_known"))
    unknown = unknown.groupBy(*key).agg(F.avg("score").alias("_unknown"))
    # The movie is usually part of the row key already.
    keyed = test.select(*dict.fromkeys([*key, movie]))
    routed = flag_seen(keyed, train, movie, "_seen").join(known, key).join(unknown, key)
    return B.route(routed, "_seen", "_known", "_unknown", "score").select(*key, "score")


def run_experiments(
    configs: dict[str, Callable[[], tuple[int, DataFrame]]], done: list[str] = (),
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Run named configurations and record the outcome of each.

    A configuration returns its number of features and its validation scores (fold, target, score).
    An error is recorded and does not stop the others. Result: (config, n_features, cv_auc_mean,
    cv_auc_std, path, error), where ``path`` holds the validation scores, and the scores of those that ran.
    """
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rows, scores = [], {}
    for name, run in configs.items():
        if name in done:
            continue
        try:
            n, valid = run()
            path = scratch_path(spark, "validation-scores")
            valid.write.parquet(path)
            scores[name] = spark.read.schema(valid.schema).parquet(path)
            mean, std = A.fold_summary(fold_scores(scores[name]), [], "auc").first()
            rows.append((name, n, mean, std, path, None))
        except Exception as exc:  # recorded per configuration by contract
            rows.append((name, None, None, None, None, f"{type(exc).__name__}: {exc}"[:500]))
    schema = "config string, n_features int, cv_auc_mean double, cv_auc_std double, path string, error string"
    return spark.createDataFrame(rows, schema), scores
