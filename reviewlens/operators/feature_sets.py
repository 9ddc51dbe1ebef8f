"""Named feature sets and the tables that hold them.

A ``Tables`` value is a train and a held-out frame that get the same new columns step by step. Both
stay separate, because the train side of an encoder looks at other rows than the held-out side.
Statistics always come from the train frame alone. Frames are written between stages: an encoder reads
its input more than once, and unwritten stages would multiply. Rows are wide, so encoders of many categories move
row numbers and keys in their place.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.functions import columns as C
from reviewlens.operators import encode as E
from reviewlens.operators import factor as X
from reviewlens.operators import folds as K
from reviewlens.operators import similar as N
from reviewlens.session import cut_lineage

# Raw categories (each enters by its frequency) and encoder settings.
CATEGORIES = (
    "movie", "critic", "publisher", "title", "info", "content_rating", "directors", "authors", "actors",
    "production_company",
)
DATES = ("review", "release")
TIME_ORDERED = ("critic", "production_company")
OUT_OF_FOLD = {"critic": 10, "movie": 10, "publisher": 10, "directors": 15, "authors": 15, "production_company": 10}
NMF_FACTORS, SVD_FACTORS, TE_FOLDS, PCA_COMPONENTS, RANKING_FACTORS = 24, 32, 5, 16, 64

ROW = "_row"  # number of a row between two steps
FEW = 100_000  # categories whose statistics are joined to whole rows

BASELINE = (
    *(f"{c}_freq" for c in CATEGORIES),
    "top_critic", "runtime",
    *(f"{d}_{p}" for d in DATES for p in ("year", "month", "dayofweek")),
    "age_days",
    *(f"genre_{g}" for g in C.GENRES),
    *(f"{c}_te_ts" for c in TIME_ORDERED),
    *(f"{c}_te_ts_bin" for c in TIME_ORDERED),
    "runtime_bin", "age_bin", "release_decade",
    "info_len", "info_words", "title_len", "title_words",
)
V2 = (*(f"{c}_te" for c in OUT_OF_FOLD), "critic_review_count", "movie_review_count")
RATIOS = ("critic_avg_fresh", "ratio_movie_te_to_critic", "ratio_movie_te_to_global", "ratio_critic_te_to_global")
DOCUMENTARY = "documentary_x_critic_te"

# Names of the features that the sets are made of, here and above.
# What a model for unseen movies must not use.
MOVIE_IDENTITY = (
    "movie_freq", "movie_te", "movie_review_count", "ratio_movie_te_to_critic", "ratio_movie_te_to_global",
)
MOVIE_VECTORS = ("nmf_movie", "svd_movie")

STAGES = {
    "minimal": ("top_critic", "content_rating_freq"),
    "dates": (*(f"{d}_{p}" for d in DATES for p in ("year", "month", "dayofweek")), "age_days"),
    "genres": tuple(f"genre_{g}" for g in C.GENRES),
    "numbers": ("is_runtime_missing", "is_age_missing", "runtime", "publisher_freq"),
    "strings": (*V2, "critic_loo", "n_directors", "info_len", "info_words"),
    "bins": ("release_decade", "runtime_bin", "age_bin"),
    "critics": ("critic_freq", "publisher_neighbours", "rating_top_critic_loo"),
}


def feature_sets(available: list[str] | None = None) -> dict[str, list[str]]:
    """Set name -> feature names. Vector features count as one name each.

    ``available`` leaves out features whose raw columns a data set does not have.
    """
    v2 = (*BASELINE, *V2)
    everything = (*v2, *RATIOS, "nmf_critic", "nmf_movie", "svd_critic", "svd_movie")
    best = (*BASELINE, "vector_pca", DOCUMENTARY)
    sets = {
        "baseline": BASELINE,
        "v2": v2,
        "v2_ratio": (*v2, *RATIOS),
        "v2_nmf": (*v2, "nmf_critic", "nmf_movie"),
        "v2_svd": (*v2, "svd_critic", "svd_movie"),
        "v2_all": everything,
        "known": everything,
        # Of a movie that train does not have, the vectors hold their defaults.
        "unknown": [*without_movie_identity(everything), *MOVIE_VECTORS],
        "unknown_v2": without_movie_identity(v2),
        "best": best,
        "best_ranking": (*best, "ranking_critic", "ranking_movie"),
    }
    for i in range(len(STAGES)):
        names = [n for stage in list(STAGES.values())[: i + 1] for n in stage]
        sets[f"stage_{i}"] = tuple(dict.fromkeys(names))
    return {k: [n for n in v if available is None or n in available] for k, v in sets.items()}


def without_movie_identity(names) -> list[str]:
    return [n for n in names if n not in MOVIE_IDENTITY and n not in MOVIE_VECTORS]


def expanded_size(names: list[str], vectors: dict[str, int]) -> int:
    """Number of numeric inputs, each vector feature counted with its length."""
    return sum(vectors.get(n, 1) for n in names)


@dataclass
class Tables:
    train: DataFrame
    test: DataFrame

    def each(self, step) -> Tables:
        """The same step on both frames; ``step`` gets (rows, train as it is now)."""
        base = self.train
        return Tables(step(self.train, base), step(self.test, base))

    def written(self) -> Tables:
        return Tables(cut_lineage(self.train), cut_lineage(self.test))


def add_row_features(tables: Tables) -> Tables:
    def step(df: DataFrame, train: DataFrame) -> DataFrame:
        df = df.withColumns({
            **C.date_parts("review_date", "review"),
            **C.date_parts("release_date", "release"),
            "age_days": C.age_days("review_date", "release_date"),
            "is_runtime_missing": C.missing_flag("runtime"),
            **C.genre_flags("genres"),
            **{c: C.fill_missing(c) for c in CATEGORIES if c in df.columns and c not in ("movie", "critic")},
        })
        df = C.fill_train_median(df, train, "runtime")
        return df.withColumns({
            "is_age_missing": C.missing_flag("age_days"),
            "runtime_bin": C.right_closed_bin("runtime", C.RUNTIME_EDGES),
            "age_bin": C.age_bin("age_days"),
            "release_decade": C.decade("release_year"),
            "n_directors": C.list_size("directors"),
            **{f"{c}_len": C.text_length(c) for c in ("info", "title")},
            **{f"{c}_words": C.word_count(c) for c in ("info", "title")},
            "top_critic": F.col("top_critic").cast("int"),
        })

    return tables.each(step)


@dataclass
class Lookup:
    """A statistics table, written, with its keys and the values of categories that it does not hold."""

    stats: DataFrame
    keys: list[str]
    default: dict[str, Column | float]


def _numbered(tables: Tables) -> Tables:
    """Both frames written with a number for each row, by which results made from some of its columns find it again."""
    return tables.each(lambda df, _: cut_lineage(df.withColumn(ROW, F.monotonically_increasing_id())))


def _with_results(rows: DataFrame, lookups: list[Lookup], results: list[DataFrame]) -> DataFrame:
    """Numbered rows with the values of all lookups and results (row number, values).

    A table of few categories is joined to the rows themselves. For one of many categories only row numbers and keys travel to it,
    and what they find travels to the rows; so the rows move once, however many such tables and results there are.
    """
    few = [x.stats.count() <= FEW for x in lookups]
    narrow = [E.lookup(rows.select(ROW, *x.keys), x.stats, x.keys, x.default).select(ROW, *x.default) for x, own in zip(lookups, few) if not own]
    for found in [*results, *narrow]:
        rows = rows.join(found, ROW, "left")
    for x in itertools.compress(lookups, few):
        rows = E.lookup(rows, x.stats, x.keys, x.default)
    return rows


def _frequencies(train: DataFrame) -> list[Lookup]:
    names = [n for n in CATEGORIES if n in train.columns]
    counts = {n: train.groupBy(n).agg(F.count(F.lit(1)).alias(f"{n}_freq")) for n in names}
    return [Lookup(cut_lineage(counts[n]), [n], {f"{n}_freq": 0}) for n in names]


def _target_means(train: DataFrame, names: tuple[str, ...], target: str, m: float) -> list[Lookup]:
    prior = E.mean_of(train, target)
    return [Lookup(cut_lineage(E.target_means(train, [n], target, m, f"{n}_te_ts")), [n], {f"{n}_te_ts": prior}) for n in names]


def _time_ordered(train: DataFrame, tie: Column, target: str, m: float) -> list[DataFrame]:
    """(row number, encoding) of every time-ordered column; only what orders and adds up a row is moved."""
    return [
        E.time_ordered_target_encode(train, n, target, "review_date", tie, f"{n}_te_ts", m, keep=[ROW]).select(ROW, f"{n}_te_ts")
        for n in TIME_ORDERED
    ]


def _after_time_ordered(tables: Tables) -> Tables:
    def step(df: DataFrame, _: DataFrame) -> DataFrame:
        for name in TIME_ORDERED:
            df = E.with_bin(df, f"{name}_te_ts")
        return df.withColumn(DOCUMENTARY, C.product("critic_te_ts", "genre_Documentary")).drop(ROW)

    return tables.each(step)


def add_frequencies(tables: Tables) -> Tables:
    tables = _numbered(tables)
    lookups = _frequencies(tables.train)
    return tables.each(lambda df, _: _with_results(df, lookups, []).drop(ROW))


def add_time_ordered(tables: Tables, tie: Column, target: str = "target", m: float = 10) -> Tables:
    tables = _numbered(tables)
    train = _with_results(tables.train, [], _time_ordered(tables.train, tie, target, m))
    test = _with_results(tables.test, _target_means(tables.train, TIME_ORDERED, target, m), [])
    return _after_time_ordered(Tables(train, test))


def baseline(tables: Tables, tie: Column, target: str = "target", m: float = 10) -> Tables:
    """Row features, time-ordered encodings and frequencies, for the caller to write: rows are written once on the way."""
    tables = _numbered(add_row_features(tables))
    lookups = _frequencies(tables.train)
    train = _with_results(tables.train, lookups, _time_ordered(tables.train, tie, target, m))
    test = _with_results(tables.test, lookups + _target_means(tables.train, TIME_ORDERED, target, m), [])
    return _after_time_ordered(Tables(train, test))


def add_baseline(tables: Tables, tie: Column, target: str = "target") -> Tables:
    return baseline(tables, tie, target).written()


def add_v2(tables: Tables, tie: Column, target: str = "target", folds: int = TE_FOLDS) -> Tables:
    """Out-of-fold encodings and review counts."""
    base = K.hash_folds(tables.train, tie, folds, "_fold")
    prior = E.mean_of(base, target)
    train, test = base, tables.test
    for name, m in OUT_OF_FOLD.items():
        if name in base.columns:
            train = E.out_of_fold_encode(train, [name], target, "_fold", f"{name}_te", m, prior, base)
            test = E.target_encode(test, base, [name], target, m, f"{name}_te")
    out = Tables(train.drop("_fold"), test)
    for name in ("critic", "movie"):
        out = Tables(*(E.frequency_encode(df, base, name, f"{name}_review_count") for df in (out.train, out.test)))
    return out


def add_ratios(tables: Tables, target: str = "target") -> Tables:
    return tables.each(lambda df, train: E.encoding_ratios(df, train, "critic", "movie_te", "critic_te", target))


def add_leave_one_out(tables: Tables, keys: list[str], out: str, target: str = "target", m: float = 5) -> Tables:
    return Tables(
        E.leave_one_out_encode(tables.train, keys, target, out, m),
        E.target_encode(tables.test, tables.train, keys, target, m, out),
    )


def _attach(tables: Tables, factors: DataFrame, key: str, out: str, default: Column) -> Tables:
    return tables.each(lambda df, _: X.attach_factors(df, factors, key, "vector", out, default))


def add_nmf(tables: Tables, k: int = NMF_FACTORS, iterations: int = 50) -> Tables:
    """Unseen critics get zeros, unseen movies the overall mean of the movie factors."""
    pairs = X.interactions([tables.train], "critic", "movie").withColumn("value", F.lit(1.0))
    critics, movies = X.non_negative_factors(pairs, "critic", "movie", "value", k, iterations)
    overall = movies.select(F.explode("vector").alias("x")).agg(F.avg("x")).scalar()
    tables = _attach(tables, critics, "critic", "nmf_critic", F.array_repeat(F.lit(0.0), k))
    return _attach(tables, movies, "movie", "nmf_movie", F.array_repeat(overall, k))


def add_svd(tables: Tables, k: int = SVD_FACTORS, size: int = 2000) -> Tables:
    pairs = X.interactions([tables.train], "critic", "movie")
    critics = cut_lineage(X.neighbour_factors(pairs, "critic", "movie", k, size))
    movies = cut_lineage(X.neighbour_factors(pairs, "movie", "critic", k, size))
    tables = _attach(tables, critics, "critic", "svd_critic", F.array_repeat(F.lit(0.0), k))
    return _attach(tables, movies, "movie", "svd_movie", X.column_means(movies, "vector"))


def add_vector_pca(tables: Tables, vectors: DataFrame, dims: int, k: int = PCA_COMPONENTS) -> Tables:
    """Principal components of the movie vectors, fitted on the train rows; no vector counts as zeros."""
    counts = tables.train.groupBy("movie").agg(F.count(F.lit(1)).alias("_rows"))
    fit = N.join_vectors(counts, vectors, "movie", "vector", dims)
    projection = X.fit_projection(fit, "vector", k, centre=True, weight="_rows")
    reduced = X.project(vectors.select("movie", "vector"), "vector", projection)
    missing = (-projection.mean) @ projection.matrix
    return _attach(tables, reduced, "movie", "vector_pca", F.array(*[F.lit(float(x)) for x in missing]))


def add_ranking(tables: Tables, k: int = RANKING_FACTORS, epochs: int = 100, dot_only: bool = False) -> Tables:
    """Ranking factors of the pairs of both sides, and their dot product; ``dot_only`` keeps the product alone."""
    pairs = X.interactions([tables.train, tables.test], "critic", "movie")
    critics, movies = X.ranking_factors(pairs, "critic", "movie", k, epochs)
    zeros = F.array_repeat(F.lit(0.0), k)
    tables = _attach(tables, critics, "critic", "ranking_critic", zeros)
    tables = _attach(tables, movies, "movie", "ranking_movie", zeros)
    vectors = ("ranking_critic", "ranking_movie") if dot_only else ()
    return tables.each(lambda df, _: df.withColumn("ranking_dot", X.dot("ranking_critic", "ranking_movie")).drop(*vectors))


def add_two_hop(
    tables: Tables, ratio: bool = False, leave_one_out: bool = False, columns: tuple[str, ...] | None = None,
) -> Tables:
    """Means over the movie's reviews. ``columns`` names those wanted, all by default; the ratio needs the encoding's mean."""
    values = {"movie_fresh_rate_mean": "target", "movie_critic_te_mean": "critic_te_ts"}
    if columns is not None:
        values = {name: values[name] for name in columns}
    if ratio and "movie_critic_te_mean" not in values:
        raise ValueError("the ratio needs movie_critic_te_mean")

    def step(df: DataFrame, train: DataFrame) -> DataFrame:
        own = leave_one_out and "target" in df.columns and df is train
        df = E.two_hop(df, train, "movie", values, "movie_two_hop_count", leave_one_out=own)
        return E.two_hop_ratio(df, "critic_te_ts", "movie_critic_te_mean", "critic_te_div_movie_te") if ratio else df

    return tables.each(step)


def add_rest(
    tables: Tables, tie: Column, nmf: int = NMF_FACTORS, svd: int = SVD_FACTORS, svd_size: int = 2000,
    iterations: int = 50,
) -> Tables:
    """Everything that ``v2_all`` needs on top of the baseline."""
    tables = add_ratios(add_v2(tables, tie).written()).written()
    return add_svd(add_nmf(tables, nmf, iterations), svd, svd_size)


def add_all(tables: Tables, tie: Column, **sizes: int) -> Tables:
    """Everything that ``v2_all`` needs on top of the raw columns."""
    return add_rest(add_baseline(tables, tie), tie, **sizes)
