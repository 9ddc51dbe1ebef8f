"""Text vectors: vocabulary, counts, TF-IDF, hashed n-grams, topics, word vectors.

Term tables are kept in long form (key, index, value) with a vocabulary of bounded size, so a large
text is only a row with many terms. ``dense`` turns a long table into one array per key for the
learners; its length is the vocabulary size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import LDA, LDAModel
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.operators.factor import fit_projection, non_negative_factors, project, project_rows
from reviewlens.operators.folds import hash_bucket
from reviewlens.session import cut_lineage

# A term is two or more letters, digits or underscores in a row; limits of the vocabulary.
TOKEN = r"[\p{L}\p{N}_]{2,}"
MIN_DF = 2
MAX_DF = 0.95


def tokens(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TOKEN), F.lit(0))


def with_bigrams(words: Column) -> Column:
    n = F.size(words) - 1
    pairs = F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(n > 0, F.concat(words, pairs)).otherwise(words)


def _terms(df: DataFrame, key: str, text: str) -> DataFrame:
    words = df.select(key, tokens(text).alias("_words"))
    return words.select(key, F.explode(with_bigrams(F.col("_words"))).alias("term"))


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, n) over one- and two-word terms."""
    return _terms(df, key, text).groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(term, index, df, total): the ``size`` most frequent terms within the document limits.

    Equal totals resolve by term; the index is the alphabetical position among the chosen ones.
    """
    stats = term_counts(df, key, text).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("total"))
    documents = df.agg(F.count(F.lit(1))).scalar()
    chosen = stats.filter((F.col("df") >= MIN_DF) & (F.col("df") <= MAX_DF * documents))
    chosen = chosen.orderBy(F.col("total").desc(), "term").limit(size)
    # ``size`` rows at most.
    return chosen.withColumn("index", F.row_number().over(Window.orderBy("term")) - 1)


def count_vectors(df: DataFrame, vocab: DataFrame, key: str, text: str) -> DataFrame:
    """(key, index, term, n) for the terms of the vocabulary. They are picked before the shuffle."""
    # The vocabulary is limited to a fixed number of terms.
    picked = _terms(df, key, text).join(F.broadcast(vocab.select("term", "index", "df")), "term")
    return picked.groupBy(key, "index", "term", "df").agg(F.count(F.lit(1)).alias("n"))


def tfidf_vectors(df: DataFrame, train: DataFrame, vocab: DataFrame, key: str, text: str) -> DataFrame:
    """(key, index, term, value): (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), scaled to length 1."""
    documents = train.agg(F.count(F.lit(1))).scalar()
    weight = (1 + F.ln("n")) * (F.ln((1 + documents) / (1 + F.col("df"))) + 1)
    weighted = count_vectors(df, vocab, key, text).withColumn("_w", weight)
    # A text has at most one row per vocabulary term here.
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)))
    return weighted.select(key, "index", "term", (F.col("_w") / length).alias("value"))


def dense(long: DataFrame, keys: DataFrame, key: str, dims: int, index: str = "index", value: str = "value") -> DataFrame:
    """(key, vector): one array of ``dims`` numbers for every row of ``keys``, zeros where nothing is known."""

    @F.pandas_udf("array<double>")
    def fill(places: pd.Series, values: pd.Series) -> pd.Series:
        out = np.zeros((len(places), dims))
        for row, (i, v) in enumerate(zip(places, values)):
            if i is not None:
                out[row, i] = v
        return pd.Series(list(out))

    # At most ``dims`` entries per key.
    entry = F.struct(F.col(index).cast("int").alias("i"), F.col(value).cast("double").alias("v"))
    rows = long.groupBy(key).agg(F.collect_list(entry).alias("_e"))
    filled = fill(F.transform("_e", lambda e: e["i"]), F.transform("_e", lambda e: e["v"]))
    return keys.select(key).join(rows, key, "left").select(key, filled.alias("vector"))


def hashed_vectors(df: DataFrame, key: str, text: str, buckets: int) -> DataFrame:
    """(key, vector): one- and two-word terms in md5 buckets, length 1. Stateless, so nothing is fitted."""
    terms = df.select(key, tokens(text).alias("_t")).select(key, F.explode(with_bigrams(F.col("_t"))).alias("_t"))
    counted = terms.groupBy(key, hash_bucket(F.md5("_t"), buckets).alias("index")).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    length = F.sqrt(F.sum(F.col("_n") * F.col("_n")).over(Window.partitionBy(key)))  # at most ``buckets`` rows per key
    return dense(counted.withColumn("value", F.col("_n") / length), df, key, buckets)


def topic_model(fit: DataFrame, topics: int, iterations: int = 10, seed: int = 42) -> LDAModel:
    """Latent Dirichlet allocation over dense term weights."""
    lda = LDA(k=topics, maxIter=iterations, seed=seed, featuresCol="_f", optimizer="online")
    return lda.fit(fit.select(array_to_vector("vector").alias("_f")))


def topic_shares(model: LDAModel, rows: DataFrame, key: str) -> DataFrame:
    """(key, vector): topic distribution of each row."""
    out = model.transform(rows.withColumn("_f", array_to_vector("vector")))
    return out.select(key, vector_to_array("topicDistribution").alias("vector"))


def word_vectors(
    df: DataFrame, text: str, size: int = 32, window: int = 5, min_count: int = 2, epochs: int = 5, seed: int = 42,
    partitions: int = 8,
) -> DataFrame:
    """(word, vector) of the words that occur at least ``min_count`` times."""
    sentences = df.select(F.filter(F.split(text, r"\s+"), lambda t: t != "").alias("_s"))
    learner = Word2Vec(
        inputCol="_s", outputCol="_v", vectorSize=size, windowSize=window, minCount=min_count, maxIter=epochs, seed=seed,
        numPartitions=partitions,
    )
    return learner.fit(sentences).getVectors().select("word", F.col("vector").alias("_wv"))


def mean_word_vectors(df: DataFrame, words: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, vector): mean over the known words of a text; zeros if it has none."""
    long = df.select(key, F.explode(F.filter(F.split(text, r"\s+"), lambda t: t != "")).alias("word"))
    counted = long.groupBy(key, "word").agg(F.count(F.lit(1)).cast("double").alias("_n"))
    means = counted.join(words, "word").groupBy(key).agg(
        vector_to_array(Summarizer.mean(F.col("_wv"), F.col("_n"))).alias("vector")
    )
    zeros = F.array_repeat(F.lit(0.0), size)
    return df.select(key).join(means, key, "left").withColumn("vector", F.coalesce("vector", zeros))


# --- named configurations -------------------------------------------------------------------------
#
# A configuration is a function (train, key, text) -> (rows -> vectors). What it learns from train is
# written once, so that applying it to several frames does not learn it again.


def _learned_vocabulary(train, key, text, n):
    return cut_lineage(vocabulary(train, key, text, n))


def _counts(n):
    def fit(train, key, text):
        vocab = _learned_vocabulary(train, key, text, n)
        return lambda rows: dense(count_vectors(rows, vocab, key, text), rows, key, n, value="n")

    return fit


def _tfidf(n):
    def fit(train, key, text):
        vocab = _learned_vocabulary(train, key, text, n)
        return lambda rows: dense(tfidf_vectors(rows, train, vocab, key, text), rows, key, n)

    return fit


def _hashed(buckets):
    def fit(train, key, text):
        return lambda rows: hashed_vectors(rows, key, text, buckets)

    return fit


def _reduced(inner, components):
    def fit(train, key, text):
        vectors = inner(train, key, text)
        projection = fit_projection(vectors(train), "vector", components, centre=False)
        return lambda rows: project(vectors(rows), "vector", projection)

    return fit


def _topics(n, terms=200):
    def fit(train, key, text):
        vectors = _tfidf(terms)(train, key, text)
        model = topic_model(vectors(train), n)
        return lambda rows: topic_shares(model, vectors(rows), key)

    return fit


def _parts(n, terms=200, iterations=20):
    def fit(train, key, text):
        vocab = _learned_vocabulary(train, key, text, terms)
        weights = tfidf_vectors(train, train, vocab, key, text)
        _, parts = non_negative_factors(weights, key, "index", "value", n, iterations)

        def apply(rows):
            long = tfidf_vectors(rows, train, vocab, key, text)
            out = project_rows(long, key, "index", "value", parts, n, iterations)
            zeros = F.array_repeat(F.lit(0.0), n)
            return rows.select(key).join(out, key, "left").withColumn("vector", F.coalesce("vector", zeros))

        return apply

    return fit


def _word_means(size):
    def fit(train, key, text):
        words = cut_lineage(word_vectors(train, text, size))
        return lambda rows: mean_word_vectors(rows, words, key, text, size)

    return fit


# Names and sizes that callers of the configurations use.
# name -> (configuration, description, reads title and info together)
CONFIGS = {
    "tfidf_50": (_tfidf(50), "TF-IDF, 50 terms", False),
    "tfidf_100": (_tfidf(100), "TF-IDF, 100 terms", False),
    "tfidf_svd20": (_reduced(_tfidf(200), 20), "TF-IDF of 200 terms, reduced to 20", False),
    "count_50": (_counts(50), "term counts, 50 terms", False),
    "count_svd20": (_reduced(_counts(200), 20), "counts of 200 terms, reduced to 20", False),
    "hash_50": (_hashed(50), "hashed terms in 50 buckets", False),
    "hash_svd20": (_reduced(_hashed(512), 20), "hashed terms in 512 buckets, reduced to 20", False),
    "lda_10": (_topics(10), "10 LDA topics", False),
    "lda_20": (_topics(20), "20 LDA topics", False),
    "nmf_10": (_parts(10), "10 non-negative parts", False),
    "nmf_20": (_parts(20), "20 non-negative parts", False),
    "word2vec_32": (_word_means(32), "mean word vector, 32 dimensions", False),
    "concat_mi_title_tfidf_50": (_tfidf(50), "title and info together, TF-IDF, 50 terms", True),
    "concat_mi_title_tfidf_svd20": (_reduced(_tfidf(200), 20), "title and info together, TF-IDF, reduced to 20", True),
    "concat_mi_title_count_50": (_counts(50), "title and info together, term counts", True),
}


def available_configs() -> list[str]:
    """Names that ``build_vectors`` accepts; ``base`` means no text vector."""
    return ["base", *CONFIGS, "sentence_transformer_32"]


def config_descriptions() -> dict[str, str]:
    return {
        "base": "no text vector",
        **{name: entry[1] for name, entry in CONFIGS.items()},
        "sentence_transformer_32": "first 32 dimensions of a given vector",
    }


def build_vectors(
    name: str, train: DataFrame, rows: DataFrame, key: str, text: str, title: str | None = None,
    vectors: DataFrame | None = None,
) -> DataFrame | None:
    """(key, vector) of a named configuration, fitted on ``train``; None for ``base``. Errors are raised."""
    if name == "base":
        return None
    if name == "sentence_transformer_32":
        if vectors is None:
            raise ValueError("this configuration needs given vectors")
        return rows.select(key).join(vectors, key).select(key, F.slice("vector", 1, 32).alias("vector"))
    if name not in CONFIGS:
        raise ValueError(f"unknown text configuration {name}")
    fit, _, joined = CONFIGS[name]
    if joined:
        if title is None:
            raise ValueError(f"{name} needs a title column")
        both = F.concat_ws(" ", title, text)
        train, rows = train.withColumn(text, both), rows.withColumn(text, both)
    return fit(train, key, text)(rows)
