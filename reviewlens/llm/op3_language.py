"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Characters are lower-cased, everything that is no letter becomes a space. N-grams of one to three characters fall into
``BUCKETS`` hash buckets. Document frequencies are counted over all learnable documents. The weights are learned on a
bounded sample (``PER_LANGUAGE`` documents of each language in expectation, chosen by hash) with follow-the-regularised-
leader and elastic-net penalties, most of them stay exactly zero; a fifth of the sample is kept for fitting the
temperature that calibrates the probabilities.

A text that is null or has no letter gets ``und`` with score 0, as do all texts if nothing can be learned. Repeated rows
are predicted each on their own, an empty table gives no rows, extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.llm import common as C

BUCKETS, LONGEST = 1 << 14, 3
#: Bound on the sample that the weights are learned on, for each language.
PER_LANGUAGE = 500
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 2e-3, 1e-4, 4
UNDECIDED = "und"
_ROWS = 64


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else a space."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            table[c] = c
    return table


def ngram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams, (texts, BUCKETS), and which texts have a letter."""
    counts = np.zeros((len(texts), BUCKETS), np.float32)
    lettered = np.zeros(len(texts), bool)
    table = _letters()
    for r, text in enumerate(texts):
        for lo in range(0, len(text), 1 << 20):  # n-grams of a very long text, piece by piece
            piece = text[max(0, lo - LONGEST + 1):lo + (1 << 20)].lower()
            x = table[np.frombuffer(piece.encode("utf-32-le", "replace"), np.uint32)]
            letter = x != 32
            if not letter.any():
                continue
            lettered[r] = True
            keep = letter.copy()
            keep[1:] |= letter[:-1]  # of a run of spaces one stays
            x = x[keep].astype(np.uint32) * np.uint32(0x9E3779B1)
            h = np.zeros(len(x), np.uint32)
            for n in range(1, LONGEST + 1):
                if len(x) < n:
                    break
                h = (h[:len(x) - n + 1] ^ (x[n - 1:] + np.uint32(n))) * np.uint32(0x85EBCA6B)
                h ^= h >> np.uint32(15)
                bucket = (h * np.uint32(0xC2B2AE35)) >> np.uint32(18)
                counts[r] += np.bincount(bucket, minlength=BUCKETS)
    return counts, lettered


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length 1, with log-scaled counts."""
    x = np.log1p(counts) * idf
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


def learn(rows: list[np.ndarray], values: list[np.ndarray], target: np.ndarray, n_classes: int) -> np.ndarray:
    """Weights (BUCKETS, classes) by FTRL-proximal steps, one document at a time."""
    z = np.zeros((BUCKETS, n_classes))
    squares = np.zeros((BUCKETS, n_classes))

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(squares[i])) / ALPHA + L2)
        return np.where(np.abs(z[i]) <= L1, 0.0, w)

    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for d in rng.permutation(len(rows)):
            i, v = rows[d], values[d]
            w = weights(i)
            logits = v @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[target[d]] -= 1
            gradient = v[:, None] * p[None, :]
            sigma = (np.sqrt(squares[i] + gradient ** 2) - np.sqrt(squares[i])) / ALPHA
            z[i] += gradient - sigma * w
            squares[i] += gradient ** 2
    return weights(np.arange(BUCKETS)).astype(np.float32)


def temperature(logits: np.ndarray, target: np.ndarray) -> float:
    """The temperature of least log loss, on a grid."""
    best, chosen = np.inf, 1.0
    for t in np.exp(np.linspace(np.log(0.05), np.log(5), 60)):
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        loss = (np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), target]).mean()
        if loss < best:
            best, chosen = loss, float(t)
    return chosen


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and the number of texts; partial sums leave each task."""

    def count(batches):
        df, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for i in range(0, batch.num_rows, _ROWS):
                counts, lettered = ngram_counts([t or "" for t in batch.column(0).slice(i, _ROWS).to_pylist()])
                df += (counts > 0).sum(axis=0)
                n += int(lettered.sum())
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.append(used, -1)), "df": pa.array(np.append(df[used], n))})

    sums = docs.select("text").mapInArrow(count, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df"))
    df, n = np.zeros(BUCKETS, np.int64), 0
    for r in sums.collect():  # at most BUCKETS + 1 rows
        if r.bucket < 0:
            n = r.df
        else:
            df[r.bucket] = r.df
    return df, n


class Model:
    """Languages, weights with the IDF, and temperature; small enough to travel with a task."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, heat: float):
        self.languages, self.idf, self.weights, self.heat = languages, idf, weights, heat

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        counts, lettered = ngram_counts([t or "" for t in texts])
        if not self.languages:
            return [UNDECIDED] * len(texts), np.zeros(len(texts))
        logits = (weighted(counts, self.idf) @ self.weights).astype(float) / self.heat
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        names = [self.languages[k] if ok else UNDECIDED for k, ok in zip(best, lettered)]
        return names, np.where(lettered, p[np.arange(len(p)), best], 0.0)


def fit(docs: DataFrame) -> Model:
    """Learn from (key, text, lang); rows without lang are left out."""
    docs = docs.filter("lang is not null and text is not null").select("key", "text", "lang")
    sizes = {r.lang: r.n for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    df, n = document_frequencies(docs)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.1)
    if not languages:
        return Model([], idf, np.zeros((BUCKETS, 0), np.float32), 1.0)
    share = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, PER_LANGUAGE / sizes[k])]), F.col("lang"))
    sample = docs.filter(share < rate)

    def features(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, _ROWS):
                part = batch.slice(i, _ROWS)
                counts, _ = ngram_counts(part.column("text").to_pylist())
                used = [np.flatnonzero(c) for c in counts]
                yield pa.RecordBatch.from_pydict({
                    "key": part.column("key"), "lang": part.column("lang"),
                    "buckets": pa.array([u.astype(np.int32) for u in used], pa.list_(pa.int32())),
                    "counts": pa.array([c[u] for c, u in zip(counts, used)], pa.list_(pa.float32()))})

    found = sample.mapInArrow(features, "key string, lang string, buckets array<int>, counts array<float>").collect()
    found.sort(key=lambda r: (C.mix(np.array([hash_of(r.key)], np.uint64))[0], r.lang))
    rows = [np.array(r.buckets, np.int64) for r in found]
    values = []
    for i, r in zip(rows, found):
        v = np.log1p(np.array(r.counts, np.float32)) * idf[i]
        values.append(v / max(float(np.sqrt((v * v).sum())), 1e-9))
    target = np.array([languages.index(r.lang) for r in found], np.int64)
    cut = len(rows) - len(rows) // 5
    weights = learn(rows[:cut], values[:cut], target[:cut], len(languages))
    logits = np.array([v @ weights[i] for i, v in zip(rows[cut:], values[cut:])]).reshape(-1, len(languages))
    return Model(languages, idf, weights, temperature(logits, target[cut:]) if len(logits) else 1.0)


def hash_of(key: str) -> int:
    import zlib

    return zlib.crc32(key.encode())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS times the number of languages

    def score(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, _ROWS):
                part = batch.slice(i, _ROWS)
                names, scores = shared.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, lang_pred string, score double")


def remainder(doc_id: str, n: int) -> Column:
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % n


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learnable = docs.filter(remainder("doc_id", 5) != 0).select(F.col("doc_id").cast("string").alias("key"), "text", "lang")
    out = predict(docs, fit(learnable))
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
