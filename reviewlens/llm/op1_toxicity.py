"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as the vector of its hash bucket (word input) beside the mean vector of its hashed character n-grams
(``^`` and ``$`` mark its ends; characters are UTF-8 bytes, A-Z lower-cased). Two recurrent networks read a window of
``WINDOW`` words in both directions, attention pools their states, a logistic unit scores the window. All windows of the
whole text are scored, every ``STRIDE`` words, with one that ends at the last word; the document's score comes from its
highest window through a calibration learned on documents that the network did not see.

Learning uses a bounded sample of labelled documents (``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` in expectation, chosen by
hash, each at most ``SAMPLE_CHARS`` long). Labels are of documents, not of windows: first all windows of a toxic document
count as toxic, later only those that score highest in it, against the highest windows of clean documents.

Null and empty texts and texts without words score 0, as does everything if one of both classes has no example. Repeated
rows are scored each on their own, an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.llm import common as C

WINDOW, STRIDE = 32, 16
WORD_BUCKETS, GRAM_BUCKETS, WORD_DIM, GRAM_DIM, HIDDEN = 1 << 13, 1 << 13, 8, 12, 8
#: Bound on the labelled sample.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 900, 1800, 20_000
BATCH, RATE, DECAY, FIRST_EPOCHS, LATER_EPOCHS, EPOCH_WINDOWS = 128, 0.01, 1e-4, 3, 7, 16_000
THRESHOLD = 0.3
_BLOCK_BYTES = 2 << 20


# ---------------------------------------------------------------- words and windows


#: Words whose features are held at full width at a time.
_WORDS = 1 << 14


def word_features(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, hashes: np.ndarray):
    """(word bucket, n-gram buckets end to end, where each word's begin) of words given by their bytes."""
    parts = [_some_features(data, *(x[i:i + _WORDS] for x in (begins, sizes, hashes))) for i in range(0, len(hashes), _WORDS)]
    word, gram, gram_at = zip(*parts)
    before = np.cumsum([0, *map(len, gram)])
    return np.concatenate(word), np.concatenate(gram), np.concatenate([at + n for at, n in zip(gram_at, before)])


def _some_features(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, hashes: np.ndarray):
    full = sizes + 2
    at = np.concatenate([[0], np.cumsum(full)])
    chars = np.empty(at[-1], np.uint32)
    chars[at[:-1]], chars[at[1:] - 1] = ord("^"), ord("$")
    inner = np.ones(at[-1], bool)
    inner[at[:-1]] = inner[at[1:] - 1] = False
    source = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    chars[inner] = C._LOWER[data[source]]
    word = np.repeat(np.arange(len(sizes)), full)
    grams, owner = [], []
    for n in (3, 4, 5):
        if len(chars) < n:
            continue
        h = np.zeros(len(chars) - n + 1, np.uint32)
        for k in range(n):
            h = (h ^ chars[k:len(chars) - n + 1 + k]) * np.uint32(0x01000193) + np.uint32(n)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        own = word[:len(h)]
        inside = own == word[n - 1:]
        grams.append((h[inside] >> np.uint32(16)).astype(np.int32) % GRAM_BUCKETS)
        owner.append(own[inside])
    gram, own = np.concatenate(grams), np.concatenate(owner)
    order = np.argsort(own, kind="stable")
    return (hashes % np.uint64(WORD_BUCKETS)).astype(np.int32), gram[order], np.searchsorted(own[order], np.arange(len(sizes)))


def window_starts(n_words: int) -> np.ndarray:
    last = max(0, n_words - WINDOW)
    return np.append(np.arange(0, last, STRIDE), last)


def split(data: np.ndarray, at: np.ndarray):
    """Different words of a block (their features), and of each row the places of its words among them."""
    hashes, row_at, begins, sizes = C.word_spans(data, at, lower=True)
    unique, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    features = word_features(data, begins[first], sizes[first], unique) if len(unique) else None
    return features, group.astype(np.int32), row_at


class Windows:
    """The places of the words of windows, made when rows of it are asked for."""

    def __init__(self, group: np.ndarray, starts: np.ndarray):
        self.group, self.starts = group, starts

    def __len__(self) -> int:
        return len(self.starts)

    def __getitem__(self, own) -> np.ndarray:
        return self.group[np.minimum(self.starts[own][:, None] + np.arange(WINDOW), len(self.group) - 1)]


def windows_of(row_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, number of words) of all windows of rows with words."""
    rows, starts, counts = [], [], []
    for r in np.flatnonzero(np.diff(row_at)).tolist():
        n = int(row_at[r + 1] - row_at[r])
        own = window_starts(n)
        rows.append(np.full(len(own), r))
        starts.append(own + row_at[r])
        counts.append(np.full(len(own), min(n, WINDOW)))
    if not rows:
        none = np.zeros(0, np.int64)
        return none, none, none
    return np.concatenate(rows), np.concatenate(starts), np.concatenate(counts)


# ---------------------------------------------------------------- network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters are float32 arrays in ``p``; suffixes f and b name the two directions."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + GRAM_DIM, HIDDEN

        def start(*shape, scale=0.3):
            return (rng.normal(size=shape) * scale).astype(np.float32)

        self.p = {"words": start(WORD_BUCKETS, WORD_DIM, scale=0.01), "grams": start(GRAM_BUCKETS, GRAM_DIM, scale=0.05),
                  "look": start(2 * h), "out": start(2 * h), "bias": np.zeros(1, np.float32)}
        for s in "fb":
            self.p |= {f"x{s}": start(d, 3 * h), f"u{s}": start(h, 3 * h), f"c{s}": np.zeros(3 * h, np.float32)}

    def vectors(self, features) -> np.ndarray:
        word, gram, gram_at = features
        ends = np.append(gram_at, len(gram))
        out = np.empty((len(word), WORD_DIM + GRAM_DIM), np.float32)
        out[:, :WORD_DIM] = self.p["words"][word]
        for i in range(0, len(word), _WORDS):
            own = ends[i:i + _WORDS + 1]
            some = np.add.reduceat(self.p["grams"][gram[own[0]:own[-1]]], own[:-1] - own[0])
            out[i:i + _WORDS, WORD_DIM:] = some / np.sqrt(np.diff(own))[:, None].astype(np.float32)
        return out

    def score(self, features, index: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Logits of windows; ``index`` (windows, WINDOW; an array or ``Windows``) names words, those past ``counts`` are padding."""
        vectors = self.vectors(features)
        tables = {s: vectors @ self.p[f"x{s}"] + self.p[f"c{s}"] for s in "fb"}
        out = np.empty(len(index), np.float32)
        for short in (False, True):
            chosen = np.flatnonzero((counts < WINDOW) == short)
            for i in range(0, len(chosen), 2048):
                own = chosen[i:i + 2048]
                inside = np.arange(WINDOW)[None, :] < counts[own, None] if short else None
                out[own] = self._forward(tables, index[own], inside)
        return out

    def _forward(self, tables, index, inside) -> np.ndarray:
        h, size = HIDDEN, len(index)
        states = np.empty((WINDOW, size, 2 * h), np.float32)
        for s, order, side in (("f", range(WINDOW), slice(0, h)), ("b", range(WINDOW - 1, -1, -1), slice(h, 2 * h))):
            u, table = self.p[f"u{s}"], tables[s]
            state = np.zeros((size, h), np.float32)
            for t in order:
                a, hu = table[index[:, t]], state @ u
                gates = _sigmoid(a[:, :2 * h] + hu[:, :2 * h])
                z = gates[:, :h]
                new = np.tanh(a[:, 2 * h:] + gates[:, h:] * hu[:, 2 * h:])
                new += z * (state - new)
                state = new if inside is None else np.where(inside[:, t, None], new, state)
                states[t, :, side] = state
        weight = states @ self.p["look"]
        if inside is not None:
            weight = np.where(inside.T, weight, -1e9)
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        return ((states @ self.p["out"]) * weight).sum(axis=0) + self.p["bias"]

    def gradients(self, features, index, counts, target, importance) -> dict[str, np.ndarray]:
        """Gradient of the weighted log loss of a batch, through time and attention."""
        p, h = self.p, HIDDEN
        used, local = np.unique(index, return_inverse=True)
        local = local.reshape(index.shape)
        word, gram, gram_at = features
        ends = np.append(gram_at, len(gram))
        lens = ends[used + 1] - ends[used]
        own_at = np.cumsum(lens) - lens
        own_gram = gram[np.repeat(ends[used] - own_at, lens) + np.arange(int(lens.sum()))]
        mine = (word[used], own_gram, own_at)
        vectors = self.vectors(mine)
        x = vectors[local]
        inside = (np.arange(WINDOW)[None, :] < counts[:, None])[:, :, None].astype(np.float32)
        states = np.empty((*index.shape, 2 * h), np.float32)
        kept = {}
        for s, order, side in (("f", range(WINDOW), slice(0, h)), ("b", range(WINDOW - 1, -1, -1), slice(h, 2 * h))):
            a = x @ p[f"x{s}"] + p[f"c{s}"]
            state = np.zeros((len(index), h), np.float32)
            for t in order:
                hu = state @ p[f"u{s}"]
                gates = _sigmoid(a[:, t, :2 * h] + hu[:, :2 * h])
                z, r = gates[:, :h], gates[:, h:]
                n = np.tanh(a[:, t, 2 * h:] + r * hu[:, 2 * h:])
                kept[s, t] = (state, hu[:, 2 * h:], z, r, n)
                state = inside[:, t] * ((1 - z) * n + z * state) + (1 - inside[:, t]) * state
                states[:, t, side] = state
        weight = np.where(inside[:, :, 0] > 0, states @ p["look"], -1e9)
        weight = np.exp(weight - weight.max(axis=1, keepdims=True))
        weight /= weight.sum(axis=1, keepdims=True)
        pooled = (states * weight[:, :, None]).sum(axis=1)
        d_logit = (_sigmoid(pooled @ p["out"] + p["bias"]) - target) * importance
        g = {"out": d_logit @ pooled, "bias": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["out"]
        d_weight = (states * d_pooled[:, None, :]).sum(axis=2)
        d_look = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
        g["look"] = (d_look[:, :, None] * states).sum(axis=(0, 1))
        d_states = weight[:, :, None] * d_pooled[:, None, :] + d_look[:, :, None] * p["look"]
        d_x = np.zeros_like(x)
        for s, order, side in (("f", range(WINDOW - 1, -1, -1), slice(0, h)), ("b", range(WINDOW), slice(h, 2 * h))):
            u, d_u = p[f"u{s}"], np.zeros_like(p[f"u{s}"])
            d_a = np.empty((*index.shape, 3 * h), np.float32)
            d_state = np.zeros((len(index), h), np.float32)
            for t in order:
                state, hu_n, z, r, n = kept[s, t]
                d_all = d_state + d_states[:, t, side]
                d_new = d_all * inside[:, t]
                d_n = d_new * (1 - z) * (1 - n * n)
                d_z = d_new * (state - n) * z * (1 - z)
                d_r = d_n * hu_n * r * (1 - r)
                d_hu = np.concatenate([d_z, d_r, d_n * r], axis=1)
                d_a[:, t] = np.concatenate([d_z, d_r, d_n], axis=1)
                d_u += state.T @ d_hu
                d_state = d_all * (1 - inside[:, t]) + d_new * z + d_hu @ u.T
            flat = d_a.reshape(-1, 3 * h)
            g[f"x{s}"] = x.reshape(len(flat), -1).T @ flat
            g[f"c{s}"], g[f"u{s}"] = flat.sum(axis=0), d_u
            d_x += d_a @ p[f"x{s}"].T
        d_vectors = np.zeros_like(vectors)
        np.add.at(d_vectors, local.ravel(), d_x.reshape(-1, d_x.shape[2]))
        g["words"], g["grams"] = np.zeros_like(p["words"]), np.zeros_like(p["grams"])
        np.add.at(g["words"], mine[0], d_vectors[:, :WORD_DIM])
        spread = d_vectors[:, WORD_DIM:] / np.sqrt(lens)[:, None].astype(np.float32)
        np.add.at(g["grams"], own_gram, np.repeat(spread, lens, axis=0))
        return g


class Adam:
    def __init__(self, p: dict[str, np.ndarray]):
        self.p, self.t = p, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, g: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        for k, d in g.items():
            d = d + DECAY * self.p[k] * (np.abs(d) > 0)
            self.m[k] += 0.1 * (d - self.m[k])
            self.v[k] += 0.01 * (d * d - self.v[k])
            self.p[k] -= rate * (self.m[k] / (1 - 0.9 ** self.t)) / (np.sqrt(self.v[k] / (1 - 0.99 ** self.t)) + 1e-7)


# ---------------------------------------------------------------- model


class Model:
    """Network and calibration of the highest window's logit; ``network`` is None if nothing could be learned."""

    def __init__(self, network: Network | None, slope: float = 1.0, shift: float = 0.0):
        self.network, self.slope, self.shift = network, slope, shift

    def highest(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Highest window logit of each row, -inf without words."""
        out = np.full(len(at) - 1, -np.inf)
        features, group, row_at = split(data, at)
        rows, starts, counts = windows_of(row_at)
        if features is not None:
            np.maximum.at(out, rows, self.network.score(features, Windows(group, starts), counts))
        return out

    def scores(self, column: pa.Array):
        """(first row, scores) in runs of rows with a bounded number of bytes."""
        data, at = C.text_bytes(column)
        for i, j in C.row_blocks(at, _BLOCK_BYTES):
            if self.network is None:
                yield i, np.zeros(j - i)
                continue
            top = self.highest(data[at[i]:at[j]], at[i:j + 1] - at[i])
            with np.errstate(over="ignore"):
                yield i, np.where(np.isfinite(top), 1 / (1 + np.exp(-(self.slope * np.where(np.isfinite(top), top, 0) + self.shift))), 0.0)


def _calibration(top: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton steps with a weak prior."""
    w = np.array([1.0, 0.0])
    x = np.stack([top, np.ones(len(top))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - target) + 0.05 * (w - [1.0, 0.0])
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        w -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def train(texts: list[str], toxic: np.ndarray) -> Model:
    """Fit on documents with 0/1 labels; every fifth is kept for the calibration."""
    if not len(texts) or toxic.min() == toxic.max():
        return Model(None)
    size = len(texts)
    features, group, row_at = split(*C.text_bytes(pa.array(texts, pa.large_string())))
    rows, starts, counts = windows_of(row_at)
    if features is None:
        return Model(None)
    index = Windows(group, starts)
    fold = np.arange(size) % 5 == 4
    rng = np.random.default_rng(11)
    network = Network()
    adam = Adam(network.p)
    learn = ~fold[rows]
    bad = learn & (toxic[rows] == 1)
    good = learn & (toxic[rows] == 0)
    score = np.zeros(len(rows))
    for epoch in range(FIRST_EPOCHS + LATER_EPOCHS):
        if epoch < FIRST_EPOCHS:
            positive = np.flatnonzero(bad)
        else:  # the highest window of each toxic document, and those near it
            score = network.score(features, index, counts)
            top = np.full(size, -np.inf)
            np.maximum.at(top, rows, score)
            positive = np.flatnonzero(bad & (score >= np.minimum(top[rows], np.maximum(top[rows] - 2.0, 1.0))))
        half = EPOCH_WINDOWS // 2
        positive = rng.permutation(positive)[:half]
        negative = np.flatnonzero(good)
        hard = negative[np.argsort(-score[negative], kind="stable")[:half // 3]] if epoch >= FIRST_EPOCHS else negative[:0]
        negative = np.concatenate([hard, rng.permutation(negative)[:half]])
        if not len(positive) or not len(negative):
            return Model(None)
        chosen = rng.permutation(np.concatenate([positive, negative]))
        weight = np.where(toxic[rows[chosen]] == 1, 0.5 * len(chosen) / len(positive), 0.5 * len(chosen) / len(negative)).astype(np.float32)
        for i in range(0, len(chosen), BATCH):
            own = chosen[i:i + BATCH]
            g = network.gradients(features, index[own], counts[own], toxic[rows[own]].astype(np.float32), weight[i:i + BATCH] / len(own))
            adam.step(g, RATE * (0.5 if epoch >= FIRST_EPOCHS + LATER_EPOCHS - 2 else 1))
    model = Model(network)
    top = np.full(size, -np.inf)
    np.maximum.at(top, rows, network.score(features, index, counts))
    own = fold & np.isfinite(top)
    if own.any() and toxic[own].min() != toxic[own].max():
        model.slope, model.shift = _calibration(top[own], toxic[own].astype(float))
    return model


def remainder(doc_id: str, n: int) -> Column:
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % n


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from (doc_id, text) and (doc_id, toxic); only documents whose crc32(doc_id) mod 4 is not 2."""
    marked = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marked = marked.filter(remainder("doc_id", 4) != 2)
    sizes = {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model(None)
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.when(F.col("toxic") == 1, SAMPLE_TOXIC / sizes[1]).otherwise(SAMPLE_CLEAN / sizes[0])
    chosen = marked.filter(share < rate)
    short = docs.select("doc_id", "text").filter(F.length("text").between(1, SAMPLE_CHARS))
    # The chosen labels are bounded by the sample size, so they go to the documents and not the other way round.
    found = short.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").collect()
    found.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.text))
    toxic, texts = np.array([r.toxic for r in found], np.int64), [r.text for r in found]
    del found
    return train(texts, toxic)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """The columns of ``docs`` with the score in ``out`` (a column of that name is replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size
    columns = [c for c in docs.columns if c != out]
    place = columns.index(text)

    def run(batches):
        for batch in batches:
            for first, values in shared.value.scores(batch.column(place)):
                part = batch.slice(first, len(values))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, pa.float64())], [*columns, out])

    kept = docs.select(*[f"`{c}`" for c in columns])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{schema}, `{out}` double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
