"""SentencePiece encoding and decoding with a max-plus parallel scan for giant documents.

The encoding of a text is the sequence of pieces with the greatest sum of piece scores (scores of the model file; a
character that no piece covers costs ``UNKNOWN`` and becomes its UTF-8 bytes). The model file at hand was made by pair
merging, so the library's own encoder may choose other pieces of the same vocabulary; decoding is the same.

Texts up to ``CHUNK`` characters are encoded in one go. Longer ones are cut into chunks. The only thing that crosses a cut
is a piece that begins before and ends behind it; the state is how many characters of the chunk that piece takes. A chunk
gives a matrix of the best scores from each entering to each leaving state. Matrices combine associatively (maximum of
sums); a prefix scan finds the best state at every cut, and then each chunk is traced back on its own between two known
states. No piece has a space behind another character, so the lattice has one node before each such space; the part between
the first and last of them in a chunk does not depend on the states and is computed once.

Null counts as empty text; an empty text has no ids. Decoding gives back every text exactly. Repeated rows and document
ids are kept apart by a row number, an empty table gives no rows, extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.llm import common as C
from reviewlens.llm import tokens

CHUNK = 1 << 16
UNKNOWN = -100_000.0
_NONE = -np.inf


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Vocabulary with spaces for the model's space marks: ``ids`` by piece, ``scores`` and ``pieces`` by id."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces: list[str | None] = [None] * n
        self.bytes = np.full(n, -1)
        self.scores = np.zeros(n)
        self.byte_id = np.full(256, -1)
        self.ids: dict[str, int] = {}
        for i in range(n):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:-1], 16)
                self.bytes[i], self.byte_id[value] = value, i
                self.scores[i] = 0.0 if 0x80 <= value < 0xC0 else UNKNOWN
            elif not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i)):
                self.pieces[i] = model.id_to_piece(i).replace("▁", " ")
                self.ids[self.pieces[i]] = i
                self.scores[i] = model.get_score(i)
        if (self.byte_id < 0).any():
            raise ValueError("the model needs a piece for every byte")
        if any(" " in p.lstrip(" ") for p in self.ids):
            raise ValueError("a piece has a space behind another character")
        self.longest = max(map(len, self.ids))
        # Every beginning of a piece: its id, or -1 if it is none itself.
        self.begun = {p[:k]: -1 for p in self.ids for k in range(1, len(p))} | self.ids
        self.score_list = self.scores.tolist()
        # UTF-8 bytes of all pieces end to end.
        raw = [bytes([b]) if b >= 0 else (p or "").encode() for b, p in zip(self.bytes.tolist(), self.pieces)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_len = np.array([len(r) for r in raw])
        self.raw_at = np.cumsum(self.raw_len) - self.raw_len

    def lattice(self, text: str, start: int, stop: int, begin_before: int) -> tuple[list[float], list[int]]:
        """Best scores of reaching start..stop from ``start``, and where the last piece begins.

        Pieces begin before ``begin_before``; places behind it are reached by pieces that cross it.
        """
        scores, back = [_NONE] * (stop - start + 1), [-1] * (stop - start + 1)
        scores[0] = 0.0
        get, value, longest, ids = self.begun.get, self.score_list, self.longest, self.ids
        for i in range(start, min(begin_before, stop)):
            here = scores[i - start]
            if here == _NONE:
                continue
            if text[i] not in ids:
                s = here + UNKNOWN
                if s > scores[i + 1 - start]:
                    scores[i + 1 - start], back[i + 1 - start] = s, i
            for j in range(i + 1, min(i + longest, stop) + 1):
                piece = get(text[i:j])
                if piece is None:  # no piece begins like this
                    break
                if piece >= 0:
                    s = here + value[piece]
                    if s > scores[j - start]:
                        scores[j - start], back[j - start] = s, i
        return scores, back

    def trace(self, text: str, start: int, stop: int, back: list[int]) -> list[int]:
        ids: list[list[int]] = []
        j = stop
        while j > start:
            i = back[j - start]
            piece = self.ids.get(text[i:j])
            ids.append([piece] if piece is not None else self.byte_id[list(text[i:j].encode())].tolist())
            j = i
        return [x for own in reversed(ids) for x in own]

    def best(self, text: str) -> list[int]:
        return self.trace(text, 0, len(text), self.lattice(text, 0, len(text), len(text))[1])

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """UTF-8 bytes of ids, with the leading space that encoding adds."""
        lens = self.raw_len[ids]
        stop = np.cumsum(lens)
        return self.raw[np.arange(stop[-1] if len(stop) else 0) + np.repeat(self.raw_at[ids] - (stop - lens), lens)]

    def decode(self, ids) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).tobytes().decode()


class PieceEncoder(tokens.WordEncoder):
    """Words are runs between spaces; a word is looked up with the spaces before it, all but one."""

    def __init__(self, path: str):
        self.vocabulary = Pieces(path)
        self.codes = {}
        self.pool = np.zeros(0, np.uint32)
        self.begin = np.zeros(1, np.int64)
        self.length = np.zeros(1, np.int64)  # nothing is appended to a row

    def _ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.vocabulary.best(" " + w.decode()) for w in words]
        lens = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for own in found for i in own), np.uint32, int(lens.sum())), lens

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, each with a space put before it; an empty one has none."""
        data, at = C.text_bytes(pa.array([t.rstrip(" ") for t in texts], pa.large_string()))
        hashes, row_at, begins, sizes = C.word_spans(data, at, spaces=b" ")
        # Spaces before a word, without the one that belongs to it (at the start of a row: the one put before the text).
        previous = np.empty(len(begins), np.int64)
        previous[1:] = begins[:-1] + sizes[:-1] + 1
        firsts = row_at[:-1][np.diff(row_at) > 0]
        previous[firsts] = at[:-1][np.diff(row_at) > 0]
        extra = begins - previous
        ids, ids_at = self.encode_spans(data, row_at, begins - extra, sizes + extra, hashes + extra.astype(np.uint64) * np.uint64(C._BASE))
        loose = [r for r, t in enumerate(texts) if t.endswith(" ")]
        if not loose:
            return ids, ids_at
        parts = [ids[ids_at[r]:ids_at[r + 1]] for r in range(len(texts))]
        for r in loose:
            n = len(texts[r]) - len(texts[r].rstrip(" ")) + (len(texts[r].rstrip(" ")) == 0)
            parts[r] = np.append(parts[r], np.array(self.vocabulary.best(" " * n), np.uint32))
        lens = [len(p) for p in parts]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


# ---------------------------------------------------------------- chunks of giant documents


def cuts(n: int, chunk: int) -> list[int]:
    """Ends of equal chunks of at most ``chunk`` characters."""
    k = -(-n // chunk)
    return [n * i // k for i in range(k + 1)]


def _nodes(text: str, lowest: int, highest: int) -> tuple[int, int]:
    """First and last place in the range before which every path has a node; (-1, -1) if there is none."""
    p = max(lowest, 1)
    while p <= highest and not (p < len(text) and text[p] == " " and text[p - 1] != " "):
        p = text.find(" ", p)
        if p < 0:
            return -1, -1
        if p <= highest and text[p - 1] == " ":
            p += 1
    if p > highest:
        return -1, -1
    q = highest
    while not (q < len(text) and text[q] == " " and text[q - 1] != " "):
        q -= 1
    return p, q


class Chunk:
    """``text`` is the chunk with the characters behind it that a crossing piece may take; ``size`` is the chunk alone."""

    def __init__(self, enc: PieceEncoder, text: str, size: int):
        self.enc, self.v, self.text, self.size = enc, enc.vocabulary, text, size
        self.states = self.v.longest
        self.first, self.last = _nodes(text, self.states - 1, size)

    def _middle(self) -> np.ndarray:
        if self.last == self.first:
            return np.zeros(0, np.uint32)
        return self.enc.encode_texts([self.text[self.first + 1:self.last]])[0]

    def matrix(self) -> np.ndarray:
        """Best scores, [entering state, leaving state]; a piece counts in the chunk where it begins."""
        out = np.full((self.states, self.states), _NONE)
        if self.first < 0:
            for s in range(min(self.states, self.size + 1)):
                scores, _ = self.v.lattice(self.text, s, len(self.text), self.size)
                own = scores[self.size - s:][:self.states]
                out[s, :len(own)] = own
            return out
        middle = float(self.v.scores[self._middle()].sum())
        tail, _ = self.v.lattice(self.text, self.last, len(self.text), self.size)
        leave = np.array(tail[self.size - self.last:][:self.states])
        for s in range(self.states):
            enter = self.v.lattice(self.text, s, self.first, self.first)[0][-1]
            out[s, :len(leave)] = enter + middle + leave
        return out

    def ids(self, enter: int, leave: int) -> list[int]:
        stop = self.size + leave
        if self.first < 0:
            _, back = self.v.lattice(self.text, enter, stop, self.size)
            return self.v.trace(self.text, enter, stop, back)
        _, back = self.v.lattice(self.text, enter, self.first, self.first)
        head = self.v.trace(self.text, enter, self.first, back)
        _, back = self.v.lattice(self.text, self.last, stop, self.size)
        return head + self._middle().tolist() + self.v.trace(self.text, self.last, stop, back)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product: chunk a, then chunk b."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def boundary_states(matrices: list[np.ndarray]) -> list[int]:
    """States at all cuts of the best path, 0 at both ends."""
    scan = list(matrices)  # inclusive prefix products, by doubling steps
    step = 1
    while step < len(scan):
        scan = [scan[i] if i < step else combine(scan[i - step], scan[i]) for i in range(len(scan))]
        step *= 2
    states = [0]
    for k in range(len(matrices) - 1, 0, -1):
        states.append(int((scan[k - 1][0] + matrices[k][:, states[-1]]).argmax()))
    return [0, *reversed(states)] if len(matrices) else [0]


# ---------------------------------------------------------------- Spark


_ENCODED = "row long, doc_id long, chunk long, ids array<int>, score double, n_chars long, same boolean"


def _encoded_batch(rows, doc_ids, chunks, ids, at, scores, n_chars, same):
    return pa.RecordBatch.from_arrays(
        [pa.array(rows, pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(chunks, pa.int64()),
         pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))), pa.array(scores, pa.float64()),
         pa.array(n_chars, pa.int64()), pa.array(same, pa.bool_())],
        ["row", "doc_id", "chunk", "ids", "score", "n_chars", "same"])


def encode(docs: DataFrame, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """(row, doc_id, chunk, ids, score, n_chars, same): the ids of each text, giant ones in several rows by chunk.

    ``same`` says that decoding the row's ids gave back its characters. The result is stored.
    """
    path = path or default_model()

    def whole(batches):
        enc = encoder(path)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            i = 0
            while i < len(texts):
                j, size, own = i, 0, []
                while j < len(texts) and len(texts[j]) <= chunk and size < 4 << 20:
                    size += len(texts[j])
                    j += 1
                if j > i:
                    own = texts[i:j]
                    ids, at = enc.encode_texts(own)
                    sums = np.concatenate([[0.0], np.cumsum(enc.vocabulary.scores[ids])])
                    raw = enc.vocabulary.decode_bytes(ids).tobytes()
                    ends = np.concatenate([[0], np.cumsum(enc.vocabulary.raw_len[ids])])[at].tolist()
                    yield _chunked(_encoded_batch(
                        [row + k for k in range(i, j)], doc_ids[i:j], [0] * (j - i), ids, at, sums[at[1:]] - sums[at[:-1]],
                        [len(t) for t in own], [t.encode() == raw[a + 1:b] for t, a, b in zip(own, ends, ends[1:])]), None)
                    i = j
                    continue
                text = " " + texts[i]
                ends = cuts(len(text), chunk)
                for k, (lo, hi) in enumerate(zip(ends, ends[1:])):
                    none = _encoded_batch([row + i], [doc_ids[i]], [k], np.zeros(0), [0, 0], [0.0], [hi - lo], [None])
                    yield _chunked(none, text[lo:hi + enc.vocabulary.longest - 1])
                i += 1
            row += len(texts)

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = C.saved(read.mapInArrow(whole, f"{_ENCODED}, piece string"), "pieces-whole")
    short = first.filter("piece is null").drop("piece")
    spread = C.saved(first.filter("piece is not null").select("row", "doc_id", "chunk", "n_chars", "piece")
                     .repartition(C.shuffle_parts(docs.sparkSession), "row", "chunk"), "pieces-chunks")

    def transfer(batches):
        enc = encoder(path)
        for batch in batches:
            for r, k, n, text in zip(*(batch.column(c).to_pylist() for c in ("row", "chunk", "n_chars", "piece"))):
                m = Chunk(enc, text, n).matrix()
                yield pa.RecordBatch.from_arrays([pa.array([r]), pa.array([k]), pa.array([m.ravel().tolist()])], ["row", "chunk", "m"])

    def scan(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk")
        side = int(len(frame["m"].iloc[0]) ** 0.5)
        states = boundary_states([np.array(m).reshape(side, side) for m in frame["m"]])
        return pd.DataFrame({"row": frame["row"], "chunk": frame["chunk"], "enter": states[:-1], "leave": states[1:]})

    def finish(batches):
        enc = encoder(path)
        names = ("row", "doc_id", "chunk", "n_chars", "piece", "enter", "leave")
        for batch in batches:
            for r, d, k, n, text, enter, leave in zip(*(batch.column(c).to_pylist() for c in names)):
                ids = np.array(Chunk(enc, text, n).ids(enter, leave), np.uint32)
                same = enc.vocabulary.decode(ids) == text[enter:n + leave]
                yield _encoded_batch([r], [d], [k], ids, [0, len(ids)], [float(enc.vocabulary.scores[ids].sum())],
                                     [n + leave - enter - (k == 0)], [same])

    matrices = spread.mapInArrow(transfer, "row long, chunk long, m array<double>")
    # One small matrix per chunk: a document's matrices are a few hundredths of its text.
    states = C.saved(matrices.groupBy("row").applyInPandas(scan, "row long, chunk long, enter long, leave long"), "pieces-states")
    traced = spread.join(states, ["row", "chunk"]).select("row", "doc_id", "chunk", "n_chars", "piece", "enter", "leave")
    return short.unionByName(traced.mapInArrow(finish, _ENCODED))


def _chunked(batch: pa.RecordBatch, piece: str | None) -> pa.RecordBatch:
    extra = pa.array([piece] * batch.num_rows, pa.string())
    return pa.RecordBatch.from_arrays([*batch.columns, extra], [*batch.schema.names, "piece"])


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(row, doc_id, chunk, text) of encoded rows; the chunks of a document in order give its text."""
    path = path or default_model()

    def run(batches):
        vocabulary = encoder(path).vocabulary
        for batch in batches:
            chunks = batch.column("chunk").to_pylist()
            texts = [vocabulary.decode(ids)[k == 0:] for ids, k in zip(batch.column("ids").to_pylist(), chunks)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("chunk"), pa.array(texts, pa.string())],
                                             ["row", "doc_id", "chunk", "text"])

    return encoded.select("row", "doc_id", "chunk", "ids").mapInArrow(run, "row long, doc_id long, chunk long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.groupBy("row").agg(
        F.min("doc_id").alias("doc_id"), F.sum("n_chars").alias("n_chars"), F.sum(F.size("ids")).cast("long").alias("n_tokens"),
        F.sum("score").alias("score"), F.count(F.lit(1)).alias("n_chunks"), F.min("same").alias("round_trip"),
    ).drop("row")
