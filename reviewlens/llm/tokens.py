"""Word-wise encoding with the tokenizers library, and Spark tables of encoded documents.

The tokenizer's pre-tokenizer never lets a token cross white space and its normalizer never joins characters across a
space, so the ids of a text are the ids of its white-space separated words, one after the other. Each worker process
keeps the ids of words it has met (``MEMO_WORDS`` of them, a bound on memory; words beyond it are encoded each time).
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa

from reviewlens.llm import common as C

MEMO_WORDS = 600_000
#: A control character that stands between words of one call; words that contain it are encoded alone.
_MARK = "\x01"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Encodes rows of UTF-8 bytes; ``end_id`` is appended to each row.

    ``special_as_text``: the names of special tokens inside a text are ordinary text, so no id of theirs can come from it.
    """

    def __init__(self, path: str, end_id: int, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        marks = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        if len(marks) != 1:
            raise ValueError("the tokenizer needs one id for the mark between words")
        self.mark = marks[0]
        self.codes: dict[bytes, int] = {}
        self.pool = np.array([end_id], np.uint32)
        self.begin = np.zeros(1, np.int64)
        self.length = np.ones(1, np.int64)

    def _ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words end to end and their numbers. Many words go through one call, with a mark between them."""
        texts = [w.decode() for w in words]
        plain = [i for i, t in enumerate(texts) if _MARK not in t]
        lens = np.zeros(len(texts), np.int64)
        parts: list[np.ndarray | None] = [None] * len(texts)
        if len(plain) < len(texts):
            for i in set(range(len(texts))) - set(plain):
                parts[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
                lens[i] = len(parts[i])
        runs = [plain[i:i + 500] for i in range(0, len(plain), 500)]
        joined = [f" {_MARK} ".join([texts[i] for i in run]) for run in runs]
        for run, found in zip(runs, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(found.ids, np.uint32)
            marks = np.flatnonzero(ids == self.mark)
            lens[run] = np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1
            if len(plain) == len(texts):
                parts[run[0]] = ids[ids != self.mark]
            else:
                for i, own in zip(run, np.split(ids[ids != self.mark], np.cumsum(lens[run])[:-1])):
                    parts[i] = own
        return np.concatenate([p for p in parts if p is not None]), lens

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes of new words and the id tables with them; only words within the bound stay known."""
        flat, lens = self._ids(words)
        begin = len(self.pool) + np.cumsum(lens) - lens
        first = len(self.begin)
        pool, begins, lengths = np.append(self.pool, flat), np.append(self.begin, begin), np.append(self.length, lens)
        room = MEMO_WORDS - len(self.codes)
        if room > 0:
            stay = words[:room]
            self.codes.update(zip(stay, range(first, first + len(stay))))
            self.begin, self.length = begins[:first + len(stay)], lengths[:first + len(stay)]
            self.pool = pool[:len(self.pool) + int(lens[:len(stay)].sum())]
        return np.arange(first, first + len(words)), pool, begins, lengths

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end (uint32), and the n + 1 places where rows begin."""
        hashes, row_at, begins, sizes = C.word_spans(data, at)
        return self.encode_spans(data, row_at, begins, sizes, hashes)

    def encode_spans(self, data: np.ndarray, row_at: np.ndarray, begins: np.ndarray, sizes: np.ndarray, hashes: np.ndarray):
        """Ids of rows of words that are given by first byte, number of bytes and hash.

        Words are grouped by hash and length, each different one is looked up once by its bytes.
        """
        _, first, group = np.unique(hashes + sizes.astype(np.uint64) * np.uint64(C._BASE), return_index=True, return_inverse=True)
        raw = data.tobytes()
        words = [raw[b:e] for b, e in zip(begins[first].tolist(), (begins[first] + sizes[first]).tolist())]
        known = np.fromiter(map(self.codes.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(known < 0)
        pool, begin, length = self.pool, self.begin, self.length
        if len(missing):
            known[missing], pool, begin, length = self._learn([words[i] for i in missing.tolist()])
        # The end of a row is one more "word", of code 0.
        n = len(row_at) - 1
        codes = np.zeros(len(hashes) + n, np.int64)
        is_word = np.ones(len(codes), bool)
        ends = row_at[1:] + np.arange(n)
        is_word[ends] = False
        codes[is_word] = known[group]
        lens = length[codes]
        stop = np.cumsum(lens)
        ids = pool[np.arange(stop[-1] if n else 0) + np.repeat(begin[codes] - (stop - lens), lens)]
        return ids, np.concatenate([[0], stop[ends]]).astype(np.int64)

    def encode_column(self, column: pa.Array, limit: int = 4 << 20):
        """(first row, ids, places) for runs of rows of bounded size; a longer row is read in pieces cut at white space."""
        data, at = C.text_bytes(column)
        for i, j in C.row_blocks(at, limit):
            if at[j] - at[i] <= 2 * limit:
                yield i, *self.encode(data[at[i]:at[j]], at[i:j + 1] - at[i])
                continue
            pieces, lo, stop = [], int(at[i]), int(at[j])
            while lo < stop:
                hi = min(stop, lo + limit)
                while hi < stop:  # on to the next white space
                    gap = np.flatnonzero(~C._IS_WORD[data[hi:hi + 4096]])
                    hi = min(stop, hi + (int(gap[0]) if len(gap) else 4096))
                    if len(gap):
                        break
                ids, places = self.encode(data[lo:hi], np.array([0, hi - lo]))
                pieces.append(ids if hi == stop else ids[:-1])
                lo = hi
            ids = np.concatenate(pieces)
            yield i, ids, np.array([0, len(ids)])


@lru_cache(maxsize=4)
def encoder(path: str, end_id: int, special_as_text: bool = False) -> WordEncoder:
    """One encoder per worker process and setting, so that known words serve all its tasks."""
    return WordEncoder(path, end_id, special_as_text)
