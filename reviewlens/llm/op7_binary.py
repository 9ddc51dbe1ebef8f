"""Token-ID files: one shared zstandard dictionary, every document compressed on its own.

Format of a part, all numbers little-endian:

- ``part-NNNNN.dict`` is not stored per part; the folder has one ``dictionary.bin`` (may be empty).
- ``part-NNNNN.tok``: the zstandard frames of the documents, one after the other. A frame holds the ids of one document
  as unsigned integers of ``width`` bytes.
- ``part-NNNNN.idx``: magic, id width, number of documents, SHA-256 of the dictionary, then three arrays:
  document ids (int64), offsets of the frames (uint64, one more than documents), numbers of ids (uint64).

A reader that wants few documents reads the index and the byte ranges it needs, nothing else.

Null text counts as empty, so the document has its end id only; repeated document ids are kept, ordered by text; an empty
table writes no part and gives no rows; a null document id cannot be stored and raises an error. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.llm import common as C
from reviewlens.llm import tokens

MAGIC = b"TOKZ0001"
HEAD = "<8sHQ32s"
#: Bounds of the sample that the dictionary is trained on: documents, characters of each, bytes of the dictionary.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 1000, 4000, 32_768
LEVEL = 3


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _put(fs: pafs.FileSystem, path: str, chunks) -> None:
    """Write under a name of this attempt, then move: a second run of the task replaces the file with equal bytes."""
    task = TaskContext.get()
    own = f"{path}.{task.taskAttemptId() if task else 0}.tmp"
    with fs.open_output_stream(own) as out:
        for chunk in chunks:
            out.write(chunk)
    fs.move(own, path)


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> bytes:
    """Dictionary from the serialized ids of a bounded sample: short documents with the smallest hashes."""
    import zstandard

    short = docs.filter(F.length("text").between(1, SAMPLE_CHARS)).select("text", F.xxhash64("doc_id", "text").alias("h"))
    # Only hashes are compared between tasks; the texts up to the last of them follow (more only where hashes are equal).
    last = short.select("h").orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
    if last is None:
        return b""
    texts = [r.text for r in short.filter(F.col("h") <= last).select("text").limit(SAMPLE_DOCS).collect()]
    texts.sort()
    if not texts:
        return b""
    parts = []
    for _, ids, at in tokens.encoder(tokenizer, end_id).encode_column(pa.array(texts)):
        raw = ids.astype(f"<u{width}")
        parts += [raw[at[i]:at[i + 1]].tobytes() for i in range(len(at) - 1)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except zstandard.ZstdError:  # too little text to train on
        return b""


def write_documents(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1, width: int = 2) -> DataFrame:
    """Encode (doc_id, text) and write the files in ascending order of doc_id; returns (part, n_docs, n_ids).

    Ids have to fit ``width`` bytes. The work is done when the returned frame is used; it is already stored.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or tokens.default_tokenizer()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dictionary = train_dictionary(docs, tokenizer, end_id, width)
    digest = hashlib.sha256(dictionary).digest()
    fs, folder = _fs(path)
    fs.create_dir(folder)
    _put(fs, f"{folder}/dictionary.bin", [dictionary])

    def write(batches):
        import zstandard

        fs, folder = _fs(path)
        part = TaskContext.get().partitionId()
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=True)
        enc = tokens.encoder(tokenizer, end_id)
        doc_ids, sizes, counts = [], [], []

        def frames():
            for batch in batches:
                if batch.column(0).null_count:
                    raise ValueError("doc_id must not be null")
                doc_ids.append(batch.column(0).to_numpy(zero_copy_only=False))
                for _, ids, at in enc.encode_column(batch.column(1)):
                    if len(ids) and int(ids.max()) >> (8 * width):
                        raise ValueError(f"an id does not fit {width} bytes")
                    raw = ids.astype(f"<u{width}")
                    for i in range(len(at) - 1):
                        frame = pack.compress(raw[at[i]:at[i + 1]].tobytes())
                        sizes.append(len(frame))
                        counts.append(int(at[i + 1] - at[i]))
                        yield frame

        name = f"{folder}/part-{part:05d}"
        _put(fs, f"{name}.tok", frames())
        n = len(counts)
        if not n:
            fs.delete_file(f"{name}.tok")
            return
        offsets = np.concatenate([[0], np.cumsum(np.array(sizes, np.uint64))]).astype("<u8")
        _put(fs, f"{name}.idx", [struct.pack(HEAD, MAGIC, width, n, digest), np.concatenate(doc_ids).astype("<i8").tobytes(),
                                 offsets.tobytes(), np.array(counts, "<u8").tobytes()])
        yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [n], "n_ids": [sum(counts)]})

    ordered = docs.repartitionByRange(C.shuffle_parts(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    written = ordered.mapInArrow(write, "part long, n_docs long, n_ids long")
    return C.saved(written, "token-parts")


class PartReader:
    """Documents of one part by their place: ``ids(i)`` reads one byte range."""

    def __init__(self, path: str, part: int):
        import zstandard

        self.fs, folder = _fs(path)
        name = f"{folder}/part-{part:05d}"
        with self.fs.open_input_stream(f"{folder}/dictionary.bin") as f:
            dictionary = f.read()
        with self.fs.open_input_stream(f"{name}.idx") as f:
            raw = f.read()
        magic, self.width, self.n, digest = struct.unpack_from(HEAD, raw)
        if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{name}.idx was not written with this dictionary")
        at = struct.calcsize(HEAD)
        self.doc_ids = np.frombuffer(raw, "<i8", self.n, at)
        self.offsets = np.frombuffer(raw, "<u8", self.n + 1, at + 8 * self.n).astype(np.int64)
        self.counts = np.frombuffer(raw, "<u8", self.n, at + 16 * self.n + 8).astype(np.int64)
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self._unpack = zstandard.ZstdDecompressor(dict_data=known)
        self._file = self.fs.open_input_file(f"{name}.tok")

    def _ids(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self._unpack.decompress(frame), f"<u{self.width}").astype("<u4")

    def ids(self, i: int) -> np.ndarray:
        self._file.seek(int(self.offsets[i]))
        return self._ids(self._file.read(int(self.offsets[i + 1] - self.offsets[i])))

    def __iter__(self):
        """All documents in order; frames are read in runs of a few MB."""
        i = 0
        for i, j in C.row_blocks(self.offsets, 4 << 20):
            self._file.seek(int(self.offsets[i]))
            raw = self._file.read(int(self.offsets[j] - self.offsets[i]))
            for k in range(i, j):
                yield self._ids(raw[self.offsets[k] - self.offsets[i]:self.offsets[k + 1] - self.offsets[i]])


def read_documents(parts: DataFrame, path: str) -> DataFrame:
    """(part, doc_id, local_start, n_tokens, ids_crc32) of every document, read back from the files of ``parts``."""
    spark = parts.sparkSession

    def read(batches):
        for batch in batches:
            for part in batch.column(0).to_pylist():
                reader = PartReader(path, part)
                counts, sums = [], []
                for ids in reader:
                    counts.append(len(ids))
                    sums.append(zlib.crc32(ids.tobytes()))
                n = np.array(counts, np.int64)
                if not np.array_equal(n, reader.counts):
                    raise ValueError(f"part {part}: the index and the frames do not agree")
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(np.full(len(n), part)), "doc_id": pa.array(reader.doc_ids.astype(np.int64)),
                    "local_start": pa.array(np.cumsum(n) - n), "n_tokens": pa.array(n), "ids_crc32": pa.array(sums, pa.int64()),
                })

    spread = parts.select("part").repartition(C.shuffle_parts(spark), "part")
    return spread.mapInArrow(read, "part long, doc_id long, local_start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = C.new_path(spark, "token-files")
    parts = write_documents(docs, path)
    base = C.number_parts(parts, "part", "n_ids").select("part", "base")
    # One row for each file. Without the hint Spark takes the documents read back, whose number it cannot know, for the small side.
    rows = read_documents(parts, path).join(F.broadcast(base), "part")
    return rows.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
