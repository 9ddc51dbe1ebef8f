"""Token counts of documents in flat token files, found by scanning for the end-of-document id.

The files have no index: ids of fixed width, every document closed by its end id. A file is read in blocks of a fixed
number of bytes, each by its own task: one vectorised comparison finds the end ids of a block. A document may begin in an
earlier block, so its start comes from a running maximum of end positions over the blocks before (a prefix scan over one
row per block), as does the ordinal of a block's first document.

Ids after the last end id of a file form one unfinished document (``complete`` false). Empty files give no rows. Null
and empty texts give documents without ids (count 0); repeated rows count each on their own; a null document id is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlens.llm import common as C
from reviewlens.llm import op7_binary, tokens

END_ID, WIDTH, BLOCK_BYTES = 49407, 2, 8 << 20


def write_flat(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, width: int = WIDTH) -> DataFrame:
    """Encode (doc_id, text) as the rows come into ``part-NNNNN.bin``; returns (file, ordinal, doc_id), stored.

    Nothing is shuffled: each task writes the file of its own rows. The end id's name in a text is ordinary text, so only true ends carry the id.
    """
    tokenizer = tokenizer or tokens.default_tokenizer()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    fs, folder = op7_binary._fs(path)
    fs.create_dir(folder)

    def write(batches):
        fs, folder = op7_binary._fs(path)
        name = f"part-{TaskContext.get().partitionId():05d}.bin"
        enc = tokens.encoder(tokenizer, end_id, True)
        doc_ids = []

        def chunks():
            for batch in batches:
                doc_ids.append(batch.column(0))
                for _, ids, _ in enc.encode_column(batch.column(1)):
                    yield ids.astype(f"<u{width}").tobytes()

        op7_binary._put(fs, f"{folder}/{name}", chunks())
        n = 0
        for column in doc_ids:
            yield pa.RecordBatch.from_pydict({"file": pa.array([name] * len(column)),
                                              "ordinal": pa.array(np.arange(n, n + len(column))), "doc_id": column})
            n += len(column)

    return C.saved(docs.mapInArrow(write, "file string, ordinal long, doc_id long"), "flat-rows")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, n_bytes) of the flat files in a folder."""
    import pyarrow.fs as pafs

    fs, folder = op7_binary._fs(path)
    found = [(f.base_name, f.size) for f in fs.get_file_info(pafs.FileSelector(folder)) if f.base_name.endswith(".bin")]
    return spark.createDataFrame(sorted(found), "file string, n_bytes long")


def count_tokens(files: DataFrame, path: str, end_id: int = END_ID, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, ordinal, start, n_tokens, complete) of each document; the end id counts in ``start`` but not in ``n_tokens``."""
    spark = files.sparkSession
    per_block = block_bytes // width

    def scan(batches):
        fs, folder = op7_binary._fs(path)
        for batch in batches:
            for file, block, n_ids in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "n_ids"))):
                begin = block * per_block
                with fs.open_input_file(f"{folder}/{file}") as f:
                    f.seek(begin * width)
                    ids = np.frombuffer(f.read(min(per_block, n_ids - begin) * width), f"<u{width}")
                ends = np.flatnonzero(ids == end_id) + begin
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([block]), pa.array([n_ids]), pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), pa.array(ends))],
                    ["file", "block", "n_ids", "ends"])

    sized = files.withColumn("n_ids", F.expr(f"n_bytes div {width}")).filter("n_ids > 0")
    blocks = sized.select("file", "n_ids", F.explode(F.expr(f"sequence(0L, (n_ids - 1) div {per_block}L)")).alias("block"))
    spread = blocks.repartition(C.shuffle_parts(spark), "file", "block")
    scanned = C.saved(spread.mapInArrow(scan, "file string, block long, n_ids long, ends array<long>"), "ends")

    ordered = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summary = scanned.select("file", "block", "n_ids", F.size("ends").alias("n"), F.expr("try_element_at(ends, -1)").alias("last"))
    carried = summary.select("file", "block", F.coalesce(F.sum("n").over(ordered), F.lit(0)).alias("first"),
                             (F.coalesce(F.max("last").over(ordered), F.lit(-1)) + 1).alias("open"))
    closed = scanned.filter(F.size("ends") > 0).join(carried, ["file", "block"]).select(
        "file", "first", F.posexplode(F.expr(
            "zip_with(concat(array(open), transform(slice(ends, 1, size(ends) - 1), e -> e + 1)), ends,"
            " (a, b) -> named_struct('start', a, 'stop', b))"))
    ).select("file", (F.col("first") + F.col("pos")).alias("ordinal"), F.col("col.start").alias("start"),
             (F.col("col.stop") - F.col("col.start")).alias("n_tokens"), F.lit(True).alias("complete"))
    per_file = summary.groupBy("file").agg(F.max("n_ids").alias("n_ids"), F.sum("n").alias("ordinal"),
                                           (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"))
    unfinished = per_file.filter("n_ids > start").select(
        "file", "ordinal", "start", (F.col("n_ids") - F.col("start")).alias("n_tokens"), F.lit(False).alias("complete"))
    return closed.unionByName(unfinished)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = C.new_path(spark, "flat-files")
    rows = write_flat(docs, path)
    counts = count_tokens(list_files(spark, path), path)
    return rows.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens", "complete")
