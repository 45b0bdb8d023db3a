"""Operator 10, token counts from flat token files by a separator scan.

A flat file holds nothing but the ids of one document after the other, each closed by the
end-of-document id; there is no index. Files of any size are cut into byte ranges that are dealt out over
tasks; the positions of the separator in a block come from one vectorised comparison, and a prefix
scan over the blocks of a file stitches the documents that lie across blocks and numbers them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, query, read_table, shared_path, staged
from .op2_bpe import SPECIAL, Codec, vocabulary_path

END = SPECIAL["<|endoftext|>"]
BLOCK_TOKENS = 1 << 20          # ids read at once: 2 MB
TASK_BYTES = 64 << 20           # bytes of a task, on average
WRITE_ROWS = 100                # documents encoded before their ids are written


def _store(uri: str):
    """The file system of a URI or absolute path, and the path in it (local, HDFS, S3 and GCS)."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def write_flat(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", vocab: str | None = None) -> DataFrame:
    """Write the ids of every text, 16 bits each, little-endian, with END after each document, one file a
    task; returns ``(doc_id, file, ordinal)``: where each document is, its place counted from 0.

    The string of a special token inside a text is encoded as ordinary text, so END closes
    documents only. A null or empty text is a document of no tokens. A try of a task has a file of its
    own, and only those of tries that ended well are in the result, so lost executors leave
    files that nobody names.
    """
    vocab = vocab or vocabulary_path()

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, end = Codec.of(vocab).base, np.array([END], "<u2").tobytes()
        files, folder = _store(path)
        name, out, at = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.bin", None, 0
        try:
            for batch in batches:
                for lo in range(0, len(batch), WRITE_ROWS):
                    rows = batch.iloc[lo:lo + WRITE_ROWS]
                    if out is None:
                        files.create_dir(folder, recursive=True)
                        out = files.open_output_stream(f"{folder}/{name}")
                    for t in rows["text"]:
                        if t:
                            out.write(base.encode_to_numpy(t, disallowed_special=()).astype("<u2").tobytes())
                        out.write(end)
                    yield pd.DataFrame({"doc_id": rows["doc_id"], "file": name, "ordinal": np.arange(at, at + len(rows))})
                    at += len(rows)
        finally:
            if out is not None:
                out.close()

    rows = bounded_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return staged(rows.mapInPandas(write, f"doc_id {kind}, file string, ordinal long"), "places")


def flat_blocks(files: DataFrame, end: int, block_tokens: int) -> DataFrame:
    """``(file, block, lens, tail)`` for every block of ``files(path, length)``: the ids before each separator, and
    those after the last one. A task reads one byte range after the other, never a whole file."""
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, length, at in zip(batch["path"], batch["length"], batch["at"], strict=True):
                store, inner = _store(path)
                with store.open_input_file(inner) as f:
                    ids = np.frombuffer(f.read_at(int(min(2 * block_tokens, length - at)) // 2 * 2, int(at)), "<u2")
                ends = np.flatnonzero(ids == end)
                lens = np.diff(ends, prepend=-1) - 1
                tail = len(ids) - (int(ends[-1]) + 1 if len(ends) else 0)
                yield pd.DataFrame({"file": [path.rsplit("/", 1)[-1]], "block": [at // (2 * block_tokens)],
                                    "lens": [lens.astype(np.int64)], "tail": [tail]})

    total = files.agg(F.sum("length")).first()[0] or 0
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    step = 2 * block_tokens
    ranges = files.where("length > 1").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 2, F.lit(step).cast("long"))))
    return ranges.repartition(int(tasks), "path", "at").mapInPandas(scan, "file string, block long, lens array<long>, tail long")


def scan_flat(spark: SparkSession, path: str, end: int = END, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, n_tokens, closed) of every document in the flat files ``part-*`` of ``path``.

    ``ordinal`` counts the documents of a file from 0; the separator isn't counted. Tokens after
    the last separator of a file form a document with ``closed`` false. Empty files give no
    rows; an odd last byte is no token. The files are read once; what their blocks hold is staged.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "length")
    found = staged(flat_blocks(listed, end, block_tokens), "blocks")
    order = Window.partitionBy("file").orderBy("block")
    # the open document after a block is its tail, and what was open before it if it has no separator:
    # a running sum that starts again at every block with one. One small row a block is scanned
    scan = (found.select("file", "block", F.size("lens").cast("long").alias("n_ends"), "tail")
            .withColumn("segment", F.sum(F.when(F.col("n_ends") > 0, 1).otherwise(0)).over(order))
            .withColumn("open", F.sum("tail").over(Window.partitionBy("file", "segment").orderBy("block")))
            .withColumn("carried", F.coalesce(F.lag("open").over(order), F.lit(0)))
            .withColumn("before", F.sum("n_ends").over(order) - F.col("n_ends"))
            .withColumn("last", F.lead("block").over(order).isNull()))
    closed = found.select("file", "block", F.posexplode("lens").alias("k", "n")).join(
        scan.where("n_ends > 0").select("file", "block", "before", "carried"), ["file", "block"]).select(
        "file", (F.col("before") + F.col("k")).alias("ordinal"),
        (F.col("n") + F.when(F.col("k") == 0, F.col("carried")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("closed"))
    rest = scan.where("last and open > 0").select("file", (F.col("before") + F.col("n_ends")).alias("ordinal"),
                                                  F.col("open").alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest)


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocab: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, file, ordinal): ``docs`` written as flat files in the shared folder, then
    counted by the scan. Repeated rows are documents of their own, null ids ids like others; an empty table
    gives no rows. A document that the scan doesn't find, or finds without its end, is an error.
    """
    spark = docs.sparkSession
    path = shared_path(spark, "flat-tokens")
    places = write_flat(docs, path, doc_id, text, vocab)
    if places.isEmpty():
        return places.select("doc_id", F.lit(None).cast("long").alias("n_tokens"), "file", "ordinal")
    joined = places.join(scan_flat(spark, path), ["file", "ordinal"], "left")
    checked = F.when(F.coalesce("closed", F.lit(False)), F.col("n_tokens")).otherwise(
        F.raise_error(F.lit("flat files and table differ in their documents")))
    return joined.select("doc_id", checked.alias("n_tokens"), "file", "ordinal")


@query("op10_separator_scan")
def op10_separator_scan(spark, sf_dir):
    """Tokens of every document, counted in flat token files."""
    return count_tokens(read_table(spark, sf_dir, "documents"))
