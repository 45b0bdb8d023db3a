"""Operator 5, substring deduplication by content-defined chunking.

A gear rolling hash over the last 32 bytes cuts texts where its top bits are zero, so that cuts
depend on the content alone and an insertion moves only the chunks around it. Chunks are
deduplicated by digest; neighbouring repeated chunks form one repeated passage, reported as a span
for each earlier text that it continues.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, only_wanted, query, read_table, spread_join, staged

ZERO_BITS = 4               # a cut every 16 bytes, before the least length applies: chunks of 30 bytes on average
LEAST, MOST = 16, 512       # bytes of a chunk
SPAN_BYTES = 100            # least size of a repeated passage, however many chunks and earlier texts it has


def gear_table() -> np.ndarray:
    """256 odd-mixed 32-bit values from a multiplicative rule."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


def cut_points(raw: bytes, table: np.ndarray) -> list[int]:
    """Ends of the chunks of ``raw``; the last is its length."""
    n = len(raw)
    h = table[np.frombuffer(raw, np.uint8)]
    for s in (1, 2, 4, 8, 16):      # the hash of 2 s bytes from two of s bytes
        if s < n:
            g = h.copy()
            g[s:] += h[:-s] << np.uint32(s)
            h = g
    ends, last = [], 0
    for c in (np.flatnonzero(h >> np.uint32(32 - ZERO_BITS) == 0) + 1).tolist():
        while c - last > MOST:
            last += MOST
            ends.append(last)
        if c - last >= LEAST:
            ends.append(c)
            last = c
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if n > last:
        ends.append(n)
    return ends


def chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, d1, d2) of every chunk of every text, in bytes of UTF-8; d1 and d2 are its digest of 128 bits."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        table, digest = gear_table(), xxhash.xxh3_128_digest
        for b in batches:
            ids, starts, lens, found, held = [], [], [], [], 0
            for i, t in zip(b["doc_id"], b["text"], strict=True):
                raw = t.encode("utf-8", "replace") if t else b""
                if not raw:
                    continue
                ends = cut_points(raw, table)
                at = [0, *ends[:-1]]
                ids += [i] * len(ends)
                starts += at
                lens += [e - a for a, e in zip(at, ends, strict=True)]
                found += [digest(raw[a:e]) for a, e in zip(at, ends, strict=True)]
                held += len(ends)
                if held > 200_000:
                    yield _frame(ids, starts, lens, found)
                    ids, starts, lens, found, held = [], [], [], [], 0
            yield _frame(ids, starts, lens, found)

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null and doc_id is not null")
    return rows.mapInPandas(cut, f"doc_id {kind}, start int, length int, d1 long, d2 long")


def _frame(ids, starts, lens, found) -> pd.DataFrame:
    both = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
    return pd.DataFrame({"doc_id": ids, "start": np.array(starts, np.int32), "length": np.array(lens, np.int32),
                         "d1": both[:, 0], "d2": both[:, 1]})


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, end, keep_doc_id, keep_start, n_chunks): every repeated span, with the place
    of the occurrence that stays, in bytes.

    Of equal chunks the one with the smallest (doc_id, start) stays. A passage is a run of
    repeated chunks that lie side by side, of at least SPAN_BYTES bytes, wherever their kept
    chunks are; its spans are the pieces that continue one earlier text, of any size. Null or
    empty texts and null ids have no spans; rows with the same id and text count as one
    document. Counts are summed before the shuffle, chunks that stand once are mostly kept from the join by a
    bit set, and a digest of very many chunks is dealt out over tasks.
    """
    parts = staged(chunks(bounded_batches(docs), doc_id, text), "chunks")
    first = staged(parts.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "start")).alias("keep"), F.count(F.lit(1)).alias("n"))
                   .where("n > 1").select("d1", "d2", "n", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.start").alias("keep_start")),
                   "repeated")
    likely = only_wanted(parts.withColumn("row", F.col("d1")), first.select(F.col("d1").alias("row"))).drop("row")
    again = (spread_join(likely, first, ["d1", "d2"], "inner").where("doc_id <> keep_doc_id or start <> keep_start")
             .drop("d1", "d2").repartition("doc_id").distinct())
    w = Window.partitionBy("doc_id").orderBy("start")
    apart = F.coalesce(F.lag("start").over(w) + F.lag("length").over(w) != F.col("start"), F.lit(True))
    follows = ((F.lag("keep_doc_id").over(w) == F.col("keep_doc_id"))
               & (F.lag("keep_start").over(w) + F.lag("length").over(w) == F.col("keep_start")))
    marked = again.withColumns({"apart": apart, "new": apart | ~F.coalesce(follows, F.lit(False))})
    runs = marked.withColumns({"passage": F.sum(F.col("apart").cast("long")).over(w), "run": F.sum(F.col("new").cast("long")).over(w)})
    spans = runs.groupBy("doc_id", "passage", "run").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("end"),
        F.first("keep_doc_id").alias("keep_doc_id"), F.min("keep_start").alias("keep_start"),
        F.count(F.lit(1)).alias("n_chunks"))
    whole = F.sum(F.col("end") - F.col("start")).over(Window.partitionBy("doc_id", "passage"))
    return (spans.withColumn("passage_bytes", whole).where(f"passage_bytes >= {SPAN_BYTES}")
            .select("doc_id", "start", "end", "keep_doc_id", "keep_start", "n_chunks"))


def remove_spans(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the bytes of ``spans`` in ``text``; broken characters at the cuts are dropped."""
    @F.pandas_udf("string")
    def without(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        out = []
        for t, c in zip(texts, cuts, strict=True):
            if t is not None and c is not None and len(c):
                raw, at, kept = t.encode("utf-8", "replace"), 0, []
                for s in sorted((x["start"], x["end"]) for x in c):
                    kept.append(raw[at:s[0]])
                    at = max(at, s[1])
                t = b"".join([*kept, raw[at:]]).decode("utf-8", "ignore")
            out.append(t)
        return pd.Series(out)

    cuts = spans.groupBy(F.col("doc_id").alias("__llm_id")).agg(F.collect_list(F.struct("start", "end")).alias("__llm_cuts"))
    joined = docs.join(cuts, F.col(f"`{doc_id}`") == F.col("__llm_id"), "left")
    return joined.select(*[(without(F.col(text), "__llm_cuts").alias(c) if c == text else F.col(f"`{c}`")) for c in docs.columns])


@query("op5_gear_chunks")
def op5_gear_chunks(spark, sf_dir):
    """Repeated spans of all documents, each with the document that keeps its text."""
    return repeated_spans(read_table(spark, sf_dir, "documents"))
