"""Operator 1, quality rules by compression bands.

zstandard ratios (bytes before / bytes after) of the whole text and of fixed chunks are held
against a band that depends on the length: repetitive text compresses beyond the upper
limit, noise stays below the lower one. A map over rows: no shuffle, state bounded by one text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import WORD, bounded_batches, query, read_table

#: (bytes below, least ratio, greatest ratio): clean prose of four languages lies at
#: 0.25-0.9 below 64 bytes and rises to 2.5 at 32 KB; limits leave a margin of a fifth.
BANDS = [
    (64, 0.0, 1.4),
    (128, 0.6, 1.7),
    (256, 0.8, 2.2),
    (512, 1.1, 2.4),
    (1024, 1.2, 2.5),
    (2048, 1.25, 2.6),
    (4096, 1.3, 2.8),
    (8192, 1.35, 2.9),
    (32768, 1.35, 3.1),
    (1 << 62, 1.35, 3.5),
]
LEVEL = 3
CHUNK_BYTES = 1024
CHUNK_SHARE = 0.25      # share of the bytes that may lie in chunks outside their band
LEAST_WORDS = 50

SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, ratio double, bad_chunk_share double, kept boolean")


def band(n_bytes: int) -> tuple[float, float]:
    """(least, greatest) ratio for a text of that many bytes."""
    return next((lo, hi) for below, lo, hi in BANDS if n_bytes < below)


def repeat_words(words: list[str]) -> int:
    """Words inside 3-word windows that occur twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    m = len(seen)
    pair = np.unique(ids[:-1] * m + ids[1:], return_inverse=True)[1] if m >= 1 << 20 else ids[:-1] * m + ids[1:]
    tri = pair[:-1] * m + ids[2:]
    order = np.argsort(tri, kind="stable")
    s = tri[order]
    same = s[1:] == s[:-1]
    hit = np.zeros(n - 2, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    cover = np.zeros(n, bool)
    for k in range(3):
        cover[k:n - 2 + k] |= hit
    return int(cover.sum())


def dup_lines(text: str, has_word) -> int:
    """Lines with a word that equal an earlier line."""
    seen, n = set(), 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif has_word(line):
            seen.add(line)
    return n


def quality_rules(docs: DataFrame, text: str = "text", prefix: str = "q_") -> DataFrame:
    """Append the columns of ``SCHEMA``, each name after ``prefix``, to ``docs``.

    A null text counts as empty: zero words, ``base_failed``, not kept. The input's columns
    stay, but those that have the name of an appended one are replaced. Rows are judged
    alone, so repeated rows get equal verdicts; empty tables give empty results; long texts
    are judged whole.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    keep = [c for c in docs.columns if c not in {prefix + n for n in names}]
    out = bounded_batches(docs).withColumn("__llm_verdict", _judge_udf()(F.col(text)))
    return out.select(*[F.col(f"`{c}`") for c in keep], *[F.col("__llm_verdict." + n).alias(prefix + n) for n in names])


def _judge_udf():
    @F.pandas_udf(SCHEMA)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False).compress
        find, symbols = re.compile(WORD).findall, re.compile(r"[#*$%&|<>]").findall
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for texts in batches:
            yield pd.DataFrame([_judge_one(t or "", find, symbols, squeeze) for t in texts], columns=names)
    return judge.asNondeterministic()   # keeps the optimizer from evaluating it once per column


def _judge_one(text: str, find, symbols, squeeze) -> tuple:
    words = find(text)
    n = len(words)
    repeated = repeat_words(words)
    failed = n < LEAST_WORDS or 100 * repeated > 50 * n
    raw = text.encode("utf-8", "surrogatepass")
    ratio, share = 0.0, 0.0
    kept = not failed
    if raw:
        ratio = len(raw) / len(squeeze(raw))
        lo, hi = band(len(raw))
        bad = 0
        for k in range(0, len(raw), CHUNK_BYTES):
            part = raw[k:k + CHUNK_BYTES]
            c_lo, c_hi = band(len(part))
            bad += 0 if c_lo <= len(part) / len(squeeze(part)) <= c_hi else len(part)
        share = bad / len(raw)
        kept = kept and lo <= ratio <= hi and share <= CHUNK_SHARE
    return (n, sum(map(len, words)), len(symbols(text)), dup_lines(text, re.compile(WORD).search), repeated,
            failed, ratio, share, kept)


@query("op1_compression_bands")
def op1_compression_bands(spark, sf_dir):
    """Per document: word counts, base rule and verdict of the bands (no SQL for zstandard)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_rules(docs)
    return out.select("doc_id", *[F.col(c).alias(c[2:]) for c in out.columns if c.startswith("q_")])


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that pass, with the columns of ``docs``."""
    return quality_rules(docs, prefix="__llm_q_").where("__llm_q_kept").select(*[F.col(f"`{c}`") for c in docs.columns])
