"""Operator 9, benchmark decontamination by a BM25 index of the test items.

Test items are indexed by word, in units of at most UNIT_WORDS words; the weights of a unit are
divided by its score against itself, so 1 means that a passage holds all its words. Every passage
of every training text is a query. Units lie in blocks; the sum of the words' block maxima
bounds every score in the block, and only blocks whose bound reaches the threshold are scored
(block-max WAND, over all passages of a batch at once). Every unit above the threshold is
verified: the item's question and its answer must both be found near the passage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import bounded_batches, query, read_table

K1, B = 1.2, 0.75
THRESHOLD = 0.75            # share of a unit's own score that a passage must reach
UNIT_WORDS = 48
STRIDE = 48                 # a passage is two strides of words, so that every copied unit lies within one
QUESTION, ANSWER = 0.5, 0.5  # share of word trigrams (pairs or words in short answers) to be found
SHARD_ITEMS, SHARD_CHARS = 4_000, 8_000_000     # bound of one broadcast index
BLOCKS = 32                 # blocks of units in an index
BATCH_WORDS = 100_000

_words = re.compile(r"\w+").findall
_sentences = re.compile(r"[.?!\n]+").split


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of an item's question and of its answer: the last sentence is the answer if there are
    two or more, else the last quarter of the words."""
    parts = [w for w in (_words(s.lower()) for s in _sentences(text)) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - max(1, len(words) // 4)
    return words[:cut], words[cut:]


def grams(words: list[str], n: int = 3) -> set:
    n = min(n, len(words))
    return set(zip(*(words[k:] for k in range(n)), strict=False)) if n else set()


class Index:
    """Block-max inverted index of one shard of items; df and the mean length are those of all items."""

    def __init__(self, items: list[tuple], df: dict[str, int], n_units: int, mean_len: float):
        self.items = [(item_id, *question_answer(text or "")) for item_id, text in items]
        self.parts = [[(min(3, len(w)), grams(w)) for w in (q, a)] for _, q, a in self.items]
        self.longest = max((len(q) + len(a) for _, q, a in self.items), default=0)
        units = [(k, words[a:a + UNIT_WORDS]) for k, (_, q, ans) in enumerate(self.items)
                 for words in [q + ans] for a in range(0, len(words), UNIT_WORDS)]
        self.owner = np.array([k for k, _ in units], np.int64)
        self.vocab: dict[str, int] = {}
        rows = []
        for u, (_, words) in enumerate(units):
            w = {}
            for t in set(words):
                tf = words.count(t)
                idf = np.log(1 + (n_units - df[t] + 0.5) / (df[t] + 0.5))
                w[t] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_len))
            own = sum(w.values())
            rows += [(self.vocab.setdefault(t, len(self.vocab)), u, x / own) for t, x in w.items() if own > 0]
        rows.sort()
        self.unit = np.array([r[1] for r in rows], np.int64)
        self.weight = np.array([r[2] for r in rows], np.float32)
        self.first = np.searchsorted(np.array([r[0] for r in rows], np.int64), np.arange(len(self.vocab) + 1))
        self.span = max(1, -(-len(units) // BLOCKS))
        self.blockmax = np.zeros((len(self.vocab) + 1, -(-len(units) // self.span) if units else 0), np.float32)
        term = np.array([r[0] for r in rows], np.int64)
        if rows:
            np.maximum.at(self.blockmax, (term, self.unit // self.span), self.weight)

    def search(self, docs: list[np.ndarray]) -> list[tuple[int, int, int, float]]:
        """(document, first word of the passage, unit, score) of all units at the threshold or above."""
        cells = np.array([-(-len(d) // STRIDE) for d in docs])
        lens = np.array([len(d) for d in docs])
        ids = np.concatenate(docs)
        doc_of = np.repeat(np.arange(len(docs)), lens)
        place = np.arange(len(ids)) - np.repeat(np.cumsum(lens) - lens, lens)
        cell0 = np.cumsum(cells) - cells
        cell = cell0[doc_of] + place // STRIDE
        # passage c holds the words of the strides c and c + 1; each of its words counts once
        known = ids < len(self.vocab)
        late = known & (place >= STRIDE)
        pairs = np.sort(np.concatenate([cell[known], cell[late] - 1]) * len(self.blockmax)
                        + np.concatenate([ids[known], ids[late]]))
        if not len(pairs):
            return []
        pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
        passage, term = np.divmod(pairs, len(self.blockmax))
        edge = np.append(np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]])), len(passage))
        bound = np.add.reduceat(self.blockmax[term], edge[:-1], axis=0)
        hits = []
        for x in np.flatnonzero((bound >= THRESHOLD - 1e-3).any(axis=1)).tolist():
            terms, alive = term[edge[x]:edge[x + 1]], bound[x] >= THRESHOLD - 1e-3
            n = self.first[terms + 1] - self.first[terms]
            at = np.repeat(self.first[terms] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            at = at[alive[self.unit[at] // self.span]]
            score = np.bincount(self.unit[at], self.weight[at], minlength=len(self.owner))
            c = int(passage[edge[x]])
            d = int(np.searchsorted(cell0, c, "right")) - 1
            hits += [(d, (c - int(cell0[d])) * STRIDE, int(u), float(score[u])) for u in np.flatnonzero(score >= THRESHOLD - 1e-6)]
        return hits

    def near(self, words: list[str], at: int) -> dict[int, set]:
        """Word trigrams, pairs and words around the passage at word ``at``, as far as the longest item."""
        part = words[max(0, at - self.longest):at + 2 * STRIDE + self.longest]
        return {3: grams(part), 2: None, 1: None, 0: part}

    def verify(self, near: dict[int, set], item: int) -> tuple[float, float]:
        """Shares of the item's question and answer that are in ``near``."""
        out = []
        for k, wanted in self.parts[item]:
            if k and near[k] is None:
                near[k] = grams(near[0], k)
            out.append(len(wanted & near[k]) / len(wanted) if k else 1.0)
        return out[0], out[1]


def build_indexes(items: DataFrame, item_id: str, text: str) -> Iterator[Index]:
    """One index a shard, each of at most SHARD_ITEMS items and about SHARD_CHARS characters; word
    statistics are of all items. Shards come to the driver one after the other."""
    rows = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where("text is not null")

    @F.pandas_udf("array<string>")
    def unit_words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                q, a = question_answer(t)
                w = q + a
                out.append([x for k in range(0, len(w), UNIT_WORDS) for x in sorted(set(w[k:k + UNIT_WORDS]))])
            yield pd.Series(out)

    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("c")).first()
    if not total.n:
        return
    lens = rows.select(F.size(unit_words("text")).alias("k"))
    stat = lens.agg(F.sum(F.greatest(F.ceil(F.col("k") / UNIT_WORDS), F.lit(1))).alias("units"), F.sum("k").alias("k")).first()
    shards = int(max(-(-total.n // SHARD_ITEMS), -(-total.c // SHARD_CHARS), 1))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
    words = rows.select("shard", F.explode(unit_words("text")).alias("w"))
    df = words.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    for s in range(shards):
        mine = words.where(F.col("shard") == s).select("w").distinct().join(df, "w") if shards > 1 else df
        held = rows.where(F.col("shard") == s).select("item_id", "text").orderBy("item_id", "text").collect()
        if held:
            yield Index([tuple(r) for r in held], {r.w: r.df for r in mine.collect()}, int(stat.units),
                        max(1.0, stat.k / stat.units))


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
               item_text: str = "text") -> DataFrame:
    """Append ``leaks``: array<struct<item_id, first_word, score, question_overlap, answer_overlap>>, the best
    passage of each verified item, sorted by item.

    Null and empty texts have no leaks, null items match nothing, items without a word are
    left out; repeated rows get equal results; an input column named ``leaks`` is replaced.
    The documents aren't shuffled; the indexes are broadcast, each of bounded size.
    """
    hit = StructType([StructField("item_id", items.schema[item_id].dataType), StructField("first_word", LongType()),
                      *[StructField(n, DoubleType()) for n in ("score", "question_overlap", "answer_overlap")]])
    sc = bounded_batches(docs).sparkSession.sparkContext
    found = []
    for index in build_indexes(items, item_id, item_text):
        found.append(_leaks_udf(sc.broadcast(vars(index)), ArrayType(hit))(F.col(text)))
    none = F.array().cast(ArrayType(hit))
    keep = [F.col(f"`{c}`") for c in docs.columns if c != "leaks"]
    return docs.select(*keep, (F.array_sort(F.concat(*found)) if found else none).alias("leaks"))


def _leaks_udf(handle, kind: ArrayType):
    @F.pandas_udf(kind)
    def leaks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index.__new__(Index)
        vars(index).update(handle.value)
        for texts in batches:
            yield pd.Series(_search_texts(texts.tolist(), index), dtype=object)
    return leaks.asNondeterministic()


def _search_texts(texts: list, index: Index) -> list[list]:
    out: list[list] = [[] for _ in texts]
    unknown, get = len(index.vocab), index.vocab.get
    held: list[tuple[int, list[str], np.ndarray]] = []

    def flush():
        best: dict[tuple[int, int], tuple] = {}
        tried, near, place = set(), None, None
        for d, at, unit, score in index.search([h[2] for h in held]):
            item = int(index.owner[unit])
            if (d, at, item) in tried:
                continue
            tried.add((d, at, item))
            if place != (d, at):
                near, place = index.near(held[d][1], at), (d, at)
            q, a = index.verify(near, item)
            if q >= QUESTION and a >= ANSWER and score > best.get((d, item), (0, -1.0))[1]:
                best[d, item] = (at, score, q, a)
        for (d, item), (at, score, q, a) in best.items():
            out[held[d][0]].append((index.items[item][0], at, round(score, 6), q, a))
        held.clear()

    n = 0
    for k, t in enumerate(texts):
        words = _words(t.lower()) if t else []
        if words:
            held.append((k, words, np.array([get(w, unknown) for w in words], np.int64)))
            n += len(words)
        if n > BATCH_WORDS:
            flush()
            n = 0
    if held:
        flush()
    return out


@query("op9_bm25_blockmax")
def op9_bm25_blockmax(spark, sf_dir):
    """Pairs of a document and a benchmark item that it holds."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find_leaks(docs, read_table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("leak"))
    return out.select("doc_id", "leak.*")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that hold no benchmark item."""
    names = docs.columns
    out = find_leaks(docs.select(F.struct("*").alias("__llm_row"), "text"), read_table(spark, sf_dir, "benchmark"))
    return out.where(F.size("leaks") == 0).select(*[F.col("__llm_row").getField(c).alias(c) for c in names])
