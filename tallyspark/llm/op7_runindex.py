"""Operator 7, removal of repeated byte strings with a run-compressed Burrows-Wheeler index.

Every string of LENGTH bytes belongs to the least hash of the GRAM-byte grams in it (its minimizer), so
equal strings belong to the same minimizer wherever they are. Neighbouring strings of one
minimizer form a piece of text; equal pieces are counted before any text moves. Only where
pieces of one minimizer differ does text go to an index: the Burrows-Wheeler transform of the
distinct pieces, kept as runs with the text positions and common prefixes at the run ends.
Matching statistics are streamed from those samples, since between run ends a match gets one
byte shorter with each byte, and every match of LENGTH bytes or more is marked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import query, read_table, staged

LENGTH = 200                # bytes of a string that counts as repeated
GRAM = 32                   # bytes of the grams whose least hash is the minimizer
MOST_STRINGS = 512          # longest piece, in strings; longer stretches are cut (periodic texts)
INDEX_BYTES = 1 << 20       # text of one index, on average
HOT_PIECES = 4096           # distinct pieces of a minimizer beyond which its strings are compared by hash


# ---- pieces --------------------------------------------------------------------------

def pieces_of(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(first string, number of strings, minimizer, self_repeat) of the pieces of a text; self_repeat
    tells that the minimizer occurs twice in a piece, so that it may repeat a string itself."""
    n = len(raw) - length + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, bool))
    mult = np.uint64(0x9E3779B97F4A7C15)
    h = (np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    base, s = int(mult), 1
    while s < gram:             # hash of 2 s bytes from two of s bytes; gram is a power of two
        h = h[:-s] * np.uint64(base) + h[s:]
        base, s = base * base % (1 << 64), 2 * s
    h = (h ^ (h >> np.uint64(32))) * mult
    h ^= h >> np.uint64(29)
    width, low, s = length - gram + 1, h, 1
    while 2 * s <= width:       # least of s hashes, doubled up to the width
        low = np.minimum(low[:-s], low[s:])
        s *= 2
    if s < width:
        low = np.minimum(low[:len(low) - (width - s)], low[width - s:])
    change = np.flatnonzero(low[1:] != low[:-1]) + 1
    first = np.concatenate([[0], change])
    count = np.diff(np.append(first, n))
    if count.max() > MOST_STRINGS:
        cut = [np.arange(a, a + c, MOST_STRINGS) for a, c in zip(first.tolist(), count.tolist(), strict=True)]
        first = np.concatenate(cut)
        count = np.diff(np.append(first, n))
    f = low[first]
    # a minimizer that occurs twice among the grams of its piece
    repeat = np.zeros(len(first), bool)
    hs = np.sort(h)
    dup = hs[1:][hs[1:] == hs[:-1]]
    if len(dup):
        last = first + count - 1 + width
        for k in np.flatnonzero((count > 1) & np.isin(f, dup)).tolist():
            repeat[k] = np.count_nonzero(h[first[k]:last[k]] == f[k]) > 1
    return first, count, f, repeat


def piece_table(rows: DataFrame) -> DataFrame:
    """(key, first, strings, f, h, self_repeat) of all pieces of ``rows(key, text)``; h is the digest
    of a piece's text."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            held, n = [], 0
            for key, text in zip(b["key"], b["text"], strict=True):
                raw = text.encode("utf-8", "replace")
                first, count, f, repeat = pieces_of(raw)
                if len(first):
                    ends = (first + count + LENGTH - 1).tolist()
                    h = [digest(raw[a:e]) for a, e in zip(first.tolist(), ends, strict=True)]
                    held.append((np.full(len(first), key), first, count, f.view(np.int64),
                                 np.array(h, np.uint64).view(np.int64), repeat))
                    n += len(first)
                if n > 100_000:
                    yield _piece_frame(held)
                    held, n = [], 0
            yield _piece_frame(held)

    return (rows.where(f"octet_length(text) >= {LENGTH}")
            .mapInPandas(cut, "key long, first int, strings int, f long, h long, self_repeat boolean"))


def _piece_frame(held: list) -> pd.DataFrame:
    names = ["key", "first", "strings", "f", "h", "self_repeat"]
    cols = [np.concatenate(c) for c in zip(*held, strict=True)] if held else [[]] * 6
    kinds = ["int64", "int32", "int32", "int64", "int64", "bool"]
    return pd.DataFrame({n: np.asarray(c, k) for n, c, k in zip(names, cols, kinds, strict=True)})


# ---- the index -----------------------------------------------------------------------

class RunIndex:
    """Run-compressed Burrows-Wheeler transform of some texts, with samples at the run ends."""

    def __init__(self, texts: list[bytes]):
        m = len(texts)
        lens = np.fromiter(map(len, texts), np.int64, m)
        self.starts = np.cumsum(lens + 1) - lens - 1
        n = int(lens.sum()) + m
        sym = np.zeros(n, np.int64)
        body = np.ones(n, bool)
        body[self.starts + lens] = False
        sym[body] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + m
        sym[self.starts + lens] = np.arange(m)      # closing symbols, all different
        codes, order = _suffix_order(sym, m + 256)
        bwt = sym[order - 1]                        # symbol before each suffix, in sorted order
        edge = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1
        self.heads = np.concatenate([[0], edge])    # runs: first places and symbols
        self.symbols = bwt[self.heads]
        self.n = n
        # samples: text positions at the first and last place of each run, and the common prefix
        # with the suffix before the first and after the last
        above, below = order[edge - 1], order[edge]
        common = _common_prefix(codes, above, below)
        self.first_pos, self.first_lcp = below, common
        self.last_pos, self.last_lcp = above, common

    def matching_statistics(self) -> np.ndarray:
        """For every position, the length of the longest match with another position."""
        best = np.zeros(self.n, np.int64)
        for pos, lcp in ((self.first_pos, self.first_lcp), (self.last_pos, self.last_lcp)):
            reach = np.zeros(self.n, np.int64)
            np.maximum.at(reach, pos, pos + lcp)
            np.maximum(best, np.maximum.accumulate(reach) - np.arange(self.n), out=best)
        return best


def _suffix_order(sym: np.ndarray, top: int) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """Codes of the first 1, 2, 4, ... symbols of all suffixes, equal where those are equal, and the
    suffixes in order. Symbols are below ``top``. Only suffixes not yet told apart are sorted again."""
    n = len(sym)
    codes, k, packed = [(1, sym)], 1, sym
    while k < 4 and top ** (2 * k) < 1 << 62:       # so many symbols fit one number
        wide = packed * top ** k
        wide[:n - k] += packed[k:]
        packed, k = wide, 2 * k
        codes.append((k, packed))
    order = np.argsort(packed)
    s = packed[order]
    head = np.concatenate([[True], s[1:] != s[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = _group_start(head)
    codes[-1] = (k, rank.astype(np.int32))
    while True:
        tied = np.flatnonzero(~(head & np.append(head[1:], True)))     # places of groups of two and more
        if not len(tied):
            return codes, order
        who = order[tied]
        follow = np.where(who + k < n, rank[np.minimum(who + k, n - 1)] + 1, 0)
        old = rank[who]
        key = old * (n + 1) + follow
        by = np.argsort(key)
        who, key, old = who[by], key[by], old[by]
        order[tied] = who           # groups keep their places, as the key begins with the old rank
        head[tied] = np.concatenate([[True], key[1:] != key[:-1]])
        rank = rank.copy()
        rank[who] = _group_start(head)[tied]
        k *= 2
        codes.append((k, rank.astype(np.int32)))


def _group_start(head: np.ndarray) -> np.ndarray:
    """For every place, the first place of its group; ``head`` marks first places."""
    return np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))


def _common_prefix(codes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes at ``a`` and ``b``, which are all different."""
    a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    n = len(codes[0][1])
    for k, code in reversed(codes):
        inside = (a < n) & (b < n)
        step = np.zeros(len(a), np.int64)
        step[inside] = np.where(code[a[inside]] == code[b[inside]], k, 0)
        a, b, out = a + step, b + step, out + step
    return out


def marked_strings(texts: list[bytes], wanted: list[bool], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each wanted text the stretches [first, last + 1) of its strings of ``length`` bytes that occur
    elsewhere in the texts."""
    index = RunIndex(texts)
    hit = index.matching_statistics() >= length
    out = []
    for k, t in enumerate(texts):
        part = hit[index.starts[k]:index.starts[k] + len(t)]
        step = np.flatnonzero(np.diff(np.concatenate([[0], part.view(np.int8), [0]])))
        out.append(list(zip(step[::2].tolist(), step[1::2].tolist(), strict=True)) if wanted[k] else [])
    return out


# ---- the operator --------------------------------------------------------------------

def repeated_strings(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, with ``n_bytes``, ``n_removed``, ``n_spans`` (long), ``removed``
    (array<struct<start:int,end:int>>, in bytes of UTF-8) and ``kept_sha256``.

    A byte is removed if a string of LENGTH bytes over it also starts anywhere else, in the same or
    another row; so repeated rows of LENGTH bytes or more lose all. A null or shorter text
    loses nothing. Input columns of the appended names are replaced. Equal pieces are summed
    before the shuffle, and no join collects the pieces of one minimizer in a task.
    """
    new = ["n_bytes", "n_removed", "n_spans", "removed", "kept_sha256"]
    spark = docs.sparkSession
    rest = [c for c in docs.columns if c not in new and c != text]
    # rows with the same content share a key; how many there are counts below
    content = F.xxhash64(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(text).alias("text"), content.alias("key"))
    pieces = piece_table(keyed.select("key", "text"))
    per_f = (pieces.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("h0"), F.max("h").alias("h1"),
                                     F.max("self_repeat").alias("self_repeat"))
             .where("n > 1 or self_repeat")
             .select("f", (F.col("self_repeat") | (F.col("h0") != F.col("h1"))).alias("mixed")))
    # pieces whose minimizer recurs, with the number of equal pieces
    again = pieces.drop("self_repeat").join(per_f, "f")
    hits = staged(again.groupBy("key").agg(F.collect_set(F.struct("first", "strings", "f", "h", "mixed")).alias("pieces"),
                                           F.count(F.lit(1)).alias("n")), "hits")
    held = staged(keyed.join(hits.drop("n"), "key", "left").select(
        "key", "row", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.when(F.col("pieces").isNull(), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("whole"),
        F.when(F.col("pieces").isNotNull(), F.col("text").cast("binary")).alias("raw"), "pieces"), "held")
    # one text of every distinct mixed piece, and how often it occurs
    touched = held.where("pieces is not null")
    piece = lambda p: F.struct(p["f"].alias("f"), p["h"].alias("h"), p["strings"].alias("strings"),
                               F.substring("raw", p["first"] + 1, p["strings"] + LENGTH - 1).alias("piece"))
    texts = (touched.select(F.explode(F.transform(F.filter("pieces", lambda p: p["mixed"]), piece)).alias("p"))
             .groupBy("p.f", "p.h")
             .agg(F.count(F.lit(1)).alias("n"), F.first("p.strings").alias("strings"), F.first("p.piece").alias("piece")))
    texts = staged(texts, "pieces")
    marks = staged(piece_marks(spark, texts), "marks")
    # of the rest, pieces of one text a minimizer: repeated as a whole
    back = (touched.select("key", F.explode("pieces").alias("p")).where("p.mixed").select("key", "p.*").distinct()
            .join(marks, ["f", "h"])
            .groupBy("key").agg(F.collect_list(F.struct("first", "marks")).alias("found")))
    done = touched.join(back, "key", "left").select("row", "n_bytes", _cut_udf()("raw", "pieces", "found").alias("c"))
    cols = [F.col("row").getField(c).alias(c) for c in rest]
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    clean = held.where("pieces is null").select(*cols, "n_bytes", F.lit(0).cast("long").alias("n_removed"),
                                                F.lit(0).cast("long").alias("n_spans"), none.alias("removed"),
                                                F.col("whole").alias("kept_sha256"))
    return done.select(*cols, "n_bytes", "c.*").unionByName(clean)


def piece_marks(spark, texts: DataFrame) -> DataFrame:
    """(f, h, marks) with the repeated strings of each distinct mixed piece, as stretches of starts in
    the piece."""
    whole = texts.where("n > 1").select("f", "h", F.array(F.struct(F.lit(0).alias("a"), F.col("strings").alias("b"))).alias("marks"))
    # a text that occurs once can only match within the texts of its minimizer
    texts = texts.join(texts.where("n = 1").select("f").distinct(), "f", "left_semi")
    size = texts.agg(F.coalesce(F.sum(F.length("piece")), F.lit(0))).first()[0]
    indexes = max(1, -(-size // INDEX_BYTES))
    hot = texts.groupBy("f").count().where(F.col("count") > HOT_PIECES).select("f")

    def index(group: pd.DataFrame) -> pd.DataFrame:
        found = marked_strings([bytes(p) for p in group["piece"]], (group["n"] == 1).tolist())
        keep = [k for k, x in enumerate(found) if x]
        return pd.DataFrame({"f": group["f"].iloc[keep].to_numpy(), "h": group["h"].iloc[keep].to_numpy(),
                             "marks": pd.Series([[{"a": a, "b": b} for a, b in found[k]] for k in keep], dtype=object)})

    kind = "f long, h long, marks array<struct<a:int,b:int>>"
    plain = (texts.join(hot, "f", "left_anti").withColumn("index", F.pmod(F.xxhash64("f"), F.lit(indexes)))
             .groupBy("index").applyInPandas(index, kind))

    def strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for b in batches:
            own = [[xxhash.xxh3_64_intdigest(p[a:a + LENGTH]) for a in range(len(p) - LENGTH + 1)] for p in map(bytes, b["piece"])]
            k = np.repeat(np.arange(len(own)), [len(x) for x in own])
            yield pd.DataFrame({"f": b["f"].to_numpy()[k], "h": b["h"].to_numpy()[k], "n": b["n"].to_numpy()[k],
                                "a": np.concatenate([np.arange(len(x)) for x in own] or [[]]).astype(np.int32),
                                "s": np.array([d for x in own for d in x], np.uint64).view(np.int64)})

    # a minimizer with very many different pieces around it: its strings, dealt out by their own hash
    single = texts.join(hot, "f", "left_semi").mapInPandas(strings, "f long, h long, n long, a int, s long")
    often = single.groupBy("f", "s").agg(F.sum("n").alias("times")).where("times > 1")
    rest = (single.where("n = 1").join(often, ["f", "s"]).groupBy("f", "h")
            .agg(F.transform(F.array_sort(F.collect_list("a")), lambda a: F.struct(a.alias("a"), (a + 1).alias("b"))).alias("marks")))
    return whole.unionByName(plain).unionByName(rest)


def _cut_udf():
    @F.pandas_udf("n_removed long, n_spans long, removed array<struct<start:int,end:int>>, kept_sha256 string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for raws, pieces, found in batches:
            rows = [_cut_one(bytes(r), p, f) for r, p, f in zip(raws, pieces, found, strict=True)]
            yield pd.DataFrame(rows, columns=["n_removed", "n_spans", "removed", "kept_sha256"])
    return cut.asNondeterministic()


def _cut_one(raw: bytes, pieces, found) -> tuple:
    spans = [(p["first"], p["first"] + p["strings"]) for p in pieces if not p["mixed"]]
    for x in found if found is not None else ():
        spans += [(x["first"] + m["a"], x["first"] + m["b"]) for m in x["marks"]]
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        b += LENGTH - 1             # the last string's bytes
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    at, kept = 0, []
    for a, b in merged:
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    return (sum(b - a for a, b in merged), len(merged), [{"start": a, "end": b} for a, b in merged],
            hashlib.sha256(b"".join(kept)).hexdigest())


@query("op7_run_index")
def op7_run_index(spark, sf_dir):
    """Bytes of every document that lie in a repeated string of 200 bytes."""
    out = repeated_strings(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
