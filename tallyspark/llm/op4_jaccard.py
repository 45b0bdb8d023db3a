"""Operator 4, Jaccard join of word shingles with size-banded bitmap tiles.

Texts with the same set of shingles form a class; the join is between classes. Two sets that
reach the threshold share one of the first shingles of both in any fixed order (prefix filter);
the order puts the most frequent shingles last. Classes that share such a shingle are linked
first with one hub of them. What those links don't yet connect is compared in tiles: the
members of a shingle in one band of sizes and the next, in blocks. There the bit counts of
hashed bitmaps bound the overlap from above, and pairs that remain are decided by exact
intersection of the sorted shingle arrays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, connected_components, only_wanted, query, read_table, spread_join, staged

WORDS = 5                   # words of a shingle
PERCENT = 75                # least 100 * intersection / union of a link
BITS, BITS_MOST = 2048, 1 << 16     # bits of a bitmap; sets beyond two thirds of that get a larger one
SAMPLE = 16                 # of so many texts one is sampled for the frequent shingles
FREQUENT, FREQUENT_MOST = 5, 200_000    # least count in the sample; bound of the broadcast list
BUCKET_ENTRIES = 1 << 20    # prefix entries of a bucket, on average
SLOT_ENTRIES = 1 << 14      # prefix entries of a slot, on average; keys are counted by slots
SLOTS_MOST = 1 << 24        # slots at most
HEAVY = 1 << 17             # entries of a slot beyond which its keys pass without a bucket
BLOCK = 512                 # members of a tile's block
ROUNDS, HUBS = 2, 6         # rounds of hub links; families of keys, each of which draws its hub alike
HEAD = 16                   # folds of a prefix that decide which key owns a pair
NEAR = 64                   # members of a key up to which each is compared with every other at once
STREAM = 4_000              # members compared with one hub in a task

_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[2])
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts, A-Z taken as a-z. The hash of a word is the sum
    of its bytes' codes times powers of their places, for all words of a text at once."""

    def __init__(self, words: int = WORDS):
        self.words = words
        lower = np.arange(256)
        lower[65:91] += 32
        self.code = _mixed((lower.astype(np.uint64) + np.uint64(1)) * np.uint64(_MIX[0]))
        self.visible = np.ones(256, bool)
        self.visible[[9, 10, 11, 12, 13, 32]] = False
        self.powers = np.ones(1, np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        raw = np.frombuffer(text.encode("utf-8", "replace") if text else b"", np.uint8)
        w = self._word_hashes(raw)
        if not len(w):
            return w
        k = min(self.words, len(w))     # a shorter text is one shingle, salted by its length
        acc = np.full(len(w) - k + 1, k, np.uint64)
        for j in range(k):
            acc += w[j:len(w) - k + 1 + j]
            acc *= np.uint64(_MIX[0])
            acc ^= acc >> np.uint64(29)
        out = np.sort(_mixed(acc))
        return out[np.concatenate([[True], out[1:] != out[:-1]])]

    def _word_hashes(self, raw: np.ndarray) -> np.ndarray:
        seen = self.visible[raw]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], seen, [False]]).view(np.int8)))
        lens = edge[1::2] - edge[::2]
        if not len(lens):
            return np.zeros(0, np.uint64)
        if lens.max() > len(self.powers):
            p = np.full(int(lens.max()) + 64, _MIX[1], np.uint64)
            self.powers = np.multiply.accumulate(p)
        first = np.cumsum(lens) - lens
        place = np.arange(int(lens.sum())) - np.repeat(first, lens)
        value = self.code[raw[seen]] * self.powers[place]
        return _mixed(np.add.reduceat(value, first) + lens.astype(np.uint64) * np.uint64(_MIX[2]))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """So many of the first shingles of a set of n must hold a common one."""
    return n - -(-percent * n // 100) + 1 if n else 0


def linked(common: int, a: int, b: int, percent: int = PERCENT) -> bool:
    return a > 0 and b > 0 and 100 * common >= percent * (a + b - common)


def bitmap(shingles: np.ndarray) -> bytes:
    """Bit ``h mod bits`` set for every shingle; bits is a power of two of at least 1.5 a shingle."""
    bits = BITS
    while bits < BITS_MOST and 2 * bits < 3 * len(shingles):
        bits *= 2
    out = np.zeros(bits, np.uint8)
    out[(shingles >> np.uint64(7)).astype(np.int64) % bits] = 1
    return np.packbits(out, bitorder="little").tobytes()


def differing_bits(x: bytes, y: bytes) -> int:
    """Bits in one bitmap only, the larger one folded to the size of the other."""
    a, b, n, m = int.from_bytes(x, "little"), int.from_bytes(y, "little"), len(x), len(y)
    while n > m:
        n //= 2
        a = (a >> 8 * n) | (a & ((1 << 8 * n) - 1))
    while m > n:
        m //= 2
        b = (b >> 8 * m) | (b & ((1 << 8 * m) - 1))
    return (a ^ b).bit_count()


def set_class(shingles: np.ndarray, seed: int = 0) -> int:
    """64-bit digest of a set; equal for equal sets."""
    import xxhash

    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes(), seed)))) if len(shingles) else 0


def told_apart(sketch: DataFrame) -> DataFrame:
    """``sketch`` with classes split where ``check``, a second digest, shows that one digest stands for two sets."""
    clash = (sketch.groupBy("cls").agg(F.min("check").alias("lo"), F.max("check").alias("hi"))
             .where("lo <> hi").select("cls", "lo"))
    if clash.isEmpty():
        return sketch
    own = F.when(F.col("check") > F.col("lo"), F.xxhash64("cls", "check")).otherwise(F.col("cls"))
    return staged(sketch.join(clash, "cls", "left").withColumn("cls", own).drop("lo"), "sketch")


def frequent_shingles(rows: DataFrame) -> np.ndarray:
    """Shingles of many classes, by a sample of the texts; any list is right, it only orders the
    prefixes. At most FREQUENT_MOST values, the most frequent last."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler()
        for b in batches:
            seen = {set_class(s): s for s in map(shingles, b["text"])}
            if seen:
                h, n = np.unique(np.concatenate(list(seen.values())), return_counts=True)
                yield pd.DataFrame({"h": h.view(np.int64), "n": n})

    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    top = (sample.select("text").mapInPandas(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
           .where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "h").limit(FREQUENT_MOST).collect())
    return np.array([r.h for r in reversed(top)], np.int64).view(np.uint64)


def sketches(rows: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(doc_id, row, cls, check, n, bits, prefix): two digests and the size of each text's set, its bitmap, and the
    32-bit folds of its prefix shingles; row is a hash of the text."""
    handle = rows.sparkSession.sparkContext.broadcast(frequent)     # at most FREQUENT_MOST longs

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, folds = Shingler(), prefix_folds(handle.value)
        for b in batches:
            for lo in range(0, len(b), 500):
                part, out = b.iloc[lo:lo + 500], []
                for doc_id, row, text in zip(part["doc_id"], part["row"], part["text"], strict=True):
                    s = shingles(text)
                    out.append((doc_id, row, set_class(s), set_class(s, 1), len(s), bitmap(s), folds(s).tobytes()))
                yield pd.DataFrame(out, columns=["doc_id", "row", "cls", "check", "n", "bits", "prefix"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", F.xxhash64("text").alias("row"), "text").mapInPandas(
        sketch, f"doc_id {kind}, row long, cls long, check long, n int, bits binary, prefix binary")


def prefix_folds(late: np.ndarray):
    """A function from a set to the 32-bit folds of its prefix; the shingles of ``late`` are last in the order."""
    rank_of = np.argsort(late)                      # of the sorted values, the place in the order
    late_sorted = late[rank_of]

    def folds(s: np.ndarray) -> np.ndarray:
        first, p = s, prefix_length(len(s))
        if len(late) and len(s):
            at = np.minimum(np.searchsorted(late_sorted, s), len(late) - 1)
            is_late = late_sorted[at] == s
            tail = s[is_late][np.argsort(rank_of[at[is_late]], kind="stable")]
            first = np.concatenate([s[~is_late], tail])
        return (first[:p] ^ (first[:p] >> np.uint64(32))).astype(np.uint32)
    return folds


def _slot(k: np.ndarray, slots: int) -> np.ndarray:
    return ((k.astype(np.uint64) * np.uint64(_MIX[1])) >> np.uint64(20)) % np.uint64(slots)


class HeavySlots:
    """The slots of keys with more than HEAVY entries as a bit set of at most SLOTS_MOST bits (2 MB), whatever
    the input; with that many entries that most slots are heavy, most keys pass as rows."""

    def __init__(self, slots: int, bits: np.ndarray | None):
        self.slots, self.bits = slots, bits

    def __bool__(self) -> bool:
        return self.bits is not None

    def holds(self, k: np.ndarray) -> np.ndarray:
        at = _slot(k, self.slots).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def heavy_slots(sketch: DataFrame, total: int) -> HeavySlots:
    """The heavy ones of slots in proportion to the ``total`` prefix entries. Batches send sums."""
    slots = int(min(SLOTS_MOST, max(1, -(-total // SLOT_ENTRIES))))
    if total <= HEAVY:
        return HeavySlots(slots, None)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = [np.frombuffer(p, np.uint32) for p in b.drop_duplicates("cls")["prefix"]]
            if keys:
                found, n = np.unique(_slot(np.concatenate(keys), slots), return_counts=True)
                yield pd.DataFrame({"slot": found.astype(np.int64), "n": n})

    counts = (sketch.where("n > 0").select("cls", "prefix").mapInPandas(partial, "slot long, n long")
              .groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") > HEAVY))
    place = F.col("slot") + 1       # Spark numbers buckets of 32768 bits from 1, so bit 0 of bucket 1 is slot 0
    sets = (counts.groupBy(F.bitmap_bucket_number(place).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("set")).collect())
    if not sets:
        return HeavySlots(slots, None)
    size = len(sets[0]["set"])
    bits = np.zeros((-(-slots // (8 * size)), size), np.uint8)
    for r in sets:
        bits[r["bucket"] - 1] = np.frombuffer(r["set"], np.uint8)
    bits = bits.reshape(-1)
    return HeavySlots(slots, bits)


def heavy_entries(sketch: DataFrame, heavy: HeavySlots) -> DataFrame:
    """(k, cls, n, pos) of the keys of ``heavy`` slots, all of them, each class of a key once."""
    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.drop_duplicates("cls")
            keys = [np.frombuffer(p, np.uint32) for p in b["prefix"]]
            if not keys:
                continue
            k, lens = np.concatenate(keys), [len(x) for x in keys]
            pos = np.concatenate([np.arange(x, dtype=np.int32) for x in lens])
            who, on = np.repeat(np.arange(len(b)), lens), heavy.holds(k)
            yield pd.DataFrame({"k": k[on].view(np.int32), "cls": b["cls"].to_numpy(np.int64)[who[on]],
                                "n": b["n"].to_numpy(np.int32)[who[on]], "pos": pos[on]})

    found = sketch.where("n > 0").select("cls", "n", "prefix").mapInPandas(entries, "k int, cls long, n int, pos int")
    return found.groupBy("k", "cls").agg(F.min("n").alias("n"), F.min("pos").alias("pos"))


def narrow(x: np.ndarray) -> bytes:
    """Numbers of 0 or more in the least bytes a number that hold the largest."""
    most = int(x.max(initial=0))
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32).tobytes()


def wide(raw: bytes, count: int) -> np.ndarray:
    """The ``count`` numbers of ``narrow``."""
    return np.frombuffer(raw, f"u{len(raw) // count}").astype(np.int64)


def packed_entries(sketch: DataFrame, buckets: int, heavy: HeavySlots) -> DataFrame:
    """Prefix entries of the keys outside ``heavy`` slots, one packed row a batch and bucket: the classes with
    their sizes and counts of entries, and the entries in that order; equal classes of a batch travel once."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.drop_duplicates("cls")
            keys = [np.frombuffer(p, np.uint32) for p in b["prefix"]]
            if not keys:
                continue
            k = np.concatenate(keys)
            lens = [len(x) for x in keys]
            who = np.repeat(np.arange(len(b), dtype=np.int32), lens)
            pos = np.concatenate([np.arange(x, dtype=np.uint32) for x in lens])
            if heavy:
                light = ~heavy.holds(k)
                k, who, pos = k[light], who[light], pos[light]
            if not len(k):
                continue
            bucket = ((k.astype(np.uint64) * np.uint64(_MIX[0])) >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            k, who, pos, bucket = k[order], who[order], pos[order], bucket[order]
            edges = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(k)]])
            cls, n, out = b["cls"].to_numpy(np.int64), b["n"].to_numpy(np.int32), []
            for a, e in zip(edges[:-1], edges[1:], strict=True):
                mine, held = np.unique(who[a:e], return_counts=True)      # who rises within a bucket
                out.append((int(bucket[a]), k[a:e].tobytes(), narrow(held), cls[mine].tobytes(), narrow(n[mine]), narrow(pos[a:e])))
            yield pd.DataFrame(out, columns=["bucket", "k", "held", "cls", "n", "pos"])

    return sketch.where("n > 0").select("cls", "n", "prefix").mapInPandas(
        pack, "bucket int, k binary, held binary, cls binary, n binary, pos binary")


def shared_prefixes(sketch: DataFrame) -> DataFrame:
    """(k, cls, n, pos): the prefix entries whose key k meets other classes it may link; pos is the place of the
    shingle in the order. Entries travel packed to buckets of keys, each with less than HEAVY entries
    of a key; keys of slots with more pass as rows of their own and all stay."""
    total = sketch.agg(F.coalesce(F.sum(F.length("prefix") / 4), F.lit(0))).first()[0]
    parts = int(sketch.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = int(max(parts, -(-total // BUCKET_ENTRIES)))
    heavy = heavy_slots(sketch, total)

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        cols: list[tuple] = []
        for r in group.itertuples(index=False):
            key, ids = np.frombuffer(r.k, np.uint32), np.frombuffer(r.cls, np.int64)
            held = wide(r.held, len(ids))
            cols.append((key, np.repeat(ids, held), np.repeat(wide(r.n, len(ids)), held), wide(r.pos, len(key))))
        k, cls, n, pos = (np.concatenate(c) for c in zip(*cols, strict=True))
        order = np.lexsort((pos, cls, n, k))
        k, cls, n, pos = k[order], cls[order], n[order], pos[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (cls[1:] != cls[:-1])])
        k, cls, n, pos = k[new], cls[new], n[new], pos[new]
        edge = np.append(np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])), len(k))
        members = np.repeat(np.diff(edge), np.diff(edge))
        # an entry stays if its class can reach the threshold with another of the key; in
        # larger keys all stay
        keep = members > NEAR
        some = np.flatnonzero((members > 1) & ~keep)
        for d in range(1, NEAR):
            a = some[:-d][some[d:] - some[:-d] == d]
            a = a[k[a] == k[a + d]]
            if not len(a):
                break
            a = a[can_link(n[a], n[a + d], pos[a], pos[a + d])]
            keep[a] = keep[a + d] = True
        return pd.DataFrame({"k": k[keep].view(np.int32), "cls": cls[keep], "n": n[keep].astype(np.int32),
                             "pos": pos[keep].astype(np.int32)})

    light = packed_entries(sketch, buckets, heavy).groupBy("bucket").applyInPandas(meet, "k int, cls long, n int, pos int")
    return light.unionByName(heavy_entries(sketch, heavy)) if heavy else light


def bitmaps_allow(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (hub, cls) whose bitmaps and sizes leave the threshold in reach."""
    pairs = staged(pairs, "candidates")
    needed = only_wanted(reps.select("cls", "n", "bits"), pairs.select("cls").unionByName(pairs.select(F.col("hub").alias("cls"))), "cls")
    of = lambda c: needed.select(F.col("cls").alias(c), F.col("n").alias("n_" + c), F.col("bits").alias("bits_" + c))

    @F.pandas_udf("boolean")
    def allow(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        both = n.to_numpy(np.int64) + m.to_numpy(np.int64)
        return pd.Series(can_reach(most_common(a, b, both), both))

    joined = pairs.join(of("hub"), "hub").join(of("cls"), "cls")
    return joined.where(allow("bits_hub", "bits_cls", "n_hub", "n_cls")).select("hub", "cls")


def most_common(x, y, sizes: np.ndarray) -> np.ndarray:
    """Upper bounds of the overlaps by bitmaps: each differing bit is a shingle of one set only."""
    return (sizes - np.fromiter(map(differing_bits, x, y), np.int64, len(sizes))) // 2


def texts_of(roles: DataFrame, rows: DataFrame) -> DataFrame:
    """``roles(cls, rep_id, row, ...)`` with the ``text`` of the row that stands for the class."""
    roles = staged(roles, "roles")
    texts = only_wanted(rows.where("text is not null").withColumn("row", F.xxhash64("text")), roles.select("row"))
    return roles.join(texts, "row").where("doc_id <=> rep_id").drop("doc_id", "rep_id", "row")


def whose(reps: DataFrame) -> DataFrame:
    return reps.select("cls", F.col("rep.doc_id").alias("rep_id"), F.col("rep.row").alias("row"))


def verified(pairs: DataFrame, reps: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (hub, cls) whose sets reach the threshold. The text of a class goes once to each of
    its hubs; the members of one hub are dealt out over tasks by STREAM and pass as a stream."""
    pairs = staged(pairs, "pairs")
    counts = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / STREAM).cast("long").alias("salts"))
    members = pairs.join(counts, "hub").select("hub", F.pmod(F.xxhash64("cls"), F.col("salts")).alias("salt"), F.lit(1).alias("role"), "cls")
    hubs = counts.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"),
                         F.lit(0).alias("role"), F.col("hub").alias("cls"))
    dealt = texts_of(hubs.unionByName(members).join(whose(reps), "cls"), rows).select("hub", "salt", "role", "cls", "text")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, hub, mine = Shingler(), None, None
        for b in batches:
            out = []
            for h, role, cls, text in zip(b["hub"], b["role"], b["cls"], b["text"], strict=True):
                s = shingles(text)
                if role == 0:
                    hub, mine = h, s
                elif h == hub and linked(len(np.intersect1d(mine, s, assume_unique=True)), len(mine), len(s)):
                    out.append((h, cls))
            yield pd.DataFrame(out, columns=["hub", "cls"]).astype("int64")

    stream = dealt.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role")
    return stream.mapInPandas(compare, "hub long, cls long")


def sets_of(classes: DataFrame, reps: DataFrame, rows: DataFrame) -> DataFrame:
    """(cls, shingles) of ``classes(cls)``, from the text that stands for each."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler()
        for b in batches:
            yield pd.DataFrame({"cls": b["cls"], "shingles": [shingles(t).tobytes() for t in b["text"]]})

    return texts_of(classes.join(whose(reps), "cls"), rows).select("cls", "text").mapInPandas(read, "cls long, shingles binary")


TILE = ["k", "low", "i", "j"]
MEMBER = [*TILE, "cls", "n", "pos", "label"]
MEMBER_TYPE = "k int, low int, i int, j int, cls long, n int, pos int, label long"


def dealt_out(shared: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(k, low, i, j, cls, n, pos, label): the members of keys with several labels, dealt out to tiles. Those of a
    key are one tile, or, beyond BLOCK of them, tiles of two blocks in a band of sizes and the next."""
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / PERCENT) + 1e-9).cast("int")
    members = _labelled(shared, labels)
    # of all columns, so that members are shuffled once for this and the join
    row = F.struct("label", "cls", "n", "pos")
    counts = (members.groupBy("k").agg(F.min(row)["label"].alias("lo"), F.max(row)["label"].alias("hi"),
                                       F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("lo <> hi"))
    dealt = members.join(counts, "k").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    # a member goes to the tiles of its band and of the band below, with every other block
    placed = (dealt.withColumn("low", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array(band, band - 1))))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")))
    return placed.select(*MEMBER)


def tiles(members: DataFrame) -> DataFrame:
    """``members`` of tiles, each tile whole in a task and in a run. Members without a partner leave a tile from
    step to step; the others stay in it, so that no step deals them out anew."""
    return members.repartition(*TILE).sortWithinPartitions(*TILE)


def by_tile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole tiles of a sorted stream, many at once; the last one of a batch waits for the next."""
    held = None
    for b in batches:
        held = b if held is None or not len(held) else pd.concat([held, b], ignore_index=True)
        if len(held):
            last = (held[TILE] == held[TILE].iloc[-1]).all(axis=1).to_numpy()
            if not last.all():
                yield held[~last]
                held = held[last]
    if held is not None and len(held):
        yield held


def candidates(g: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b) of members of one tile that have different labels and may be linked."""
    t = g.groupby(TILE, sort=False).ngroup().to_numpy()
    label, n, pos = (g[c].to_numpy(np.int64) for c in ("label", "n", "pos"))
    for d in range(1, int(np.bincount(t).max())):       # each member with the one d places on
        a = np.flatnonzero(t[d:] == t[:-d])
        b = a + d
        ok = (label[a] != label[b]) & can_link(n[a], n[b], pos[a], pos[b])
        yield a[ok], b[ok]


def partnered(members: DataFrame) -> DataFrame:
    """The members of tiles that may be linked with another of their tile."""
    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in by_tile(batches):
            hit = np.zeros(len(g), bool)
            for a, b in candidates(g):
                hit[a] = hit[b] = True
            yield g.loc[hit, MEMBER]

    return tiles(members).mapInPandas(keep, MEMBER_TYPE)


def promising(members: DataFrame) -> DataFrame:
    """The members of tiles, with head and with bits or not, that have a partner of another label that sizes, places
    and bitmaps allow, in the key that owns the pair: rows of members, never of pairs."""
    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in by_tile(batches):
            tile = Tile(g)
            hit = np.zeros(len(g), bool)
            for a, b in candidates(g):
                new = ~(hit[a] & hit[b])
                a, b = tile.allowed(a[new], b[new])
                hit[a] = hit[b] = True
            yield g.loc[hit, MEMBER]

    return tiles(members).mapInPandas(keep, MEMBER_TYPE)


def tile_links(members: DataFrame) -> DataFrame:
    """Links (hub, cls) that join the labels of members of tiles with bits, head and shingles.

    A tile compares the sorted shingles of its pairs itself and keeps a union-find of labels: pairs
    whose labels are joined already are skipped, so a tile has less links than members.
    """
    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in by_tile(batches):
            tile = Tile(g)
            where, label = g.groupby(TILE, sort=False).ngroup().to_numpy(), g["label"].to_numpy(np.int64)
            sets = [np.frombuffer(x, np.uint64) for x in g["shingles"]]
            root: dict[tuple, tuple] = {}

            def top(x: tuple) -> tuple:
                while (y := root.get(x, x)) != x:
                    root[x] = root.get(y, y)
                    x = y
                return x

            out = []
            for a, b in candidates(g):
                a, b = tile.allowed(a, b)
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    p, q = top((where[x], label[x])), top((where[y], label[y]))
                    if p != q and linked(len(np.intersect1d(sets[x], sets[y], assume_unique=True)), len(sets[x]), len(sets[y])):
                        root[p] = q
                        out.append((tile.cls[x], tile.cls[y]))
            yield pd.DataFrame(out, columns=["hub", "cls"]).astype("int64")

    return tiles(members).mapInPandas(links, "hub long, cls long")


class Tile:
    """Pairs of one batch of tiles: what bitmaps allow, and which key of those that a pair shares owns it."""

    def __init__(self, g: pd.DataFrame):
        self.cls, self.n = g["cls"].to_numpy(np.int64), g["n"].to_numpy(np.int64)
        self.k = g["k"].to_numpy(np.int32).view(np.uint32)
        self.bits = np.array([bytes(x) for x in g["bits"]], dtype=object) if "bits" in g else None
        self.head, self.held = np.zeros((len(g), HEAD), np.uint32), np.zeros(len(g), np.int64)
        for r, x in enumerate(g["head"]):
            fold = np.frombuffer(x, np.uint32)
            self.head[r, :len(fold)], self.held[r] = fold, len(fold)

    def allowed(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(a):
            return a, b
        own = np.concatenate([self.owned(a[k:k + 4096], b[k:k + 4096]) for k in range(0, len(a), 4096)])
        a, b = a[own], b[own]
        if self.bits is None:
            return a, b
        both = self.n[a] + self.n[b]
        ok = can_reach(most_common(self.bits[a], self.bits[b], both), both)
        return a[ok], b[ok]

    def owned(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the key is the first fold of the head of the member with the smaller ``cls`` that the other's head
        has too and that lets the two link. Pairs without one belong to every key that they share."""
        x, y = np.where(self.cls[a] < self.cls[b], a, b), np.where(self.cls[a] < self.cls[b], b, a)
        i, j = np.arange(HEAD)[None, :, None], np.arange(HEAD)[None, None, :]
        shape = lambda v: v[:, None, None]
        same = ((self.head[x][:, :, None] == self.head[y][:, None, :]) & (i < shape(self.held[x])) & (j < shape(self.held[y]))
                & can_link(shape(self.n[x]), shape(self.n[y]), i, j)).any(axis=2)
        return ~same.any(axis=1) | (self.head[x, same.argmax(axis=1)] == self.k[x])


def can_link(n, m, i, j):
    """Whether sets of n and m shingles may be linked if their first common shingle is at places i and
    j of the order: their sizes, and what is left of either set from there, must suffice."""
    return (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)) & can_reach(np.minimum(n - i, m - j), n + m)


def can_reach(most, sizes, percent: int = PERCENT):
    """Whether an overlap of at most ``most`` suffices for two sets of ``sizes`` shingles together."""
    return (100 + percent) * most >= percent * sizes


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    The component is the smallest doc_id reachable by links, the row's own included; a text without a
    word (null, empty, white space) has no shingles and is its own component. Rows with the same
    words share a set, so repeated rows and ties in the id are in one component. A null
    doc_id keeps its row; its component is the smallest id of the others, null if there is none.
    """
    rows = bounded_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sketch = told_apart(staged(sketches(rows, frequent_shingles(rows)), "sketch"))
    shared = staged(shared_prefixes(sketch), "shared")
    # a row, by id and text hash, the bitmap and the first folds of each class that shares an entry; copies
    # meet in the map tasks, so a class of very many is no large group
    classes = only_wanted(sketch.where("n > 0"), shared.select("cls"), "cls").groupBy("cls").agg(
        F.min(F.struct("doc_id", "row")).alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits"),
        F.first(F.substring("prefix", 1, 4 * HEAD)).alias("head"))
    reps = staged(classes.join(shared.select("cls").distinct(), "cls", "left_semi"), "classes")
    # links with hubs, twice: the second time only of what the first left apart
    labels = None
    for seed in range(ROUNDS):
        found = staged(verified(bitmaps_allow(_hub_pairs(_labelled(shared, labels), seed), reps), reps, rows), "links")
        labels = _merged(labels, found)
    # what is still apart is compared in tiles
    # each step leaves fewer members to carry the next, larger sign
    signs = reps.select("cls", "bits", "head")
    owners = promising(partnered(dealt_out(shared, labels)).join(signs.select("cls", "head"), "cls"))
    left = staged(promising(owners.join(signs, "cls")), "promising")
    sets = sets_of(left.select("cls").distinct(), reps, rows).join(only_wanted(signs, left.select("cls"), "cls"), "cls")
    labels = _merged(labels, tile_links(left.join(sets, "cls")))
    return _with_components(sketch, labels)


def _with_components(sketch: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of the documents of ``sketch`` under ``labels(cls, label)``. A class or a
    label may hold a third of all rows: both are aggregated first and met by ``spread_join``."""
    by_class = sketch.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("docs"))
    known = staged(by_class.join(labels, "cls", "left").where("docs > 1 or label is not null")
                   .withColumn("label", F.coalesce("label", "cls")), "known")
    by_label = staged(known.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "least")
    of_class = staged(spread_join(known.select("cls", "docs", "label"), by_label, ["label"], "left")
                      .select("cls", "docs", "component_id"), "components")
    full = spread_join(sketch.where("n > 0").select("doc_id", "cls", F.col("n").cast("long").alias("n_shingles")),
                       of_class, ["cls"], "left", rows="docs")
    return full.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).unionByName(
        sketch.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _labelled(shared: DataFrame, labels: DataFrame | None) -> DataFrame:
    """shared with the label of each class, dealt out by keys. No value is null; the filter says so here, as
    otherwise Spark adds it to one of two uses and shuffles the rows for each."""
    known = shared.withColumn("label", F.col("cls"))
    if labels is not None:
        known = shared.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    return known.where("k is not null and n is not null and label is not null").repartition("k")


def _hub_pairs(members: DataFrame, seed: int) -> DataFrame:
    """(hub, cls): each class with one class of another label of each key, drawn alike by all keys of
    a family, where places and sizes allow a link."""
    drawn = F.xxhash64("cls", F.pmod("k", F.lit(HUBS)), F.lit(seed))
    hub = members.groupBy("k").agg(F.min(F.struct(drawn.alias("h"), "cls", "n", "pos", "label")).alias("hub"))
    n, m = F.col("n"), F.col("hub.n")
    return (members.join(hub, "k").where("label <> hub.label")
            .where(100 * F.least(n, m).cast("long") >= PERCENT * F.greatest(n, m))
            .where(can_reach(F.least(n - F.col("pos"), m - F.col("hub.pos")).cast("long"), n + m))
            .select(F.col("hub.cls").alias("hub"), "cls").distinct())


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(cls, label) of all linked classes once ``links(hub, cls)`` join the components of ``labels``."""
    edges = links.select(F.col("hub").alias("a"), F.col("cls").alias("b"))
    if labels is None:
        return connected_components(edges).select(F.col("node").alias("cls"), F.col("component").alias("label"))
    of = lambda c: labels.select(F.col("cls").alias(c), F.col("label").alias("label_" + c))
    across = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(
        F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    moved = connected_components(across).select(F.col("node").alias("label"), "component")
    old = labels.join(moved, "label", "left").select("cls", F.coalesce("component", "label").alias("label"))
    new = moved.join(labels.select("cls"), moved["label"] == labels["cls"], "left_anti").select(
        F.col("label").alias("cls"), F.col("component").alias("label"))
    return staged(old.unionByName(new), "labels")


@query("op4_jaccard_tiles")
def op4_jaccard_tiles(spark, sf_dir):
    """Component of every document under links of 5-word shingles at 75 percent."""
    return components(read_table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the document with the smallest id stays, with all rows of
    that id. Texts without words stay, and so do rows without an id."""
    best = components(docs).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(best, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
