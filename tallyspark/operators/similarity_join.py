"""Exact similarity joins by prefix filtering, as Spark equi-joins.

Two sets that overlap enough share one of the first elements of both in any fixed order; with the
rarest elements first those are shared by few others. Each join explodes the prefixes, joins on the
element and verifies the pair in the join condition, so only pairs that hold leave a task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.similarity import sequence_ratio
from ..session import cut_lineage, written
from .common import spread_join


def ranked_sets(sets: DataFrame, keys: list[str], items: str, within: list[str] | None = None) -> DataFrame:
    """``sets(keys..., items)`` with the array ``items`` sorted by falling rarity: the element found in fewest sets (of
    the same ``within`` columns) first, ties by the element. One row a key; empty sets are left out.

    Frequent elements are summed in the map tasks and dealt out where their counts are looked up."""
    group = [*(within or []), "_x"]
    flat = sets.select(*keys, F.explode(items).alias("_x"))
    counts = written(flat.groupBy(*group).agg(F.count(F.lit(1)).alias("n")))
    known = spread_join(flat, counts.withColumn("_n", F.col("n")), group)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_n", "_x"))), lambda s: s["_x"])
    return known.groupBy(*keys).agg(ordered.alias(items))


def jaccard_prefix(items: Column, least: float) -> Column:
    """The first elements of a ranked set that any set with a Jaccard index of ``least`` or more must meet."""
    n = F.size(items)
    return F.slice(items, 1, (n - F.ceil(n * least - 1e-9) + 1).cast("int"))


def jaccard_holds(a: Column, b: Column, least: float) -> Column:
    """Whether two sets have a Jaccard index of ``least`` or more; the sizes are tested first."""
    n, m, both = F.size(a), F.size(b), F.size(F.array_intersect(a, b))
    return (F.least(n, m) >= least * F.greatest(n, m) - 1e-9) & (both >= least * (n + m - both) - 1e-9)


def jaccard_pairs(sets: DataFrame, id_col: str, items: str, least: float) -> DataFrame:
    """``(a, b, jaccard)`` with a < b of all sets (distinct ids, array ``items``) with an index of ``least`` or more.

    A pair that shares several prefix elements is taken at the first one only, so nothing is deduplicated;
    sizes and places bound the overlap before the sets are intersected."""
    ranked = cut_lineage(ranked_sets(sets, [id_col], items))
    part = ranked.select(F.col(id_col).alias("id"), F.col(items).alias("s"), F.posexplode(jaccard_prefix(F.col(items), least)).alias("p", "x"))
    a, b = part.alias("a"), part.alias("b")
    col = F.col
    n, m = F.size("a.s"), F.size("b.s")
    room = F.least(n - col("a.p"), m - col("b.p"))      # overlap from this element on, at most
    first = ~F.arrays_overlap(F.slice("a.s", F.lit(1), col("a.p")), F.slice("b.s", F.lit(1), col("b.p")))
    on = ((col("a.x") == col("b.x")) & (col("a.id") < col("b.id"))
          & (F.least(n, m) >= least * F.greatest(n, m) - 1e-9) & (room * (1 + least) >= least * (n + m) - 1e-9)
          & first & jaccard_holds(col("a.s"), col("b.s"), least))
    both = F.size(F.array_intersect("a.s", "b.s"))
    return a.join(b, on).select(col("a.id").alias("a"), col("b.id").alias("b"), (both / (n + m - both)).alias("jaccard"))


# ---- strings by the sequence ratio -------------------------------------------------------------
FEW = 20        # names of a block up to which each meets every other


def _grams(text: Column, q: int) -> Column:
    """All runs of q characters, sorted."""
    n = F.char_length(text) - (q - 1)
    places = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.array_sort(F.transform(places, lambda i: F.substring(text, i, F.lit(q))))


def _numbered(grams: str) -> Column:
    """A sorted multiset as a set: each gram with its occurrence number, as text."""
    return F.transform(F.col(grams), lambda g, i: F.concat(g, F.lit("\x00"), (i - F.array_position(F.col(grams), g) + 1).cast("string")))


def _most_edits(lengths: Column, ratio: float) -> Column:
    """Most insertions and deletions between two strings of that length together whose ratio is above ``ratio``."""
    return F.ceil((1 - ratio) * lengths - 1e-9) - 1


def _least_common(n: Column, m: Column, ratio: float, q: int) -> Column:
    """Grams that two strings of n and m characters share at least if their ratio is above ``ratio``: an edit
    changes at most q of them; of single characters, the matched ones are shared."""
    if q == 1:
        return F.floor(ratio * (n + m) / 2 + 1e-9) + 1
    return F.greatest(n, m) - q + 1 - q * _most_edits(n + m, ratio)


def _by_pairs_of_characters(n: Column, m: Column, ratio: float) -> Column:
    """Whether strings of n and m characters above ``ratio`` must share a pair of characters; shorter ones need not."""
    return _least_common(n, m, ratio, 2) >= 1


def sequence_ratio_pairs(names: DataFrame, block: str, name: str, ratio: float) -> DataFrame:
    """``(block, i, j)`` of distinct strings of one block whose sequence ratio is above ``ratio``, both ways and with
    each string itself. ``names(block, name)`` is distinct.

    The ratio is twice the matched characters by both lengths, so it bounds the edits, and they bound how many
    grams the strings share: strings meet by the rarest of their grams, then by the count of shared grams, and only
    what is left is scored. Short strings meet by characters. In a block of at most ``FEW`` names each meets every other."""
    sizes = names.groupBy(F.col(block).alias("blk")).agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    every = written(names.select(F.col(block).alias("blk"), F.col(name).alias("s"), F.char_length(name).alias("n"))
                        .filter("n > 0").join(sizes, "blk"))
    same = names.select(F.col(block).alias("blk"), F.col(name).alias("i"), F.col(name).alias("j"))
    # a block of few names: at most FEW - 1 partners a name, so its pairs grow with the names
    x, y = every.filter(F.col("c") <= FEW).alias("x"), every.filter(F.col("c") <= FEW).alias("y")
    n, m = F.col("x.n"), F.col("y.n")
    both = [x.join(y, (F.col("x.blk") == F.col("y.blk")) & (F.col("x.s") < F.col("y.s")) & (2 * F.least(n, m) > ratio * (n + m)))
            .select(F.col("x.blk").alias("blk"), F.col("x.s").alias("i"), F.col("y.s").alias("j"))]
    texts = every.filter(F.col("c") > FEW).drop("c")
    for q in () if texts.isEmpty() else (1, 2):
        # what a partner of any length in reach shares at least; the prefix must hold one of the other grams
        lo, hi = F.floor(F.col("n") * ratio / (2 - ratio)), F.ceil(F.col("n") * (2 - ratio) / ratio)
        partners = F.filter(F.sequence(F.greatest(lo, F.lit(1)), hi), lambda m: _by_pairs_of_characters(F.col("n"), m, ratio) == F.lit(q == 2))
        text = texts.withColumn("need", F.array_min(F.transform(partners, lambda m: _least_common(F.col("n"), m, ratio, q)))).filter("need is not null")
        text = text.withColumn("bag", _grams(F.col("s"), q)).withColumn("g", _numbered("bag"))
        own = ranked_sets(text, ["blk", "s", "n", "need"], "g", within=["blk"])
        part = written(own.withColumn("x", F.explode(F.slice("g", F.lit(1), (F.size("g") - F.col("need") + 1).cast("int")))).drop("need"))
        a, b = part.alias("a"), part.alias("b")
        n, m = F.col("a.n"), F.col("b.n")
        on = ((F.col("a.blk") == F.col("b.blk")) & (F.col("a.x") == F.col("b.x")) & (F.col("a.s") < F.col("b.s"))
              & (2 * F.least(n, m) > ratio * (n + m)) & (_by_pairs_of_characters(n, m, ratio) == F.lit(q == 2))
              & (F.size(F.array_intersect("a.g", "b.g")) >= _least_common(n, m, ratio, q)))
        both.append(a.join(b, on).select(F.col("a.blk").alias("blk"), F.col("a.s").alias("i"), F.col("b.s").alias("j")).distinct())
    close = cut_lineage(reduce(DataFrame.unionByName, both))
    # the ratio depends on the order of its arguments
    ways = close.unionByName(close.select("blk", F.col("j").alias("i"), F.col("i").alias("j")))
    return ways.filter(sequence_ratio(F.col("i"), F.col("j")) > ratio).unionByName(same)
