"""Rows with an earlier similar row (J11), exactly, by prefix filtering and cells of date and amount.

Words are put in one order, by how often the words of their hash bucket occur, and a row takes part in the blocks of its
first words, as many as a partner of any size in the table asks for. Two similar rows meet at the first word
they share: from there on, their tails hold all that they share, so a block knows a row by size and tail only.

Rows of one size and tail that are similar to each other need no pairs: of those in one cell of date and amount, within
which both tests hold, all but the first have an earlier match. What is left, at most a row a cell, meets the rows of the
cells around it, and each of those is met by few. So a word that most rows have costs in proportion to its rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written
from .common import SPREAD_ROWS, SPREAD_SHARES, spread_join
from .dedup import FEW, _amount_bucket, _amount_window, _date_bucket, _day, _reach, _semi, _within

BUCKETS = 1 << 14       # of words; their counts order the words
KINDS = 8               # kinds (size, length of the tail) of a block up to which rows meet those of fitting kinds only
NONE = -(1 << 40)       # cell of rows without a date, or without an amount
NAN, INF = NONE + 1, NONE + 2       # of amounts that are no finite numbers


def _holds(both: Column, n: Column, m: Column, least: float) -> Column:
    """Whether sets of n and m words that share ``both`` have a Jaccard index of ``least`` or more."""
    return both >= least * (n + m - both) - 1e-9


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS))


def _level(count: int) -> int:
    """Printable character of a count, three to an octave."""
    return 33 + min(93, int(3 * math.log2(count))) if count else 33


def _prefixes(sizes: Iterable[int], least: float) -> dict[int, int]:
    """By size, how many first words of a set reach all that a partner of one of ``sizes`` shares at least."""
    out = {}
    for n in sizes:
        needs = [math.ceil((least * (n + m) - 1e-9) / (1 + least) - 1e-9) for m in sizes]
        out[n] = max(n - need + 1 for need, m in zip(needs, sizes) if need <= min(n, m))
    return out


def _entries(rows: DataFrame, least: float) -> tuple[DataFrame, str] | None:
    """``(x, n, tail, rid, d, a)``: a row of ``rows(rid, toks, d, a)`` once a prefix word, with its size and its words from there on;
    and the level above which words are common. None without rows."""
    number = lambda df: dict(df.groupBy("k").agg(F.count(F.lit(1)).alias("c")).collect())
    sizes = number(rows.select(F.size("toks").alias("k")))
    if not sizes:
        return None
    counts = number(rows.select(F.explode("toks").alias("w")).select(_bucket(F.col("w")).alias("k")))
    levels = F.lit(bytearray(_level(counts.get(k, 0)) for k in range(BUCKETS)))
    level = lambda w: F.substring(levels, _bucket(w).cast("int") + 1, F.lit(1)).cast("string")
    prefix = F.create_map(*[F.lit(v) for kv in _prefixes(sizes, least).items() for v in kv])
    # x and n can't be NULL: the optimizer would test that on one side of a self join only, which then couldn't share its shuffle
    ranked = rows.filter("rid is not null").select("rid", "d", "a", F.coalesce(F.size("toks"), F.lit(0)).alias("n"), F.sort_array(F.transform("toks", lambda w: F.concat(level(w), w))).alias("s"))
    each = ranked.withColumn("p", F.explode(F.sequence(F.lit(1), prefix[F.col("n")])))
    limit = max(SPREAD_ROWS, -(-sum(sizes.values()) // SPREAD_SHARES))
    return each.select(F.coalesce(F.element_at("s", F.col("p")), F.lit("")).alias("x"), "n", F.concat_ws(" ", F.slice("s", F.col("p"), F.col("n"))).alias("tail"),
                       "rid", "d", "a"), chr(_level(limit))


def _alike(least: float) -> Column:
    """Whether the tails of a row and its candidate hold enough for their sizes."""
    both = F.size(F.array_intersect(F.split("tail", " "), F.split("c_tail", " ")))
    return _holds(both, F.col("n"), F.col("c_n"), least)


def _close(tol: float) -> Column:
    """The amount test of two positive amounts; ones that are no finite numbers are close to their like on one day."""
    return _within(F.col("c_a"), F.col("a"), tol) | ((F.col("c_a") == F.col("a")) & F.col("c_d").eqNullSafe(F.col("d")))


def _renamed(df: DataFrame) -> DataFrame:
    return df.select([F.col(c).alias("c_" + c) for c in df.columns])


def earlier_similar(base: DataFrame, *, least: float, days: int, tol: float) -> DataFrame:
    """Row ids of ``base(rid, toks, d, a)`` that have an earlier match, as one column; an id may come more than once.

    A pair matches when the Jaccard index of the word sets ``toks`` is ``least`` or more, dates are within ``days``
    (skipped if either is NULL) and amounts are within ``tol`` of the larger (skipped if either isn't above 0).
    Rows without an id or without a word match nothing."""
    rows = written(base.filter(F.col("rid").isNotNull() & (F.size("toks") > 0)).select("rid", "toks", "d", "a"))
    found = _entries(rows, least)
    if found is None:
        return rows.select("rid")
    entries, usual = found
    level = F.substring("x", 1, 1)
    # no word of these has more rows than ``spread_join`` would deal out; counts and both sides of the join share one shuffle,
    # as names are changed above the count only, and are sorted by a hash, since many words begin alike
    rare = entries.filter(level <= usual).withColumn("h", F.xxhash64("x"))
    counted = rare.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("h", "x")))
    both_d = F.col("d").isNotNull() & F.col("c_d").isNotNull()
    both_a = F.coalesce(F.col("a") > 0, F.lit(False)) & F.coalesce(F.col("c_a") > 0, F.lit(False))
    cond = ((F.col("h") == F.col("c_h")) & (F.col("x") == F.col("c_x")) & (F.col("rid") < F.col("c_rid"))
            & (~both_d | (F.abs(F.datediff(F.col("d"), F.col("c_d"))) <= days)) & (~both_a | _close(tol)) & _alike(least))
    few = (_renamed(counted.filter(F.col("c").between(2, FEW)).drop("c")).join(rare, cond, "left_semi")
           .select(F.col("c_rid").alias("rid")))
    many = counted.filter(F.col("c") > FEW).drop("c", "h").unionByName(entries.filter(level > usual))
    many = many.withColumn("s", F.size(F.split("tail", " ")))
    done = written(many.unionByName(few, allowMissingColumns=True))
    return reduce(DataFrame.unionByName, [done.filter("x is null").select("rid"),
                                          *_in_large_blocks(done.filter("x is not null"), least, days, tol)])


def _kinds(many: DataFrame, least: float) -> DataFrame:
    """The kinds ``(x, n, s)`` of a block that fit one of it, with their ``rows``; ``own`` and ``others`` are the keys by which
    they are met and meet, ``self`` tells whether equal tails suffice."""
    kinds = many.groupBy("x", "n", "s").agg(F.count(F.lit(1)).alias("rows"))
    code = F.col("n").cast("long") * (1 << 31) + F.col("s")
    blocks = kinds.groupBy("x").agg(F.collect_list(code).alias("all"))

    def fits(k: Column) -> Column:
        m, r = F.shiftright(k, 31), F.pmod(k, F.lit(1 << 31))
        return _holds(F.least(F.col("s").cast("long"), r), F.col("n"), m, least)

    few = F.size("all") <= KINDS
    out = kinds.join(blocks, "x").withColumn("fit", F.filter("all", fits)).filter(F.size("fit") > 0)
    return written(out.select("x", "n", "s", "rows", F.when(few, code).otherwise(F.lit(0)).alias("own"),
                              F.when(few, F.col("fit")).otherwise(F.array(F.lit(0).cast("long"))).alias("others"),
                              _holds(F.col("s"), F.col("n"), F.col("n"), least).alias("self")))


def _in_large_blocks(many: DataFrame, least: float, days: int, tol: float) -> list[DataFrame]:
    """Frames of ``rid`` of the entries ``(x, n, s, tail, rid, d, a)`` with an earlier match in their block."""
    if many.isEmpty():
        return []
    has_d, has_a = F.col("d").isNotNull(), F.coalesce(F.col("a") > 0, F.lit(False))
    finite = F.col("a").cast("double") < F.lit(math.inf)
    day, log, window = _day(F.col("d")).cast("long"), F.log("a"), _amount_window(tol)
    odd = F.when(F.isnan(F.col("a").cast("double")), F.lit(NAN)).otherwise(F.lit(INF))
    # buckets, wider than the windows, in which rows meet; and cells as wide as the windows, so that both tests hold within one
    date_bucket, amount_bucket = _date_bucket(days), lambda n: F.when(finite, _amount_bucket(tol)(n)).otherwise(odd)
    date_cell = F.when(~has_d, F.lit(NONE)).when(has_a & ~finite, day).otherwise(F.floor(day / (days + 1)))
    amount_cell = F.when(~has_a, F.lit(NONE)).when(finite, F.floor(log / (window * (1 - 2e-9)))).otherwise(odd)
    known = (spread_join(many, _kinds(many, least), ["x", "n", "s"], "inner", rows="rows").drop("s")
             .withColumn("dc", date_cell.cast("long")).withColumn("ac", amount_cell.cast("long")))
    cell = ["x", "n", "tail", "dc", "ac"]
    same = known.filter("self")
    firsts = written(same.groupBy(*cell).agg(F.min("rid").alias("first"), F.count(F.lit(1)).alias("rows")))
    told = spread_join(same, firsts, cell, "inner", rows="rows")
    parts = [told.filter("rid > first").select("rid")]
    cols = ["x", "n", "tail", "rid", "d", "a"]
    js = written(told.filter("rid = first").select(*cols, "others").unionByName(known.filter("not self").select(*cols, "others")))
    cs = written(known.groupBy("x", "n", "tail", "own", "d", "a").agg(F.min("rid").alias("rid")))
    tests = {"da": has_d & has_a, "d_": has_d & ~has_a, "_a": ~has_d & has_a, "__": ~has_d & ~has_a}
    j_size, c_size = (f.agg(*[F.count_if(c).alias(k) for k, c in tests.items()]).first() for f in (js, cs))

    def add(j_cls: str, c_cls: tuple, need_d: bool, need_a: bool):
        # joins with an empty side are not planned at all
        if not j_size[j_cls] or not sum(c_size[c] for c in c_cls):
            return
        j, c = js.filter(tests[j_cls]), cs.filter(reduce(lambda x, y: x | y, [tests[k] for k in c_cls]))
        if not (need_d and need_a):
            c = c.groupBy("x", "n", "tail", "own", *["d"] * need_d, *["a"] * need_a).agg(F.min("rid").alias("rid"))
        keys, cond = ["x", "kind"], F.col("c_rid") < F.col("rid")
        j, c = j.withColumn("kind", F.explode("others")).drop("others"), c.withColumnRenamed("own", "kind")
        if need_d:
            j, c = j.withColumn("db", F.explode(_reach(day, days, date_bucket))), c.withColumn("db", date_bucket(day))
            keys, cond = [*keys, "db"], cond & (F.abs(F.datediff(F.col("d"), F.col("c_d"))) <= days)
        if need_a:
            j, c = j.withColumn("ab", F.explode(_reach(log, window, amount_bucket))), c.withColumn("ab", amount_bucket(log))
            keys, cond = [*keys, "ab"], cond & (_close(tol) if need_d else _within(F.col("c_a"), F.col("a"), tol))
        parts.append(_semi(j, _renamed(c), keys, cond & _alike(least)).select("rid"))

    add("da", ("da",), True, True)
    # the amount test is skipped, then the date test, then both
    add("d_", ("da", "d_"), True, False)
    add("da", ("d_",), True, False)
    add("_a", ("da", "_a"), False, True)
    add("da", ("_a",), False, True)
    add("__", ("da", "d_", "_a", "__"), False, False)
    add("_a", ("d_", "__"), False, False)
    add("d_", ("_a", "__"), False, False)
    add("da", ("__",), False, False)
    return parts
