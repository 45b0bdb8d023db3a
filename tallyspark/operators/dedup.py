"""De-duplication (J1-J8) and same-day consolidation.

"Earlier row" means smaller ``row_id`` (the caller's stable order). The pairwise rules
J5-J7 drop a row when ANY earlier row of its block matches, including rows that are
themselves dropped, so each step is an EXISTS over the step's input: one semi/anti join,
not an iteration.

Scale design for the pairwise rules (a single vendor may hold a third of all rows):
  * earlier-row candidates are reduced to distinct (block, vendor text, date, amount)
    tuples carrying their smallest row_id, so exact copies never multiply work;
  * in a block of at most ``FEW`` tuples each meets every other, so such rows are never copied;
  * in larger blocks candidates are blocked on (block, date bucket, log-amount bucket) and copied to the
    buckets that their window reaches, so a row only meets rows near its own date/amount window;
  * name similarity runs once per pair of distinct vendor strings of a block that share enough
    grams for the ratio, never per row pair;
  * AQE's skew-join handling splits oversized probe partitions.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.similarity import token_sort_ratio
from ..session import written
from .common import spread_join
from .similarity_join import sequence_ratio_pairs


# ---- J1, J2, J3 -------------------------------------------------------------------------
def drop_exact_duplicates(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Keep the first row (smallest row_id) of each group of identical rows.

    Hash aggregation with map-side combine: a hot duplicate group collapses inside
    each task before the shuffle."""
    cols = [c for c in df.columns if c != row_id]
    if row_id not in df.columns:
        return df.dropDuplicates()
    first = df.groupBy(*cols).agg(F.min(row_id).alias(row_id))
    return first.select(*df.columns)


def drop_key_duplicates(df: DataFrame, keys=("date", "amount", "description"), row_id: str = "row_id",
                        flag: str | None = None) -> DataFrame:
    """Keep the first row per key subset (only keys present in ``df`` are used).

    With ``flag`` set, all rows are kept and ``flag`` marks the later copies."""
    keys = [k for k in keys if k in df.columns]
    if not keys:
        return drop_exact_duplicates(df, row_id)
    if flag:
        firsts = df.groupBy(*[F.col(k).alias("f_" + k) for k in keys]).agg(F.min(row_id).alias("_first"))
        j = df.join(firsts, [F.col(k).eqNullSafe(F.col("f_" + k)) for k in keys], "left")
        return j.select(*df.columns, (F.col("_first") != F.col(row_id)).alias(flag))
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(row_id)).alias("_r"))
    return first.select(*keys, "_r.*").select(*df.columns)


def drop_large_file_duplicates(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """J2 on (vendor, amount, date)."""
    return drop_key_duplicates(df, ("vendor", "amount", "date"), row_id)


# ---- J4 ---------------------------------------------------------------------------------
def fuzzy_adjacent_dedup(df: DataFrame, text: str = "memo", date: str = "date", amount: str = "amount",
                         threshold: float = 90, row_id: str = "row_id") -> DataFrame:
    """Order by (date, amount, text, row_id); drop a row when the previous row has the
    same date and amount (both non-null) and token-sort similarity >= threshold.

    Identical (date, amount, text) runs are collapsed first: every row after the first
    of a run follows an identical text (similarity 100), so it is dropped without a
    window. The ``lag`` then runs over distinct texts only."""
    txt = F.coalesce(F.col(text).cast("string"), F.lit("nan"))
    keyed = df.withColumn("_t", txt)
    runs = (keyed.filter(F.col(date).isNotNull() & F.col(amount).isNotNull())
            .groupBy(date, amount, "_t").agg(F.min(row_id).alias("_first")))
    from pyspark.sql import Window
    w = Window.partitionBy(date, amount).orderBy(F.col("_t") == "nan", "_t")
    prev = runs.withColumn("_prev", F.lag("_t").over(w))
    drop_first = prev.filter(F.col("_prev").isNotNull()
                             & (token_sort_ratio(F.col("_prev"), F.col("_t")) >= threshold)).select("_first")
    keep_first = runs.select("_first").join(drop_first, "_first", "left_anti")
    # a row survives if it has no date/amount key, or it is an un-dropped run head
    keyed_rows = keyed.filter(F.col(date).isNotNull() & F.col(amount).isNotNull())
    survivors = keyed_rows.join(keep_first.withColumnRenamed("_first", row_id), row_id, "left_semi")
    no_key = keyed.filter(F.col(date).isNull() | F.col(amount).isNull())
    return survivors.unionByName(no_key).drop("_t")


# ---- shared pairwise machinery ---------------------------------------------------------
FEW = 32        # tuples of a block up to which each meets every other
WIDE = 2        # windows in a bucket: wider ones copy candidates less often and let more of them meet


def _reach(x: Column, window, bucket) -> Column:
    """The buckets, from that of ``x - window`` to that of ``x + window``."""
    return F.sequence(bucket(x - window), bucket(x + window))


def _day(d: Column) -> Column:
    return F.datediff(d.cast("date"), F.lit("1970-01-01").cast("date"))


def _date_bucket(days: int):
    return lambda n: F.floor(n / (WIDE * (days + 1))).cast("long")


def _amount_window(tol: float) -> float:
    return -math.log(1.0 - tol) * (1 + 1e-9)


def _amount_bucket(tol: float):
    return lambda x: F.floor(x / (WIDE * _amount_window(tol))).cast("long")


def _within(a_i: Column, a_j: Column, tol: float) -> Column:
    return F.abs(a_i - a_j) / F.greatest(a_i, a_j) <= tol


def _semi(j: DataFrame, i: DataFrame, keys: list[str], cond: Column | None) -> DataFrame:
    """Rows of ``j`` with at least one candidate in ``i`` (key columns prefixed ``c_``)
    on ``keys`` satisfying ``cond``."""
    on = [F.col(k) == F.col("c_" + k) for k in keys]
    if cond is not None:
        on.append(cond)
    return j.join(i, on, "left_semi")


def _probe_base(df: DataFrame, *, block: Column, row_id: str, date: str, amount: str, vname: Column | None = None) -> DataFrame:
    """The narrow projection that ``_pairwise_drop`` works on; rows without a block match nothing."""
    base = df.select(F.col(row_id).alias("rid"), block.alias("blk"), (vname if vname is not None else F.lit("")).alias("vlow"),
                     F.col(date).cast("date").alias("d"), F.abs(F.col(amount)).alias("a"))
    return base.filter(F.col("blk").isNotNull())


def _pairwise_drop(base: DataFrame, *, days: int, tol: float, date_optional: bool, amount_optional: bool,
                   name_pairs: DataFrame | None = None) -> DataFrame:
    """Row ids of ``base(rid, blk, vlow, d, a)`` that have an earlier matching row (EXISTS), as one column.

    A pair matches when blocks are equal, dates are within ``days`` (skipped when
    ``date_optional`` and either date is NULL) and amounts are within ``tol`` of the
    larger (skipped when ``amount_optional`` and either absolute amount is not > 0).
    With ``name_pairs`` (blk, i, j) the names must be a listed pair; without, they must be equal.

    Equal (block, name, date, amount) rows match each other wherever they can match at all, so all but the first
    of them go without a join, and the joins run over distinct tuples with their first row id. Where a test
    is skipped, its column leaves the candidates' key too: rows without a date or an amount, however many,
    meet one candidate a name.
    """
    usable = (F.lit(True) if date_optional else F.col("d").isNotNull()) & (
        F.lit(True) if amount_optional else F.coalesce(F.col("a") > 0, F.lit(False)))
    base = base.filter(usable)
    # read by the joins below: written once, so that they scan it instead of running the upstream plan again
    firsts = written(base.groupBy("blk", "vlow", "d", "a").agg(F.min("rid").alias("rid"), F.count(F.lit(1)).alias("copies")))
    parts, tuples = [], firsts.drop("copies")
    if not firsts.filter("copies > 1").isEmpty():
        parts.append(base.select("rid").join(firsts.select("rid"), "rid", "left_anti"))
    sizes = written(tuples.groupBy("blk").agg(F.count(F.lit(1)).alias("n")).withColumn("c", F.col("n")))
    known = written(spread_join(tuples, sizes, ["blk"], "inner").filter("c > 1"))     # a tuple alone in its block has no partner
    rules = {"days": days, "tol": tol, "date_optional": date_optional, "amount_optional": amount_optional, "name_pairs": name_pairs}
    parts.append(_in_small_blocks(known.filter(F.col("c") <= FEW).drop("c"), **rules))
    parts += _in_large_blocks(known.filter(F.col("c") > FEW).drop("c"), **rules)
    return reduce(DataFrame.unionByName, parts).distinct()


def _in_small_blocks(few: DataFrame, *, days: int, tol: float, date_optional: bool, amount_optional: bool,
                     name_pairs: DataFrame | None) -> DataFrame:
    """``rid`` of the tuples with an earlier match, all tests of a block's pairs being one join condition."""
    both_d = F.col("d").isNotNull() & F.col("c_d").isNotNull()
    both_a = F.coalesce(F.col("a") > 0, F.lit(False)) & F.coalesce(F.col("c_a") > 0, F.lit(False))
    cond = ((F.col("c_rid") < F.col("rid"))
            & F.when(both_d, F.abs(F.datediff(F.col("d"), F.col("c_d"))) <= days).otherwise(F.lit(date_optional))
            & F.when(both_a, _within(F.col("c_a"), F.col("a"), tol)).otherwise(F.lit(amount_optional)))
    j = few
    if name_pairs is None:
        cond = cond & (F.col("vlow") == F.col("c_vlow"))
    else:       # the listed pairs of a block of few names
        listed = (name_pairs.filter("i <> j").join(few.select("blk").distinct(), "blk", "left_semi")
                  .groupBy("blk").agg(F.collect_list(F.struct("i", "j")).alias("listed")))
        j = few.join(listed, "blk", "left")
        pair = F.struct(F.col("c_vlow").alias("i"), F.col("vlow").alias("j"))
        cond = cond & ((F.col("vlow") == F.col("c_vlow")) | F.coalesce(F.array_contains("listed", pair), F.lit(False)))
    i = few.select([F.col(x).alias("c_" + x) for x in few.columns])
    return _semi(j, i, ["blk"], cond).select("rid")


def _in_large_blocks(many: DataFrame, *, days: int, tol: float, date_optional: bool, amount_optional: bool,
                     name_pairs: DataFrame | None) -> list[DataFrame]:
    """Frames of ``rid`` of the tuples with an earlier match, by date and amount buckets; none for no tuples."""
    has_d, has_a = F.col("d").isNotNull(), F.coalesce(F.col("a") > 0, F.lit(False))
    size = many.agg(*[F.count_if(c).alias(n) for n, c in {
        "da": has_d & has_a, "d_": has_d & ~has_a, "_a": ~has_d & has_a, "__": ~has_d & ~has_a}.items()]).first()
    day, log, window = _day(F.col("d")), F.log("a"), _amount_window(tol)
    date_bucket, amount_bucket = _date_bucket(days), _amount_bucket(tol)

    def cands(filt: Column, need_d: bool, need_a: bool) -> DataFrame:
        """Earlier tuples, reduced to the columns that are tested, with their first row id."""
        cols = ["blk", "vlow"] + ["d"] * need_d + ["a"] * need_a
        c = many.filter(filt)
        if not (need_d and need_a):
            c = c.groupBy(*cols).agg(F.min("rid").alias("rid"))
        c = c.select(*cols, F.col("rid").alias("i_rid"))
        if name_pairs is not None:
            c = (c.join(name_pairs.withColumnRenamed("i", "vlow"), ["blk", "vlow"])
                 .drop("vlow").withColumnRenamed("j", "vlow"))
        if need_d:
            c = c.withColumn("db", F.explode(_reach(day, days, date_bucket)))
        if need_a:
            c = c.withColumn("ab", F.explode(_reach(log, window, amount_bucket)))
        return c.select([F.col(x) if x == "i_rid" else F.col(x).alias("c_" + x) for x in c.columns])

    parts = []

    def add(j_filt: Column, i_filt: Column, need_d: bool, need_a: bool, j_cls: tuple, i_cls: tuple):
        # joins with an empty side are not planned at all
        if not sum(size[c] for c in j_cls) or not sum(size[c] for c in i_cls):
            return
        j = many.filter(j_filt)
        if need_d:
            j = j.withColumn("db", date_bucket(day))
        if need_a:
            j = j.withColumn("ab", amount_bucket(log))
        cond = F.col("i_rid") < F.col("rid")
        if need_d:
            cond = cond & (F.abs(F.datediff(F.col("d"), F.col("c_d"))) <= days)
        if need_a:
            cond = cond & _within(F.col("c_a"), F.col("a"), tol)
        keys = ["blk", "vlow"] + ["db"] * need_d + ["ab"] * need_a
        parts.append(_semi(j, cands(i_filt, need_d, need_a), keys, cond).select("rid"))

    # both dates known and both amounts positive: block on date and amount buckets
    add(has_d & has_a, has_d & has_a, True, True, ("da",), ("da",))
    if amount_optional:
        # dates known on both sides, amount test skipped
        add(has_d & ~has_a, has_d, True, False, ("d_",), ("da", "d_"))
        add(has_d & has_a, has_d & ~has_a, True, False, ("da",), ("d_",))
    if date_optional:
        # amounts positive on both sides, date test skipped
        add(~has_d & has_a, has_a, False, True, ("_a",), ("da", "_a"))
        add(has_d & has_a, ~has_d & has_a, False, True, ("da",), ("_a",))
    if date_optional and amount_optional:
        # both tests skipped: block only
        add(~has_d & ~has_a, F.lit(True), False, False, ("__",), ("da", "d_", "_a", "__"))
        add(~has_d & has_a, ~has_a, False, False, ("_a",), ("d_", "__"))
        add(has_d & ~has_a, ~has_d, False, False, ("d_",), ("_a", "__"))
        add(has_d & has_a, ~has_d & ~has_a, False, False, ("da",), ("__",))
    return parts


def _drop_rows(df: DataFrame, dropped: DataFrame, row_id: str) -> DataFrame:
    return df.join(dropped.withColumnRenamed("rid", row_id), row_id, "left_anti")


def normalized_vendor(vendor: str = "vendor") -> Column:
    """Block key of J5: lower-case text, punctuation removed, trimmed (NULL reads 'nan')."""
    v = F.lower(F.coalesce(F.col(vendor).cast("string"), F.lit("nan")))
    return F.trim(F.regexp_replace(v, r"(?U)[^\w\s]", ""))


# ---- J5, J6, J7 ------------------------------------------------------------------------
def fuzzy_vendor_duplicates(df: DataFrame, vendor: str = "vendor", amount: str = "amount", date: str = "date",
                            row_id: str = "row_id", amount_tol: float = 0.05, days: int = 3,
                            name_threshold: float = 0.85) -> DataFrame:
    """Same normalised vendor; amounts within 5 % (skipped if either is 0/NULL);
    dates within 3 days (skipped if either is NULL); name ratio > 0.85."""
    blk = normalized_vendor(vendor)
    vlow = F.lower(F.coalesce(F.col(vendor).cast("string"), F.lit("nan")))
    base = _probe_base(df, block=blk, row_id=row_id, date=date, amount=amount, vname=vlow)
    pairs = written(sequence_ratio_pairs(base.select("blk", "vlow").distinct(), "blk", "vlow", name_threshold))
    dropped = _pairwise_drop(base, days=days, tol=amount_tol, date_optional=True, amount_optional=True, name_pairs=pairs)
    return _drop_rows(df, dropped, row_id)


def date_proximity_duplicates(df: DataFrame, vendor: str = "vendor", amount: str = "amount", date: str = "date",
                              row_id: str = "row_id", days: int = 1, amount_tol: float = 0.10) -> DataFrame:
    """Same vendor, both dates known and within 1 day, both amounts > 0 within 10 %."""
    base = _probe_base(df, block=F.col(vendor), row_id=row_id, date=date, amount=amount)
    dropped = _pairwise_drop(base, days=days, tol=amount_tol, date_optional=False, amount_optional=False)
    return _drop_rows(df, dropped, row_id)


def amount_similarity_duplicates(df: DataFrame, vendor: str = "vendor", amount: str = "amount",
                                 date: str = "date", row_id: str = "row_id", amount_tol: float = 0.02,
                                 days: int = 7) -> DataFrame:
    """Same vendor, both amounts > 0 within 2 %, both dates known within 7 days."""
    base = _probe_base(df, block=F.col(vendor), row_id=row_id, date=date, amount=amount)
    dropped = _pairwise_drop(base, days=days, tol=amount_tol, date_optional=False, amount_optional=False)
    return _drop_rows(df, dropped, row_id)


# ---- A13 ---------------------------------------------------------------------------------
def consolidate_same_day(df: DataFrame, vendor: str = "vendor", date: str = "date", category: str = "category",
                         amount: str = "amount", memo: str = "memo", row_id: str = "row_id",
                         checkpoint: bool = True) -> tuple[DataFrame, DataFrame]:
    """(vendor, day) groups of more than one row whose category values (NULL counts
    as a value) are all equal collapse into their first row: amount = group sum, memo =
    'Consolidated n transactions: m1, m2, m3 (+k more)' over distinct non-null memos in
    order of first appearance (memo unchanged when there are none).

    Returns (consolidated frame, details table). All steps are hash aggregates; the
    three leading memos come from three ``min_by`` rounds, so no group is collected.
    """
    day = F.col(date).cast("date")
    keyed = df.withColumn("_day", day)
    g = ["_gv", "_gd"]
    grp = (keyed.filter(F.col(vendor).isNotNull() & F.col("_day").isNotNull())
           .groupBy(F.col(vendor).alias("_gv"), F.col("_day").alias("_gd"))
           .agg(F.count("*").alias("n"),
                F.count(category).alias("known"), F.min(category).alias("cat"), F.max(category).alias("last"),
                F.coalesce(F.sum(amount), F.lit(0.0)).alias("total"), F.min(row_id).alias("first_id"))
           .filter((F.col("n") > 1) & ((F.col("known") == 0) | ((F.col("known") == F.col("n")) & (F.col("cat") == F.col("last")))))
           .drop("known", "last"))
    # the groups and their rows are read by many joins, which leave the other rows alone
    keep = written if checkpoint else (lambda x: x)
    grp = keep(grp)
    members = keep(keyed.join(grp.select(*g), (F.col(vendor) == F.col("_gv")) & (F.col("_day") == F.col("_gd")), "left_semi")
                   .select(F.col(vendor).alias("_gv"), F.col("_day").alias("_gd"), F.col(memo).alias("_m"), row_id))
    memos = keep(members.filter("_m is not null").groupBy(*g, "_m").agg(F.min(row_id).alias("_mid")))
    picked = []
    remaining = memos
    for k in range(3):
        top = remaining.groupBy(*g).agg(F.min_by("_m", "_mid").alias(f"m{k}"), F.min("_mid").alias(f"id{k}"))
        picked.append(top)
        remaining = remaining.join(top.select(*g, F.col(f"id{k}").alias("_mid")), g + ["_mid"], "left_anti")
    nmem = memos.groupBy(*g).agg(F.count("*").alias("nmemo"))
    info = reduce(lambda x, y: x.join(y, g, "left"), [grp, nmem] + picked)
    shown = F.concat_ws(", ", "m0", "m1", "m2")
    text = F.concat(F.lit("Consolidated "), F.col("n").cast("string"), F.lit(" transactions: "), shown,
                    F.when(F.col("nmemo") > 3, F.concat(F.lit(" (+"), (F.col("nmemo") - 3).cast("string"),
                                                        F.lit(" more)"))).otherwise(F.lit("")))
    upd = info.select(F.col("first_id").alias(row_id), F.col("total").alias("_total"),
                      F.when(F.coalesce(F.col("nmemo"), F.lit(0)) > 0, text).alias("_memo"), *g)
    dropped = members.join(upd.select(row_id), row_id, "left_anti").select(row_id)
    out = (df.join(dropped, row_id, "left_anti")
           .join(upd.drop(*g), row_id, "left")
           .withColumn(amount, F.coalesce(F.col("_total"), F.col(amount)))
           .withColumn(memo, F.coalesce(F.col("_memo"), F.col(memo)))
           .select(*df.columns))
    details = grp.select(F.col("_gv").alias("vendor"), F.col("_gd").cast("string").alias("date"),
                         F.col("n").alias("original_count"), F.col("total").alias("consolidated_amount"),
                         F.coalesce(F.col("cat"), F.lit("Unknown")).alias("category"))
    return out, details


# ---- J8 ------------------------------------------------------------------------------------
def advanced_dedup(df: DataFrame, row_id: str = "row_id", checkpoint: bool = True,
                   **cols) -> tuple[DataFrame, dict[str, DataFrame]]:
    """J1 -> J5 -> J6 -> J7 -> A13, the same at every size.

    Returns the cleaned frame and report tables: ``counts`` (step, rows_after) and
    ``consolidation_details``. With ``checkpoint`` each step's output is written to
    the session's checkpoint folder before the next step reads it.
    """
    step = written if checkpoint else (lambda x: x)
    kw = {k: v for k, v in cols.items() if k in ("vendor", "amount", "date")}
    s1 = step(drop_exact_duplicates(df, row_id))
    s2 = step(fuzzy_vendor_duplicates(s1, row_id=row_id, **kw))
    s3 = step(date_proximity_duplicates(s2, row_id=row_id, **kw))
    s4 = step(amount_similarity_duplicates(s3, row_id=row_id, **kw))
    out, details = consolidate_same_day(s4, row_id=row_id, checkpoint=checkpoint, **cols)
    names = ["input", "exact", "fuzzy_vendor", "date_proximity", "amount_similarity", "consolidated"]
    frames = [df, s1, s2, s3, s4, out]
    counts = reduce(DataFrame.unionByName,
                    [f.agg(F.count("*").alias("rows_after")).withColumn("step", F.lit(n))
                     for n, f in zip(names, frames)])
    return out, {"counts": counts, "consolidation_details": details}
