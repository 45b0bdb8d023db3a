"""Risk detectors (R1-R16). Every detector returns rows of one ``risk_flags`` schema:

    flag_type, severity, confidence, entity, txn_id, metric, threshold, expected, description

Global statistics are one-row aggregates attached with a size-1 broadcast equi-join;
range rules generate their candidate keys arithmetically (no nested-loop joins).
"""

from __future__ import annotations

import bisect
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.fixed_values import (FREQUENCY_SIGMAS, HIGH_RISK_PATTERNS, OUTLIER_SIGMAS, ROUND_TARGETS,
                                      ROUND_TOLERANCE, SAFE_VENDORS, SEVERITY_WEIGHTS, TEMPORAL_FACTOR,
                                      VENDOR_CONCENTRATION)
from ..session import cut_lineage, written
from .common import with_scalars

FLAG_COLUMNS = ["flag_type", "severity", "confidence", "entity", "txn_id", "metric", "threshold", "expected",
                "description"]


def _flags(df: DataFrame, ftype: str, severity: str, confidence: Column, *, entity: Column | None = None,
           txn_id: Column | None = None, metric: Column | None = None, threshold: Column | None = None,
           expected: Column | None = None, description: Column | None = None) -> DataFrame:
    def nz(c, t):
        return (c if c is not None else F.lit(None)).cast(t)
    return df.select(F.lit(ftype).alias("flag_type"), F.lit(severity).alias("severity"),
                     confidence.cast("double").alias("confidence"), nz(entity, "string").alias("entity"),
                     nz(txn_id, "long").alias("txn_id"), nz(metric, "double").alias("metric"),
                     nz(threshold, "double").alias("threshold"), nz(expected, "double").alias("expected"),
                     nz(description, "string").alias("description"))


def _money(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, 2))


# ---- R1 -----------------------------------------------------------------------------------
def amount_outliers(df: DataFrame, amount: str = "amount", vendor: str = "vendor", row_id: str = "row_id",
                    sigmas: float = OUTLIER_SIGMAS) -> DataFrame:
    """|amount| > mean + 3 * sample std (of |amount|)."""
    x = F.abs(F.col(amount))
    st = df.agg(F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"))
    j = with_scalars(df.select(F.col(row_id), F.col(vendor), x.alias("_x")), st)
    thr = F.col("_m") + sigmas * F.col("_s")
    hit = j.filter(F.col("_x") > thr)
    return _flags(hit, "amount_outlier", "HIGH", F.least(F.lit(0.95), (F.col("_x") - thr) / F.col("_s")),
                  entity=F.col(vendor), txn_id=F.col(row_id), metric=F.col("_x"), threshold=thr,
                  description=F.concat(F.lit("Unusual amount: "), _money(F.col("_x")), F.lit(" (threshold: "),
                                       _money(thr), F.lit(")")))


# ---- R2 -----------------------------------------------------------------------------------
def amount_histogram_clusters(df: DataFrame, amount: str = "amount", bins: int = 10) -> DataFrame:
    """R2: with more than 10 rows, any of 10 equal-width, right-closed bins of |amount|
    holding more than twice the expected share (rows / 10)."""
    x = F.abs(F.col(amount))
    st = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.count("*").alias("_n"))
    w = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(w == 0, F.lit((bins + 1) // 2)).otherwise(
        F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil((F.col("_x") - F.col("_lo")) / w).cast("int"))))
    binned = with_scalars(df.select(x.alias("_x")).filter(F.col("_x").isNotNull()), st).withColumn("_b", b)
    per = binned.groupBy("_b", "_lo", "_hi", "_n").agg(F.count("*").alias("_c"))
    exp = F.col("_n") / bins
    hit = per.filter((F.col("_n") > 10) & (F.col("_c") > exp * 2))
    lo = F.col("_lo") + (F.col("_b") - 1) * (F.col("_hi") - F.col("_lo")) / bins
    hi = F.col("_lo") + F.col("_b") * (F.col("_hi") - F.col("_lo")) / bins
    return _flags(hit, "amount_clustering", "MEDIUM", F.lit(0.8), entity=F.col("_b").cast("string"),
                  metric=F.col("_c"), expected=exp,
                  description=F.concat(F.lit("Unusual amount clustering: "), F.col("_c").cast("string"),
                                       F.lit(" transactions in range ("), F.format_number(lo, 2), F.lit(", "),
                                       F.format_number(hi, 2), F.lit("]")))


# ---- R3 -----------------------------------------------------------------------------------
def round_number_flags(df: DataFrame, amount: str = "amount", vendor: str = "vendor", row_id: str = "row_id",
                       tolerance: float = ROUND_TOLERANCE) -> DataFrame:
    """|amount| within +-10 % of a round target (k * 1000 up to 10 000, k * 5000 up to
    50 000). A target is flagged when more than 3 rows are near it or it exceeds 5000;
    a row near several targets is flagged once per target.

    Candidate targets of a row follow from arithmetic (at most a few k per base), so
    rows are exploded to their candidates and counted per target: no range join."""
    x = F.abs(F.col(amount))
    parts = []
    for list_no, (base, top) in enumerate(ROUND_TARGETS):
        kmax = int(top / base)
        k_lo = F.greatest(F.lit(1), F.floor(x / (base * (1 + tolerance))).cast("int"))
        k_hi = F.least(F.lit(kmax), F.ceil(x / (base * (1 - tolerance))).cast("int"))
        cand = (df.select(F.col(row_id), F.col(vendor), x.alias("_x"), k_lo.alias("_klo"), k_hi.alias("_khi"))
                .filter(F.col("_x").isNotNull() & (F.col("_klo") <= F.col("_khi")))
                .withColumn("_k", F.explode(F.sequence("_klo", "_khi")))
                .withColumn("_t", (F.col("_k") * base).cast("double"))
                .filter((F.col("_x") >= F.col("_t") - F.col("_t") * tolerance)
                        & (F.col("_x") <= F.col("_t") + F.col("_t") * tolerance))
                .withColumn("_list", F.lit(list_no)))
        parts.append(cand)
    cand = reduce(DataFrame.unionByName, parts)
    counts = cand.groupBy("_list", "_t").agg(F.count("*").alias("_c"))
    keep = counts.filter((F.col("_c") > 3) | (F.col("_t") > 5000))
    hit = cand.join(F.broadcast(keep), ["_list", "_t"])   # at most 20 targets
    return _flags(hit, "round_number", "MEDIUM", F.lit(0.7), entity=F.col(vendor), txn_id=F.col(row_id),
                  metric=F.col("_x"), threshold=F.col("_t"),
                  description=F.concat(F.lit("Suspicious round number: "), _money(F.col("_x")),
                                       F.lit(" (close to "), _money(F.col("_t")), F.lit(")")))


# ---- R4, R5 ---------------------------------------------------------------------------------
def _count_anomalies(counts: DataFrame, key: str, ftype: str, severity: str, cap: float, label: Column,
                     sigmas: float) -> DataFrame:
    st = counts.agg(F.avg("_c").alias("_m"), F.stddev_samp("_c").alias("_s"))
    j = with_scalars(counts, st)
    thr = F.col("_m") + sigmas * F.col("_s")
    hit = j.filter(F.col("_c") > thr)
    return _flags(hit, ftype, severity, F.least(F.lit(cap), (F.col("_c") - thr) / F.col("_s")),
                  entity=F.col(key).cast("string"), metric=F.col("_c"), threshold=thr, expected=F.col("_m"),
                  description=label)


def frequency_anomalies(df: DataFrame, date: str = "date", sigmas: float = FREQUENCY_SIGMAS) -> DataFrame:
    """Days whose row count exceeds mean + 2.5 * std of daily counts."""
    counts = df.filter(F.col(date).isNotNull()).groupBy(F.col(date).cast("date").alias("_day")) \
        .agg(F.count("*").alias("_c"))
    label = F.concat(F.lit("Unusual transaction frequency: "), F.col("_c").cast("string"),
                     F.lit(" transactions on "), F.col("_day").cast("string"), F.lit(" (avg: "),
                     F.format_number(F.col("_m"), 1), F.lit(")"))
    return _count_anomalies(counts, "_day", "frequency_anomaly", "HIGH", 0.9, label, sigmas)


def vendor_frequency_anomalies(df: DataFrame, vendor: str = "vendor", date: str = "date",
                               sigmas: float = FREQUENCY_SIGMAS) -> DataFrame:
    """Vendors (rows with a date) whose count exceeds mean + 2.5 * std of vendor counts."""
    counts = df.filter(F.col(date).isNotNull() & F.col(vendor).isNotNull()).groupBy(vendor) \
        .agg(F.count("*").alias("_c"))
    label = F.concat(F.lit("Unusual vendor frequency: "), F.col(vendor), F.lit(" has "), F.col("_c").cast("string"),
                     F.lit(" transactions (avg: "), F.format_number(F.col("_m"), 1), F.lit(")"))
    return _count_anomalies(counts, vendor, "vendor_frequency_anomaly", "MEDIUM", 0.8, label, sigmas)


# ---- R6, R7 ---------------------------------------------------------------------------------
def weekend_activity(df: DataFrame, date: str = "date", factor: float = TEMPORAL_FACTOR) -> DataFrame:
    """Saturday / Sunday row count above twice the mean count of the weekdays present."""
    per = df.filter(F.col(date).isNotNull()).groupBy(F.date_format(date, "EEEE").alias("_day")) \
        .agg(F.count("*").alias("_c"))
    st = per.agg(F.avg("_c").alias("_m"))
    hit = with_scalars(per, st).filter(F.col("_day").isin("Saturday", "Sunday") & (F.col("_c") > F.col("_m") * factor))
    return _flags(hit, "weekend_activity", "MEDIUM", F.lit(0.7), entity=F.col("_day"), metric=F.col("_c"),
                  expected=F.col("_m"),
                  description=F.concat(F.lit("Unusual "), F.col("_day"), F.lit(" activity: "),
                                       F.col("_c").cast("string"), F.lit(" transactions (avg: "),
                                       F.format_number(F.col("_m"), 1), F.lit(")")))


def after_hours_activity(df: DataFrame, date: str = "date", share: float = 0.1) -> DataFrame:
    """Share of rows at 22:00 or later above 10 %."""
    st = df.filter(F.col(date).isNotNull()).agg(
        F.count_if(F.hour(F.col(date).cast("timestamp")) >= 22).alias("_c"), F.count("*").alias("_n"))
    ratio = F.col("_c") / F.col("_n")
    hit = st.filter((F.col("_c") > 0) & (ratio > share))
    return _flags(hit, "after_hours_activity", "MEDIUM", F.lit(0.8), metric=F.col("_c"), threshold=ratio,
                  description=F.concat(F.lit("Unusual after-hours activity: "), F.col("_c").cast("string"),
                                       F.lit(" transactions after 10 PM ("),
                                       F.format_number(ratio * 100, 1), F.lit("% of total)")))


# ---- R8, R9, R10 ------------------------------------------------------------------------------
def vendor_concentration(df: DataFrame, vendor: str = "vendor", threshold: float = VENDOR_CONCENTRATION
                         ) -> DataFrame:
    """Vendors holding more than 30 % of all rows."""
    per = df.filter(F.col(vendor).isNotNull()).groupBy(vendor).agg(F.count("*").alias("_c"))
    tot = df.agg(F.count("*").alias("_n"))
    conc = F.col("_c") / F.col("_n")
    hit = with_scalars(per, tot).filter(conc > threshold)
    return _flags(hit, "vendor_concentration", "HIGH", F.least(F.lit(0.9), conc), entity=F.col(vendor),
                  metric=conc, threshold=F.lit(threshold), expected=F.col("_n"),
                  description=F.concat(F.lit("High vendor concentration: "), F.col(vendor), F.lit(" represents "),
                                       F.format_number(conc * 100, 1), F.lit("% of transactions")))


def _any_contains(lower: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [lower.contains(w) for w in words])


def unknown_vendors(df: DataFrame, vendor: str = "vendor", amount: str = "amount") -> DataFrame:
    """Vendors matching no known name (safe or high-risk lists) with more than 5 rows
    or more than 1000 in total absolute amount."""
    per = df.filter(F.col(vendor).isNotNull()).groupBy(vendor).agg(
        F.count("*").alias("_c"), F.coalesce(F.sum(F.abs(F.col(amount))), F.lit(0.0)).alias("_t"))
    low = F.lower(F.col(vendor))
    hit = per.filter(~_any_contains(low, SAFE_VENDORS + HIGH_RISK_PATTERNS)
                     & ((F.col("_c") > 5) | (F.col("_t") > 1000)))
    return _flags(hit, "unknown_vendor", "MEDIUM", F.lit(0.8), entity=F.col(vendor), metric=F.col("_c"),
                  expected=F.col("_t"),
                  description=F.concat(F.lit("Unknown vendor: "), F.col(vendor), F.lit(" ("),
                                       F.col("_c").cast("string"), F.lit(" transactions)")))


def high_risk_vendors(df: DataFrame, vendor: str = "vendor") -> DataFrame:
    """Vendors containing a high-risk word; the first word of the list is reported."""
    per = df.filter(F.col(vendor).isNotNull()).groupBy(vendor).agg(F.count("*").alias("_c"))
    low = F.lower(F.col(vendor))
    first = reduce(lambda acc, w: acc.when(low.contains(w), F.lit(w)), HIGH_RISK_PATTERNS[1:],
                   F.when(low.contains(HIGH_RISK_PATTERNS[0]), F.lit(HIGH_RISK_PATTERNS[0])))
    hit = per.withColumn("_p", first).filter(F.col("_p").isNotNull())
    return _flags(hit, "high_risk_vendor", "HIGH", F.lit(0.9), entity=F.col(vendor), metric=F.col("_c"),
                  description=F.concat(F.lit("High-risk vendor pattern detected: "), F.col(vendor),
                                       F.lit(" ("), F.col("_p"), F.lit(")")))


# ---- R11 (W6) -----------------------------------------------------------------------------------
def next_in_time(df: DataFrame, date: str = "date", row_id: str = "row_id", cols=("amount", "vendor")) -> DataFrame:
    """Each row with the next row of the global (time, row_id) order.

    A global window would be one task. Rows are range-partitioned by (time, row_id), so a day that holds a
    third of them is split too; each partition finds its own next rows, and its last row is
    handed the first row of the next partition that has any: a table of one row a partition."""
    base = df.filter(F.col(date).isNotNull()).select(
        F.col(row_id).alias("rid"), F.col(date).cast("timestamp").alias("ts"), *[F.col(c).alias(c) for c in cols])
    # written once: the ranges must be the same for the rows and for the edges
    ranged = cut_lineage(base.repartitionByRange("ts", "rid").withColumn("_part", F.spark_partition_id()))
    names = ["rid", "ts", *cols]
    w = Window.partitionBy("_part").orderBy("ts", "rid")
    inner = ranged.withColumn("_next", F.lead(F.struct(*names)).over(w))
    firsts = ranged.groupBy("_part").agg(F.min_by(F.struct(*names), F.struct("ts", "rid")).alias("_first"))
    edges = firsts.select("_part", F.lead("_first").over(Window.orderBy("_part")).alias("_edge"))
    out = inner.join(F.broadcast(edges), "_part").withColumn("_next", F.coalesce("_next", "_edge"))
    return out.select(*names, *[F.col("_next")[c].alias(f"next_{c}") for c in names])


def sequential_identical_amounts(df: DataFrame, date: str = "date", amount: str = "amount", vendor: str = "vendor",
                                 row_id: str = "row_id", hours: float = 24) -> DataFrame:
    """Consecutive rows in time order with equal |amount| no more than 24 h apart."""
    n = next_in_time(df.withColumn("_abs", F.abs(F.col(amount))), date, row_id, cols=("_abs", vendor))
    diff_h = (F.unix_micros(F.col("next_ts")) - F.unix_micros(F.col("ts"))) / 3.6e9
    hit = n.filter(F.col("next_rid").isNotNull() & (F.col("_abs") == F.col("next__abs")) & (diff_h <= hours))
    return _flags(hit, "sequential_identical_amounts", "HIGH", F.lit(0.8),
                  entity=F.concat_ws(" -> ", F.col(vendor), F.col(f"next_{vendor}")), txn_id=F.col("rid"),
                  metric=F.col("_abs"), threshold=diff_h,
                  description=F.concat(F.lit("Sequential identical amounts: "), _money(F.col("_abs")),
                                       F.lit(" within "), F.format_number(diff_h, 1), F.lit(" hours")))


# ---- R12, R13 -------------------------------------------------------------------------------------
def leader_centres(amounts: DataFrame, tolerance: float = 0.05) -> list[tuple[int, float]]:
    """Centres of the greedy leader clustering of ``amounts(x, first)``, distinct positive amounts with the first
    row that has each: taken in row order, an amount that no centre has within ``tolerance`` of itself becomes one.

    Two centres are more than ``tolerance`` apart, so there are at most log(max / min) / log(1 + tolerance) + 1 of them,
    however many the rows; the same holds for the narrow buckets of amounts whose earliest rows are looked
    at. A round settles every such row that no unknown earlier row can reach and drops the amounts it
    covers: a few rounds for rows in any mixed order, at most one a centre for rows sorted by amount."""
    narrow = 16 / math.log(1 + tolerance)
    left = cut_lineage(amounts.select("x", "first", F.floor(F.log("x") * narrow).cast("long").alias("b")))
    centres: list[tuple[int, float]] = []
    while True:
        seen = sorted((r["first"], r["x"], r["b"]) for r in left.groupBy("b").agg(
            F.min("first").alias("first"), F.min_by("x", "first").alias("x")).collect())
        if not seen:
            return sorted(centres)
        new: list[float] = []
        unsure: set[int] = set()
        for first, x, b in seen:
            reach = range(math.floor(math.log(x / (1 + tolerance)) * narrow) - 1, math.floor(math.log(x / (1 - tolerance)) * narrow) + 2)
            at = bisect.bisect_left(new, x)
            if any(abs(x - c) / c <= tolerance for c in new[max(0, at - 1):at + 1]) or not unsure.isdisjoint(reach):
                unsure.add(b)       # covered, or an earlier row that isn't known yet may cover it
            else:
                new.insert(at, x)
                centres.append((first, x))
        near = F.broadcast(left.sparkSession.createDataFrame([(c, k) for c in new for k in range(
            math.floor(math.log(c * (1 - tolerance)) * narrow) - 1, math.floor(math.log(c * (1 + tolerance)) * narrow) + 2)], "c double, cb long"))
        covered = (F.col("b") == F.col("cb")) & (F.abs(F.col("x") - F.col("c")) / F.col("c") <= tolerance)
        left = cut_lineage(left.join(near, covered, "left_anti"))


def amount_leader_clusters(df: DataFrame, amount: str = "amount", row_id: str = "row_id", tolerance: float = 0.05,
                           min_size: int = 3) -> DataFrame:
    """Greedy leader clusters of |amount| in the order of ``row_id``: an amount joins the first centre that
    has it within 5 % of the centre, or becomes one; clusters of more than 3 rows are flagged, each known by
    the row of its centre. Zeros, which no ratio reaches, are a cluster of their own; infinite amounts are left out."""
    x = F.abs(F.col(amount)).cast("double")
    per = cut_lineage(df.select(x.alias("x"), F.col(row_id).alias("rid")).filter("x is not null and x < double('infinity')")
                      .groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("first")))
    centres = leader_centres(per.filter("x > 0").select("x", "first"), tolerance)
    width = math.log(1 + tolerance)
    # a centre lies in the bucket of each amount it covers, or in one beside it
    table = F.broadcast(df.sparkSession.createDataFrame(
        [(first, c, math.floor(math.log(c) / width) + k) for first, c in centres for k in (-2, -1, 0, 1, 2)], f"crow {per.schema['first'].dataType.simpleString()}, c double, cb long"))
    joined = per.filter("x > 0").withColumn("b", F.floor(F.log("x") / width).cast("long")).join(
        table, (F.col("b") == F.col("cb")) & (F.abs(F.col("x") - F.col("c")) / F.col("c") <= tolerance))
    own = joined.groupBy("x").agg(F.first("n").alias("n"), F.min(F.struct("crow", "c")).alias("centre"))
    sums = own.groupBy("centre").agg(F.sum("n").alias("_c")).select(
        F.col("centre.crow").cast("string").alias("_e"), "_c", F.col("centre.c").alias("_centre"))
    zero = per.filter("x = 0").select(F.lit("zero").alias("_e"), F.col("n").alias("_c"), F.col("x").alias("_centre"))
    hit = sums.unionByName(zero).filter(F.col("_c") > min_size)
    return _flags(hit, "amount_clustering", "MEDIUM", F.least(F.lit(0.8), F.col("_c") / 10),
                  entity=F.col("_e"), metric=F.col("_c"), threshold=F.col("_centre"),
                  description=F.concat(F.lit("Amount clustering: "), F.col("_c").cast("string"),
                                       F.lit(" transactions around "), _money(F.col("_centre"))))


def vendor_amount_consistency(df: DataFrame, vendor: str = "vendor", amount: str = "amount") -> DataFrame:
    """Vendors with more than 2 rows whose |amount| sample std < 10 % of the mean."""
    x = F.abs(F.col(amount))
    per = df.filter(F.col(vendor).isNotNull()).groupBy(vendor).agg(
        F.count("*").alias("_c"), F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"))
    hit = per.filter((F.col("_c") > 2) & (F.col("_s") < F.col("_m") * 0.1))
    return _flags(hit, "vendor_amount_consistency", "MEDIUM", F.lit(0.7), entity=F.col(vendor),
                  metric=F.col("_s"), expected=F.col("_m"),
                  description=F.concat(F.lit("Unusual amount consistency for "), F.col(vendor), F.lit(": "),
                                       F.col("_c").cast("string"), F.lit(" transactions with low variance")))


# ---- R14, R15, R16 ---------------------------------------------------------------------------------
def all_flags(df: DataFrame, date: str = "date", amount: str = "amount", vendor: str = "vendor",
              row_id: str = "row_id") -> DataFrame:
    """U4: every detector's flags as one table. The four columns they read are written once, so that the detectors
    scan that narrow table and the plan above ``df`` runs once."""
    df = written(df.select(date, amount, vendor, row_id))
    parts = [amount_outliers(df, amount, vendor, row_id), amount_histogram_clusters(df, amount),
             round_number_flags(df, amount, vendor, row_id), frequency_anomalies(df, date),
             vendor_frequency_anomalies(df, vendor, date), weekend_activity(df, date),
             after_hours_activity(df, date), vendor_concentration(df, vendor), unknown_vendors(df, vendor, amount),
             high_risk_vendors(df, vendor), sequential_identical_amounts(df, date, amount, vendor, row_id),
             amount_leader_clusters(df, amount, row_id), vendor_amount_consistency(df, vendor, amount)]
    return reduce(DataFrame.unionByName, parts)


def overall_risk_score(flags: DataFrame) -> DataFrame:
    """Weighted severity score (min 1), level and counts per severity."""
    w = F.coalesce(*[F.when(F.col("severity") == k, F.lit(v)) for k, v in SEVERITY_WEIGHTS.items()], F.lit(0.0))
    agg = flags.agg(F.count("*").alias("total_risk_flags"), F.sum(w).alias("_s"),
                    *[F.count_if(F.col("severity") == k).alias(f"{k.lower()}_risks") for k in SEVERITY_WEIGHTS])
    score = F.when(F.col("total_risk_flags") > 0,
                   F.least(F.lit(1.0), F.col("_s") / F.col("total_risk_flags"))).otherwise(F.lit(0.0))
    return agg.select(
        score.alias("overall_risk_score"),
        F.when(score >= 0.7, "CRITICAL").when(score >= 0.5, "HIGH").when(score >= 0.3, "MEDIUM")
         .otherwise("LOW").alias("risk_level"),
        "total_risk_flags", "critical_risks", "high_risks", "medium_risks", "low_risks")


def risk_recommendations(flags: DataFrame) -> DataFrame:
    """Recommendations by flag type (one per vendor for concentration flags)."""
    per = flags.groupBy("flag_type").agg(F.count("*").alias("n"))
    counted = {"amount_outlier": "Investigate {} unusual amount transactions",
               "unknown_vendor": "Review {} transactions with unknown vendors",
               "sequential_identical_amounts": "Investigate {} sequential identical amount transactions",
               "weekend_activity": "Review {} unusual weekend transactions",
               "after_hours_activity": "Review {} after-hours transactions"}
    order = {"amount_outlier": 0, "vendor_concentration": 1, "unknown_vendor": 2,
             "sequential_identical_amounts": 3, "weekend_activity": 4, "after_hours_activity": 5}
    text = reduce(lambda acc, kv: acc.when(F.col("flag_type") == kv[0],
                                           F.format_string(kv[1].replace("{}", "%d"), F.col("n"))),
                  list(counted.items())[1:],
                  F.when(F.col("flag_type") == "amount_outlier",
                         F.format_string(counted["amount_outlier"].replace("{}", "%d"), F.col("n"))))
    rank = reduce(lambda acc, kv: acc.when(F.col("flag_type") == kv[0], F.lit(kv[1])), list(order.items())[1:],
                  F.when(F.col("flag_type") == "amount_outlier", F.lit(0)))
    general = per.select(rank.alias("rank"), text.alias("recommendation")).filter(F.col("recommendation").isNotNull())
    conc = flags.filter(F.col("flag_type") == "vendor_concentration").select(
        F.lit(1).alias("rank"),
        F.concat(F.lit("Review vendor concentration risk with "), F.col("entity"), F.lit(" ("),
                 F.format_number(F.col("metric") * 100, 1), F.lit("% of transactions)")).alias("recommendation"))
    recs = general.unionByName(conc)
    fallback = recs.agg(F.count("*").alias("_n")).filter(F.col("_n") == 0).select(
        F.lit(9).alias("rank"), F.lit("Monitor transaction patterns for unusual activity").alias("recommendation"))
    return recs.unionByName(fallback)


def assess_risk(df: DataFrame, **cols) -> dict[str, DataFrame]:
    """Flags, overall score and recommendations; the flags, few rows, are written once and read by all three."""
    flags = cut_lineage(all_flags(df, **cols))
    return {"flags": flags, "score": overall_risk_score(flags), "recommendations": risk_recommendations(flags)}
