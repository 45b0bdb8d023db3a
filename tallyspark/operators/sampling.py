"""Sampling (M1-M8). Reproducible: rows are ordered by ``md5(row_id#seed)`` (ties by
row_id), which any SQL engine can evaluate, instead of a fraction-based Bernoulli draw.

Per-group quotas use ``row_number() <= k``: Spark inserts a per-group limit before the
shuffle (window group limit), so a hot group never ships more than k rows per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import with_scalars
from .quantiles import exact_quantiles


def sample_key(row_id: str = "row_id", seed: int = 42) -> Column:
    return F.md5(F.concat_ws("#", F.col(row_id).cast("string"), F.lit(str(seed))))


def random_sample(df: DataFrame, n: int, row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """M1: n rows in pseudo-random (hash) order (top-n: per-partition then merge)."""
    return df.orderBy(sample_key(row_id, seed), F.col(row_id)).limit(n)


def _quota(df: DataFrame, keys: list, k, row_id: str, seed: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(sample_key(row_id, seed), F.col(row_id))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def stratified_sample(df: DataFrame, n: int, amount: str = "amount", vendor: str = "vendor",
                      row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """M2: strata = amount quartile (thresholds from percentiles, NULL amount reads 0) x
    vendor tier (frequent > 10 rows, moderate > 3, rare); at most n // 12 rows per
    stratum; then the first n by (stratum, hash)."""
    a = F.coalesce(F.col(amount).cast("double"), F.lit(0.0))
    q = exact_quantiles(df, {"_q1": (a, 0.25), "_q2": (a, 0.5), "_q3": (a, 0.75)})
    vc = df.filter(F.col(vendor).isNotNull()).groupBy(vendor).agg(F.count("*").alias("_vc"))
    x = with_scalars(df.join(vc, vendor, "left"), q)
    tier = F.when(a <= F.col("_q1"), 1).when(a <= F.col("_q2"), 2).when(a <= F.col("_q3"), 3).otherwise(4)
    vt = F.coalesce(F.col("_vc"), F.lit(0))
    vtier = F.when(vt > 10, "frequent").when(vt > 3, "moderate").otherwise("rare")
    s = x.withColumn("amount_tier", tier).withColumn("vendor_tier", vtier).drop("_vc", "_q1", "_q2", "_q3")
    picked = _quota(s, ["amount_tier", "vendor_tier"], max(n // 12, 0), row_id, seed)
    return picked.orderBy("amount_tier", "vendor_tier", sample_key(row_id, seed), row_id).limit(n)


def vendor_sample(df: DataFrame, n: int, vendor: str = "vendor", row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """M3: rows of 20 top vendors (by count), 30 pseudo-random vendors and 10 random
    single-row vendors; cut to n by hash order, or topped up with other rows."""
    vc = df.filter(F.col(vendor).isNotNull()).groupBy(vendor).agg(F.count("*").alias("_c"))
    vkey = F.md5(F.concat_ws("#", F.col(vendor), F.lit(str(seed))))
    top = vc.orderBy(F.desc("_c"), F.col(vendor)).limit(20).select(vendor)
    rnd = vc.orderBy(vkey, F.col(vendor)).limit(30).select(vendor)
    rare = vc.filter("_c = 1").orderBy(vkey, F.col(vendor)).limit(10).select(vendor)
    chosen = top.union(rnd).union(rare).distinct()       # at most 60 names
    inside = df.join(F.broadcast(chosen), vendor, "left_semi").withColumn("_pri", F.lit(0))
    outside = df.join(F.broadcast(chosen), vendor, "left_anti").withColumn("_pri", F.lit(1))
    return inside.unionByName(outside).orderBy("_pri", sample_key(row_id, seed), row_id).limit(n).drop("_pri")


def temporal_sample(df: DataFrame, n: int, date: str = "date", row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """M4: equal share per month present (n // months rows each), first n by month.

    The share is a literal of the plan, so Spark cuts every month to it before the shuffle."""
    m = df.filter(F.col(date).isNotNull()).withColumn("_m", F.trunc(F.col(date), "MM"))
    months = m.agg(F.count_distinct("_m")).first()[0]       # one number
    picked = _quota(m, ["_m"], n // max(months, 1), row_id, seed)
    return picked.orderBy("_m", sample_key(row_id, seed), row_id).limit(n).drop("_m")


def high_value_sample(df: DataFrame, n: int, amount: str = "amount", row_id: str = "row_id",
                      seed: int = 42) -> DataFrame:
    """M5: up to n // 2 rows at or above the 90th percentile of |amount|, the rest below."""
    a = F.abs(F.col(amount))
    base = df.filter(a.isNotNull())
    thr = exact_quantiles(base, {"_thr": (a, 0.9)})
    j = with_scalars(base, thr).withColumn("_hi", (a >= F.col("_thr")).cast("int"))
    high = j.filter("_hi = 1").orderBy(sample_key(row_id, seed), row_id).limit(n // 2)
    nh = high.agg(F.count("*").alias("_nh"))
    low = with_scalars(j.filter("_hi = 0"), nh)
    w = Window.orderBy(sample_key(row_id, seed), F.col(row_id))
    low = low.orderBy(sample_key(row_id, seed), row_id).limit(n).withColumn("_rn", F.row_number().over(w)) \
        .filter(F.col("_rn") <= F.lit(n) - F.col("_nh")).drop("_rn", "_nh")
    return high.unionByName(low).drop("_thr", "_hi")


def cluster_samples(df: DataFrame, n: int, **kw) -> DataFrame:
    """M6: vendor, amount and temporal samples of n // 3 rows each, tagged by name."""
    k = n // 3
    row_id = kw.get("row_id", "row_id")
    parts = [vendor_sample(df, k, row_id=row_id).withColumn("sample_name", F.lit("cluster_vendor")),
             high_value_sample(df, k, row_id=row_id).withColumn("sample_name", F.lit("cluster_amount")),
             temporal_sample(df, k, row_id=row_id).withColumn("sample_name", F.lit("cluster_temporal"))]
    return reduce(DataFrame.unionByName, parts)


def hierarchical_samples(df: DataFrame, n: int, row_id: str = "row_id") -> DataFrame:
    """M6: stratified, vendor and plain random samples of n // 3 rows each."""
    k = n // 3
    parts = [stratified_sample(df, k, row_id=row_id).drop("amount_tier", "vendor_tier")
             .withColumn("sample_name", F.lit("level1_representative")),
             vendor_sample(df, k, row_id=row_id).withColumn("sample_name", F.lit("level2_vendors")),
             random_sample(df, k, row_id=row_id).withColumn("sample_name", F.lit("level3_validation"))]
    return reduce(DataFrame.unionByName, parts)


#: Sample types of the three plans; a plan is named by the caller, never by the table's size.
SAMPLE_PLANS = [["stratified", "vendor", "temporal"], ["cluster", "high_value", "representative"], ["hierarchical"]]


def tiered_samples(df: DataFrame, total: int, kinds: list[str], row_id: str = "row_id") -> DataFrame:
    """M7: the named samples, each of total // 3 rows, tagged by sample_name."""
    per = total // 3
    tiers = ["amount_tier", "vendor_tier"]
    makers = {"stratified": lambda: stratified_sample(df, per, row_id=row_id).drop(*tiers),
              "representative": lambda: stratified_sample(df, per, row_id=row_id).drop(*tiers),
              "vendor": lambda: vendor_sample(df, per, row_id=row_id),
              "temporal": lambda: temporal_sample(df, per, row_id=row_id),
              "high_value": lambda: high_value_sample(df, per, row_id=row_id),
              "cluster": lambda: cluster_samples(df, per, row_id=row_id),
              "hierarchical": lambda: hierarchical_samples(df, per, row_id=row_id)}
    unknown = [k for k in kinds if k not in makers]
    if unknown or not kinds:
        raise ValueError(f"unknown sample types: {unknown}")
    parts = [makers[k]() if k in ("cluster", "hierarchical") else makers[k]().withColumn("sample_name", F.lit(k)) for k in kinds]
    return reduce(DataFrame.unionByName, parts)


def scale_patterns(patterns: DataFrame, samples: int, key: str = "pattern_type", sample_col: str = "sample_name") -> DataFrame:
    """M8: patterns seen in at least max(1, samples // 2) of the ``samples`` taken (those without a
    pattern count too), with their consistency (share of samples) and mean impact."""
    per = patterns.groupBy(key).agg(F.count_distinct(sample_col).alias("samples_seen"),
                                    F.avg("impact_score").alias("mean_impact"))
    return (per.where(F.col("samples_seen") >= max(1, samples // 2))
            .withColumn("consistency", F.col("samples_seen") / F.lit(samples)))
