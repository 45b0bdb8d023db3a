"""Aggregations (A1-A12, A14-A21). All are grouped or global aggregates, so Spark does a
map-side partial aggregation and shuffles only one row per group per task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import money_mean, money_sum, prepared, r2, safe_div, with_scalars
from .quantiles import exact_quantiles


def basic_stats(df: DataFrame, amount: str = "amount") -> DataFrame:
    """A1: count, sum, mean, max, min of the amount."""
    a = F.col(amount)
    return df.agg(F.count(a).alias("count"), F.sum(a).alias("sum"), F.avg(a).alias("mean"),
                  F.max(a).alias("max"), F.min(a).alias("min"))


def category_summary(df: DataFrame, category: str = "category", value: str = "abs_amount") -> DataFrame:
    """A2: sum, count, mean of ``value`` per category (rounded to 2)."""
    v = F.col(value)
    return (df.filter(F.col(category).isNotNull()).groupBy(category)
            .agg(money_sum(v).alias("sum"), F.count(v).alias("count"), money_mean(v).alias("mean")))


def category_share(df: DataFrame, category: str = "category", value: str = "abs_amount") -> DataFrame:
    """A3: per category total and percent of the grand total."""
    per = (df.filter(F.col(category).isNotNull()).groupBy(category)
           .agg(F.sum(value).alias("sum"), F.count(value).alias("count"), F.avg(value).alias("mean")))
    tot = per.agg(F.sum("sum").alias("_total"))
    return with_scalars(per, tot).withColumn("percentage", F.col("sum") / F.col("_total") * 100).drop("_total")


def vendor_summary(df: DataFrame, vendor: str = "vendor", date: str = "date", category: str = "category",
                   value: str = "abs_amount") -> DataFrame:
    """A4: per vendor sum, count, mean, sample std, first/last date and modal category
    (smallest value among ties, 'Unknown' when none), rounded to 2 before use."""
    v = F.col(value)
    return (df.filter(F.col(vendor).isNotNull()).groupBy(vendor).agg(
        money_sum(v).alias("total_spend"), F.count(v).alias("transaction_count"),
        money_mean(v).alias("avg_amount"), r2(F.stddev_samp(v)).alias("std_amount"),
        F.min(date).alias("first_transaction"), F.max(date).alias("last_transaction"),
        F.coalesce(F.mode(category, True), F.lit("Unknown")).alias("primary_category")))


def vendor_top5_fallback(df: DataFrame, vendor: str = "vendor", amount: str = "amount", n: int = 5) -> DataFrame:
    """A5: sum and count per vendor for the first ``n`` vendors in name order."""
    return (df.filter(F.col(vendor).isNotNull()).groupBy(vendor)
            .agg(F.sum(amount).alias("sum"), F.count(amount).alias("count")).orderBy(vendor).limit(n))


def hhi(df: DataFrame, vendor: str = "vendor", value: str = "abs_amount") -> DataFrame:
    """Herfindahl index of vendor spend shares, top-5 and top-10 share (%), vendor count.

    Two-level aggregation: per-vendor sums (one row per vendor), then one global pass
    where the top-k sums come from ``max_by``-free ranking on the vendor table."""
    per = df.filter(F.col(vendor).isNotNull()).groupBy(vendor).agg(F.sum(value).alias("spend"))
    # top-10 via TakeOrderedAndProject (per-partition top-k, then a 10-row merge)
    top = (per.orderBy(F.desc("spend"), F.col(vendor)).limit(10)
           .withColumn("_rk", F.row_number().over(Window.orderBy(F.desc("spend"), F.col(vendor)))))
    tops = top.agg(F.sum(F.when(F.col("_rk") <= 5, F.col("spend"))).alias("_t5"),
                   F.sum("spend").alias("_t10"))
    totals = per.agg(F.sum(F.pow(F.col("spend"), 2)).alias("_sq"), F.sum("spend").alias("_tot"),
                     F.count("*").alias("vendor_count"))
    return with_scalars(totals, tops).select(
        safe_div(F.col("_sq"), F.col("_tot") * F.col("_tot")).alias("hhi"),
        safe_div(F.col("_t5") * 100, F.col("_tot")).alias("top_5_percentage"),
        safe_div(F.col("_t10") * 100, F.col("_tot")).alias("top_10_percentage"),
        F.col("vendor_count"))


def key_metrics(df: DataFrame, vendor: str = "vendor", category: str = "category", date: str = "date",
                amount: str = "amount") -> DataFrame:
    """One row with the 13 headline metrics over prepared rows."""
    p = prepared(df, date, amount)
    base = p.agg(
        F.count("*").alias("total_transactions"), F.sum("abs_amount").alias("total_spend"),
        F.avg("abs_amount").alias("avg_transaction_amount"),
        F.count_distinct(vendor).alias("unique_vendors"), F.count_distinct(category).alias("unique_categories"),
        F.datediff(F.max(F.col(date).cast("date")), F.min(F.col(date).cast("date"))).alias("analysis_period_days"),
        F.sum(F.when(F.col(amount) > 0, F.col(amount)).otherwise(0.0)).alias("total_inflow"),
        F.abs(F.sum(F.when(F.col(amount) < 0, F.col(amount)).otherwise(0.0))).alias("total_outflow"),
    )
    per_vendor = (p.filter(F.col(vendor).isNotNull()).groupBy(vendor).agg(F.sum("abs_amount").alias("s"))
                  .agg(F.avg("s").alias("avg_vendor_spend")))
    top_cat = (p.filter(F.col(category).isNotNull()).groupBy(category).count()
               .agg(F.max("count").alias("_top")))
    median = exact_quantiles(p, {"median_transaction_amount": (F.col("abs_amount"), 0.5)})
    m = with_scalars(with_scalars(with_scalars(base, per_vendor), top_cat), median)
    return m.select(
        "total_transactions", "total_spend", "avg_transaction_amount", "median_transaction_amount",
        "unique_vendors", "avg_vendor_spend", "unique_categories",
        (F.col("_top") / F.col("total_transactions") * 100).alias("top_category_percentage"),
        "analysis_period_days",
        (F.col("total_transactions") / F.greatest(F.lit(1), F.col("analysis_period_days"))).alias("transactions_per_day"),
        "total_inflow", "total_outflow", (F.col("total_inflow") - F.col("total_outflow")).alias("net_cash_flow"))


def daily_series(df: DataFrame, date: str = "date", value: str = "abs_amount", name: str = "value") -> DataFrame:
    """One row per calendar day present, summed ``value``, with its 0-based position."""
    d = df.groupBy(F.col(date).cast("date").alias("day")).agg(F.sum(value).alias(name))
    return d.withColumn("idx", F.row_number().over(Window.orderBy("day")) - 1)


def monthly_series(df: DataFrame, date: str = "date", value: str = "abs_amount", name: str = "value") -> DataFrame:
    """One row per month present (first day of month), summed ``value``, position."""
    m = df.groupBy(F.trunc(F.col(date), "MM").alias("month")).agg(F.sum(value).alias(name))
    return m.withColumn("idx", F.row_number().over(Window.orderBy("month")) - 1)


def cash_flow(df: DataFrame, date: str = "date", amount: str = "amount") -> DataFrame:
    """A8 + A9 + W4: inflow, outflow, net, liquidity ratio (NULL = infinite), trend of the
    daily net flow, burn rate and runway (only when net < 0 and at least 30 rows)."""
    p = prepared(df, date, amount)
    a = F.col(amount)
    tot = p.agg(F.sum(F.when(a > 0, a).otherwise(0.0)).alias("cash_inflow"),
                F.abs(F.sum(F.when(a < 0, a).otherwise(0.0))).alias("cash_outflow"),
                F.count("*").alias("n"), F.min(date).alias("_first"), F.max(date).alias("_last"))
    trend = daily_series(p, date, amount, "net").agg(F.regr_slope("net", "idx").alias("_slope"))
    burn = (monthly_series(p.filter(a < 0), date, "abs_amount", "out")
            .agg(F.avg("out").alias("_burn")))
    m = with_scalars(with_scalars(tot, trend), burn)
    net = F.col("cash_inflow") - F.col("cash_outflow")
    enough = F.col("n") >= 30
    burn_rate = F.when((net < 0) & enough & (F.col("_burn") > 0), F.col("_burn"))
    return m.select(
        F.concat_ws(" to ", F.date_format("_first", "yyyy-MM"), F.date_format("_last", "yyyy-MM")).alias("period"),
        net.alias("net_cash_flow"), "cash_inflow", "cash_outflow",
        F.when(~enough, F.lit("Insufficient Data")).when(F.col("_slope") > 0, F.lit("Improving"))
         .when(F.col("_slope") < 0, F.lit("Declining")).otherwise(F.lit("Stable")).alias("cash_flow_trend"),
        safe_div(F.col("cash_inflow"), F.col("cash_outflow")).alias("liquidity_ratio"),
        burn_rate.alias("burn_rate"),
        (net / burn_rate).alias("runway_months"),
        F.col("n").alias("rows"))


def scaled_cash_flow(df: DataFrame, amount: str = "amount") -> DataFrame:
    """A10: full-table net / inflow / outflow and Positive/Negative trend."""
    a = F.col(amount)
    return df.agg(F.sum(a).alias("net_flow"), F.sum(F.when(a > 0, a).otherwise(0.0)).alias("inflow"),
                  F.sum(F.when(a < 0, a).otherwise(0.0)).alias("outflow")) \
        .withColumn("trend", F.when(F.col("net_flow") > 0, "Positive").otherwise("Negative"))


def category_shares(df: DataFrame, vendor: str = "vendor", category: str = "category") -> DataFrame:
    """A11 in long form: (vendor, category, count, share of the vendor's rows with a category). A vendor's total comes
    from an aggregate of the counts, joined back; nothing is gathered a vendor."""
    counts = df.filter(F.col(vendor).isNotNull() & F.col(category).isNotNull()).groupBy(vendor, category).count()
    totals = counts.groupBy(vendor).agg(F.sum("count").alias("_n"))
    return counts.join(totals, vendor).withColumn("share", F.col("count") / F.col("_n")).drop("_n")


def category_distribution(df: DataFrame, vendor: str = "vendor", category: str = "category") -> DataFrame:
    """Per vendor, share of rows per (non-null) category as a MAP, from ``category_shares``. A map has an entry a
    category; where a vendor may have very many, use the long form."""
    shares = category_shares(df, vendor, category)
    return shares.groupBy(vendor).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(category), F.col("share")))))
        .alias("category_distribution"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Frequency of each non-null value, most frequent first."""
    return df.filter(F.col(col).isNotNull()).groupBy(col).count().orderBy(F.desc("count"), F.col(col))


def weekday_distribution(df: DataFrame, date: str = "date", value: str = "abs_amount") -> DataFrame:
    """Spend per weekday (Monday = 0) and its percent of the total, with weekend flag."""
    per = df.groupBy(F.weekday(date).alias("day_of_week")).agg(F.sum(value).alias("spend"))
    tot = per.agg(F.sum("spend").alias("_t"))
    return (with_scalars(per, tot)
            .withColumn("percentage", safe_div(F.col("spend") * 100, F.col("_t")))
            .withColumn("is_weekend", F.col("day_of_week").isin(5, 6)).drop("_t"))


def amount_moments(df: DataFrame, value: str = "abs_amount") -> DataFrame:
    """Quartiles (linear interpolation), population skewness, mean, sample std."""
    v = F.col(value)
    rest = df.agg(F.skewness(v).alias("skewness"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))
    quartiles = exact_quantiles(df, {"q1": (v, 0.25), "q2": (v, 0.5), "q3": (v, 0.75)})
    return with_scalars(rest, quartiles).select("q1", "q2", "q3", "skewness", "mean", "std")


def round_number_share(df: DataFrame, value: str = "abs_amount") -> DataFrame:
    """Percent of rows whose absolute amount is a multiple of 100."""
    v = F.col(value)
    return df.agg(F.count_if(F.pmod(v, F.lit(100.0)) == 0).alias("round_count"), F.count(v).alias("total_transactions")) \
        .withColumn("round_percentage", F.col("round_count") / F.col("total_transactions") * 100)


def quality_report(original: DataFrame, cleaned: DataFrame, category: str = "category", date: str = "date",
                   amount: str = "amount", vendor: str = "vendor") -> DataFrame:
    """before/after counts, categorised share and valid dates/amounts/vendors."""
    o = original.agg(F.count("*").alias("original_rows"))
    uncategorised = F.col(category).isNull() | F.lower(F.col(category)).isin("", "unknown", "uncategorized", "other")
    c = cleaned.agg(
        F.count("*").alias("cleaned_rows"),
        F.count_if(~uncategorised).alias("categorized"), F.count_if(uncategorised).alias("uncategorized"),
        F.count(date).alias("valid_dates"), F.count_if(F.col(date).isNull()).alias("invalid_dates"),
        F.count(amount).alias("valid_amounts"), F.count(vendor).alias("valid_vendors"))
    m = with_scalars(o, c)
    return m.withColumns({
        "duplicates_removed": F.col("original_rows") - F.col("cleaned_rows"),
        "categorization_rate": safe_div(F.col("categorized") * 100.0, F.col("cleaned_rows")),
    })


def completeness(df: DataFrame, cols=("date", "amount", "vendor")) -> DataFrame:
    """Mean non-null rate over the given columns."""
    rates = [F.avg(F.col(c).isNotNull().cast("double")) for c in cols]
    return df.agg((sum(rates, F.lit(0.0)) / len(cols)).alias("completeness"))


def missing_and_duplicates(df: DataFrame, amount: str = "amount") -> DataFrame:
    """Null cells, duplicate rows (rows - distinct rows), negative amounts, labels."""
    nulls = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    stats = df.agg(nulls.alias("null_cells"), F.count("*").alias("rows"),
                   F.count_if(F.col(amount) < 0).alias("negative_amounts"))
    distinct = df.distinct().agg(F.count("*").alias("distinct_rows"))
    m = with_scalars(stats, distinct).withColumn("duplicate_rows", F.col("rows") - F.col("distinct_rows"))
    return m.withColumns({
        "missing_risk": F.when(F.col("null_cells") > 0, "Missing data present").otherwise("Complete"),
        "duplicate_risk": F.when(F.col("duplicate_rows") > 0, "Duplicates present").otherwise("No duplicates"),
    })


def date_range(df: DataFrame, date: str = "date") -> DataFrame:
    """Min..max label, total days, row count with a date."""
    d = F.col(date).cast("date")
    return df.agg(F.min(d).alias("start"), F.max(d).alias("end"), F.count(d).alias("count")) \
        .withColumns({"label": F.concat_ws(" to ", F.col("start").cast("string"), F.col("end").cast("string")),
                      "days": F.datediff("end", "start")})
