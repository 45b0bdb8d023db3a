"""Registered queries for aggregations (A), windows (W), spending patterns (K), top-k (T)
and set operations (U) over the ledger views, with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import insights as K
from ..operators.common import prepared, r2, rnd
from ..operators.risk import next_in_time
from .catalog import query
from .queries_core import money_sql
from .queries_scalar import PARSED_SQL, parsed_raw

P = "(SELECT *, abs(amount) AS abs_amount FROM ledger WHERE date IS NOT NULL AND amount IS NOT NULL)"


def r6(df, *cols):
    return df.withColumns({c: rnd(F.col(c), 6) for c in cols})


@query("a01_basic_stats", "SELECT count(amount) AS count, round(sum(amount), 2) AS sum, round(avg(amount), 6) AS mean, "
       "max(amount) AS max, min(amount) AS min FROM ledger")
def q_a1(spark, t):
    """A1 on the ledger."""
    return A.basic_stats(t("ledger")).withColumns({"sum": r2(F.col("sum")), "mean": rnd(F.col("mean"), 6)})


@query("a02_category_summary", money_sql("SELECT category, MONEY_SUM(abs_amount) AS sum, count(abs_amount) AS count, "
                                         "MONEY_MEAN(abs_amount) AS mean FROM " + P + " t WHERE category IS NOT NULL "
                                         "GROUP BY category"))
def q_a2(spark, t):
    """A2: spend per market segment (exact cents)."""
    return A.category_summary(prepared(t("ledger")))


@query("a03_category_share", "WITH s AS (SELECT category, sum(abs(amount)) AS s, count(*) AS c FROM ledger_lines "
       "WHERE category IS NOT NULL GROUP BY category) SELECT category, round(s, 2) AS sum, c AS count, "
       "round(s / (SELECT sum(s) FROM s) * 100, 6) AS percentage FROM s")
def q_a3(spark, t):
    """A3: share of line spend per part type."""
    x = A.category_share(t("ledger_lines").withColumn("abs_amount", F.abs("amount")))
    return x.select("category", r2(F.col("sum")).alias("sum"), "count", rnd(F.col("percentage"), 6).alias("percentage"))


@query("a04_vendor_summary", money_sql("""
SELECT vendor, MONEY_SUM(abs_amount) AS total_spend, count(*) AS transaction_count, MONEY_MEAN(abs_amount) AS avg_amount,
  CAST(min(date) AS VARCHAR) AS first_transaction, CAST(max(date) AS VARCHAR) AS last_transaction,
  coalesce(mode(category ORDER BY category), 'Unknown') AS primary_category
FROM """ + P + """ t WHERE vendor IS NOT NULL GROUP BY vendor"""))
def q_a4(spark, t):
    """A4 on the ledger (std compared through K9)."""
    return A.vendor_summary(prepared(t("ledger"))).drop("std_amount")


@query("a05_vendor_top5_fallback", "SELECT vendor, round(sum(amount), 2) AS sum, count(amount) AS count FROM ledger "
       "WHERE vendor IS NOT NULL GROUP BY vendor ORDER BY vendor LIMIT 5")
def q_a5(spark, t):
    """A5: first five vendors by name."""
    return A.vendor_top5_fallback(t("ledger")).withColumn("sum", r2(F.col("sum")))


@query("a06_hhi", "WITH v AS (SELECT vendor, sum(abs(amount)) AS s FROM ledger WHERE vendor IS NOT NULL GROUP BY vendor), "
       "r AS (SELECT s, row_number() OVER (ORDER BY s DESC, vendor) AS rk FROM v) "
       "SELECT round(sum(s * s) / (sum(s) * sum(s)), 9) AS hhi, "
       "round(sum(s) FILTER (WHERE rk <= 5) * 100 / sum(s), 6) AS top_5_percentage, "
       "round(sum(s) FILTER (WHERE rk <= 10) * 100 / sum(s), 6) AS top_10_percentage, count(*) AS vendor_count FROM r")
def q_a6(spark, t):
    """Vendor concentration of the ledger."""
    h = A.hhi(t("ledger").withColumn("abs_amount", F.abs("amount")))
    return h.select(rnd(F.col("hhi"), 9).alias("hhi"), rnd(F.col("top_5_percentage"), 6).alias("top_5_percentage"),
                    rnd(F.col("top_10_percentage"), 6).alias("top_10_percentage"), "vendor_count")


@query("a07_key_metrics", """
WITH p AS """ + P + """, v AS (SELECT vendor, sum(abs_amount) AS s FROM p WHERE vendor IS NOT NULL GROUP BY vendor),
c AS (SELECT category, count(*) AS n FROM p WHERE category IS NOT NULL GROUP BY category),
b AS (SELECT count(*) AS total_transactions, sum(abs_amount) AS total_spend, avg(abs_amount) AS mean_amt,
        median(abs_amount) AS med, count(DISTINCT vendor) AS unique_vendors, count(DISTINCT category) AS unique_categories,
        date_diff('day', min(date), max(date)) AS days,
        sum(CASE WHEN amount > 0 THEN amount ELSE 0.0 END) AS inflow, abs(sum(CASE WHEN amount < 0 THEN amount ELSE 0.0 END)) AS outflow
      FROM p)
SELECT total_transactions, round(total_spend, 2) AS total_spend, round(mean_amt, 6) AS avg_transaction_amount,
  round(med, 6) AS median_transaction_amount, unique_vendors, round((SELECT avg(s) FROM v), 6) AS avg_vendor_spend,
  unique_categories, round((SELECT max(n) FROM c) / total_transactions * 100, 6) AS top_category_percentage,
  days AS analysis_period_days, round(total_transactions / greatest(1, days), 6) AS transactions_per_day,
  round(inflow, 2) AS total_inflow, round(outflow, 2) AS total_outflow, round(inflow - outflow, 2) AS net_cash_flow FROM b""")
def q_a7(spark, t):
    """Headline metrics of the ledger."""
    m = A.key_metrics(t("ledger"))
    return m.select("total_transactions", r2(F.col("total_spend")).alias("total_spend"),
                    rnd(F.col("avg_transaction_amount"), 6).alias("avg_transaction_amount"),
                    rnd(F.col("median_transaction_amount"), 6).alias("median_transaction_amount"),
                    "unique_vendors", rnd(F.col("avg_vendor_spend"), 6).alias("avg_vendor_spend"), "unique_categories",
                    rnd(F.col("top_category_percentage"), 6).alias("top_category_percentage"),
                    F.col("analysis_period_days").cast("long").alias("analysis_period_days"),
                    rnd(F.col("transactions_per_day"), 6).alias("transactions_per_day"),
                    r2(F.col("total_inflow")).alias("total_inflow"), r2(F.col("total_outflow")).alias("total_outflow"),
                    r2(F.col("net_cash_flow")).alias("net_cash_flow"))


CASH_SQL = """
WITH p AS {src}, tot AS (SELECT sum(CASE WHEN amount > 0 THEN amount ELSE 0.0 END) AS cin,
      abs(sum(CASE WHEN amount < 0 THEN amount ELSE 0.0 END)) AS cout, count(*) AS n,
      min(date) AS f, max(date) AS l FROM p),
d AS (SELECT CAST(date AS DATE) AS day, sum(amount) AS net FROM p GROUP BY 1),
di AS (SELECT net, CAST(row_number() OVER (ORDER BY day) - 1 AS DOUBLE) AS idx FROM d),
tr AS (SELECT regr_slope(net, idx) AS slope FROM di),
m AS (SELECT date_trunc('month', date) AS mo, sum(abs_amount) AS o FROM p WHERE amount < 0 GROUP BY 1),
bu AS (SELECT avg(o) AS burn FROM m)
SELECT strftime(f, '%Y-%m') || ' to ' || strftime(l, '%Y-%m') AS period, round(cin - cout, 2) AS net_cash_flow,
  round(cin, 2) AS cash_inflow, round(cout, 2) AS cash_outflow,
  CASE WHEN n < 30 THEN 'Insufficient Data' WHEN slope > 0 THEN 'Improving' WHEN slope < 0 THEN 'Declining' ELSE 'Stable' END
    AS cash_flow_trend,
  round(CASE WHEN cout <> 0 THEN cin / cout END, 6) AS liquidity_ratio,
  round(CASE WHEN cin - cout < 0 AND n >= 30 AND burn > 0 THEN burn END, 4) AS burn_rate,
  round(CASE WHEN cin - cout < 0 AND n >= 30 AND burn > 0 THEN (cin - cout) / burn END, 6) AS runway_months, n AS rows
FROM tot, tr, bu"""


def _cash(df):
    c = A.cash_flow(df)
    return c.select("period", r2(F.col("net_cash_flow")).alias("net_cash_flow"), r2(F.col("cash_inflow")).alias("cash_inflow"),
                    r2(F.col("cash_outflow")).alias("cash_outflow"), "cash_flow_trend",
                    rnd(F.col("liquidity_ratio"), 6).alias("liquidity_ratio"), rnd(F.col("burn_rate"), 4).alias("burn_rate"),
                    rnd(F.col("runway_months"), 6).alias("runway_months"), "rows")


@query("a08_a09_cash_flow", CASH_SQL.format(src=P))
def q_a8(spark, t):
    """A8 + A9 + W4 on the ledger (net outflow: burn rate and runway present)."""
    return _cash(t("ledger"))


@query("a08b_cash_flow_events", CASH_SQL.format(
    src="(SELECT *, abs(amount) AS abs_amount FROM ledger_events WHERE date IS NOT NULL AND amount IS NOT NULL)"))
def q_a8b(spark, t):
    """A8 + A9 + W4 on the event ledger (timestamps)."""
    return _cash(t("ledger_events"))


@query("a10_scaled_cash_flow", "SELECT round(sum(amount), 2) AS net_flow, round(sum(CASE WHEN amount > 0 THEN amount ELSE 0.0 END), 2) "
       "AS inflow, round(sum(CASE WHEN amount < 0 THEN amount ELSE 0.0 END), 2) AS outflow, "
       "CASE WHEN sum(amount) > 0 THEN 'Positive' ELSE 'Negative' END AS trend FROM ledger_lines")
def q_a10(spark, t):
    """A10 over the whole line ledger."""
    s = A.scaled_cash_flow(t("ledger_lines"))
    return s.withColumns({c: r2(F.col(c)) for c in ("net_flow", "inflow", "outflow")})


@query("a11_category_distribution", "WITH c AS (SELECT vendor, category, count(*) AS n FROM ledger_lines WHERE vendor IS NOT NULL "
       "AND category IS NOT NULL GROUP BY 1, 2) SELECT vendor, category, round(n / sum(n) OVER (PARTITION BY vendor), 9) AS share FROM c")
def q_a11(spark, t):
    """Per supplier, the share of lines per part type (map entries as rows)."""
    d = A.category_shares(t("ledger_lines"))
    return d.select("vendor", "category", "share") \
        .withColumn("share", rnd(F.col("share"), 9))


@query("a12_value_counts", "SELECT category, count(*) AS count FROM ledger_events WHERE category IS NOT NULL GROUP BY category")
def q_a12(spark, t):
    """Event types by frequency."""
    return A.value_counts(t("ledger_events"), "category")


@query("a14_weekday_distribution", "WITH d AS (SELECT CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, sum(abs(amount)) AS spend "
       "FROM ledger GROUP BY 1) SELECT day_of_week, round(spend, 2) AS spend, round(spend * 100 / (SELECT sum(spend) FROM d), 6) "
       "AS percentage, day_of_week IN (5, 6) AS is_weekend FROM d")
def q_a14(spark, t):
    """A14 on the ledger."""
    w = A.weekday_distribution(t("ledger").withColumn("abs_amount", F.abs("amount")))
    return w.select("day_of_week", r2(F.col("spend")).alias("spend"), rnd(F.col("percentage"), 6).alias("percentage"),
                    "is_weekend")


@query("a15_monthly_spend", "SELECT CAST(CAST(date_trunc('month', date) AS DATE) AS VARCHAR) AS month, round(sum(abs(amount)), 2) AS value, "
       "CAST(row_number() OVER (ORDER BY date_trunc('month', date)) - 1 AS INTEGER) AS idx FROM ledger GROUP BY date_trunc('month', date)")
def q_a15(spark, t):
    """Monthly spend series of the ledger."""
    m = A.monthly_series(t("ledger").withColumn("abs_amount", F.abs("amount")))
    return m.select("month", r2(F.col("value")).alias("value"), "idx")


@query("a15b_daily_net_flow", "SELECT CAST(CAST(date AS DATE) AS VARCHAR) AS day, round(sum(amount), 2) AS value, "
       "CAST(row_number() OVER (ORDER BY CAST(date AS DATE)) - 1 AS INTEGER) AS idx FROM ledger_events GROUP BY CAST(date AS DATE)")
def q_a15b(spark, t):
    """Daily net flow of the event ledger."""
    d = A.daily_series(t("ledger_events"), value="amount")
    return d.select("day", r2(F.col("value")).alias("value"), "idx")


@query("a16_amount_moments", """
WITH p AS (SELECT abs(amount) AS x FROM ledger WHERE amount IS NOT NULL),
m AS (SELECT avg(x) AS mu, count(*) AS n FROM p)
SELECT round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.5), 6) AS q2, round(quantile_cont(x, 0.75), 6) AS q3,
  round((SELECT avg(power(x - mu, 3)) / power(avg(power(x - mu, 2)), 1.5) FROM p, m), 6) AS skewness,
  round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std FROM p""")
def q_a16(spark, t):
    """Quartiles and population skewness of |amount|."""
    m = A.amount_moments(t("ledger").withColumn("abs_amount", F.abs("amount")))
    return r6(m, "q1", "q2", "q3", "skewness", "mean", "std")


@query("a17_round_number_share", "SELECT count(*) FILTER (WHERE abs(amount) % 100 = 0) AS round_count, count(amount) AS total_transactions, "
       "round(count(*) FILTER (WHERE abs(amount) % 100 = 0) * 100.0 / count(amount), 6) AS round_percentage FROM ledger_lines")
def q_a17(spark, t):
    """Share of line amounts that are multiples of 100."""
    r = A.round_number_share(t("ledger_lines").withColumn("abs_amount", F.abs("amount")))
    return r.withColumn("round_percentage", rnd(F.col("round_percentage"), 6))


@query("a19_completeness", "SELECT round((avg(CASE WHEN date IS NOT NULL THEN 1.0 ELSE 0.0 END) + "
       "avg(CASE WHEN amount IS NOT NULL THEN 1.0 ELSE 0.0 END) + avg(CASE WHEN vendor IS NOT NULL THEN 1.0 ELSE 0.0 END)) / 3, 9) "
       "AS completeness FROM " + PARSED_SQL + " p")
def q_a19(spark, t):
    """A19 on the parsed raw ledger (unparseable text is missing)."""
    return A.completeness(parsed_raw(t)).withColumn("completeness", rnd(F.col("completeness"), 9))


@query("a20_missing_and_duplicates", "SELECT 0 AS null_cells, count(*) AS rows, count(*) FILTER (WHERE amount < 0) AS negative_amounts, "
       "(SELECT count(*) FROM (SELECT DISTINCT * FROM ledger_lines)) AS distinct_rows, "
       "count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ledger_lines)) AS duplicate_rows, 'Complete' AS missing_risk, "
       "CASE WHEN count(*) > (SELECT count(*) FROM (SELECT DISTINCT * FROM ledger_lines)) THEN 'Duplicates present' "
       "ELSE 'No duplicates' END AS duplicate_risk FROM ledger_lines")
def q_a20(spark, t):
    """A20 on the line ledger."""
    return A.missing_and_duplicates(t("ledger_lines"))


@query("a21_date_range", "SELECT CAST(min(date) AS VARCHAR) AS start, CAST(max(date) AS VARCHAR) AS \"end\", count(date) AS count, "
       "CAST(min(date) AS VARCHAR) || ' to ' || CAST(max(date) AS VARCHAR) AS label, date_diff('day', min(date), max(date)) AS days "
       "FROM ledger")
def q_a21(spark, t):
    """A21 on the ledger."""
    return A.date_range(t("ledger")).withColumn("days", F.col("days").cast("long"))


# ---------------------------------------------------------------- windows
@query("w01_payment_interval", "SELECT vendor, count(*) AS n, round(CASE WHEN count(*) > 1 THEN date_diff('day', min(date), max(date)) "
       "/ (count(*) - 1) END, 6) AS avg_interval_days, CASE WHEN count(*) < 5 THEN 'Insufficient Data' "
       "WHEN date_diff('day', min(date), max(date)) / (count(*) - 1) <= 7 THEN 'Frequent' "
       "WHEN date_diff('day', min(date), max(date)) / (count(*) - 1) <= 30 THEN 'Monthly' "
       "WHEN date_diff('day', min(date), max(date)) / (count(*) - 1) <= 90 THEN 'Quarterly' ELSE 'Infrequent' END AS payment_pattern "
       "FROM ledger WHERE vendor IS NOT NULL AND date IS NOT NULL GROUP BY vendor")
def q_w1(spark, t):
    """Mean days between a vendor's payments."""
    return K.payment_interval(t("ledger")).withColumn("avg_interval_days", rnd(F.col("avg_interval_days"), 6))


@query("w03_spending_trend", """
WITH p AS """ + P + """, d AS (SELECT CAST(date AS DATE) AS day, sum(abs_amount) AS s FROM p GROUP BY 1),
di AS (SELECT s, CAST(row_number() OVER (ORDER BY day) - 1 AS DOUBLE) AS idx FROM d)
SELECT (SELECT count(*) FROM p) AS rows, round(regr_slope(s, idx), 4) AS trend_coefficient, round(avg(s), 4) AS daily_mean,
  round(stddev_samp(s), 4) AS daily_std, round(min(s), 2) AS daily_min, round(max(s), 2) AS daily_max FROM di""")
def q_w3(spark, t):
    """Least-squares slope of daily spend."""
    s = K.spending_trend(t("ledger"))
    return s.select("rows", rnd(F.col("trend_coefficient"), 4).alias("trend_coefficient"),
                    rnd(F.col("daily_mean"), 4).alias("daily_mean"), rnd(F.col("daily_std"), 4).alias("daily_std"),
                    r2(F.col("daily_min")).alias("daily_min"), r2(F.col("daily_max")).alias("daily_max"))


@query("w05_vendor_trend", "WITH vm AS (SELECT vendor, date_trunc('month', date) AS m, sum(abs(amount)) AS s FROM ledger "
       "WHERE vendor IS NOT NULL GROUP BY 1, 2), vi AS (SELECT vendor, s, CAST(row_number() OVER (PARTITION BY vendor ORDER BY m) - 1 "
       "AS DOUBLE) AS idx FROM vm) SELECT vendor, count(*) AS months, CASE WHEN count(*) < 2 THEN NULL WHEN regr_slope(s, idx) > 0 THEN 1 "
       "WHEN regr_slope(s, idx) < 0 THEN -1 WHEN regr_slope(s, idx) = 0 THEN 0 END AS trend_sign FROM vi GROUP BY vendor")
def q_w5(spark, t):
    """Direction of each vendor's monthly spend trend."""
    v = K.vendor_trend(t("ledger").withColumn("abs_amount", F.abs("amount")))
    return v.select("vendor", "months", F.signum("trend").cast("int").alias("trend_sign"))


@query("w06_next_in_time", "SELECT row_id AS rid, lead(row_id) OVER w AS next_rid, lead(abs(amount)) OVER w AS next_abs "
       "FROM ledger_events WHERE date IS NOT NULL WINDOW w AS (ORDER BY date, row_id)")
def q_w6(spark, t):
    """Next event of the global time order, computed per hour with bucket links."""
    n = next_in_time(t("ledger_events").withColumn("abs", F.abs("amount")), cols=("abs",))
    return n.select("rid", "next_rid", F.col("next_abs").alias("next_abs"))


@query("w07_seasonality", """
WITH m AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, sum(abs(amount)) AS spend FROM ledger WHERE date IS NOT NULL
           AND amount IS NOT NULL GROUP BY 1)
SELECT count(*) AS months, round(avg(spend), 4) AS mean, round(stddev_samp(spend), 4) AS std,
  CAST(arg_min(month, (-spend, month)) AS VARCHAR) AS peak_month, CAST(arg_min(month, (spend, month)) AS VARCHAR) AS low_month,
  round(CASE WHEN avg(spend) > 0 THEN stddev_samp(spend) / avg(spend) ELSE 0.0 END, 6) AS variation_coefficient FROM m""")
def q_w7(spark, t):
    """Monthly seasonality of the ledger."""
    s = K.seasonality(t("ledger"))
    return s.select("months", rnd(F.col("mean"), 4).alias("mean"), rnd(F.col("std"), 4).alias("std"), "peak_month",
                    "low_month", rnd(F.col("variation_coefficient"), 6).alias("variation_coefficient"))


# ---------------------------------------------------------------- patterns K1-K8, K10-K12
def patterns_out(df):
    return df.select("pattern_type", rnd(F.col("confidence"), 6).alias("confidence"),
                     rnd(F.col("impact_score"), 6).alias("impact_score"))


@query("k01_k08_spending_patterns", """
WITH p AS """ + P + """,
m AS (SELECT date_trunc('month', date) AS mo, sum(abs_amount) AS s FROM p GROUP BY 1),
k1 AS (SELECT 'Seasonal Variation' AS pattern_type, least(0.9, 0.5 + cv) AS confidence, cv AS impact_score FROM (
        SELECT count(*) AS n, CASE WHEN avg(s) > 0 THEN stddev_samp(s) / avg(s) ELSE 0.0 END AS cv FROM m) WHERE n >= 3 AND cv > 0.3),
c AS (SELECT category, sum(abs_amount) AS s FROM p WHERE category IS NOT NULL GROUP BY 1),
k2 AS (SELECT 'Category Concentration' AS pattern_type, 0.8 AS confidence, s / (SELECT sum(s) FROM c) AS impact_score
       FROM (SELECT * FROM c ORDER BY s DESC, category LIMIT 3)),
r AS (SELECT count(*) FILTER (WHERE abs_amount % 100 = 0) * 100.0 / count(*) AS pct FROM p),
k3 AS (SELECT 'Round Number Spending' AS pattern_type, 0.9 AS confidence, pct / 100 AS impact_score FROM r WHERE pct > 20),
mu AS (SELECT avg(abs_amount) AS mu FROM p),
sk AS (SELECT avg(power(abs_amount - mu, 3)) / power(avg(power(abs_amount - mu, 2)), 1.5) AS sk FROM p, mu),
k4 AS (SELECT 'Amount Distribution' AS pattern_type, 0.7 AS confidence, abs(sk) / 3 AS impact_score FROM sk WHERE abs(sk) > 1.5),
w AS (SELECT sum(CASE WHEN isodow(date) IN (6, 7) THEN abs_amount ELSE 0.0 END) AS we, sum(abs_amount) AS tot FROM p),
k5 AS (SELECT 'Weekend Spending' AS pattern_type, 0.8 AS confidence, we / tot AS impact_score FROM w WHERE tot > 0 AND we * 100 / tot > 30),
d AS (SELECT CAST(date AS DATE) AS day, sum(abs_amount) AS s FROM p GROUP BY 1),
di AS (SELECT s, CAST(row_number() OVER (ORDER BY day) - 1 AS DOUBLE) AS idx FROM d),
ts AS (SELECT regr_slope(s, idx) AS sl, avg(s) AS mean, stddev_samp(s) AS sd FROM di),
k6 AS (SELECT 'Spending Trend' AS pattern_type, 0.7 AS confidence, CASE WHEN mean > 0 THEN abs(sl) / mean ELSE 0.0 END AS impact_score
       FROM ts WHERE (SELECT count(*) FROM p) >= 30 AND abs(sl) > sd * 0.1),
v AS (SELECT vendor, sum(abs_amount) AS s FROM p WHERE vendor IS NOT NULL GROUP BY 1),
k7 AS (SELECT 'Vendor Concentration' AS pattern_type, 0.9 AS confidence, h AS impact_score FROM (
        SELECT sum(s * s) / (sum(s) * sum(s)) AS h FROM v) WHERE h > 0.25),
st AS (SELECT avg(abs_amount) AS mu, stddev_samp(abs_amount) AS sd, count(*) AS n FROM p),
an AS (SELECT count(*) AS a FROM p, st WHERE sd > 0 AND abs((abs_amount - mu) / sd) > 2.0),
k8 AS (SELECT 'Spending Anomalies' AS pattern_type, 0.8 AS confidence, a * 100.0 / n / 100 AS impact_score FROM an, st WHERE a > 0)
SELECT pattern_type, round(confidence, 6) AS confidence, round(impact_score, 6) AS impact_score FROM (
  SELECT * FROM k1 UNION ALL SELECT * FROM k2 UNION ALL SELECT * FROM k3 UNION ALL SELECT * FROM k4 UNION ALL
  SELECT * FROM k5 UNION ALL SELECT * FROM k6 UNION ALL SELECT * FROM k7 UNION ALL SELECT * FROM k8)""")
def q_k1(spark, t):
    """K1-K8: every spending pattern detector on the ledger."""
    return patterns_out(K.spending_patterns(t("ledger")))


@query("k10_recommendations")
def q_k10(spark, t):
    """Recommendation rules over the ledger's metrics."""
    return K.recommendations(t("ledger"))


@query("k11_insight_risk_flags")
def q_k11(spark, t):
    """Cash-flow and concentration risk rules over the ledger."""
    return K.insight_risk_flags(t("ledger"))


@query("k12_opportunities")
def q_k12(spark, t):
    """Opportunities over the ledger."""
    return K.opportunities(t("ledger"))


@query("k14_minimal_insights", "SELECT count(amount) AS count, round(sum(amount), 2) AS sum, round(avg(amount), 6) AS mean, "
       "max(amount) AS max, min(amount) AS min FROM ledger_lines")
def q_k14(spark, t):
    """Totals only, over the line ledger."""
    m = K.minimal_insights(t("ledger_lines"))
    return m.withColumns({"sum": r2(F.col("sum")), "mean": rnd(F.col("mean"), 6)})


# ---------------------------------------------------------------- top-k, sort, set operations
@query("t01_top_categories", "SELECT category, round(sum(abs(amount)), 2) AS spend FROM ledger_lines GROUP BY category "
       "ORDER BY sum(abs(amount)) DESC, category LIMIT 5")
def q_t1(spark, t):
    """Five part types with the most spend."""
    l = t("ledger_lines")
    g = l.groupBy("category").agg(F.sum(F.abs("amount")).alias("_s"))
    return g.orderBy(F.desc("_s"), "category").limit(5).select("category", r2(F.col("_s")).alias("spend"))


@query("t02_top_vendors", "SELECT vendor, round(sum(abs(amount)), 2) AS spend FROM ledger GROUP BY vendor "
       "ORDER BY sum(abs(amount)) DESC, vendor LIMIT 10")
def q_t2(spark, t):
    """Ten vendors with the most spend."""
    g = t("ledger").groupBy("vendor").agg(F.sum(F.abs("amount")).alias("_s"))
    return g.orderBy(F.desc("_s"), "vendor").limit(10).select("vendor", r2(F.col("_s")).alias("spend"))


@query("t04_high_value_transactions", "SELECT row_id, vendor, amount FROM ledger ORDER BY abs(amount) DESC, row_id LIMIT 5")
def q_t4(spark, t):
    """T4: five largest transactions."""
    return t("ledger").orderBy(F.desc(F.abs("amount")), "row_id").limit(5).select("row_id", "vendor", "amount")


@query("t05_sorted_vendor_relationships", money_sql("SELECT vendor AS vendor_name, MONEY_SUM(abs_amount) AS total_spend FROM " + P +
                                                    " t WHERE vendor IS NOT NULL GROUP BY vendor HAVING count(*) >= 3 "
                                                    "ORDER BY 2 DESC, 1"))
def q_t5(spark, t):
    """T5: all vendor relationships by spend."""
    return K.vendor_relationships(t("ledger")).select("vendor_name", "total_spend").orderBy(F.desc("total_spend"), "vendor_name")


@query("t06_t07_head_sorted", "SELECT row_id, CAST(date AS VARCHAR) AS date, amount FROM ledger ORDER BY date, amount, row_id LIMIT 20")
def q_t6(spark, t):
    """First 20 rows in (date, amount) order."""
    return t("ledger").orderBy("date", "amount", "row_id").limit(20).select("row_id", "date", "amount")


@query("u01_union_all", "SELECT 'ledger' AS src, count(*) AS n FROM ledger UNION ALL SELECT 'dups', count(*) FROM ledger_dups "
       "UNION ALL SELECT 'all', (SELECT count(*) FROM ledger) + (SELECT count(*) FROM ledger_dups)")
def q_u1(spark, t):
    """Union of ledger and ledger_dups, counted per source and in total."""
    a = t("ledger").withColumn("src", F.lit("ledger"))
    b = t("ledger_dups").withColumn("src", F.lit("dups"))
    u = a.unionByName(b)
    per = u.groupBy("src").agg(F.count("*").alias("n"))
    return per.unionByName(u.agg(F.count("*").alias("n")).withColumn("src", F.lit("all")))


@query("u02_union_distinct", "SELECT vendor FROM ledger UNION SELECT vendor FROM ledger_dups")
def q_u2(spark, t):
    """Distinct union of the vendors of two tables."""
    return t("ledger").select("vendor").union(t("ledger_dups").select("vendor")).distinct()


@query("u03_difference", "SELECT row_id FROM ledger_dups EXCEPT ALL SELECT row_id FROM ledger")
def q_u3(spark, t):
    """Rows of ledger_dups that are not in ledger (multiset difference)."""
    return t("ledger_dups").select("row_id").exceptAll(t("ledger").select("row_id"))
