"""Registered queries: scalar cleaning, aggregates and insights over the ledger views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import insights as K
from .catalog import query


def money_sql(sql: str) -> str:
    """Expand MONEY_SUM(x) / MONEY_MEAN(x): exact DECIMAL sums, rounded half away from
    zero to cents with integer division (the Spark side does the same in DECIMAL)."""
    import re

    def mean(m):
        x = m.group(1)
        u = f"CAST(sum(CAST({x} AS DECIMAL(38,4))) * 10000 AS HUGEINT)"
        return (f"CAST(sign({u}) * ((abs({u}) * 2 + count({x}) * 100) // (count({x}) * 200)) AS DOUBLE) / 100")

    def tot(m):
        x = m.group(1)
        u = f"CAST(sum(CAST({x} AS DECIMAL(38,4))) * 10000 AS HUGEINT)"
        return f"CAST(sign({u}) * ((abs({u}) * 2 + 100) // 200) AS DOUBLE) / 100"
    sql = re.sub(r"MONEY_MEAN\(([^()]+)\)", mean, sql)
    return re.sub(r"MONEY_SUM\(([^()]+)\)", tot, sql)

# ---------------------------------------------------------------- K9 vendor relationships
K9_SQL = """
WITH p AS (SELECT *, abs(amount) AS abs_amount FROM ledger WHERE date IS NOT NULL AND amount IS NOT NULL),
tot AS (SELECT sum(abs_amount) AS total FROM p),
v AS (SELECT vendor, MONEY_SUM(abs_amount) AS total_spend, count(*) AS transaction_count,
             MONEY_MEAN(abs_amount) AS avg_amount, round(stddev_samp(abs_amount), 2) AS std_amount,
             min(date) AS first_transaction, max(date) AS last_transaction,
             date_diff('day', min(date), max(date)) AS span
      FROM p WHERE vendor IS NOT NULL GROUP BY vendor),
mc AS (SELECT vendor, category FROM (
         SELECT vendor, category, row_number() OVER (PARTITION BY vendor ORDER BY count(*) DESC, category) AS rn
         FROM p WHERE vendor IS NOT NULL AND category IS NOT NULL GROUP BY vendor, category) t WHERE rn = 1),
vm AS (SELECT vendor, date_trunc('month', date) AS m, sum(abs_amount) AS s FROM p WHERE vendor IS NOT NULL GROUP BY 1, 2),
tr AS (SELECT vendor, count(*) AS months, regr_slope(s, idx) AS trend FROM (
         SELECT vendor, s, CAST(row_number() OVER (PARTITION BY vendor ORDER BY m) - 1 AS DOUBLE) AS idx FROM vm) t
       GROUP BY vendor)
SELECT v.vendor AS vendor_name, v.total_spend, v.transaction_count, v.avg_amount, v.std_amount,
       CAST(v.first_transaction AS VARCHAR) AS first_transaction,
       CAST(v.last_transaction AS VARCHAR) AS last_transaction, coalesce(mc.category, 'Unknown') AS primary_category,
       round(least(1.0, v.transaction_count / 50.0), 6) AS relationship_strength,
       CASE WHEN v.total_spend > tot.total * 0.1 THEN 'High' WHEN v.total_spend > tot.total * 0.05 THEN 'Medium'
            ELSE 'Low' END AS risk_level,
       CASE WHEN v.transaction_count < 5 THEN 'Insufficient Data'
            WHEN v.span / (v.transaction_count - 1) <= 7 THEN 'Frequent'
            WHEN v.span / (v.transaction_count - 1) <= 30 THEN 'Monthly'
            WHEN v.span / (v.transaction_count - 1) <= 90 THEN 'Quarterly' ELSE 'Infrequent' END AS payment_pattern,
       concat_ws('; ',
         CASE WHEN v.transaction_count >= 10 AND tr.months >= 3 AND tr.trend > 0 THEN 'Increasing spending trend'
              WHEN v.transaction_count >= 10 AND tr.months >= 3 AND tr.trend < 0 THEN 'Decreasing spending trend' END,
         CASE WHEN v.std_amount > v.avg_amount * 0.5 THEN 'High transaction amount variability' END,
         CASE WHEN v.total_spend > tot.total * 0.05 THEN 'Significant vendor concentration' END) AS insights
FROM v CROSS JOIN tot LEFT JOIN mc ON v.vendor = mc.vendor LEFT JOIN tr ON v.vendor = tr.vendor
WHERE v.transaction_count >= 3
"""


def vendor_relationships_flat(df):
    rel = K.vendor_relationships(df)
    return rel.select("vendor_name", "total_spend", "transaction_count", "avg_amount", "std_amount",
                      "first_transaction", "last_transaction", "primary_category",
                      F.round("relationship_strength", 6).alias("relationship_strength"), "risk_level",
                      "payment_pattern", F.array_join("insights", "; ").alias("insights"))


@query("k09_vendor_relationships", money_sql(K9_SQL))
def q_k9(spark, t):
    """K9 over the ledger view (the flagship query)."""
    return vendor_relationships_flat(t("ledger"))
