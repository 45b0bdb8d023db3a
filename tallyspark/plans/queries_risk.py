"""Registered risk-detector queries (R1-R16) with DuckDB oracles.

Compared columns: flag_type, severity, confidence, entity, txn_id, metric, threshold,
expected (doubles rounded to 6 places); the free-text description is not compared
because number formatting differs between engines.
"""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions.fixed_values import HIGH_RISK_PATTERNS, SAFE_VENDORS
from ..operators import risk as R
from ..operators.common import rnd
from .catalog import query

CMP = ["flag_type", "severity", "confidence", "entity", "txn_id", "metric", "threshold", "expected"]


def flags_out(df):
    return df.select("flag_type", "severity", rnd(F.col("confidence"), 6).alias("confidence"), "entity", "txn_id",
                     *[rnd(F.col(c), 6).alias(c) for c in ("metric", "threshold", "expected")])


def _sel(ftype, sev, conf, entity="NULL", txn="NULL", metric="NULL", thr="NULL", exp="NULL"):
    return (f"SELECT '{ftype}' AS flag_type, '{sev}' AS severity, round(CAST({conf} AS DOUBLE), 6) AS confidence, "
            f"CAST({entity} AS VARCHAR) AS entity, CAST({txn} AS BIGINT) AS txn_id, "
            f"round(CAST({metric} AS DOUBLE), 6) AS metric, round(CAST({thr} AS DOUBLE), 6) AS threshold, "
            f"round(CAST({exp} AS DOUBLE), 6) AS expected")


def sql_r1(src):
    return (f"{_sel('amount_outlier', 'HIGH', 'least(0.95, (abs(amount) - (m + 3.0 * s)) / s)', 'vendor', 'row_id', 'abs(amount)', 'm + 3.0 * s')} "
            f"FROM {src}, (SELECT avg(abs(amount)) AS m, stddev_samp(abs(amount)) AS s FROM {src}) st "
            f"WHERE abs(amount) > m + 3.0 * s")


def sql_r2(src):
    b = ("CASE WHEN hi = lo THEN 5 ELSE least(10, greatest(1, CAST(ceil((abs(amount) - lo) / ((hi - lo) / 10)) "
         "AS INTEGER))) END")
    return (f"{_sel('amount_clustering', 'MEDIUM', '0.8', 'b', 'NULL', 'c', 'NULL', 'n / 10')} FROM ("
            f"SELECT b, n, count(*) AS c FROM (SELECT {b} AS b, n FROM {src}, (SELECT min(abs(amount)) AS lo, "
            f"max(abs(amount)) AS hi, count(*) AS n FROM {src}) st WHERE amount IS NOT NULL) GROUP BY b, n) "
            f"WHERE n > 10 AND c > n / 10 * 2")


def sql_r3(src):
    return (f"{_sel('round_number', 'MEDIUM', '0.7', 'vendor', 'row_id', 'x', 't')} FROM ("
            f"SELECT c.* FROM (SELECT l.row_id, l.vendor, abs(l.amount) AS x, t.list, t.t FROM {src} l JOIN ("
            f"SELECT 0 AS list, range * 1000.0 AS t FROM range(1, 11) UNION ALL "
            f"SELECT 1 AS list, range * 5000.0 AS t FROM range(1, 11)) t "
            f"ON abs(l.amount) >= t.t - t.t * 0.1 AND abs(l.amount) <= t.t + t.t * 0.1) c "
            f"JOIN (SELECT list, t FROM (SELECT l.row_id, t.list, t.t FROM {src} l JOIN ("
            f"SELECT 0 AS list, range * 1000.0 AS t FROM range(1, 11) UNION ALL "
            f"SELECT 1 AS list, range * 5000.0 AS t FROM range(1, 11)) t "
            f"ON abs(l.amount) >= t.t - t.t * 0.1 AND abs(l.amount) <= t.t + t.t * 0.1) GROUP BY list, t "
            f"HAVING count(*) > 3 OR t > 5000) k ON c.list = k.list AND c.t = k.t)")


def _count_sql(ftype, sev, cap, key_sql, src_filter, src):
    return (f"{_sel(ftype, sev, f'least({cap}, (c - (m + 2.5 * s)) / s)', 'k', 'NULL', 'c', 'm + 2.5 * s', 'm')} "
            f"FROM (SELECT {key_sql} AS k, count(*) AS c FROM {src} WHERE {src_filter} GROUP BY 1) cc, "
            f"(SELECT avg(c) AS m, stddev_samp(c) AS s FROM (SELECT {key_sql} AS k, count(*) AS c FROM {src} "
            f"WHERE {src_filter} GROUP BY 1)) st WHERE c > m + 2.5 * s")


def sql_r4(src):
    return _count_sql("frequency_anomaly", "HIGH", 0.9, "CAST(date AS DATE)", "date IS NOT NULL", src)


def sql_r5(src, vendor="vendor"):
    return _count_sql("vendor_frequency_anomaly", "MEDIUM", 0.8, vendor,
                      f"date IS NOT NULL AND {vendor} IS NOT NULL", src)


def sql_r6(src):
    return (f"{_sel('weekend_activity', 'MEDIUM', '0.7', 'd', 'NULL', 'c', 'NULL', 'm')} FROM ("
            f"SELECT dayname(date) AS d, count(*) AS c FROM {src} WHERE date IS NOT NULL GROUP BY 1) p, "
            f"(SELECT avg(c) AS m FROM (SELECT dayname(date) AS d, count(*) AS c FROM {src} WHERE date IS NOT NULL "
            f"GROUP BY 1)) st WHERE d IN ('Saturday', 'Sunday') AND c > m * 2.0")


def sql_r7(src):
    return (f"{_sel('after_hours_activity', 'MEDIUM', '0.8', 'NULL', 'NULL', 'c', 'c / n')} FROM ("
            f"SELECT count(*) FILTER (WHERE hour(CAST(date AS TIMESTAMP)) >= 22) AS c, count(*) AS n FROM {src} "
            f"WHERE date IS NOT NULL) WHERE c > 0 AND c / n > 0.1")


def sql_r8(src, vendor="vendor"):
    return (f"{_sel('vendor_concentration', 'HIGH', 'least(0.9, c / n)', vendor, 'NULL', 'c / n', '0.3', 'n')} FROM ("
            f"SELECT {vendor}, count(*) AS c FROM {src} WHERE {vendor} IS NOT NULL GROUP BY 1) p, "
            f"(SELECT count(*) AS n FROM {src}) t WHERE c / n > 0.3")


def _contains_any(col, words):
    return " OR ".join(f"contains(lower({col}), '{w}')" for w in words)


def sql_r9(src, vendor="vendor"):
    return (f"{_sel('unknown_vendor', 'MEDIUM', '0.8', vendor, 'NULL', 'c', 'NULL', 't')} FROM ("
            f"SELECT {vendor}, count(*) AS c, coalesce(sum(abs(amount)), 0.0) AS t FROM {src} "
            f"WHERE {vendor} IS NOT NULL GROUP BY 1) "
            f"WHERE NOT ({_contains_any(vendor, SAFE_VENDORS + HIGH_RISK_PATTERNS)}) AND (c > 5 OR t > 1000)")


def sql_r10(src, vendor="vendor"):
    case = "CASE " + " ".join(f"WHEN contains(lower({vendor}), '{w}') THEN '{w}'" for w in HIGH_RISK_PATTERNS) + " END"
    return (f"{_sel('high_risk_vendor', 'HIGH', '0.9', vendor, 'NULL', 'c')} FROM ("
            f"SELECT {vendor}, count(*) AS c, {case} AS p FROM {src} WHERE {vendor} IS NOT NULL GROUP BY 1) "
            f"WHERE p IS NOT NULL")


def sql_r11(src):
    h = "(epoch_us(nts) - epoch_us(ts)) / 3.6e9"
    return (f"{_sel('sequential_identical_amounts', 'HIGH', '0.8', "concat_ws(' -> ', vendor, nv)", 'row_id', 'a', h)} "
            f"FROM (SELECT row_id, CAST(date AS TIMESTAMP) AS ts, abs(amount) AS a, vendor, "
            f"lead(row_id) OVER w AS nrid, lead(CAST(date AS TIMESTAMP)) OVER w AS nts, lead(abs(amount)) OVER w AS na, "
            f"lead(vendor) OVER w AS nv FROM {src} WHERE date IS NOT NULL "
            f"WINDOW w AS (ORDER BY CAST(date AS TIMESTAMP), row_id)) "
            f"WHERE nrid IS NOT NULL AND a = na AND {h} <= 24")


def sql_r12(src):
    covers = "abs(x - c) / c <= 0.05"
    first = "first_value(row_id) OVER (ORDER BY row_id) AS cr, first_value(x) OVER (ORDER BY row_id) AS c"
    groups = (f"WITH RECURSIVE u AS (SELECT row_id, x, {first} FROM (SELECT row_id, abs(amount) AS x FROM {src} WHERE abs(amount) > 0) "
              f"UNION ALL SELECT row_id, x, {first} FROM u WHERE NOT ({covers})) "
              f"SELECT CAST(cr AS VARCHAR) AS e, c AS centre, count(*) AS n FROM u WHERE {covers} GROUP BY cr, c "
              f"UNION ALL SELECT 'zero', 0.0, count(*) FROM {src} WHERE amount = 0")
    return (f"{_sel('amount_clustering', 'MEDIUM', 'least(0.8, n / 10)', 'e', 'NULL', 'n', 'centre')} "
            f"FROM ({groups}) WHERE n > 3")


def sql_r13(src, vendor="vendor"):
    return (f"{_sel('vendor_amount_consistency', 'MEDIUM', '0.7', vendor, 'NULL', 's', 'NULL', 'm')} FROM ("
            f"SELECT {vendor}, count(*) AS c, avg(abs(amount)) AS m, stddev_samp(abs(amount)) AS s FROM {src} "
            f"WHERE {vendor} IS NOT NULL GROUP BY 1) WHERE c > 2 AND s < m * 0.1")


def sql_all(src):
    return " UNION ALL ".join(f"({f(src)})" for f in (sql_r1, sql_r2, sql_r3, sql_r4, sql_r5, sql_r6, sql_r7, sql_r8,
                                                        sql_r9, sql_r10, sql_r11, sql_r12, sql_r13))


def _reg(name, sql, fn, doc):
    def q(spark, t):
        return flags_out(fn(t))
    q.__doc__ = doc
    query(name, sql)(q)


_reg("r01_amount_outliers", sql_r1("ledger_risky"), lambda t: R.amount_outliers(t("ledger_risky")), "R1 on the ledger with a crowded night, outliers and a dominant vendor.")
_reg("r02_amount_histogram_clusters", sql_r2("ledger_risky"), lambda t: R.amount_histogram_clusters(t("ledger_risky")),
     "R2 on the ledger with a crowded night, outliers and a dominant vendor.")
_reg("r03_round_number_flags", sql_r3("ledger"), lambda t: R.round_number_flags(t("ledger")), "R3 on the ledger.")
_reg("r04_frequency_anomalies", sql_r4("ledger_risky"), lambda t: R.frequency_anomalies(t("ledger_risky")),
     "R4 on the ledger with a crowded night, outliers and a dominant vendor.")
_reg("r05_vendor_frequency_anomalies", sql_r5("ledger"), lambda t: R.vendor_frequency_anomalies(t("ledger")),
     "R5 on the ledger.")
_reg("r06_weekend_activity", sql_r6("ledger_risky"), lambda t: R.weekend_activity(t("ledger_risky")), "R6 on the ledger with a crowded night, outliers and a dominant vendor.")
_reg("r07_after_hours_activity", sql_r7("ledger_risky"), lambda t: R.after_hours_activity(t("ledger_risky")),
     "R7 on the ledger with a crowded night, outliers and a dominant vendor.")
_reg("r08_vendor_concentration", sql_r8("ledger_risky"),
     lambda t: R.vendor_concentration(t("ledger_risky")),
     "R8 on the ledger with a crowded night, outliers and a dominant vendor.")
_reg("r09_unknown_vendors", sql_r9("ledger"), lambda t: R.unknown_vendors(t("ledger")), "R9 on the ledger.")
_reg("r10_high_risk_vendors", sql_r10("ledger_risky"),
     lambda t: R.high_risk_vendors(t("ledger_risky")),
     "R10 on the ledger with a crowded night, outliers and a dominant vendor.")
_reg("r11_sequential_identical_amounts", sql_r11("ledger_events"),
     lambda t: R.sequential_identical_amounts(t("ledger_events")), "R11 on the event ledger (timestamps).")
_reg("r12_amount_leader_clusters", sql_r12("ledger"), lambda t: R.amount_leader_clusters(t("ledger")),
     "R12 on the ledger.")
_reg("r13_vendor_amount_consistency", sql_r13("ledger_risky"),
     lambda t: R.vendor_amount_consistency(t("ledger_risky")),
     "R13 on the ledger with a crowded night, outliers and a dominant vendor.")
_reg("u04_all_flags_risky", sql_all("ledger_risky"), lambda t: R.all_flags(t("ledger_risky")),
     "U4: every detector on a ledger on which all of them find something.")
_reg("r16_all_flags", sql_all("ledger_events"), lambda t: R.all_flags(t("ledger_events")),
     "U4/R16: every detector on the event ledger.")

R14_SQL = f"""WITH fl AS ({sql_all('ledger_events')}),
a AS (SELECT count(*) AS n, sum(CASE severity WHEN 'CRITICAL' THEN 1.0 WHEN 'HIGH' THEN 0.7 WHEN 'MEDIUM' THEN 0.4
        WHEN 'LOW' THEN 0.1 ELSE 0.0 END) AS s,
        count(*) FILTER (WHERE severity = 'CRITICAL') AS critical_risks, count(*) FILTER (WHERE severity = 'HIGH') AS high_risks,
        count(*) FILTER (WHERE severity = 'MEDIUM') AS medium_risks, count(*) FILTER (WHERE severity = 'LOW') AS low_risks
      FROM fl),
b AS (SELECT *, CASE WHEN n > 0 THEN least(1.0, s / n) ELSE 0.0 END AS score FROM a)
SELECT round(score, 6) AS overall_risk_score,
  CASE WHEN score >= 0.7 THEN 'CRITICAL' WHEN score >= 0.5 THEN 'HIGH' WHEN score >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END
    AS risk_level, n AS total_risk_flags, critical_risks, high_risks, medium_risks, low_risks FROM b"""


@query("r14_overall_risk_score", R14_SQL)
def q_r14(spark, t):
    """R14 over all flags of the event ledger."""
    s = R.overall_risk_score(R.all_flags(t("ledger_events")))
    return s.withColumn("overall_risk_score", rnd(F.col("overall_risk_score"), 6))


R15_SQL = f"""WITH fl AS ({sql_all('ledger_events')}),
per AS (SELECT flag_type, count(*) AS n FROM fl GROUP BY 1),
g AS (SELECT CASE flag_type WHEN 'amount_outlier' THEN 0 WHEN 'unknown_vendor' THEN 2
          WHEN 'sequential_identical_amounts' THEN 3 WHEN 'weekend_activity' THEN 4 WHEN 'after_hours_activity' THEN 5 END
          AS rank,
        CASE flag_type WHEN 'amount_outlier' THEN 'Investigate ' || n || ' unusual amount transactions'
          WHEN 'unknown_vendor' THEN 'Review ' || n || ' transactions with unknown vendors'
          WHEN 'sequential_identical_amounts' THEN 'Investigate ' || n || ' sequential identical amount transactions'
          WHEN 'weekend_activity' THEN 'Review ' || n || ' unusual weekend transactions'
          WHEN 'after_hours_activity' THEN 'Review ' || n || ' after-hours transactions' END AS recommendation
      FROM per),
r AS (SELECT rank, recommendation FROM g WHERE recommendation IS NOT NULL
      UNION ALL SELECT 1, 'Review vendor concentration risk with ' || entity || ' (' || format('{{:,.1f}}', metric * 100)
        || '% of transactions)'
        FROM fl WHERE flag_type = 'vendor_concentration')
SELECT rank, recommendation FROM r
UNION ALL SELECT 9, 'Monitor transaction patterns for unusual activity' WHERE (SELECT count(*) FROM r) = 0"""


@query("r15_risk_recommendations", R15_SQL)
def q_r15(spark, t):
    """R15 over all flags of the event ledger (rank, recommendation)."""
    return R.risk_recommendations(R.all_flags(t("ledger_events")))
