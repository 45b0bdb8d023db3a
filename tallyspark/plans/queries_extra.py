"""Registered queries for the remaining inventory rows: A18, H17-H19, K13, B13, B15, V5,
X1/X2 and S3."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.fixed_values import MAPPER_PATTERNS, PRESERVE_PATTERN
from ..functions.similarity import sequence_ratio, token_sort_ratio
from ..operators import accounts as B
from ..operators import mapping as H
from ..operators.common import rnd
from .catalog import ORACLES, RAW_SQL, query, with_views
from .queries_enrich import CONTENT_SQL, HDR_SQL, MAPPED, STATISTICS_SQL, _all_profiles_sql, headers, raw_with_text


@query("a18_quality_report")
def q_a18(spark, t):
    """Raw ledger before / after transaction cleaning (P25)."""
    from ..operators.aggregates import quality_report
    from .composites import clean_transactions
    raw = raw_with_text(t)
    cleaned, _ = clean_transactions(raw)
    return quality_report(raw, cleaned)


H17_SQL = f"""WITH p AS ({_all_profiles_sql()}),
pats AS (SELECT * FROM (VALUES {", ".join(f"({fi}, '{f}', {pi}, '{x}')" for fi, (f, xs) in enumerate(MAPPER_PATTERNS.items())
                                          for pi, x in enumerate(xs))}) AS v(fo, field, po, pattern)),
h9 AS (SELECT source_file, "column", arg_min(field, (-score, fo, po)) AS field FROM (
         SELECT source_file, "column", field, fo, po, length(pattern) / length("column") AS score FROM p JOIN pats
           ON regexp_matches(lower("column"), pattern)) GROUP BY 1, 2 HAVING max(score) > 0.3),
v AS (SELECT source_file, "column", field, 1 AS o FROM h9 UNION ALL
      SELECT source_file, "column", {CONTENT_SQL} AS f, 2 FROM p WHERE f IS NOT NULL UNION ALL
      SELECT source_file, "column", {STATISTICS_SQL} AS f, 3 FROM p WHERE f IS NOT NULL),
n AS (SELECT source_file, "column", field, count(*) AS n, min(o) AS o FROM v GROUP BY 1, 2, 3),
b AS (SELECT source_file, "column", arg_min(field, (-n, o)) AS field, max(n) / sum(n) AS share FROM n GROUP BY 1, 2),
c AS (SELECT source_file, "column", field, share + CASE
        WHEN contains("column", 'reference') AND contains("column", 'number') THEN CASE WHEN field = 'reference' THEN 0.5 ELSE -0.3 END
        WHEN contains("column", 'memo') OR contains("column", 'notes') OR contains("column", 'comment')
          THEN CASE WHEN field = 'memo' THEN 0.3 ELSE -0.2 END
        WHEN contains("column", 'description') THEN CASE WHEN field = 'memo' THEN 0.2 ELSE -0.1 END ELSE 0.0 END AS confidence FROM b)
SELECT source_file, "column", field, round(confidence, 6) AS confidence FROM c WHERE confidence >= 0.4"""


def _mapped(t):
    return {name: t(name).select(*cols) for name, (cols, _) in MAPPED.items()}


@query("h17_combine_mappings", H17_SQL)
def q_h17(spark, t):
    """Votes of the header patterns, the contents and the statistics of three tables, combined per column."""
    votes, _ = H.mapping_votes(_mapped(t))
    out = H.combine_mappings(votes.filter("method <> 'semantic'"))
    return out.select("source_file", "column", "field", rnd(F.col("confidence"), 6).alias("confidence"))


@query("h18_resolve_mapping")
def q_h18(spark, t):
    """The whole mapper on three tables, one column a field (no SQL for the string ratio of H16)."""
    return H.map_columns_enhanced(_mapped(t)).withColumn("score", rnd(F.col("score"), 6))


@query("h19_preserve_columns", "SELECT source_file, position, \"column\" FROM " + HDR_SQL + " h "
       "WHERE regexp_matches(\"column\", '" + PRESERVE_PATTERN + "')")
def q_h19(spark, t):
    """Id / key / number / currency / type ... columns of the test tables."""
    return H.preserve_columns(headers(spark, t))


@query("b13_find_account_columns", "WITH h AS " + HDR_SQL + " SELECT coalesce(a.source_file, b.source_file) AS source_file, a.account_column, b.balance_column FROM "
       "(SELECT source_file, arg_min(\"column\", position) AS account_column FROM h WHERE regexp_matches(lower(\"column\"), "
       "'account|name|description') GROUP BY 1) a FULL JOIN (SELECT source_file, arg_min(\"column\", position) AS balance_column "
       "FROM h WHERE regexp_matches(lower(\"column\"), 'balance|amount|value|total') GROUP BY 1) b ON a.source_file = b.source_file")
def q_b13(spark, t):
    """Account-name and balance column of every test table, by header."""
    hd = headers(spark, t)
    a, b = B.find_account_column(hd), B.find_balance_column(hd)
    return a.join(b, "source_file", "full").select("source_file", "account_column", "balance_column")


@query("b15_analyze_accounts")
def q_b15(spark, t):
    """Every accounts table of the accounts view, as (table, rows)."""
    tables = B.analyze_accounts(t("accounts"))
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("rows")).withColumn("table", F.lit(n))
                                          for n, df in tables.items()])


@query("k13_business_insights")
def q_k13(spark, t):
    """Every insight table of the ledger, as (table, rows)."""
    from ..operators.insights import business_insights
    tables = business_insights(t("ledger"))
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("rows")).withColumn("table", F.lit(n))
                                          for n, df in tables.items()])


@query("v05_validation_history")
def q_v5(spark, t):
    """V5: validation runs over three ledger views summarised as a history."""
    from ..operators.validation import validate_table, validation_history
    runs = []
    for i, name in enumerate(("ledger", "ledger_lines", "ledger_events")):
        df = t(name).drop("row_id") if "row_id" in t(name).columns else t(name)
        _, score = validate_table(df)
        runs.append(score.select(F.lit(i).alias("run_id"), F.lit(i).cast("timestamp").alias("run_ts"), "score",
                                 F.lit(len(df.columns)).alias("columns_validated")))
    return validation_history(reduce(DataFrame.unionByName, runs)).withColumn("average_score",
                                                                             rnd(F.col("average_score"), 6))


@query("x01_x02_string_similarity")
def q_x1(spark, t):
    """Similarity of each distinct ledger vendor with its upper-case copy in
    ledger_dups (pairs of distinct strings only)."""
    a = t("ledger").select(F.col("vendor").alias("a")).distinct()
    b = t("ledger_dups").select(F.col("vendor").alias("b")).distinct().filter(F.col("b").endswith(","))
    pairs = a.join(b, F.concat(F.upper("a"), F.lit(",")) == F.col("b"))
    return pairs.select("a", "b", rnd(sequence_ratio(F.lower("a"), F.lower("b")), 6).alias("sequence_ratio"),
                        rnd(token_sort_ratio(F.col("a"), F.col("b")), 6).alias("token_sort_ratio"))


@query("s03_write_csv")
def q_s3(spark, t):
    """S3: the ledger written as CSV under the checkpoint folder and read back (all text)."""
    from ..session import ensure_checkpoint_dir
    from ..sources.readers import read_ledger, write_csv
    import uuid
    path = ensure_checkpoint_dir(spark).rstrip("/") + f"/exports/ledger-{uuid.uuid4().hex}"
    write_csv(t("ledger"), path)
    back = read_ledger(spark, path, "csv")
    return back.agg(F.count("*").alias("rows"), F.count_distinct("row_id").alias("ids"))


# ---- oracles for the K10 / K11 rule texts, composed from the verified metric queries ----
def _metrics_ctes() -> str:
    return (f"WITH cf AS ({RAW_SQL['a08_a09_cash_flow']}), km AS ({RAW_SQL['a07_key_metrics']}), "
            f"pt AS ({RAW_SQL['k01_k08_spending_patterns']}), vr AS ({RAW_SQL['k09_vendor_relationships']}) ")


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


K10_SQL = _metrics_ctes() + "SELECT recommendation FROM (" + " UNION ALL ".join([
    "SELECT " + _q("Implement cost reduction strategies to improve cash flow") + " AS recommendation FROM cf WHERE net_cash_flow < 0",
    "SELECT " + _q("Optimize payment terms and cash flow management") + " FROM cf WHERE coalesce(liquidity_ratio, 'inf'::DOUBLE) < 1.2",
    "SELECT " + _q("Diversify vendor base to reduce concentration risk") + " WHERE (SELECT count(*) FROM vr WHERE risk_level = 'High') > 0",
    "SELECT " + _q("Develop backup vendor relationships for key suppliers") + " WHERE coalesce((SELECT max(impact_score) FROM pt "
    "WHERE pattern_type = 'Vendor Concentration') > 0.5, false)",
    "SELECT " + _q("Implement seasonal budgeting and cash flow planning") + " WHERE (SELECT count(*) FROM pt WHERE pattern_type = "
    "'Seasonal Variation') > 0",
    "SELECT " + _q("Consider implementing automated expense management systems") + " FROM km WHERE total_transactions > 1000",
    "SELECT " + _q("Review large transaction approval processes") + " FROM km WHERE avg_transaction_amount > 1000"]) + ")"

K11_SQL = _metrics_ctes() + "SELECT risk_flag FROM (" + " UNION ALL ".join([
    "SELECT 'Negative net cash flow' AS risk_flag FROM cf WHERE net_cash_flow < 0",
    "SELECT 'Cash outflow exceeds inflow' FROM cf WHERE coalesce(liquidity_ratio, 'inf'::DOUBLE) < 1.0",
    "SELECT 'Critical cash runway: ' || format('{:.1f}', runway_months) || ' months' FROM cf WHERE runway_months <> 0 "
    "AND runway_months < 3",
    "SELECT 'High vendor concentration risk' WHERE (SELECT count(*) FROM vr WHERE risk_level = 'High') > 2",
    "SELECT 'Unusual spending patterns detected' WHERE coalesce((SELECT max(impact_score) FROM pt WHERE pattern_type = "
    "'Spending Anomalies') > 0.1, false)",
    "SELECT 'Extreme vendor concentration' WHERE coalesce((SELECT max(impact_score) FROM pt WHERE pattern_type = "
    "'Vendor Concentration') > 0.7, false)"]) + ")"

for _name, _sql in (("k10_recommendations", K10_SQL), ("k11_insight_risk_flags", K11_SQL)):
    RAW_SQL[_name] = _sql
    ORACLES[_name] = with_views(_sql)

K12_SQL = _metrics_ctes() + "SELECT opportunity FROM (" + " UNION ALL ".join([
    "SELECT 'Negotiate better terms with ' || vendor_name AS opportunity FROM vr WHERE transaction_count >= 10 "
    "AND relationship_strength > 0.7",
    "SELECT " + _q("Consolidate spending categories for better tracking") + " FROM km WHERE unique_categories > 10",
    "SELECT " + _q("Consider investment opportunities with excess cash") + " FROM cf WHERE coalesce(liquidity_ratio, "
    "'inf'::DOUBLE) > 1.5",
    "SELECT " + _q("Implement automated expense categorization") + " FROM km WHERE total_transactions > 500"]) + ")"
RAW_SQL["k12_opportunities"] = K12_SQL
ORACLES["k12_opportunities"] = with_views(K12_SQL)

B12B_SQL = ("WITH s AS (SELECT count(*) AS n, sum(balance) AS tot, count(*) FILTER (WHERE balance < 0) AS neg, "
            "count(*) FILTER (WHERE balance = 0) AS zero FROM accounts), "
            "c AS (SELECT count(DISTINCT currency) > 1 AS multi FROM accounts WHERE currency IS NOT NULL) "
            "SELECT recommendation FROM (" + " UNION ALL ".join([
                "SELECT 'Total balance is ' || format('{:,.2f}', tot) || ' - verify this aligns with expected trial balance' "
                "AS recommendation FROM s WHERE abs(tot) > 0",
                "SELECT " + _q("Review negative balance accounts - ensure they're expected (e.g., credit balances)")
                + " FROM s WHERE neg > 0",
                "SELECT " + _q("High number of zero-balance accounts - consider archiving inactive accounts")
                + " FROM s WHERE zero > n * 0.2",
                "SELECT " + _q("Multi-currency detected - ensure proper exchange rate handling and reporting")
                + " FROM c WHERE multi",
                "SELECT CASE WHEN n > 500 THEN " + _q("Large chart of accounts - consider account consolidation for better reporting")
                + " ELSE " + _q("Small chart of accounts - ensure adequate detail for reporting needs")
                + " END FROM s WHERE n > 500 OR n < 20"]) + ")")
RAW_SQL["b12b_accounting_recommendations"] = B12B_SQL
ORACLES["b12b_accounting_recommendations"] = with_views(B12B_SQL)
