"""Registered queries for categorisation (C1-C11), chart-of-accounts analytics (B1-B13),
sampling (M1-M8) and validation (V1-V6), with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as FV
from ..operators import accounts as B
from ..operators import categorize as C
from ..operators import sampling as M
from ..operators import validation as V
from ..operators.common import rnd
from .catalog import query
from .queries_scalar import PARSED_SQL, parsed_raw


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def low(x: str) -> str:
    return f"lower(coalesce(CAST({x} AS VARCHAR), 'nan'))"


def any_contains(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, {q(w)})" for w in words) + ")"


def simple_sql(v: str) -> str:
    parts = " ".join(f"WHEN {any_contains(f'lower({v})', ws)} THEN {q(n)}" for n, ws in FV.SIMPLE_RULES)
    return f"CASE WHEN {v} IS NULL THEN 'Other' {parts} ELSE 'Other' END"


def basic_sql(v: str) -> str:
    parts = " ".join(f"WHEN {any_contains(f'lower({v})', ws)} THEN {q(n.title())}" for n, ws in FV.BASIC_RULES)
    return f"CASE WHEN {v} IS NULL THEN 'Other' {parts} ELSE 'Other' END"


def vendordb_sql(v: str) -> str:
    parts = []
    for g, vendors, pats, _ in FV.VENDOR_DB:
        cond = any_contains(f"lower({v})", vendors) + " OR " + "(" + " OR ".join(
            f"regexp_matches(lower({v}), {q(p)})" for p in pats) + ")"
        parts.append(f"WHEN {cond} THEN {q(g.title())}")
    return f"CASE WHEN {v} IS NULL THEN 'Other' {' '.join(parts)} ELSE 'Other' END"


def scored_sql(v: str, m: str, a: str) -> str:
    scores = []
    for g, vendors, pats, ranges in FV.VENDOR_DB:
        s = f"(CASE WHEN {any_contains(low(v), vendors)} THEN 2 ELSE 0 END)"
        for p in pats:
            s += f" + CAST(regexp_matches({low(v)}, {q(p)}) AS INTEGER) + CAST(regexp_matches({low(m)}, {q(p)}) AS INTEGER)"
        rng = " OR ".join(f"(abs({a}) >= {lo} AND abs({a}) <= {hi})" for lo, hi in ranges)
        s += f" + CAST(coalesce({rng}, false) AS INTEGER)"
        scores.append(s)
    names = "[" + ", ".join(q(g.title()) for g, *_ in FV.VENDOR_DB) + "]"
    arr = "[" + ", ".join(scores) + "]"
    return (f"CASE WHEN list_max({arr}) > 0 THEN {names}[list_position({arr}, list_max({arr}))] ELSE 'Other' END")


def amount_sql(a: str) -> str:
    parts = " ".join(f"WHEN abs({a}) >= {lo}" + (f" AND abs({a}) <= {hi}" if hi is not None else "") + f" THEN {q(n)}"
                     for lo, hi, n in FV.AMOUNT_BANDS)
    return f"CASE {parts} ELSE 'Other' END"


def time_sql(m: str) -> str:
    parts = " ".join(f"WHEN {any_contains(low(m), ws)} THEN {q(n)}" for n, ws in FV.TIME_KEYWORDS)
    return f"CASE {parts} END"


def text_sql(v: str, m: str) -> str:
    txt = f"({low(v)} || ' ' || {low(m)})"
    parts = " ".join(f"WHEN {any_contains(txt, ws)} THEN {q(n)}" for n, ws in FV.TEXT_RULES)
    return f"CASE {parts} END"


def freq_sql(cnt: str) -> str:
    parts = " ".join(f"WHEN {cnt} > {thr} THEN {q(n)}" for thr, n in FV.FREQUENCY_TIERS)
    return f"CASE {parts} ELSE {q(FV.FREQUENCY_FALLBACK)} END"


def consolidate_sql(c: str) -> str:
    parts = " ".join(f"WHEN {c} = {q(k)} THEN {q(v)}" for k, v in FV.CONSOLIDATE.items())
    return f"coalesce(CASE {parts} ELSE {c} END, 'Other')"


@query("c01_c03_keyword_categories", "SELECT memo, " + simple_sql("memo") + " AS simple, " + basic_sql("memo") + " AS basic, "
       + vendordb_sql("memo") + " AS vendor_db FROM (SELECT DISTINCT memo FROM ledger_lines)")
def q_c1(spark, t):
    """C1, C2, C3 on the distinct line descriptions (part names) read as vendor text."""
    d = t("ledger_lines").select("memo").distinct()
    return d.select("memo", C.categorize_simple("memo").alias("simple"), C.categorize_basic("memo").alias("basic"),
                    C.categorize_vendor_db("memo").alias("vendor_db"))


@query("c04_c08_rule_steps", "SELECT memo, round(amount, 2) AS amount, " + scored_sql("memo", "category", "amount")
       + " AS scored, " + amount_sql("amount") + " AS by_amount, " + time_sql("category") + " AS by_time, "
       + text_sql("memo", "category") + " AS by_text FROM ledger_lines")
def q_c4(spark, t):
    """C4 scores (part name as vendor, part type as memo), C5 amount band, C6 time words,
    C8 text rules, each shown on its own."""
    l = C.with_scored_category(t("ledger_lines"), "scored", "memo", "category", "amount")
    return l.select("memo", rnd(F.col("amount"), 2).alias("amount"), "scored",
                    C.categorize_amount("amount").alias("by_amount"), C.categorize_time("category").alias("by_time"),
                    C.categorize_text("memo", "category").alias("by_text"))


@query("c01b_keyword_categories_known", "SELECT vendor, " + simple_sql("vendor") + " AS simple, " + basic_sql("vendor") + " AS basic, "
       + vendordb_sql("vendor") + " AS vendor_db FROM (SELECT DISTINCT vendor FROM ledger_known)")
def q_c1b(spark, t):
    """C1, C2, C3 on vendors that the rule tables know."""
    d = t("ledger_known").select("vendor").distinct()
    return d.select("vendor", C.categorize_simple("vendor").alias("simple"), C.categorize_basic("vendor").alias("basic"),
                    C.categorize_vendor_db("vendor").alias("vendor_db"))


@query("c04b_rule_steps_known", "SELECT row_id, " + scored_sql("vendor", "memo", "amount") + " AS scored, "
       + amount_sql("amount") + " AS by_amount, " + time_sql("memo") + " AS by_time, " + text_sql("vendor", "memo")
       + " AS by_text FROM ledger_known")
def q_c4b(spark, t):
    """C4, C5, C6 and C8 on vendors and memos that the rule tables know."""
    l = C.with_scored_category(t("ledger_known"), "scored", "vendor", "memo", "amount")
    return l.select("row_id", "scored", C.categorize_amount("amount").alias("by_amount"), C.categorize_time("memo").alias("by_time"),
                    C.categorize_text("vendor", "memo").alias("by_text"))


C10_SQL = ("WITH vc AS (SELECT vendor, count(*) AS n FROM ledger_lines WHERE vendor IS NOT NULL GROUP BY vendor), "
           "s AS (SELECT l.vendor, l.memo, l.amount, vc.n, " + scored_sql("l.vendor", "l.memo", "l.amount") + " AS c4 "
           "FROM ledger_lines l LEFT JOIN vc ON l.vendor = vc.vendor), "
           "s5 AS (SELECT *, CASE WHEN c4 = 'Other' THEN " + amount_sql("amount") + " ELSE c4 END AS c5 FROM s), "
           "s6 AS (SELECT *, CASE WHEN c5 = 'Other' THEN coalesce(" + time_sql("memo") + ", 'Other') ELSE c5 END AS c6 FROM s5), "
           "s7 AS (SELECT *, CASE WHEN c6 = 'Other' THEN CASE WHEN vendor IS NULL THEN 'Other' ELSE "
           + freq_sql("coalesce(n, 0)") + " END ELSE c6 END AS c7 FROM s6), "
           "s8 AS (SELECT *, CASE WHEN c7 = 'Other' THEN coalesce(" + text_sql("vendor", "memo") + ", 'Other') ELSE c7 END AS c8 FROM s7) "
           "SELECT " + consolidate_sql("c8") + " AS category, count(*) AS n FROM s8 GROUP BY 1")


@query("c10_categorize_enhanced", C10_SQL)
def q_c10(spark, t):
    """C10 over the whole line ledger, summarised as rows per final category."""
    out = C.categorize_enhanced(t("ledger_lines").drop("category"))
    return out.groupBy("category").agg(F.count("*").alias("n"))


@query("c10b_categorize_steps")
def q_c10b(spark, t):
    """C10 report: category counts after each step."""
    return C.categorize_steps(t("ledger_lines"))


@query("c07_frequency_tiers", "SELECT vendor, count(*) AS n, " + freq_sql("count(*)") + " AS tier FROM ledger "
       "WHERE vendor IS NOT NULL GROUP BY vendor")
def q_c7(spark, t):
    """Vendor frequency tier of every ledger vendor."""
    vc = C.vendor_counts(t("ledger"))
    return vc.select("vendor", F.col("_vendor_count").alias("n"), C.frequency_label(F.col("_vendor_count")).alias("tier"))


@query("c09_consolidate", "SELECT g, " + consolidate_sql("g") + " AS consolidated FROM (SELECT DISTINCT "
       + vendordb_sql("memo") + " AS g FROM ledger_lines)")
def q_c9(spark, t):
    """C9 on the vendor-database groups found in the part names."""
    g = t("ledger_lines").select(C.categorize_vendor_db("memo").alias("g")).distinct()
    return g.select("g", C.consolidate_category("g").alias("consolidated"))


@query("c11_apply_taxonomy", "SELECT category AS raw, CASE WHEN category IN (" + ", ".join(q(c) for c in FV.CATEGORIES)
       + ") THEN category ELSE 'Other' END AS category, count(*) AS n FROM ledger_lines GROUP BY 1, 2")
def q_c11(spark, t):
    """C11: line categories forced onto the canonical list, as counts."""
    l = t("ledger_lines").withColumn("raw", F.col("category"))
    return C.apply_taxonomy(l).groupBy("raw", "category").agg(F.count("*").alias("n"))


@query("c11b_apply_taxonomy_known", "SELECT row_id, category AS raw, CASE WHEN category IN (" + ", ".join(q(c) for c in FV.CATEGORIES)
       + ") THEN category ELSE 'Other' END AS category FROM ledger_known")
def q_c11b(spark, t):
    """C11 on categories some of which are canonical."""
    return C.apply_taxonomy(t("ledger_known").withColumn("raw", F.col("category"))).select("row_id", "raw", "category")


# ---------------------------------------------------------------- accounts
@query("b01_account_summary", "SELECT count(*) AS total_accounts, round(sum(balance), 2) AS total_balance, "
       "round(avg(balance), 6) AS average_balance, min(balance) AS min_balance, max(balance) AS max_balance FROM accounts")
def q_b1(spark, t):
    """B1 on the accounts view."""
    s = B.account_summary(t("accounts"))
    return s.withColumns({"total_balance": rnd(F.col("total_balance"), 2), "average_balance": rnd(F.col("average_balance"), 6)})


@query("b02_top_accounts", "SELECT row_id, account, balance FROM accounts WHERE balance IS NOT NULL "
       "ORDER BY balance DESC, row_id LIMIT 10")
def q_b2(spark, t):
    """Ten largest balances."""
    return B.top_accounts(t("accounts"))


@query("b02b_balance_flags", "SELECT count(*) AS n, count(*) FILTER (WHERE balance < 0) AS negative_accounts, "
       "count(*) FILTER (WHERE balance = 0) AS zero_accounts, count(*) FILTER (WHERE balance = 0) > count(*) * 0.1 "
       "AS high_zero_share FROM accounts")
def q_b2b(spark, t):
    """B2: negative / zero balance counts."""
    return B.balance_flags(t("accounts"))


@query("b03_currency_analysis", "WITH c AS (SELECT currency, count(*) AS n FROM accounts WHERE currency IS NOT NULL GROUP BY 1) "
       "SELECT count(*) AS currencies_found, arg_min(currency, (-n, currency)) AS primary_currency, count(*) > 1 AS multi_currency FROM c")
def q_b3(spark, t):
    """B3 on the accounts view."""
    return B.currency_analysis(t("accounts"))


@query("b04_type_breakdown", "SELECT type, count(*) AS count, round(sum(balance), 2) AS total FROM accounts "
       "WHERE type IS NOT NULL GROUP BY type")
def q_b4(spark, t):
    """B4 on the accounts view."""
    return B.type_breakdown(t("accounts")).withColumn("total", rnd(F.col("total"), 2))


@query("b05_missing_flags", "SELECT column_name AS column, pct AS pct_missing FROM (SELECT 'date' AS column_name, "
       "count(*) FILTER (WHERE date IS NULL) * 100.0 / count(*) AS pct FROM " + PARSED_SQL + " p UNION ALL "
       "SELECT 'amount', count(*) FILTER (WHERE amount IS NULL) * 100.0 / count(*) FROM " + PARSED_SQL + " p UNION ALL "
       "SELECT 'vendor', count(*) FILTER (WHERE vendor IS NULL) * 100.0 / count(*) FROM " + PARSED_SQL + " p UNION ALL "
       "SELECT 'row_id', 0.0) WHERE pct > 5")
def q_b5(spark, t):
    """Columns of the parsed raw ledger with more than 5 % missing."""
    return B.missing_flags(parsed_raw(t))


def _cls(name: str) -> str:
    return f"coalesce(sum(balance) FILTER (WHERE regexp_matches(account, {q('(?i)' + FV.ACCOUNT_PATTERNS[name])})), 0.0)"


B6_SQL = f"""
WITH s AS (SELECT {_cls('assets')} AS assets, {_cls('liabilities')} AS liab, {_cls('equity')} AS eq, {_cls('revenue')} AS rev,
  {_cls('expenses')} AS exp, {_cls('current_assets')} AS ca, {_cls('current_liabilities')} AS cl, {_cls('cash')} AS cash,
  {_cls('expense_accounts')} AS expa, {_cls('operating')} AS op, {_cls('cogs')} AS cogs, coalesce(sum(balance), 0.0) AS tot,
  count(*) AS n, count(*) FILTER (WHERE balance > 0) AS pos, count(*) FILTER (WHERE balance < 0) AS neg,
  count(*) FILTER (WHERE balance = 0) AS zero,
  count(*) FILTER (WHERE regexp_matches(account, '[A-Z][a-z]|[a-z][A-Z]')) AS naming FROM accounts),
t5 AS (SELECT coalesce(sum(balance), 0.0) AS top5 FROM (SELECT balance FROM accounts WHERE balance IS NOT NULL
       ORDER BY balance DESC, row_id LIMIT 5)),
r AS (SELECT *, CASE WHEN liab <> 0 THEN assets / abs(liab) ELSE 'inf'::DOUBLE END AS cur,
        CASE WHEN eq <> 0 THEN abs(liab) / abs(eq) ELSE 'inf'::DOUBLE END AS dte,
        CASE WHEN rev <> 0 THEN (rev - exp) / rev ELSE 0.0 END AS pm,
        CASE WHEN assets <> 0 THEN cash / abs(assets) * 100 ELSE 0.0 END AS cashpct,
        CASE WHEN tot <> 0 THEN top5 / abs(tot) ELSE 0.0 END AS conc FROM s, t5),
k AS (SELECT *, (CASE WHEN cur < 1 THEN 3 WHEN cur < 1.5 THEN 1 ELSE 0 END) + (CASE WHEN dte > 3 THEN 3 WHEN dte > 2 THEN 1 ELSE 0 END)
        + (CASE WHEN pm < 0 THEN 3 WHEN pm < 0.05 THEN 1 ELSE 0 END) + (CASE WHEN conc > 0.8 THEN 2 ELSE 0 END) AS risk,
        (CASE WHEN cur >= 2.0 THEN 3 WHEN cur >= 1.5 THEN 2 WHEN cur >= 1.0 THEN 1 ELSE 0 END)
        + (CASE WHEN dte <= 0.5 THEN 3 WHEN dte <= 1.0 THEN 2 WHEN dte <= 2.0 THEN 1 ELSE 0 END)
        + (CASE WHEN pm >= 0.2 THEN 3 WHEN pm >= 0.1 THEN 2 WHEN pm >= 0.05 THEN 1 ELSE 0 END) AS pts FROM r)
SELECT round(cur, 6) AS current_ratio, round(dte, 6) AS debt_to_equity_ratio, round(pm, 6) AS profit_margin,
  round(assets, 2) AS total_assets, round(liab, 2) AS total_liabilities, round(eq, 2) AS total_equity, round(rev, 2) AS total_revenue,
  round(exp, 2) AS total_expenses, round(rev - exp, 2) AS net_income,
  CASE WHEN pts >= 7 THEN 'Excellent' WHEN pts >= 5 THEN 'Good' WHEN pts >= 3 THEN 'Fair' ELSE 'Poor' END AS health_score,
  round(ca - cl, 2) AS working_capital, round(cashpct, 6) AS cash_percentage,
  CASE WHEN ca - cl > 0 AND cashpct > 5 THEN 'Strong' ELSE 'Needs attention' END AS cash_flow_health,
  round(CASE WHEN rev <> 0 THEN (rev - cogs) / rev ELSE 0.0 END, 6) AS gross_margin,
  round(CASE WHEN rev <> 0 THEN (rev - expa) / rev ELSE 0.0 END, 6) AS operating_margin,
  risk AS risk_score, CASE WHEN risk >= 5 THEN 'High' WHEN risk >= 2 THEN 'Medium' ELSE 'Low' END AS risk_level,
  round(conc, 6) AS concentration_ratio, n AS account_count, pos AS positive_accounts, neg AS negative_accounts,
  zero AS zero_accounts, naming AS naming_issues FROM k"""


@query("b06_b11_account_metrics", B6_SQL)
def q_b6(spark, t):
    """Financial health, working capital, profitability, risk and operational
    metrics of the accounts view."""
    m = B.account_metrics(t("accounts"))
    six = ["current_ratio", "debt_to_equity_ratio", "profit_margin", "cash_percentage", "gross_margin",
           "operating_margin", "concentration_ratio"]
    two = ["total_assets", "total_liabilities", "total_equity", "total_revenue", "total_expenses", "net_income",
           "working_capital"]
    out = m.select(*[rnd(F.col(c), 6).alias(c) for c in six], *[rnd(F.col(c), 2).alias(c) for c in two], "health_score",
                   "cash_flow_health", F.col("risk_score").cast("int").alias("risk_score"), "risk_level", "account_count",
                   "positive_accounts", "negative_accounts", "zero_accounts", "naming_issues")
    return out


def _rules_sql(rules, name: str) -> str:
    sel = " UNION ALL ".join(f"SELECT {i} AS o, {q(text)} AS {name} FROM m WHERE coalesce({cond}, false)"
                             for i, (cond, text) in enumerate(rules))
    return (f"WITH m AS ({B6_SQL}), r AS ({sel}) "
            f"SELECT CAST(row_number() OVER (ORDER BY o) - 1 AS INTEGER) AS pos, {name} FROM r")


B10_RULES = [
    ("current_ratio < 1", "Critical liquidity risk - insufficient current assets to meet short-term obligations."),
    ("current_ratio >= 1 AND current_ratio < 1.5", "Moderate liquidity risk - consider strengthening cash position."),
    ("debt_to_equity_ratio > 3", "High solvency risk - excessive debt levels relative to equity position."),
    ("debt_to_equity_ratio <= 3 AND debt_to_equity_ratio > 2", "Moderate solvency risk - debt levels require monitoring."),
    ("profit_margin < 0", "Profitability risk - operations generating negative returns requiring immediate attention."),
    ("profit_margin >= 0 AND profit_margin < 0.05", "Low profitability risk - margins below optimal levels."),
    ("concentration_ratio > 0.8",
     "High concentration risk - significant portion of assets concentrated in limited accounts."),
]
B11_RULES = [
    ("account_count > 500", "Chart of accounts complexity may impact reporting efficiency - consider consolidation strategy."),
    ("account_count < 20", "Limited account detail may restrict reporting granularity - evaluate additional account categories."),
    ("negative_accounts > account_count * 0.3",
     "High proportion of negative balances - verify account classifications and posting accuracy."),
    ("zero_accounts > account_count * 0.2", "Significant number of inactive accounts - implement account cleanup procedures."),
    ("naming_issues > account_count * 0.1",
     "Account naming inconsistencies detected - standardize naming conventions for improved reporting."),
]
B12_RULES = [
    ("current_ratio < 1.5", "STRATEGIC: Implement cash flow management program to strengthen liquidity position."),
    ("debt_to_equity_ratio > 2", "STRATEGIC: Develop comprehensive debt reduction strategy to improve financial flexibility."),
    ("profit_margin < 0.1", "STRATEGIC: Conduct pricing and cost structure analysis to improve profitability metrics."),
    ("working_capital < 0", "STRATEGIC: Establish working capital management framework to address cash flow challenges."),
    ("cash_percentage < 5", "STRATEGIC: Build cash reserves to enhance operational flexibility and risk mitigation."),
    ("account_count > 500", "STRATEGIC: Implement account consolidation program to streamline reporting and reduce complexity."),
    ("risk_level = 'High'", "STRATEGIC: Develop comprehensive risk mitigation plan addressing identified vulnerabilities."),
    ("profit_margin > 0.2 AND current_ratio > 2",
     "STRATEGIC: Strong financial position supports expansion initiatives and strategic investments."),
]


@query("b10_account_risks", _rules_sql(B10_RULES, "risk"))
def q_b10(spark, t):
    """Risk texts for the accounts view."""
    return B.account_risks(t("accounts"))


@query("b11_operational_insights", _rules_sql(B11_RULES, "insight"))
def q_b11(spark, t):
    """Operational insight texts for the accounts view."""
    return B.operational_insights(t("accounts"))


@query("b12_strategic_recommendations", _rules_sql(B12_RULES, "recommendation"))
def q_b12(spark, t):
    """Strategic rules for the accounts view."""
    return B.strategic_recommendations(t("accounts"))


@query("b12b_accounting_recommendations")
def q_b12b(spark, t):
    """Accounting recommendation rules for the accounts view."""
    return B.accounting_recommendations(t("accounts"))


@query("b14_narrative")
def q_b14(spark, t):
    """Templated summary of the accounts view."""
    return B.narrative(t("accounts"))


# ---------------------------------------------------------------- sampling
KEY = "md5(concat_ws('#', CAST(row_id AS VARCHAR), '42'))"


@query("m01_random_sample", f"SELECT row_id FROM ledger ORDER BY {KEY}, row_id LIMIT 100")
def q_m1(spark, t):
    """M1: 100 reproducible pseudo-random ledger rows."""
    return M.random_sample(t("ledger"), 100).select("row_id")


@query("m02_stratified_sample", f"""
WITH qq AS (SELECT quantile_cont(coalesce(amount, 0.0), [0.25, 0.5, 0.75]) AS q FROM ledger),
vc AS (SELECT vendor, count(*) AS c FROM ledger WHERE vendor IS NOT NULL GROUP BY vendor),
s AS (SELECT l.row_id, CASE WHEN coalesce(l.amount, 0.0) <= q[1] THEN 1 WHEN coalesce(l.amount, 0.0) <= q[2] THEN 2
          WHEN coalesce(l.amount, 0.0) <= q[3] THEN 3 ELSE 4 END AS amount_tier,
        CASE WHEN coalesce(vc.c, 0) > 10 THEN 'frequent' WHEN coalesce(vc.c, 0) > 3 THEN 'moderate' ELSE 'rare' END AS vendor_tier
      FROM ledger l LEFT JOIN vc ON l.vendor = vc.vendor, qq),
r AS (SELECT *, row_number() OVER (PARTITION BY amount_tier, vendor_tier ORDER BY {KEY}, row_id) AS rn FROM s)
SELECT row_id, amount_tier, vendor_tier FROM r WHERE rn <= 50 ORDER BY amount_tier, vendor_tier, {KEY}, row_id LIMIT 600""")
def q_m2(spark, t):
    """M2: 600-row stratified sample of the ledger."""
    return M.stratified_sample(t("ledger"), 600).select("row_id", "amount_tier", "vendor_tier")


@query("m03_vendor_sample", f"""
WITH vc AS (SELECT vendor, count(*) AS c FROM ledger WHERE vendor IS NOT NULL GROUP BY vendor),
ch AS (SELECT vendor FROM (SELECT vendor FROM vc ORDER BY c DESC, vendor LIMIT 20)
       UNION SELECT vendor FROM (SELECT vendor FROM vc ORDER BY md5(concat_ws('#', vendor, '42')), vendor LIMIT 30)
       UNION SELECT vendor FROM (SELECT vendor FROM vc WHERE c = 1 ORDER BY md5(concat_ws('#', vendor, '42')), vendor LIMIT 10)),
x AS (SELECT row_id, CASE WHEN vendor IN (SELECT vendor FROM ch) THEN 0 ELSE 1 END AS pri FROM ledger)
SELECT row_id FROM x ORDER BY pri, {KEY}, row_id LIMIT 500""")
def q_m3(spark, t):
    """M3: 500-row vendor-focused sample."""
    return M.vendor_sample(t("ledger"), 500).select("row_id")


@query("m04_temporal_sample", f"""
WITH m AS (SELECT row_id, date_trunc('month', date) AS mo FROM ledger WHERE date IS NOT NULL),
k AS (SELECT count(DISTINCT mo) AS nm FROM m),
r AS (SELECT row_id, mo, row_number() OVER (PARTITION BY mo ORDER BY {KEY}, row_id) AS rn FROM m)
SELECT row_id FROM r, k WHERE rn <= floor(1000 / nm) ORDER BY mo, rn LIMIT 1000""")
def q_m4(spark, t):
    """M4: 1000-row sample spread evenly over months."""
    return M.temporal_sample(t("ledger"), 1000).select("row_id")


@query("m05_high_value_sample", f"""
WITH b AS (SELECT row_id, abs(amount) AS x FROM ledger WHERE amount IS NOT NULL),
th AS (SELECT quantile_cont(x, 0.9) AS thr FROM b),
hi AS (SELECT row_id FROM b, th WHERE x >= thr ORDER BY {KEY}, row_id LIMIT 200),
lo AS (SELECT row_id FROM b, th WHERE x < thr ORDER BY {KEY}, row_id LIMIT (400 - (SELECT count(*) FROM hi)))
SELECT row_id FROM hi UNION ALL SELECT row_id FROM lo""")
def q_m5(spark, t):
    """M5: 400-row sample, half from the top decile of |amount|."""
    return M.high_value_sample(t("ledger"), 400).select("row_id")


@query("m06_cluster_samples")
def q_m6(spark, t):
    """M6: cluster samples (vendor, amount, temporal) of the ledger."""
    return M.cluster_samples(t("ledger"), 900).select("row_id", "sample_name")


@query("m07_tiered_samples")
def q_m7(spark, t):
    """M7: stratified, vendor and temporal samples, a third of the total each."""
    return M.tiered_samples(t("ledger"), 6000, M.SAMPLE_PLANS[0]).select("row_id", "sample_name")


@query("m08_scale_patterns")
def q_m8(spark, t):
    """M8: patterns of per-sample insight runs kept when seen in n // 2 samples, at least one."""
    from ..operators import insights as K
    samples = M.cluster_samples(t("ledger"), 3000)
    pats = None
    for name in ("cluster_vendor", "cluster_amount", "cluster_temporal"):
        p = K.spending_patterns(samples.filter(F.col("sample_name") == name)).withColumn("sample_name", F.lit(name))
        pats = p if pats is None else pats.unionByName(p)
    return M.scale_patterns(pats, samples=3)


# ---------------------------------------------------------------- validation
@query("v01_validate_numeric", """
WITH q AS (SELECT quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.75) AS q3 FROM ledger),
s AS (SELECT count(amount) AS n, count(*) FILTER (WHERE amount > 0) AS pos,
        count(*) FILTER (WHERE amount >= q1 - 1.5 * (q3 - q1) AND amount <= q3 + 1.5 * (q3 - q1)) AS inr FROM ledger, q)
SELECT 'amount' AS column, 'all_positive' AS "check", pos = n AS passed, pos AS valid, n - pos AS invalid FROM s
UNION ALL SELECT 'amount', 'iqr_range', inr = n, inr, n - inr FROM s""")
def q_v1(spark, t):
    """V1 on the ledger amount."""
    return V.validate_numeric(t("ledger"), "amount")


@query("v02_v03_validate_columns", "SELECT 'date' AS column, 'not_null' AS \"check\", count(*) FILTER (WHERE date IS NULL) = 0 AS passed, "
       "count(date) AS valid, count(*) FILTER (WHERE date IS NULL) AS invalid FROM " + PARSED_SQL + " p UNION ALL "
       "SELECT 'vendor', 'non_empty', count(*) FILTER (WHERE NOT coalesce(trim(vendor) <> '', false)) = 0, "
       "count(*) FILTER (WHERE coalesce(trim(vendor) <> '', false)), count(*) FILTER (WHERE NOT coalesce(trim(vendor) <> '', false)) "
       "FROM " + PARSED_SQL + " p")
def q_v2(spark, t):
    """V2 (dates) and V3 (text) on the parsed raw ledger."""
    p = parsed_raw(t)
    return V.validate_date(p, "date").unionByName(V.validate_text(p, "vendor"))


V4_SQL = """
WITH q AS (SELECT quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.75) AS q3 FROM ledger),
a AS (SELECT count(amount) AS n, count(*) FILTER (WHERE amount > 0) AS pos,
        count(*) FILTER (WHERE amount >= q1 - 1.5 * (q3 - q1) AND amount <= q3 + 1.5 * (q3 - q1)) AS inr FROM ledger, q),
c AS (SELECT 'amount' AS "column", 'all_positive' AS "check", pos = n AS passed, pos AS valid, n - pos AS invalid FROM a
  UNION ALL SELECT 'amount', 'iqr_range', inr = n, inr, n - inr FROM a
  UNION ALL SELECT 'date', 'not_null', count(*) FILTER (WHERE date IS NULL) = 0, count(date), count(*) FILTER (WHERE date IS NULL)
    FROM ledger
""" + "".join(f"""  UNION ALL SELECT '{c}', 'non_empty', count(*) FILTER (WHERE NOT coalesce(trim({c}) <> '', false)) = 0,
    count(*) FILTER (WHERE coalesce(trim({c}) <> '', false)), count(*) FILTER (WHERE NOT coalesce(trim({c}) <> '', false))
    FROM ledger
""" for c in ("vendor", "category", "memo")) + """)
SELECT "column", "check", passed, valid, invalid, (SELECT count(*) FROM c) AS total_checks,
  (SELECT count(*) FILTER (WHERE passed) FROM c) AS passed_checks,
  round((SELECT count(*) FILTER (WHERE passed) FROM c) / (SELECT count(*) FROM c), 6) AS score FROM c"""


@query("v04_validate_table", V4_SQL)
def q_v4(spark, t):
    """V4: every column of the ledger checked, with the overall score on each row."""
    from ..operators.common import with_scalars
    checks, score = V.validate_table(t("ledger").drop("row_id"))
    return with_scalars(checks, score.withColumn("score", rnd(F.col("score"), 6)))


@query("v06_validate_schema", "SELECT count(*) FILTER (WHERE NOT bad) AS valid_rows, count(*) FILTER (WHERE bad) AS quarantine_rows "
       "FROM (SELECT (date IS NOT NULL AND TRY_CAST(date AS TIMESTAMP) IS NULL) OR "
       "(amount IS NOT NULL AND TRY_CAST(amount AS DOUBLE) IS NULL) AS bad FROM ledger_raw)")
def q_v6(spark, t):
    """V6: the raw ledger cast to the typed ledger schema, split into valid / quarantine."""
    valid, quarantine = V.validate_schema(t("ledger_raw"))
    from ..operators.common import with_scalars
    return with_scalars(valid.agg(F.count("*").alias("valid_rows")), quarantine.agg(F.count("*").alias("quarantine_rows")))
