"""Registered queries for scalar cleaning (P1-P19), filters (F1-F9) and null handling
(N1-N5). Oracles state the same rules in DuckDB SQL (strptime formats run natively)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as FV
from ..functions.amounts import amount_invalid, clean_amount
from ..functions.calendar import derive_calendar
from ..functions.dates import (coerce_date, detect_date_format, normalize_dates, ordered_formats,
                               standardize_date, standardize_dates)
from ..functions.text import (capitalize_memo, capitalize_vendor, clean_text, dedup_key, digits_only, email_valid,
                              extract_vendor, fill_memo, normalize_string, title_case)
from ..operators import filters as FL
from ..operators.common import rnd
from .catalog import query

# ---------------------------------------------------------------- date oracle (SQL side)
MONTHS = "|".join(FV.MONTH_TOKENS)
PRE_SQL = (r"CASE WHEN regexp_matches(lower(trim({s})), '" + MONTHS + r"') THEN trim({s}) ELSE trim("
           r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({s})), '\s+', ' ', 'g'), "
           r"'(\d{{1,2}})[/\-.](\d{{1,2}})[/\-.](\d{{4}})', '\1/\2/\3', 'g'), "
           r"'(\d{{1,2}})[/\-.](\d{{1,2}})[/\-.](\d{{2}})$', '\1/\2/\3', 'g'), "
           r"'(\d{{4}})[/\-.](\d{{1,2}})[/\-.](\d{{1,2}})', '\1-\2-\3', 'g')) END")


def _try(p: str, fmt: str) -> str:
    return f"CAST(try_strptime({p}, '{fmt}') AS DATE)"


def date_sql(s: str, american: bool = True) -> str:
    """P1 in DuckDB SQL for the text expression ``s``."""
    p = "(" + PRE_SQL.format(s=s) + ")"
    parts = [_try(p, f) for f in ordered_formats(american)]
    x = (rf"regexp_replace(regexp_replace(regexp_replace({p}, '(\d+)(st|nd|rd|th)\b', '\1', 'gi'), "
         rf"'\bsept\b', 'Sep', 'gi'), '\s+', ' ', 'g')")
    names = [_try(x, f) for f in ordered_formats(american) if "%B" in f or "%b" in f]
    iso = (rf"CASE WHEN regexp_matches({p}, '^\d{{4}}-\d{{1,2}}-\d{{1,2}}[ tT]\d{{1,2}}:\d{{2}}(:\d{{2}}(\.\d+)?)?$') "
           rf"THEN CAST(TRY_CAST(regexp_replace({p}, '[tT]', ' ') AS TIMESTAMP) AS DATE) END")
    serial = f"TRY_CAST(trim({s}) AS DOUBLE)"
    return (f"CASE WHEN {s} IS NULL THEN NULL "
            f"WHEN {serial} >= 1 AND {serial} <= 100000 THEN CAST(DATE '1899-12-30' + CAST(floor({serial}) AS INTEGER) AS DATE) "
            f"WHEN length({p}) < 6 THEN NULL ELSE coalesce({', '.join(parts + names + [iso])}) END")


@query("p01_standardize_date", "SELECT row_id, CAST(" + date_sql("date", True) + " AS VARCHAR) AS date_american, "
       "CAST(" + date_sql("date", False) + " AS VARCHAR) AS date_european FROM ledger_raw")
def q_p1(spark, t):
    """Text dates of the raw ledger, American and European preference."""
    r = t("ledger_raw").select("row_id", "date")
    r = standardize_dates(r, {"date_american": "date"}, True)
    r = standardize_dates(r, {"date_european": "date"}, False)
    return r.select("row_id", "date_american", "date_european")


def _detect_sql() -> str:
    p = "(" + PRE_SQL.format(s="CAST(date AS VARCHAR)") + ")"
    sel = " UNION ALL ".join(
        f"SELECT {i} AS pos, '{f}' AS fmt, count(*) FILTER (WHERE try_strptime({p}, '{f}') IS NOT NULL) AS hits, "
        f"count(date) AS n, {1 if ('%m/%d' in f or '%m-%d' in f) else (2 if ('%d/%m' in f or '%d-%m' in f) else 0)} "
        f"AS fam FROM ledger_raw" for i, f in enumerate(FV.DATE_FORMATS))
    return (f"WITH h AS ({sel}), b AS (SELECT * FROM h ORDER BY hits DESC, pos LIMIT 1) "
            f"SELECT CASE WHEN b.hits > 0 THEN b.fmt ELSE 'unknown' END AS format, "
            f"round(CASE WHEN b.hits > 0 THEN b.hits / b.n ELSE 0.0 END, 6) AS confidence, "
            f"(SELECT sum(hits) FILTER (WHERE fam = 1) >= coalesce(sum(hits) FILTER (WHERE fam = 2), 0) FROM h) "
            f"AS american_likely, b.n AS non_null FROM b")


@query("p02_detect_date_format", _detect_sql())
def q_p2(spark, t):
    """Best date format of the raw ledger's date column."""
    d = detect_date_format(t("ledger_raw"), "date")
    return d.withColumn("confidence", rnd(F.col("confidence"), 6))


@query("p03_normalize_dates",
       "SELECT row_id, date AS date_original, CAST(" + date_sql(r"regexp_replace(trim(date), '(\d+)(st|nd|rd|th)', '\1', 'g')")
       + " AS VARCHAR) AS date, (date IS NOT NULL AND trim(date) <> '') AND ("
       + date_sql(r"regexp_replace(trim(date), '(\d+)(st|nd|rd|th)', '\1', 'g')") + ") IS NULL AS date_invalid "
       "FROM ledger_raw")
def q_p3(spark, t):
    """Normalise the raw ledger's date column (original and invalid flag kept)."""
    return normalize_dates(t("ledger_raw").select("row_id", "date"), "date")


@query("p04_coerce_date", "SELECT row_id, CAST(coalesce(CAST(try_strptime(trim(date), '%Y-%m-%d') AS DATE), "
       "CAST(try_strptime(trim(date), '%Y-%m-%d %H:%M:%S') AS DATE)) AS VARCHAR) AS date FROM ledger_raw")
def q_p4(spark, t):
    """Strict ISO parse of the raw ledger dates."""
    return t("ledger_raw").select("row_id", coerce_date("date").alias("date"))


def _num_sql(x: str) -> str:
    return f"(CASE WHEN isnan(TRY_CAST({x} AS DOUBLE)) THEN NULL ELSE TRY_CAST({x} AS DOUBLE) END)"


ROBUST_T1 = r"regexp_replace(regexp_replace(trim(amount), '(?i)(usd|eur|gbp|[$€£])', '', 'g'), '[,\s]', '', 'g')"
ROBUST_NUM = _num_sql(r"regexp_replace(regexp_replace(" + ROBUST_T1 + r", '[()]', '', 'g'), '[+\-]', '', 'g')")
ROBUST_SQL = (f"CASE WHEN regexp_matches({ROBUST_T1}, '^\\(.*\\)$') "
              f"OR starts_with(regexp_replace({ROBUST_T1}, '[()]', '', 'g'), '-') "
              f"THEN -abs({ROBUST_NUM}) ELSE {ROBUST_NUM} END")
BASIC_SQL = _num_sql("replace(replace(amount, '$', ''), ',', '')")
UNSIGNED_SQL = _num_sql("replace(replace(replace(replace(amount, '$', ''), ',', ''), '(', ''), ')', '')")


@query("p05_p07_clean_amount",
       f"SELECT row_id, {BASIC_SQL} AS amount_basic, {UNSIGNED_SQL} AS amount_unsigned, {ROBUST_SQL} AS amount_robust, "
       f"coalesce(trim(amount) <> '', false) AND ({ROBUST_SQL}) IS NULL AS amount_invalid FROM ledger_raw")
def q_p5(spark, t):
    """The three amount parsing modes on the raw ledger."""
    r = t("ledger_raw")
    return r.select("row_id", clean_amount("amount", "basic").alias("amount_basic"),
                    clean_amount("amount", "unsigned").alias("amount_unsigned"),
                    clean_amount("amount", "robust").alias("amount_robust"),
                    amount_invalid("amount").alias("amount_invalid"))


@query("p08_p09_text_cleaning",
       "SELECT row_id, CASE WHEN trim(vendor) IN ('nan', 'None', '', 'null') THEN NULL ELSE trim(vendor) END AS clean_text, "
       "CASE WHEN lower(trim(vendor)) IN ('nan', 'none', '') THEN NULL ELSE lower(trim(vendor)) END AS normalized "
       "FROM ledger_raw")
def q_p8(spark, t):
    """P8 and P9 on the raw ledger's vendor text."""
    r = t("ledger_raw")
    return r.select("row_id", clean_text("vendor").alias("clean_text"), normalize_string("vendor").alias("normalized"))


INITCAP_SQL = ("array_to_string(list_transform(string_split(lower({x}), ' '), "
               "lambda w: upper(w[1:1]) || w[2:]), ' ')")


@query("p10_title_case", "SELECT row_id, " + INITCAP_SQL.format(x="memo") + " AS memo_title, "
       + INITCAP_SQL.format(x="vendor") + " AS vendor_title FROM ledger")
def q_p10(spark, t):
    """P10 on the ledger memo and vendor."""
    r = t("ledger")
    return r.select("row_id", title_case("memo").alias("memo_title"), title_case("vendor").alias("vendor_title"))


@query("p11_email_valid",
       "SELECT doc_id, tok AS token, regexp_matches(tok, '" + FV.EMAIL_PATTERN + "') AS valid FROM ("
       "SELECT doc_id, unnest(string_split_regex(text, '\\s+')) AS tok FROM documents) WHERE contains(tok, '@')")
def q_p11(spark, t):
    """E-mail-like tokens found in the documents, and whether each is valid."""
    d = t("documents").select("doc_id", F.explode(F.split("text", r"\s+")).alias("token"))
    return d.filter(F.col("token").contains("@")).select("doc_id", "token", email_valid("token").alias("valid"))


@query("p12_digits_only", "SELECT row_id, CASE WHEN regexp_replace(memo, '[^0-9]', '', 'g') = '' THEN NULL "
       "ELSE regexp_replace(memo, '[^0-9]', '', 'g') END AS digits FROM ledger_events")
def q_p12(spark, t):
    """P12 on the event ledger's memo (JSON properties)."""
    return t("ledger_events").select("row_id", digits_only("memo").alias("digits"))


@query("p13_extract_vendor", """
SELECT memo, CASE WHEN memo IS NULL THEN 'Unknown'
  WHEN contains(trim(memo), 'POS ') THEN coalesce(nullif(regexp_extract(string_split(trim(memo), 'POS ')[-1], '^\\s*(\\S+)', 1), ''), 'Unknown')
  WHEN contains(trim(memo), 'PURCHASE ') THEN coalesce(nullif(regexp_extract(string_split(trim(memo), 'PURCHASE ')[-1], '^\\s*(\\S+)', 1), ''), 'Unknown')
  WHEN contains(trim(memo), 'PAYMENT ') THEN coalesce(nullif(regexp_extract(string_split(trim(memo), 'PAYMENT ')[-1], '^\\s*(\\S+)', 1), ''), 'Unknown')
  ELSE coalesce(nullif(regexp_extract(trim(memo), '^\\s*(\\S+)', 1), ''), 'Unknown') END AS vendor
FROM (SELECT DISTINCT memo FROM ledger_lines)""")
def q_p13(spark, t):
    """Vendor word extracted from the distinct line descriptions."""
    return t("ledger_lines").select("memo").distinct().select("memo", extract_vendor("memo").alias("vendor"))


CAP_SQL = ("CASE WHEN {x} IS NULL OR trim({x}) = '' THEN {x} ELSE array_to_string(list_transform("
           "string_split_regex(trim({x}), '\\s+'), lambda w: CASE WHEN w = upper(w) AND w <> lower(w) THEN w "
           "ELSE upper(w[1:1]) || lower(w[2:]) END), ' ') END")
MEMO_SQL = ("CASE WHEN trim({x}) IS NULL OR trim({x}) = '' OR lower(trim({x})) = 'nan' THEN NULL ELSE "
            "array_to_string(list_transform(string_split_regex(trim({x}), '\\s+'), "
            "lambda w: upper(w[1:1]) || lower(w[2:])), ' ') END")


@query("p14_p15_capitalize", "SELECT row_id, " + CAP_SQL.format(x="vendor") + " AS vendor, "
       + MEMO_SQL.format(x="vendor") + " AS memo_style FROM ledger_raw")
def q_p14(spark, t):
    """P14 (keep ALL-CAPS words) and P15 (capitalise every word) on raw vendor text."""
    r = t("ledger_raw")
    return r.select("row_id", capitalize_vendor("vendor").alias("vendor"), capitalize_memo("vendor").alias("memo_style"))


@query("p16_derive_calendar", """
SELECT row_id, CAST(CAST(date_trunc('month', date) AS DATE) AS VARCHAR) AS month,
       CAST(CAST(date_trunc('quarter', date) AS DATE) AS VARCHAR) AS quarter,
       CAST(year(date) AS INTEGER) AS year, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week,
       isodow(date) IN (6, 7) AS is_weekend, amount > 0 AS is_inflow, amount < 0 AS is_outflow,
       abs(amount) AS abs_amount FROM ledger""")
def q_p16(spark, t):
    """P16 on the ledger."""
    return derive_calendar(t("ledger")).select("row_id", "month", "quarter", "year", "day_of_week", "is_weekend",
                                               "is_inflow", "is_outflow", "abs_amount")


@query("p17_dedup_key", "SELECT row_id, md5(concat_ws('_', coalesce(vendor, ''), coalesce(CAST(amount AS VARCHAR), ''), "
       "coalesce(CAST(date AS VARCHAR), ''))) AS dedup_key FROM ledger")
def q_p17(spark, t):
    """md5 key of vendor_amount_date."""
    return t("ledger").select("row_id", dedup_key().alias("dedup_key"))


@query("p19_fill_memo", """
SELECT l.row_id, CASE WHEN r.vendor IS NULL OR lower(trim(r.vendor)) IN ('', 'nan', 'null', 'none', 'unknown')
  THEN CASE WHEN coalesce(l.amount > 0, false) THEN coalesce(l.category, 'Other') || ' expense from ' || coalesce(l.vendor, 'Unknown')
            ELSE coalesce(l.category, 'Other') || ' refund from ' || coalesce(l.vendor, 'Unknown') END
  ELSE r.vendor END AS memo
FROM ledger l JOIN ledger_raw r ON l.row_id = r.row_id""")
def q_p19(spark, t):
    """Raw vendor text used as the memo; blank-like memos are generated."""
    l, r = t("ledger"), t("ledger_raw").select("row_id", F.col("vendor").alias("raw_memo"))
    j = l.join(r, "row_id")
    return j.select("row_id", fill_memo("raw_memo").alias("memo"))


# ---------------------------------------------------------------- filters
PARSED_SQL = ("(SELECT row_id, " + date_sql("date", True) + " AS date, " +
              "CASE WHEN trim(vendor) IN ('nan', 'None', '', 'null') THEN NULL ELSE trim(vendor) END AS vendor, "
              + ROBUST_SQL + " AS amount FROM ledger_raw)")


def parsed_raw(t):
    r = standardize_dates(t("ledger_raw"), {"date": "date"})
    return r.select("row_id", "date", clean_text("vendor").alias("vendor"),
                    clean_amount("amount", "robust").alias("amount"))


@query("f01_drop_incomplete", f"SELECT row_id, CAST(date AS VARCHAR) AS date, vendor, amount FROM {PARSED_SQL} p "
       "WHERE NOT ((SELECT count(vendor) > 0 AND count(amount) > 0 FROM " + PARSED_SQL + " q)) "
       "OR (vendor IS NOT NULL AND amount IS NOT NULL)")
def q_f1(spark, t):
    """F1 on the parsed raw ledger."""
    return FL.drop_incomplete(parsed_raw(t), ("vendor", "amount"))


@query("f02_f06_sign_filters", "SELECT 'positive' AS part, row_id FROM ledger WHERE amount > 0 UNION ALL "
       "SELECT 'inflow', row_id FROM ledger WHERE amount > 0 UNION ALL SELECT 'outflow', row_id FROM ledger WHERE amount < 0")
def q_f2(spark, t):
    """F2 positive amounts and F6 inflows / outflows on the ledger."""
    l = t("ledger")
    return (FL.positive_amounts(l).select(F.lit("positive").alias("part"), "row_id")
            .unionByName(FL.inflows(l).select(F.lit("inflow").alias("part"), "row_id"))
            .unionByName(FL.outflows(l).select(F.lit("outflow").alias("part"), "row_id")))


@query("f03_f05_needs_value", "SELECT row_id, vendor IS NULL OR lower(vendor) IN ('', 'unknown', 'uncategorized', 'none', "
       "'null', 'nan', 'other') AS needs_category, amount IS NULL OR lower(amount) IN ('', 'unknown', 'n/a', 'none') "
       "AS needs_text FROM ledger_raw")
def q_f3(spark, t):
    """F3 on raw vendor text used as a category, F5 on the raw amount text."""
    from ..operators.categorize import needs_category
    r = t("ledger_raw")
    return r.select("row_id", needs_category("vendor").alias("needs_category"), FL.needs_text("amount").alias("needs_text"))


@query("f04_not_canonical_category", "SELECT category, count(*) AS n FROM ledger_lines WHERE category IS NULL OR "
       "category NOT IN (" + ", ".join("'" + c.replace("'", "''") + "'" for c in FV.CATEGORIES) + ") GROUP BY category")
def q_f4(spark, t):
    """line categories outside the canonical list, with counts."""
    l = t("ledger_lines")
    return l.filter(FL.not_canonical_category("category")).groupBy("category").agg(F.count("*").alias("n"))


@query("f07_balance_filters", "SELECT 'negative' AS part, row_id, balance FROM accounts WHERE balance < 0 UNION ALL "
       "SELECT 'zero', row_id, balance FROM accounts WHERE balance = 0")
def q_f7(spark, t):
    """F7 on the accounts view."""
    a = t("accounts")
    return (FL.negative_balances(a).select(F.lit("negative").alias("part"), "row_id", "balance")
            .unionByName(FL.zero_balances(a).select(F.lit("zero").alias("part"), "row_id", "balance")))


@query("f08_drop_null_dates_amounts", f"SELECT row_id FROM {PARSED_SQL} p WHERE date IS NOT NULL AND amount IS NOT NULL")
def q_f8(spark, t):
    """F8 on the parsed raw ledger."""
    return FL.drop_null_dates_amounts(parsed_raw(t)).select("row_id")


@query("f09_rlike_accounts", "SELECT row_id, account FROM accounts WHERE regexp_matches(account, '(?i)cash|bank')")
def q_f9(spark, t):
    """case-insensitive regex on account names."""
    a = t("accounts")
    return a.filter(FL.rlike_accounts("account", "cash|bank")).select("row_id", "account")


# ---------------------------------------------------------------- null handling
@query("n01_fill_nulls", f"""
WITH p AS {PARSED_SQL}, m AS (SELECT median(amount) AS med, count(amount) AS n FROM p)
SELECT p.row_id, CAST(p.date AS VARCHAR) AS date, coalesce(p.vendor, 'Unknown') AS vendor,
       round(coalesce(p.amount, CASE WHEN m.n = 0 THEN 0.0 ELSE m.med END), 6) AS amount FROM p, m""")
def q_n1(spark, t):
    """Median / 'Unknown' fill on the parsed raw ledger."""
    out, _ = FL.fill_nulls(parsed_raw(t))
    return out.select("row_id", "date", "vendor", rnd(F.col("amount"), 6).alias("amount"))


@query("n02_coerce_failures", "SELECT 'amount' AS column, amount AS value, count(*) AS n FROM ledger_raw "
       "WHERE amount IS NOT NULL AND TRY_CAST(amount AS DOUBLE) IS NULL GROUP BY amount")
def q_n2(spark, t):
    """Raw amounts that do not convert to DOUBLE."""
    _, fails = FL.coerce_types(t("ledger_raw"), {"amount": "double"})
    return fails.select("column", "value", "n")


@query("n03_convert_data_types", "SELECT row_id, CAST(coalesce(CAST(try_strptime(trim(date), '%Y-%m-%d') AS DATE), "
       "CAST(try_strptime(trim(date), '%Y-%m-%d %H:%M:%S') AS DATE)) AS VARCHAR) AS date, "
       "TRY_CAST(amount AS DOUBLE) AS amount, vendor FROM ledger_raw")
def q_n3(spark, t):
    """Types by header name on the raw ledger."""
    return FL.convert_data_types(t("ledger_raw"))


@query("n04_finalize_types", f"SELECT CAST(row_id AS VARCHAR) AS row_id_text, CAST(date AS VARCHAR) AS date, "
       f"coalesce(amount, 0.0) AS amount, vendor FROM {PARSED_SQL} p")
def q_n4(spark, t):
    """Numeric NULL -> 0, the rest as text (row id shown as text for comparison)."""
    out = FL.finalize_types(parsed_raw(t).withColumn("row_id", F.col("row_id").cast("string")))
    return out.select(F.col("row_id").alias("row_id_text"), "date", "amount", "vendor")


@query("n05_replace_values", "SELECT count(*) FILTER (WHERE vendor IN (" +
       ", ".join("'" + k.replace("'", "''") + "'" for k in FV.VENDOR_ALIASES) + ")) AS rows_affected FROM ledger")
def q_n5(spark, t):
    """Vendor alias replacement count on the ledger."""
    _, n = FL.replace_values(t("ledger"), "vendor", FV.VENDOR_ALIASES)
    return n


@query("n05b_replace_values_known", "SELECT row_id, CASE vendor " + " ".join(
    "WHEN '" + k.replace("'", "''") + "' THEN '" + v.replace("'", "''") + "'" for k, v in FV.VENDOR_ALIASES.items())
    + " ELSE vendor END AS vendor FROM ledger_known")
def q_n5b(spark, t):
    """Vendor aliases replaced, rows returned."""
    out, _ = FL.replace_values(t("ledger_known"), "vendor", FV.VENDOR_ALIASES)
    return out.select("row_id", "vendor")
