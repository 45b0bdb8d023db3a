"""Registered queries for header mapping (H), lookups and similarity joins (J9-J18),
sources (S), composite cleaning paths (P25, P26, X6-X14) and the batch form of the
stream operators (Q2, Q3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as FV
from ..functions.text import dedup_key
from ..operators import enrich as E
from ..operators import mapping as H
from ..operators.common import rnd, with_scalars
from ..sources.testdata import BASE_TABLES
from .catalog import query
from .queries_core import K9_SQL, money_sql
from .queries_scalar import parsed_raw


def headers(spark, t):
    """Header table of every base test table (derived from their schemas)."""
    return H.header_table(spark, {n: t(n) for n in BASE_TABLES})


HDR_SQL = ("(SELECT table_name AS source_file, CAST(ordinal_position - 1 AS INTEGER) AS position, column_name AS \"column\" "
           "FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{n}'" for n in BASE_TABLES) + "))")


def _alias_values() -> str:
    import re
    norm = {}
    for canon, aliases in FV.HEADER_ALIASES.items():
        for a in aliases:
            norm[re.sub(r"\W+", "", a.strip().lower())] = canon
        norm[canon] = canon
    return "(VALUES " + ", ".join(f"('{a}', '{f}')" for a, f in sorted(norm.items())) + ") AS al(alias, field)"


@query("h01_h02_canonicalise_headers", "SELECT h.source_file, h.position, h.\"column\", al.field FROM " + HDR_SQL + " h "
       "LEFT JOIN " + _alias_values() + " ON regexp_replace(lower(trim(h.\"column\")), '\\W+', '', 'g') = al.alias")
def q_h2(spark, t):
    """H1/H2: canonical field of every column header of the test tables."""
    return H.canonicalise_headers(headers(spark, t))


def _kw_rows(table) -> str:
    return "(VALUES " + ", ".join(f"({fi}, '{f}', {pi}, '{w}')" for fi, (f, ws) in enumerate(table.items())
                                   for pi, w in enumerate(ws)) + ") AS kw(field_order, field, pattern_order, kw)"


@query("h05_map_fallback", "WITH hits AS (SELECT h.source_file, h.position, h.\"column\", kw.field, kw.field_order FROM "
       + HDR_SQL + " h JOIN " + _kw_rows(FV.FALLBACK_KEYWORDS) + " ON contains(lower(h.\"column\"), kw.kw)), "
       "pc AS (SELECT source_file, position, \"column\", arg_min(field, field_order) AS field FROM hits GROUP BY 1, 2, 3) "
       "SELECT source_file, \"column\", field FROM (SELECT *, row_number() OVER (PARTITION BY source_file, field ORDER BY position) "
       "AS rn FROM pc) WHERE rn = 1")
def q_h5(spark, t):
    """H5 on the test tables' headers."""
    return H.map_fallback(headers(spark, t))


@query("h06_map_keyword_count")
def q_h6(spark, t):
    """H6 on the test tables' headers."""
    return H.map_keyword_count(headers(spark, t))


@query("h07_map_rule_scored")
def q_h7(spark, t):
    """H7 on the test tables' headers."""
    return H.map_rule_scored(headers(spark, t))


@query("h08_map_regex_fuzzy")
def q_h8(spark, t):
    """H8 on the test tables' headers."""
    return H.map_regex_fuzzy(headers(spark, t))


@query("h09_map_pattern_coverage")
def q_h9(spark, t):
    """H9 on the test tables' headers."""
    return H.map_pattern_coverage(headers(spark, t))


@query("h16_map_semantic")
def q_h16(spark, t):
    """H16 on the test tables' headers."""
    return H.map_semantic(headers(spark, t))


KINDS_SQL = "(VALUES " + ", ".join(f"({ki}, '{k}', {len(ps)})" for ki, (k, ps) in enumerate(FV.TABLE_KINDS.items())) \
    + ") AS kd(kind_order, kind, np)"
PATS_SQL = "(VALUES " + ", ".join(f"('{k}', {pi}, '{p}')" for k, ps in FV.TABLE_KINDS.items()
                                   for pi, p in enumerate(ps)) + ") AS kp(kind, pattern_order, pattern)"


@query("h21_classify_table", "WITH hits AS (SELECT source_file, kind, count(DISTINCT pattern_order) AS hit FROM " + HDR_SQL +
       " h JOIN " + PATS_SQL + " ON regexp_matches(lower(h.\"column\"), kp.pattern) GROUP BY 1, 2), "
       "g AS (SELECT f.source_file, kd.kind, kd.kind_order, coalesce(hits.hit, 0) / kd.np AS score FROM "
       "(SELECT DISTINCT source_file FROM " + HDR_SQL + " x) f CROSS JOIN " + KINDS_SQL +
       " LEFT JOIN hits ON hits.source_file = f.source_file AND hits.kind = kd.kind) "
       "SELECT source_file, arg_min(kind, (-score, kind_order)) AS kind, round(max(score), 6) AS confidence FROM g GROUP BY 1")
def q_h21(spark, t):
    """Table kind of every test table from its headers."""
    return H.classify_table(headers(spark, t)).withColumn("confidence", rnd(F.col("confidence"), 6))


#: H22 on tables with and without dates: (columns, date column or None, first text column, order).
ACCOUNTING_TABLES = {"ledger": ("row_id date amount vendor category memo", "date", "vendor", "row_id"),
                     "ledger_events": ("row_id date amount vendor category memo", "date", "vendor", "row_id"),
                     "accounts": ("row_id account balance type currency", None, "account", "row_id"),
                     "year_end": ("account balance date", "date", "account", "account, balance"),
                     "payments": ("payment_reference payee_name value", None, "payee_name", "payment_reference")}
YEAR_END = "SELECT account, balance, DATE '2020-12-31' AS date FROM accounts"
PAYMENTS = "SELECT row_id AS payment_reference, vendor AS payee_name, amount AS value FROM ledger"


def _accounting_sql() -> str:
    rows = []
    for name, (cols, date, text, order) in ACCOUNTING_TABLES.items():
        src = {"year_end": f"({YEAR_END})", "payments": f"({PAYMENTS})"}.get(name, name)
        terms = {k: sum(w for x, w in ws.items() if any(x in c for c in cols.split()))
                 for k, ws in (("a", FV.ACCOUNTING_TERMS), ("t", FV.TRANSACTION_TERMS))}
        like = " OR ".join(f"contains(lower({text}), '{x}')" for x in FV.ACCOUNT_NAME_TERMS)
        rows.append(f"SELECT '{name}' AS source_file, {date is not None} AS named, {terms['a']} AS a, {terms['t']} AS t, count(*) AS n, "
                    f"count(DISTINCT {date or 'NULL'}) AS days, (SELECT count(*) FILTER (WHERE {like}) FROM (SELECT {text} FROM {src} "
                    f"ORDER BY {order} LIMIT 10)) AS alike FROM {src}")
    return ("WITH f AS (" + " UNION ALL ".join(rows) + "), s AS (SELECT source_file, "
            "a + CASE WHEN named AND days <= 5 AND n > 10 THEN 2 WHEN NOT named THEN 3 ELSE 0 END + CASE WHEN alike >= 3 THEN 2 ELSE 0 END "
            "AS accounting_score, t + CASE WHEN named AND NOT (days <= 5 AND n > 10) AND days > 0.5 * n THEN 2 ELSE 0 END AS transactions_score "
            "FROM f) SELECT *, CASE WHEN accounting_score > transactions_score THEN 'accounting' ELSE 'transactions' END AS detected_type, "
            "round(least(0.95, 0.5 + 0.05 * greatest(accounting_score, transactions_score)), 6) AS confidence, "
            "CASE WHEN least(0.95, 0.5 + 0.05 * greatest(accounting_score, transactions_score)) > 0.7 THEN 'Process as ' || detected_type || ' data' "
            "ELSE 'Manual review recommended' END AS recommendation FROM s")


@query("h22_detect_accounting", _accounting_sql())
def q_h22(spark, t):
    """Accounting or transactions, for ledgers, a chart of accounts, a year-end snapshot and a list of payments."""
    t("accounts")
    made = {"year_end": YEAR_END, "payments": PAYMENTS}
    tables = {n: spark.sql(made[n]) if n in made else t(n) for n in ACCOUNTING_TABLES}
    order = {n: [c.strip() for c in o.split(",")] for n, (_, _, _, o) in ACCOUNTING_TABLES.items()}
    return H.detect_accounting(tables, order).withColumn("confidence", rnd(F.col("confidence"), 6))


@query("h23_suggest_mappings")
def q_h23(spark, t):
    """H23 on the test tables' headers (suggestions joined as text)."""
    return H.suggest_mappings(headers(spark, t)).withColumn("suggestions", F.array_join("suggestions", ","))


@query("h24_mapping_strategy")
def q_h24(spark, t):
    """H24 + V7: mapping chain over the test tables' headers, with mapping checks."""
    hd = headers(spark, t)
    m = H.mapping_strategy(hd)
    return m.select("source_file", "column", "field", "method").unionByName(
        H.mapping_checks(hd, m).select("source_file", F.col("item").alias("column"), F.col("issue").alias("field"),
                                       F.lit("check").alias("method")))


def _profile_sql(table: str, cols: list[str]) -> str:
    parts = []
    for i, c in enumerate(cols):
        s = f"CAST(\"{c}\" AS VARCHAR)"
        low, plain = f"lower({s})", f"TRY_CAST({s} AS DOUBLE)"
        num = f"TRY_CAST(regexp_replace({s}, '[$,]', '', 'g') AS DOUBLE)"
        rate = lambda cond: f"CASE WHEN count({s}) > 0 THEN count(*) FILTER (WHERE {cond}) / count({s}) ELSE 0.0 END"
        most = lambda conds: "greatest(" + ", ".join(map(rate, conds)) + ")"
        parsed = " OR ".join(f"try_strptime(trim({s}), '{f}') IS NOT NULL" for f in ("%Y-%m-%d", "%m/%d/%Y", "%d.%m.%Y"))
        parts.append(
            f"SELECT {i} AS position, '{c}' AS \"column\", count(*) AS rows, count({s}) AS non_null, "
            f"count(*) - count({s}) AS null_count, round(CASE WHEN count(*) > 0 THEN (count(*) - count({s})) / count(*) ELSE 0.0 END, 6) AS null_pct, "
            f"count(DISTINCT {s}) AS distinct, round({rate(f'{plain} IS NOT NULL')}, 6) AS numeric_rate, "
            f"round({most([f"regexp_matches({s}, '{r}')" for r in FV.NUMBER_PATTERNS])}, 6) AS number_pattern_rate, "
            f"round({most([f"contains({s}, '{w}')" for w in FV.CURRENCY_SYMBOLS])}, 6) AS currency_rate, "
            f"round({most([f"regexp_matches({low}, '{r}')" for r in FV.CONTENT_DATE_REGEXES])}, 6) AS date_pattern_rate, "
            f"round({most([f"contains({low}, '{w}')" for w in FV.CONTENT_MONTH_NAMES])}, 6) AS month_name_rate, "
            f"round({rate(f'{plain} IS NULL AND ({parsed})')}, 6) AS date_parse_rate, "
            f"round(avg(length({s})), 6) AS avg_len, round(avg(len(string_split_regex(trim({s}), '\\s+'))), 6) AS avg_words, "
            f"round(avg(len(string_split_regex({s}, '\\s+'))), 6) AS avg_word_gaps, "
            f"round(min(abs({num})), 6) AS min_abs, round(max(abs({num})), 6) AS max_abs, round(avg({num}), 6) AS mean, "
            f"round(stddev_samp({num}), 6) AS std, round(min(abs({plain})), 6) AS plain_min_abs, "
            f"round(max(abs({plain})), 6) AS plain_max_abs, round(avg({plain}), 6) AS plain_mean, "
            f"round(stddev_samp({plain}), 6) AS plain_std, "
            f"round({most([f"contains({low}, '{w}')" for w in FV.BUSINESS_INDICATORS])}, 6) AS business_rate, "
            f"round({most([f"contains({low}, '{w}')" for w in FV.COMMON_VENDORS])}, 6) AS known_vendor_rate FROM {table}")
    return " UNION ALL ".join(parts)


RAW_COLS = ["row_id", "date", "amount", "vendor"]
PROFILE_DOUBLES = ["null_pct", "numeric_rate", "number_pattern_rate", "currency_rate", "date_pattern_rate",
                   "month_name_rate", "date_parse_rate", "avg_len", "avg_words", "avg_word_gaps", "min_abs", "max_abs", "mean",
                   "std", "plain_min_abs", "plain_max_abs", "plain_mean", "plain_std", "business_rate", "known_vendor_rate"]
#: Tables for the content rules: columns, and those of them that hold text.
MAPPED = {"ledger_raw": (RAW_COLS, ["date", "amount", "vendor"]),
          "ledger_lines": (["date", "amount", "vendor", "category", "memo"], ["vendor", "category", "memo"]),
          "accounts": (["row_id", "account", "balance", "type", "currency"], ["account", "type", "currency"])}


def _all_profiles_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{t}' AS source_file, \"column\" IN ({', '.join(repr(c) for c in text)}) AS is_text, * FROM ("
                              + _profile_sql(t, cols) + ")" for t, (cols, text) in MAPPED.items())


IS_DATE = "((non_null > 0 AND date_parse_rate = 1.0) OR date_pattern_rate > 0.3 OR month_name_rate > 0.1)"
CONTENT_SQL = (f"CASE WHEN non_null = 0 THEN NULL WHEN {IS_DATE} THEN 'date' "
               "WHEN (numeric_rate > 0.8 AND plain_max_abs < 1e6 AND plain_min_abs > 0.01) OR currency_rate > 0.3 "
               "OR number_pattern_rate > 0.5 THEN 'amount' "
               "WHEN is_text AND (business_rate > 0.1 OR known_vendor_rate > 0.05 OR avg_word_gaps > 1.5) THEN 'vendor' "
               "WHEN is_text AND (avg_len > 20 OR numeric_rate < 0.3) THEN 'memo' END")
STATISTICS_SQL = ("CASE WHEN \"distinct\" / greatest(non_null, 1) > 0.8 AND null_pct < 0.1 AND date_parse_rate = 1.0 THEN 'date' "
                  "WHEN numeric_rate * non_null > 0.8 * rows AND plain_std > 0 AND plain_mean > 0 AND plain_std < 10 * plain_mean "
                  "THEN 'amount' WHEN is_text AND \"distinct\" / greatest(non_null, 1) > 0.3 AND "
                  "\"distinct\" / greatest(non_null, 1) < 0.9 THEN 'vendor' END")


@query("h00_profile_columns", _profile_sql("ledger_raw", RAW_COLS))
def q_h0(spark, t):
    """H0: one-pass profile of every raw ledger column."""
    p = H.profile_columns(t("ledger_raw"))
    return p.withColumns({c: rnd(F.col(c), 6) for c in PROFILE_DOUBLES})


def _per_table(t, rule):
    from functools import reduce
    parts = [rule(H.profile_columns(t(name).select(*cols)), text).withColumn("source_file", F.lit(name)) for name, (cols, text) in MAPPED.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("h10_h15_content_mapping", "SELECT source_file, \"column\", " + CONTENT_SQL + " AS content_field FROM ("
       + _all_profiles_sql() + ") WHERE content_field IS NOT NULL")
def q_h10(spark, t):
    """Content-based field of each column of three tables (text columns may be vendor/memo)."""
    return _per_table(t, H.map_by_content).withColumnRenamed("field", "content_field")


@query("h15_map_by_statistics", "SELECT source_file, \"column\", " + STATISTICS_SQL + " AS field FROM ("
       + _all_profiles_sql() + ") WHERE field IS NOT NULL")
def q_h15(spark, t):
    """Statistics-based field of each column of three tables."""
    return _per_table(t, H.map_by_statistics)


@query("h03_standardize_columns")
def q_h3(spark, t):
    """H3: the orders table renamed to the canonical ledger columns (with provenance)."""
    clean, prov, dropped = H.standardize_columns(t("orders"), "orders")
    return clean.withColumn("mapped_from", F.lit(",".join(r.old or "" for r in prov.collect())))


@query("h04_h20_names_and_defaults")
def q_h4(spark, t):
    """H4 (snake case) and H20 (missing canonical columns) on the event table."""
    return H.ensure_columns(H.snake_case_columns(t("events").withColumnRenamed("event_type", "EventType")))


# ---------------------------------------------------------------- J9-J18
@query("j09_reuse_cached_decisions", """
WITH cache AS (SELECT md5(concat_ws('_', coalesce(vendor, ''), coalesce(CAST(amount AS VARCHAR), ''), coalesce(CAST(date AS VARCHAR), '')))
                 AS key, min(category) AS category FROM ledger GROUP BY 1),
d AS (SELECT row_id, vendor, md5(concat_ws('_', coalesce(vendor, ''), coalesce(CAST(amount AS VARCHAR), ''), coalesce(CAST(date AS VARCHAR), '')))
        AS key FROM ledger_dups)
SELECT d.row_id, coalesce(c.category, """ + "CASE WHEN d.vendor IS NULL THEN 'Other' " + " ".join(
    f"WHEN {' OR '.join(f'contains(lower(d.vendor), {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{n}'" for n, ws in FV.SIMPLE_RULES)
    + """ ELSE 'Other' END) AS category, c.key IS NOT NULL AS cache_hit FROM d LEFT JOIN cache c ON d.key = c.key""")
def q_j9(spark, t):
    """ledger_dups looked up in a decision cache built from the ledger; misses get the
    rule category (C1)."""
    from ..operators.categorize import categorize_simple
    cache = t("ledger").groupBy(dedup_key().alias("key")).agg(F.min("category").alias("category"))
    out, _ = E.reuse_cached_decisions(t("ledger_dups").drop("category"), cache, lambda f: categorize_simple("vendor"))
    return out.select("row_id", "category", "cache_hit")


@query("j10_similar_label_transfer", """
WITH p AS (SELECT a.vec_id AS q, b.vec_id AS n, b.label AS nl, list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s
           FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
f AS (SELECT * FROM p WHERE s > 0.8),
best AS (SELECT q, arg_min(nl, (-s, n)) AS transferred_label, max(s) AS best_similarity FROM f GROUP BY q)
SELECT e.vec_id, e.label, best.transferred_label, round(best.best_similarity, 4) AS best_similarity
FROM embeddings e LEFT JOIN best ON e.vec_id = best.q""")
def q_j10(spark, t):
    """Nearest-neighbour label transfer over all embeddings (exact, pivot-blocked)."""
    out = E.similar_label_transfer(t("embeddings"))
    return out.select("vec_id", "label", "transferred_label", rnd(F.col("best_similarity"), 4).alias("best_similarity"))


@query("j11_semantic_duplicates", """
WITH x AS (SELECT row_id, date, abs(amount) AS a, list_distinct(list_filter(regexp_split_to_array(
             lower(coalesce(vendor, 'nan') || ' ' || coalesce(memo, 'nan')), '\\s+'), lambda s: s <> '')) AS tk FROM ledger_dups),
near AS (SELECT j.row_id, i.tk AS ti, j.tk AS tj FROM x j CROSS JOIN (SELECT unnest(range(-3, 4)) AS off) o
         JOIN x i ON i.date = CAST(j.date + to_days(CAST(o.off AS INTEGER)) AS DATE) AND i.row_id < j.row_id
          AND (NOT coalesce(i.a > 0 AND j.a > 0, false) OR abs(i.a - j.a) / greatest(i.a, j.a) <= 0.05))
SELECT row_id FROM x WHERE row_id NOT IN (
  SELECT row_id FROM near WHERE 2 * len(list_intersect(ti, tj)) >= len(list_distinct(list_concat(ti, tj))))""")
def q_j11(spark, t):
    """Duplicates of ledger_dups by similar vendor + memo texts (all dates are known there)."""
    return E.semantic_duplicates(t("ledger_dups")).select("row_id")


@query("j12_normalize_vendor")
def q_j12(spark, t):
    """Vendor registry match of the distinct raw vendor texts."""
    v = t("ledger_raw").select("vendor").distinct()
    return E.normalize_vendor(v).select("vendor", "canonical_vendor")


@query("j13_p18_template_memos")
def q_j13(spark, t):
    """J13 + P18: registry category and template memo for the line ledger's suppliers."""
    return E.template_memos(t("ledger_lines")).select("vendor", "category", "template_memo").distinct()


@query("j14_canonicalize_category")
def q_j14(spark, t):
    """Part types mapped onto the canonical category list."""
    return E.canonicalize_category(t("ledger_lines").select("category").distinct().withColumn("raw", F.col("category")))


def _ledger_known_row(spark, t, make, *cols):
    return make(t("ledger_known")).select("row_id", *cols)


@query("j12b_normalize_vendor_known")
def q_j12b(spark, t):
    """J12 on vendors some of which the registry knows by name or alias (no SQL for the token-sort ratio)."""
    return _ledger_known_row(spark, t, E.normalize_vendor, "vendor", "canonical_vendor")


@query("j13b_p18_template_memos_known")
def q_j13b(spark, t):
    """J13 + P18 on registry vendors with registry categories."""
    return _ledger_known_row(spark, t, E.template_memos, "vendor", "category", "template_memo")


@query("j14b_canonicalize_category_known")
def q_j14b(spark, t):
    """J14 on canonical, misspelt and unknown categories."""
    return _ledger_known_row(spark, t, lambda d: E.canonicalize_category(d.withColumn("raw", F.col("category"))), "raw", "category")


@query("j18b_row_diff", "SELECT CAST(date AS VARCHAR) AS date, round(amount, 4) AS amount, vendor, category, memo FROM ledger_copies "
       "EXCEPT ALL SELECT CAST(date AS VARCHAR), round(amount, 4), vendor, category, memo FROM ledger")
def q_j18b(spark, t):
    """J18 row level: the copies that the plain ledger does not hold, as a multiset."""
    r = lambda d: d.withColumns({"date": F.col("date").cast("string"), "amount": rnd(F.col("amount"), 4)})
    return E.row_diff(r(t("ledger_copies")), r(t("ledger").drop("row_id")))


@query("j15_semi_filter", "SELECT row_id FROM ledger WHERE vendor IN (SELECT vendor FROM ledger GROUP BY vendor "
       "ORDER BY sum(abs(amount)) DESC, vendor LIMIT 10)")
def q_j15(spark, t):
    """Ledger rows of the ten largest vendors (left semi join)."""
    l = t("ledger")
    top = l.groupBy("vendor").agg(F.sum(F.abs("amount")).alias("_s")).orderBy(F.desc("_s"), "vendor").limit(10)
    return E.semi_filter(l, top).select("row_id")


@query("j16_attach_vendor_risk", "WITH k AS (" + money_sql(K9_SQL) + ") SELECT coalesce(k.risk_level, 'Unknown') AS vendor_risk, "
       "count(*) AS n FROM ledger l LEFT JOIN k ON l.vendor = k.vendor_name GROUP BY 1")
def q_j16(spark, t):
    """Vendor risk level (K9) attached to every ledger row, counted per level."""
    from ..operators.insights import vendor_relationships
    l = t("ledger")
    risk = vendor_relationships(l).select(F.col("vendor_name").alias("vendor"), "risk_level")
    return E.attach_vendor_risk(l, risk).groupBy("vendor_risk").agg(F.count("*").alias("n"))


@query("j17_lookup_vendor_frequency", "SELECT row_id, count(*) OVER (PARTITION BY vendor) AS vendor_frequency FROM ledger")
def q_j17(spark, t):
    """Rows per vendor attached to each ledger row."""
    return E.lookup_vendor_frequency(t("ledger")).select("row_id", "vendor_frequency")


@query("j18_quality_diff", "SELECT (SELECT count(*) FROM ledger_dups) AS original_rows, count(*) AS cleaned_rows, "
       "(SELECT count(*) FROM ledger_dups) - count(*) AS rows_removed, '' AS columns_added, 'category' AS columns_removed "
       "FROM (SELECT DISTINCT vendor, amount, date FROM ledger_dups)")
def q_j18(spark, t):
    """ledger_dups before / after key de-duplication on (vendor, amount, date)."""
    from ..operators.dedup import drop_large_file_duplicates
    d = t("ledger_dups")
    cleaned = drop_large_file_duplicates(d).drop("category")
    return E.quality_diff(d, cleaned)


# ---------------------------------------------------------------- sources
def table_path(df) -> str:
    """The folder of a table of part files, or its one file."""
    files = df.inputFiles()
    return files[0] if len(files) == 1 else files[0].rsplit("/", 1)[0]


@query("s01_read_ledger")
def q_s1(spark, t):
    """The orders parquet read through the ledger reader (source file kept)."""
    from ..sources.readers import read_ledger
    path = table_path(t("orders"))
    return read_ledger(spark, path, "parquet").groupBy("source_file").agg(F.count("*").alias("rows"))


@query("s05_multi_file_summary")
def q_s5(spark, t):
    """S2 + S5: two tables read, mapped to canonical columns and summarised with a total."""
    from ..sources.readers import read_many
    paths = [table_path(t("orders")), table_path(t("customer"))]
    combined, info = read_many(spark, paths, standardize=lambda d: H.standardize_columns(d, keep=("_file", "_broken"))[0])
    return info.withColumn("source_file", F.regexp_extract("source_file", r"([^/]+)$", 1))


@query("s06_filter_date_range", "SELECT row_id FROM ledger WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def q_s6(spark, t):
    """Ledger rows of 1996."""
    from ..sources.readers import filter_date_range
    return filter_date_range(t("ledger"), "1996-01-01", "1996-12-31").select("row_id")


@query("s07_preview", "SELECT row_id, strftime(date, '%Y-%m-%d') AS date, amount, substr(vendor, 1, 100) AS vendor, "
       "substr(category, 1, 100) AS category, substr(memo, 1, 100) AS memo FROM ledger ORDER BY row_id LIMIT 3")
def q_s7(spark, t):
    """Three-row preview of the ledger."""
    from ..sources.readers import preview
    return preview(t("ledger"), 3, order_by=["row_id"])


@query("s04_processing_summary")
def q_s4(spark, t):
    """Key metrics of the ledger as (Metric, Value) rows."""
    from ..operators.aggregates import key_metrics
    from ..sources.readers import processing_summary
    return processing_summary(key_metrics(t("ledger")))


# ---------------------------------------------------------------- composite paths
def raw_with_text(t):
    """Raw ledger (text dates / amounts / vendors) with the category and memo of each row."""
    return t("ledger_raw").join(t("ledger").select("row_id", "category", "memo"), "row_id")


@query("p25_clean_transactions")
def q_p25(spark, t):
    """P25: transaction cleaning of the raw ledger."""
    from .composites import clean_transactions
    out, _ = clean_transactions(raw_with_text(t))
    return out


@query("p26_bulk_clean")
def q_p26(spark, t):
    """Bulk cleaning of the raw ledger."""
    from .composites import bulk_clean
    return bulk_clean(raw_with_text(t))


@query("p20_p24_kind_cleaners")
def q_p20(spark, t):
    """X14 + P20-P24: every test table classified and sent to its cleaner; rows per table."""
    from .composites import clean_any
    parts = []
    for n in ("customer", "supplier", "part", "orders", "nation"):
        out, rep = clean_any(t(n), n)
        kind = rep["classification"].first().kind
        parts.append(out.agg(F.count("*").alias("rows")).withColumn("table", F.lit(n)).withColumn("kind", F.lit(kind)))
    from functools import reduce
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("x06_x07_rule_chain")
def q_x6(spark, t):
    """The standard rule chain over the raw ledger."""
    from .composites import standard_registry
    from .registry import run_pipeline
    reg = standard_registry()
    out, _ = run_pipeline(raw_with_text(t).drop("row_id"), {"rules": reg.names()}, reg)
    return out


@query("x09_hybrid_rules")
def q_x9(spark, t):
    """Standard rules, model step and history, twice, the second run appended to the first."""
    from .composites import hybrid_pipeline
    src = raw_with_text(t).drop("row_id")
    hook = lambda pdf: ["Other"] * len(pdf)
    _, first = hybrid_pipeline(src, hook, run="first")
    _, rep = hybrid_pipeline(src, run="second", history=first["history"])
    return rep["history"]


@query("x10_hybrid_full")
def q_x10(spark, t):
    """Bulk clean, samples, scaled patterns, vendor risk attached; rows per risk."""
    from .composites import hybrid_full
    out, _ = hybrid_full(t("ledger"))
    return out.groupBy("vendor_risk").agg(F.count("*").alias("n"))


@query("x11_clean_ledger")
def q_x11(spark, t):
    """X11: complete ledger path over the raw ledger (rows after cleaning)."""
    from .composites import clean_ledger
    out, _ = clean_ledger(raw_with_text(t))
    return out.select("row_id", "date", "amount", "vendor", "category", "memo")


@query("x12_core_clean")
def q_x12(spark, t):
    """Core cleaning of the raw ledger."""
    from .composites import core_clean
    out, _ = core_clean(raw_with_text(t))
    return out


@query("x13_dream_clean")
def q_x13(spark, t):
    """Rule path with a decision cache over the ledger."""
    from .composites import dream_clean
    cache = t("ledger").groupBy(dedup_key().alias("key")).agg(F.min("category").alias("category"))
    out, _ = dream_clean(t("ledger_dups"), cache=cache)
    return out


def model_stub(pdf):
    """A hook for queries and tests: segments by the first letter of the category; vendors whose last digit is 7
    get no answer, and a batch in which one ends with 99 fails."""
    if any(isinstance(v, str) and v.endswith("99") for v in pdf["vendor"]):
        raise RuntimeError("service not available")
    return ["Travel" if c < "F" else "Groceries" for c in pdf["category"]]


@query("x04_score_in_batches", "SELECT row_id, CASE WHEN vendor LIKE '%99' THEN 'fallback' ELSE 'model' END AS model_category_from, "
       "CASE WHEN vendor LIKE '%99' THEN 'Office' WHEN category < 'F' THEN 'Travel' ELSE 'Other' END AS model_category FROM ledger")
def q_x4(spark, t):
    """A hook that answers most batches (of one row each here), fails on some and gives values that are not allowed."""
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = t("ledger").select("row_id", "vendor", "category").repartition(tasks)      # a few blocks of orders feed the hook else
    out, _ = E.score_in_batches(rows, model_stub, "model_category", F.lit("Office"), batch=1, allowed=["Travel", "Office"])
    return out.select("row_id", "model_category", "model_category_from")


@query("x05_parse_model_json", "SELECT row_id, TRY_CAST(json_extract_string(memo, '$.k') AS INTEGER) AS k FROM ledger_events")
def q_x5(spark, t):
    """JSON properties of the event ledger parsed through the response parser."""
    ev = t("ledger_events").select("row_id", F.concat(F.lit("```json\n"), F.col("memo"), F.lit("\n```")).alias("resp"))
    return ev.select("row_id", E.parse_model_json("resp", "k INT").alias("parsed")).select("row_id", "parsed.k")


# ---------------------------------------------------------------- streaming operators, batch form
FLOW_SQL = ("SELECT CAST(date_trunc('day', date) AS VARCHAR) AS day_start, "
       "CAST(date_trunc('day', date) + INTERVAL 1 DAY AS VARCHAR) AS day_end, count(*) AS n, "
       "round(sum(CASE WHEN amount > 0 THEN amount ELSE 0.0 END), 4) AS inflow, "
       "round(sum(CASE WHEN amount < 0 THEN -amount ELSE 0.0 END), 4) AS outflow, round(sum(amount), 4) AS net "
       "FROM ledger_events GROUP BY 1, 2")


@query("q03_daily_flow", FLOW_SQL)
def q_q3(spark, t):
    """Q3 over the event ledger as a bounded stream (same operator, batch input)."""
    from ..streaming.streams import stream_daily_flow
    d = stream_daily_flow(t("ledger_events"))   # wall-clock (NTZ) days: independent of the session time zone
    return d.withColumns({c: rnd(F.col(c), 4) for c in ("inflow", "outflow", "net")}).withColumns(
        {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("day_start", "day_end")})


@query("q02_dedup_within_watermark", "SELECT count(*) AS n FROM (SELECT DISTINCT vendor, amount FROM ledger_events)")
def q_q2(spark, t):
    """Q2 on a bounded input: repeated (vendor, amount) keys dropped."""
    from ..streaming.streams import batch_dedup
    return batch_dedup(t("ledger_events"), ["vendor", "amount"]).agg(F.count("*").alias("n"))


def _event_stream(spark, t):
    """The event table as a stream of its files, in the columns of the ledger."""
    table = t("events")
    path = table_path(table)
    folder, name = path.rsplit("/", 1)
    src = spark.readStream.schema(table.schema).parquet(f"{folder}/[{name[0]}]{name[1:]}")      # a pattern may name one file
    return src.select(F.col("event_id").alias("row_id"), F.col("ts").cast("timestamp").alias("date"),
                      F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(-F.col("value")).alias("amount"),
                      F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("vendor"))


def _drained(spark, stream, name, output_mode="append"):
    """Run ``stream`` over all that is there, one epoch after the other, and read what it wrote in the shared folder."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..streaming.streams import epoch_sink, stream_insights
    base = f"{(spark.conf.get('spark.checkpoint.dir', None) or ensure_checkpoint_dir(spark)).rstrip('/')}/stream-{uuid.uuid4().hex}"
    q = stream_insights(stream, epoch_sink(f"{base}/out"), f"{base}/checkpoint", {name: lambda d: d}, available_now=True, output_mode=output_mode)
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out/{name}")


@query("q02b_stream_dedup", "SELECT DISTINCT vendor, amount FROM ledger_events")
def q_q2b(spark, t):
    """Q2 as a stream: the event files run through watermarked state; all repeats lie within the watermark."""
    from ..streaming.streams import stream_dedup
    keys = ["vendor", "amount"]
    return _drained(spark, stream_dedup(_event_stream(spark, t), keys, "date", "36500 days"), "dedup").select(*keys)


@query("q03b_stream_daily_flow", FLOW_SQL)
def q_q3b(spark, t):
    """Q3 as a stream: daily windows kept as state; the last epoch holds the complete result."""
    from ..streaming.streams import stream_daily_flow
    d = _drained(spark, stream_daily_flow(_event_stream(spark, t)), "flow", "complete")
    last = d.agg(F.max("epoch").alias("epoch"))
    d = with_scalars(d, last.withColumnRenamed("epoch", "last")).filter("epoch = last").drop("epoch", "last")
    return d.withColumns({c: rnd(F.col(c), 4) for c in ("inflow", "outflow", "net")}).withColumns(
        {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("day_start", "day_end")})


@query("q04_stream_insights", "SELECT vendor, count(*) AS n, round(sum(abs(amount)), 4) AS spend FROM ledger_events GROUP BY vendor")
def q_q4(spark, t):
    """Q4: a detector (spend by vendor) on every micro-batch, its epochs added up."""
    from ..streaming.streams import stream_insights  # noqa: F401  (run by _drained)
    d = _drained(spark, _event_stream(spark, t), "rows")
    return d.groupBy("vendor").agg(F.count("*").alias("n"), rnd(F.sum(F.abs("amount")), 4).alias("spend"))


