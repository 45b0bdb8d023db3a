"""Registered de-duplication queries (J1-J8, A13) over the ledger views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup as D
from ..operators.common import rnd
from .catalog import query

LEDGER_COLS = "row_id, date, amount, vendor, category, memo"

J5_COND = """i.vn = j.vn AND i.row_id < j.row_id
      AND (NOT coalesce(i.a > 0 AND j.a > 0, false) OR abs(i.a - j.a) / greatest(i.a, j.a) <= 0.05)
      AND (i.date IS NULL OR j.date IS NULL OR abs(date_diff('day', i.date, j.date)) <= 3)"""
J6_COND = """i.vendor = j.vendor AND i.row_id < j.row_id AND i.date IS NOT NULL AND j.date IS NOT NULL
      AND abs(date_diff('day', i.date, j.date)) <= 1 AND i.a > 0 AND j.a > 0
      AND abs(i.a - j.a) / greatest(i.a, j.a) <= 0.10"""
J7_COND = """i.vendor = j.vendor AND i.row_id < j.row_id AND i.a > 0 AND j.a > 0
      AND abs(i.a - j.a) / greatest(i.a, j.a) <= 0.02 AND i.date IS NOT NULL AND j.date IS NOT NULL
      AND abs(date_diff('day', i.date, j.date)) <= 7"""


def _step(name: str, src: str, cond: str) -> str:
    return f"""{name}_in AS (SELECT {LEDGER_COLS}, abs(amount) AS a,
        trim(regexp_replace(lower(coalesce(vendor, 'nan')), '[^\\w\\s]', '', 'g')) AS vn FROM {src}),
{name} AS (SELECT {LEDGER_COLS} FROM {name}_in j WHERE NOT EXISTS (
    SELECT 1 FROM {name}_in i WHERE {cond}))"""


def _consolidate(src: str) -> str:
    return f"""cg AS (SELECT vendor, date, count(*) AS n,
        count(DISTINCT category) + max(CASE WHEN category IS NULL THEN 1 ELSE 0 END) AS ncat,
        coalesce(sum(amount), 0) AS total, min(row_id) AS first_id
      FROM {src} WHERE vendor IS NOT NULL AND date IS NOT NULL GROUP BY vendor, date),
g AS (SELECT * FROM cg WHERE n > 1 AND ncat = 1),
m AS (SELECT s.vendor, s.date, s.memo, min(s.row_id) AS mid FROM {src} s
      JOIN g ON s.vendor = g.vendor AND s.date = g.date WHERE s.memo IS NOT NULL GROUP BY 1, 2, 3),
mr AS (SELECT vendor, date, memo, row_number() OVER (PARTITION BY vendor, date ORDER BY mid) AS rn,
              count(*) OVER (PARTITION BY vendor, date) AS nm FROM m),
txt AS (SELECT vendor, date, max(nm) AS nm, string_agg(memo, ', ' ORDER BY rn) FILTER (WHERE rn <= 3) AS shown
        FROM mr GROUP BY 1, 2),
upd AS (SELECT g.first_id, g.total,
          CASE WHEN txt.nm > 0 THEN 'Consolidated ' || CAST(g.n AS VARCHAR) || ' transactions: ' || txt.shown ||
               CASE WHEN txt.nm > 3 THEN ' (+' || CAST(txt.nm - 3 AS VARCHAR) || ' more)' ELSE '' END END AS new_memo
        FROM g LEFT JOIN txt ON g.vendor = txt.vendor AND g.date = txt.date),
consolidated AS (SELECT s.row_id, s.date, coalesce(u.total, s.amount) AS amount, s.vendor, s.category,
          coalesce(u.new_memo, s.memo) AS memo
        FROM {src} s LEFT JOIN upd u ON s.row_id = u.first_id
        WHERE u.first_id IS NOT NULL OR NOT EXISTS (SELECT 1 FROM g WHERE g.vendor = s.vendor AND g.date = s.date))"""


def _out(df):
    return df.select("row_id", F.col("date").cast("string").alias("date"), rnd(F.col("amount"), 4).alias("amount"),
                     "vendor", "category", "memo")


OUT_SQL = "SELECT row_id, CAST(date AS VARCHAR) AS date, round(amount, 4) AS amount, vendor, category, memo FROM "


@query("j01_drop_exact_duplicates", "SELECT DISTINCT CAST(date AS VARCHAR) AS date, round(amount, 4) AS amount, "
       "vendor, category, memo FROM ledger_lines")
def q_j1(spark, t):
    """J1 on the line-level ledger (no row id: all columns compared)."""
    out = D.drop_exact_duplicates(t("ledger_lines"))
    return out.select(F.col("date").cast("string").alias("date"), rnd(F.col("amount"), 4).alias("amount"),
                      "vendor", "category", "memo")


@query("j02_drop_key_duplicates", "SELECT row_id, CAST(date AS VARCHAR) AS date, round(amount, 4) AS amount, vendor, "
       "category, memo FROM (SELECT *, row_number() OVER (PARTITION BY vendor, category ORDER BY row_id) AS rn "
       "FROM ledger_dups) WHERE rn = 1")
def q_j2(spark, t):
    """First row per (vendor, category)."""
    return _out(D.drop_key_duplicates(t("ledger_dups"), ("vendor", "category")))


@query("j02b_flag_key_duplicates", "SELECT row_id, row_id <> min(row_id) OVER (PARTITION BY date, amount) AS dedup_flag "
       "FROM ledger_raw")
def q_j2b(spark, t):
    """J2 flag variant on the raw ledger (text keys)."""
    return D.drop_key_duplicates(t("ledger_raw"), ("date", "amount"), flag="dedup_flag").select("row_id", "dedup_flag")


@query("j03_large_file_duplicates", OUT_SQL + "(SELECT *, row_number() OVER (PARTITION BY vendor, amount, date "
       "ORDER BY row_id) AS rn FROM (SELECT row_id, date, round(amount, -3) AS amount, vendor, category, memo "
       "FROM ledger_dups)) WHERE rn = 1")
def q_j3(spark, t):
    """J3 on ledger_dups with amounts rounded to thousands (so that keys collide)."""
    df = t("ledger_dups").withColumn("amount", F.round("amount", -3))
    return _out(D.drop_large_file_duplicates(df))


@query("j05_fuzzy_vendor_duplicates", "WITH " + _step("j5", "ledger_dups", J5_COND) + "\n" + OUT_SQL + "j5")
def q_j5(spark, t):
    """J5 on ledger_dups (the shifted upper-case copies share the normalised vendor)."""
    return _out(D.fuzzy_vendor_duplicates(t("ledger_dups")))


@query("j06_date_proximity_duplicates", "WITH " + _step("j6", "ledger_dups", J6_COND) + "\n" + OUT_SQL + "j6")
def q_j6(spark, t):
    """J6 on ledger_dups."""
    return _out(D.date_proximity_duplicates(t("ledger_dups")))


@query("j07_amount_similarity_duplicates", "WITH " + _step("j7", "ledger_dups", J7_COND) + "\n" + OUT_SQL + "j7")
def q_j7(spark, t):
    """J7 on ledger_dups."""
    return _out(D.amount_similarity_duplicates(t("ledger_dups")))


@query("a13_consolidate_same_day", "WITH " + _consolidate("ledger_dups") + "\n" + OUT_SQL + "consolidated")
def q_a13(spark, t):
    """A13 on ledger_dups (same-day copies of the same vendor and category)."""
    out, _ = D.consolidate_same_day(t("ledger_dups"))
    return _out(out)


J8_SQL = ("WITH j1 AS (SELECT min(row_id) AS row_id, date, amount, vendor, category, memo FROM ledger_dups "
          "GROUP BY date, amount, vendor, category, memo),\n"
          + _step("j5", "j1", J5_COND) + ",\n" + _step("j6", "j5", J6_COND) + ",\n" + _step("j7", "j6", J7_COND)
          + ",\n" + _consolidate("j7") + "\n" + OUT_SQL + "consolidated")


@query("j08_advanced_dedup", J8_SQL)
def q_j8(spark, t):
    """The whole de-duplication chain on ledger_dups."""
    out, _ = D.advanced_dedup(t("ledger_dups"))
    return _out(out)


@query("j08b_dedup_step_counts")
def q_j8b(spark, t):
    """J8 report: rows after each step."""
    _, rep = D.advanced_dedup(t("ledger_dups"))
    return rep["counts"]


@query("j04_fuzzy_adjacent_dedup")
def q_j4(spark, t):
    """J4 on the event ledger: same timestamp and amount, token-sort similar memo."""
    return D.fuzzy_adjacent_dedup(t("ledger_events"), text="memo").select("row_id", "vendor", "amount")


@query("j01b_drop_exact_copies", "SELECT DISTINCT CAST(date AS VARCHAR) AS date, round(amount, 4) AS amount, vendor, category, memo "
       "FROM ledger_copies")
def q_j1b(spark, t):
    """J1 on a ledger in which every third row stands twice."""
    out = D.drop_exact_duplicates(t("ledger_copies"))
    return out.select(F.col("date").cast("string").alias("date"), rnd(F.col("amount"), 4).alias("amount"), "vendor", "category", "memo")
