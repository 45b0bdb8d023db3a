"""Ledger-shaped views over the driver's TPC-H-like parquet tables.

The view text is plain SQL accepted by both Spark SQL and DuckDB, so the same string
builds the Spark inputs and the prefix of every oracle query (``oracle_prefix``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Ordered: later views may reference earlier ones.
VIEWS: dict[str, str] = {
    "ledger": """
SELECT o_orderkey AS row_id, CAST(o_orderdate AS DATE) AS date,
       CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END AS amount,
       c_name AS vendor, c_mktsegment AS category, o_orderpriority AS memo
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "ledger_dups": """
SELECT row_id, date, amount, vendor, category, memo FROM ledger
UNION ALL
SELECT row_id + 1000000000, CAST(date + INTERVAL '1' DAY AS DATE), amount * 1.01,
       concat(upper(vendor), ','), category, memo FROM ledger WHERE row_id % 20 = 0
UNION ALL
SELECT row_id + 2000000000, date, amount * 0.99, vendor, category, memo FROM ledger WHERE row_id % 20 = 1""",
    # a third of the rows on one Saturday night, one vendor with 40 % of the rows, outliers, equal rents
    "ledger_risky": """
SELECT row_id,
  CASE WHEN row_id % 3 = 0 THEN TIMESTAMP '1997-06-14 23:30:00' ELSE CAST(date AS TIMESTAMP) + INTERVAL '10' HOUR END AS date,
  CASE WHEN row_id % 50 = 4 THEN 1200.0 + row_id % 7 WHEN row_id % 997 = 5 THEN amount * 40 WHEN row_id % 4 = 1 THEN 250.0
       ELSE amount END AS amount,
  CASE WHEN row_id % 50 = 4 THEN 'Steady Rent' WHEN row_id % 50 = 3 THEN 'ATM Withdrawal 24h' WHEN row_id % 5 < 2 THEN 'Acme Holdings'
       ELSE vendor END AS vendor, category, memo
FROM ledger""",
    # vendors, categories and memos that the rule tables know
    "ledger_known": """
SELECT row_id, date, amount,
  CASE row_id % 16 WHEN 0 THEN 'Uber Trip' WHEN 1 THEN 'AMAZON MKTPLACE' WHEN 2 THEN 'Spotify Inc.' WHEN 3 THEN 'DHL Express'
    WHEN 4 THEN 'Office Depot #12' WHEN 5 THEN 'Shell Gas' WHEN 6 THEN 'Adobe Systems' WHEN 7 THEN 'City Water and Electric'
    WHEN 8 THEN 'Corner Cafe' WHEN 9 THEN 'Blue Cross Insurance' WHEN 10 THEN 'Smith Attorney' WHEN 11 THEN 'WAL-MART'
    ELSE vendor END AS vendor,
  CASE WHEN row_id % 16 = 2 THEN 'Annual Plan' WHEN row_id % 5 = 0 THEN 'Transportation' WHEN row_id % 5 = 1 THEN 'office_suplies'
    WHEN row_id % 5 = 2 THEN 'Utilities' WHEN row_id % 5 = 3 THEN 'unknown' ELSE category END AS category,
  CASE row_id % 6 WHEN 0 THEN 'monthly subscription' WHEN 1 THEN 'quarterly billing' WHEN 2 THEN 'annual renewal'
    WHEN 3 THEN 'setup of equipment' WHEN 4 THEN 'lunch at restaurant' ELSE memo END AS memo
FROM ledger""",
    "ledger_copies": """
SELECT date, amount, vendor, category, memo FROM ledger
UNION ALL
SELECT date, amount, vendor, category, memo FROM ledger WHERE row_id % 3 = 0""",
    "ledger_raw": """
SELECT row_id,
  CASE row_id % 6
    WHEN 0 THEN CAST(date AS STRING)
    WHEN 1 THEN concat(lpad(CAST(month(date) AS STRING),2,'0'),'/',lpad(CAST(day(date) AS STRING),2,'0'),'/',CAST(year(date) AS STRING))
    WHEN 2 THEN concat(CAST(day(date) AS STRING),'.',CAST(month(date) AS STRING),'.',CAST(year(date) AS STRING))
    WHEN 3 THEN replace(CAST(date AS STRING),'-','')
    WHEN 4 THEN ' not a date '
    ELSE NULL END AS date,
  CASE row_id % 5
    WHEN 0 THEN concat('$', CAST(abs(amount) AS STRING))
    WHEN 1 THEN concat('(', CAST(abs(amount) AS STRING), ')')
    WHEN 2 THEN concat('USD ', CAST(abs(amount) AS STRING))
    WHEN 3 THEN 'n/a'
    ELSE CAST(amount AS STRING) END AS amount,
  CASE row_id % 4 WHEN 0 THEN concat('  ', vendor, ' ') WHEN 1 THEN 'nan' ELSE vendor END AS vendor
FROM ledger""",
    "ledger_lines": """
SELECT CAST(l_shipdate AS DATE) AS date,
       CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS amount,
       s_name AS vendor, p_type AS category, p_name AS memo
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey""",
    "ledger_events": """
SELECT event_id AS row_id, ts AS date,
       CASE WHEN event_type = 'purchase' THEN value ELSE -value END AS amount,
       concat('User ', CAST(user_id AS STRING)) AS vendor, event_type AS category, props AS memo
FROM events""",
    "accounts": """
SELECT c_custkey AS row_id,
  CASE c_custkey % 10 WHEN 0 THEN 'Cash and Bank' WHEN 1 THEN 'Accounts Receivable' WHEN 2 THEN 'Accounts Payable'
    WHEN 3 THEN 'Long Term Loan' WHEN 4 THEN 'Retained Earnings' WHEN 5 THEN 'Sales Revenue'
    WHEN 6 THEN 'Cost of Goods Sold' WHEN 7 THEN 'Operating Expense' WHEN 8 THEN 'Inventory' ELSE 'Equipment' END AS account,
  CASE WHEN c_custkey % 25 = 0 THEN 0.0 ELSE c_acctbal END AS balance,
  c_mktsegment AS type, CASE WHEN c_nationkey % 3 = 0 THEN 'EUR' ELSE 'USD' END AS currency
FROM customer""",
}


def register_tables(spark: SparkSession, sf_dir: str, names=BASE_TABLES) -> None:
    """Register the base parquet tables as temp views (lazy; nothing is read yet)."""
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Register base tables plus every ledger view for ``sf_dir``."""
    register_tables(spark, sf_dir)
    for name, sql in VIEWS.items():
        spark.sql(sql).createOrReplaceTempView(name)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One ledger view (or base table) as a DataFrame, analysed against ``sf_dir``."""
    register_views(spark, sf_dir)
    return spark.table(name)


def oracle_prefix() -> str:
    """``WITH`` clause defining all ledger views, for DuckDB oracle queries."""
    return "WITH " + ",\n".join(f"{n} AS ({sql})" for n, sql in VIEWS.items()) + "\n"
