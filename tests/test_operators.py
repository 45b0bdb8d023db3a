"""Operators on literal frames: categorisation rules, risk ordering, accounts, mapping."""

import datetime as dt

from pyspark.sql import functions as F

from tallyspark.operators import accounts as B
from tallyspark.operators import categorize as C
from tallyspark.operators import mapping as H
from tallyspark.operators.risk import next_in_time, sequential_identical_amounts

VENDORS = ["Microsoft Azure", "Staples Store", "Uber Trip", "Verizon Wireless", "Starbucks Cafe", "Deloitte LLP",
           "Chase Bank", "Aetna Health", "Caterpillar Inc", "Exxon Mobil", "Kroger Market", "Unknown Shop",
           "Netflix", "Spotify", "Office Depot", "Lyft", "Shell Gas", "Random Name"]


def test_vendor_db_first_group_wins(spark):
    df = spark.createDataFrame([(v,) for v in VENDORS], "vendor string")
    got = dict((r.vendor, r.c) for r in df.select("vendor", C.categorize_vendor_db("vendor").alias("c")).collect())
    assert got["Microsoft Azure"] == "Software"
    assert got["Staples Store"] == "Office"
    assert got["Uber Trip"] == "Travel"
    assert got["Verizon Wireless"] == "Utilities"
    assert got["Starbucks Cafe"] == "Food"
    assert got["Chase Bank"] == "Financial"
    assert got["Netflix"] == "Utilities"        # listed under utilities, not software
    assert got["Spotify"] == "Software"         # software group comes first
    assert got["Random Name"] == "Other"


def test_simple_and_enhanced(spark):
    df = spark.createDataFrame([(1, "Netflix", None, 12.0, "monthly subscription"),
                                (2, "Random Name", "Other", None, "quarterly fee"),
                                (3, "Random Name", "", None, None),
                                (4, None, None, 60000.0, None)],
                               "row_id long, vendor string, category string, amount double, memo string")
    simple = {r.row_id: r.category for r in C.apply_simple(df).collect()}
    assert simple[1] == "Software & Technology" and simple[2] == "Other"
    enh = {r.row_id: r.category for r in C.categorize_enhanced(df).collect()}
    assert enh[1] == "Technology"                 # software scores highest
    assert enh[2] == "Recurring Quarterly"        # no amount: C6 applies
    assert enh[3] == "Occasional Vendor"          # 2 rows of 'Random Name'
    assert enh[4] == "Capital Expense"            # above every group range: C5 band


def test_next_in_time_equals_global_order(spark):
    import random
    rnd = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=rnd.randint(0, 60 * 30)), float(rnd.choice([5, 7, 9])), "v")
            for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, date timestamp, amount double, vendor string")
    got = {r.rid: r.next_rid for r in next_in_time(df).collect()}
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    exp = {order[k][0]: (order[k + 1][0] if k + 1 < len(order) else None) for k in range(len(order))}
    assert got == exp
    flags = sequential_identical_amounts(df).collect()
    brute = sum(1 for k in range(len(order) - 1) if order[k][2] == order[k + 1][2]
                and (order[k + 1][1] - order[k][1]).total_seconds() / 3600 <= 24)
    assert len(flags) == brute


def test_account_metrics(spark):
    rows = [(1, "Cash", 100.0), (2, "Accounts Payable", 50.0), (3, "Retained Earnings", 25.0),
            (4, "Sales Revenue", 200.0), (5, "Operating Expense", 150.0)]
    df = spark.createDataFrame(rows, "row_id long, account string, balance double")
    m = B.account_metrics(df).first()
    assert m.current_ratio == 2.0 and m.debt_to_equity_ratio == 2.0 and abs(m.profit_margin - 0.25) < 1e-12
    assert m.health_score == "Excellent"        # 3 + 1 + 3 = 7 points
    assert m.account_count == 5


def test_header_mapping(spark):
    hdr = spark.createDataFrame([("f", 0, "Txn Date"), ("f", 1, "Payee"), ("f", 2, "Amt"), ("f", 3, "Notes"),
                                 ("g", 0, "account_name"), ("g", 1, "balance")],
                                "source_file string, position int, column string")
    canon = {(r.source_file, r.column): r.field for r in H.canonicalise_headers(hdr).collect()}
    assert canon[("f", "Payee")] == "vendor" and canon[("f", "Amt")] == "amount" and canon[("f", "Notes")] == "memo"
    kinds = {r.source_file: r.kind for r in H.classify_table(hdr).collect()}
    assert kinds["g"] == "accounts"
    m = {(r.source_file, r.column): r.field for r in H.mapping_strategy(hdr).collect()}
    assert m[("f", "Txn Date")] == "date"


def test_profile_and_content(spark):
    df = spark.createDataFrame([("2024-01-05", "$1,200.00", "Acme Inc"), ("2024-02-05", "$15.50", "Beta LLC")],
                               "a string, b string, c string")
    prof = H.profile_columns(df)
    fields = {r.column: r.field for r in H.map_by_content(prof).collect()}
    assert fields == {"a": "date", "b": "amount", "c": "vendor"}


def test_categories_of_awkward_texts(spark):
    """Labels of a lower-cased text that is computed once, NULL reading 'nan', the first group winning."""
    from tallyspark.operators.categorize import categorize_text, categorize_time
    df = spark.createDataFrame([("A", "MONTHLY rent", 1), (None, None, 2), ("x", "", 3)], "vendor string, memo string, k int")
    out = df.select("k", categorize_time("memo").alias("t"), categorize_text("vendor", "memo").alias("x"))
    plan = out.filter("t is not null or x is not null")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(coalesce(memo") <= 4        # twice in the filter, twice in the output
    got = {r.k: r for r in out.collect()}
    assert got[1].t is not None and got[2].t is None and got[3].t is None
