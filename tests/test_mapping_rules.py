"""H10-H18 and H22 on small tables whose results follow from the stated rules by hand."""

import datetime as dt

import pytest

from tallyspark.operators import mapping as H


def votes(spark, rows):
    return spark.createDataFrame([("f", p, c, f, m) for p, c, f, m in rows],
                                 "source_file string, position int, column string, field string, method string")


def test_h17_shares_bonuses_and_ties(spark):
    rows = [(0, "when", "date", "pattern"), (0, "when", "date", "content"), (0, "when", "vendor", "statistics"),      # 2 of 3
            (1, "reference_number", "reference", "pattern"), (1, "reference_number", "amount", "content"),             # tie: 1/2 + .5
            (2, "memo_text", "vendor", "content"), (2, "memo_text", "memo", "statistics"),                           # tie: 1/2 - .2, out
            (3, "description", "vendor", "pattern"), (3, "description", "vendor", "content"),                        # 1 - .1
            (4, "notes", "memo", "semantic"),                                                                        # 1 + .3
            (5, "x", "memo", "content"), (5, "x", "amount", "pattern"), (5, "x", "vendor", "semantic"),              # 1/3, out
            (6, "refnumber", "id", "pattern")]
    got = {r.column: (r.field, round(r.confidence, 6)) for r in H.combine_mappings(votes(spark, rows)).collect()}
    assert got == {"when": ("date", 0.666667), "reference_number": ("reference", 1.0), "description": ("vendor", 0.9),
                   "notes": ("memo", 1.3), "refnumber": ("id", 1.0)}


def test_h18_keeps_the_best_column_of_a_field(spark):
    mapping = spark.createDataFrame([("f", 0, "posted", "date", 1), ("f", 1, "when", "date", 1), ("f", 2, "zz", "memo", 2),
                                     ("f", 3, "yy", "memo", 2), ("f", 4, "qq", "balance", 2), ("f", 5, "b", "vendor", 2), ("f", 6, "a", "vendor", 1)],
                                    "source_file string, position int, column string, field string, method_order int")
    scores = spark.createDataFrame([("f", "posted", "date", 0.3), ("f", "when", "date", 1.0), ("f", "b", "vendor", 0.5), ("f", "a", "vendor", 0.5)],
                                   "source_file string, column string, field string, score double")
    got = {r.field: r.column for r in H.resolve_mapping(mapping, scores).collect()}
    assert got == {"date": "when", "balance": "qq", "vendor": "a"}      # no column of memo scores; equal scores: first mapped


def profile(spark, **cols):
    rows = list(zip(*cols.values()))
    return H.profile_columns(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols)))


def fields(p):
    return {r.column: r.field for r in H.map_by_content(p).collect()}


def test_content_tests_take_each_pattern_alone(spark):
    # two currency symbols on a quarter of the values each do not add up; one on more than 30 % does
    mixed = ["$1x", "€2x", "no", "no"]
    alone = ["$1x", "$2x", "no", "no"]
    months = ["jan"] + ["x"] * 9 + ["feb"] + ["x"] * 9       # 5 % each
    suffixes = ["a inc"] + ["x"] * 9 + ["b llc"] + ["x"] * 9
    p = profile(spark, mixed=mixed * 5, alone=alone * 5, months=months, suffixes=suffixes,
                parsed=["Jan 5, 2024", "2024/02/03", "03.04.2024", None, "5 Feb 2024"] * 4, number=["20.5"] * 20,
                padded=["  one "] * 20, far=["0.001", "2"] * 10)
    got = fields(p)
    assert got["mixed"] == "memo" and got["alone"] == "amount" and got["months"] == "memo" and got["suffixes"] == "memo"
    assert got["parsed"] == "date" and got["number"] == "amount" and got["padded"] == "vendor"
    assert fields(profile(spark, none=[None, None])) == {}


def test_profile_without_exact_distinct_is_the_same_but_for_distinct(spark):
    cols = {"a": ["1", "1", "2.5", None, "x"] * 8, "b": ["2024-01-05", "$3", "a  b", "", "9"] * 8}
    df = spark.createDataFrame(list(zip(*cols.values())), "a string, b string")
    one, two = (sorted(H.profile_columns(df, exact_distinct=x).drop("distinct").collect()) for x in (True, False))
    for r, s in zip(one, two):
        assert all(x == (pytest.approx(y) if isinstance(y, float) else y) for x, y in zip(r, s))
    assert {r.column: r.distinct for r in H.profile_columns(df).collect()} == {"a": 3, "b": 5}


def test_h22_terms_dates_and_account_names(spark):
    names = ["Cash", "Bank of X", "Accounts payable", "Other"] * 5
    day = [dt.date(2020, 1, 1)] * 20
    tables = {
        "chart": spark.createDataFrame([(n, 1.0) for n in names], "account_name string, balance double"),                  # 3+2 +3 +2
        "snapshot": spark.createDataFrame([(n, d) for n, d in zip(names, day)], "account string, date date"),              # 3 +2 +2 : 3
        "payments": spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(k), "x", 1.0) for k in range(20)],
                                          "date date, vendor string, amount double"),                                    # 0 : 3+2 +2
        "dated": spark.createDataFrame([(dt.date(2020, 1, 1), "x")] * 3, "post_date date, memo string"),                   # 3 : 3+1
        "empty": spark.createDataFrame([], "date string")}
    got = {r.source_file: (r.detected_type, round(r.confidence, 6), r.accounting_score, r.transactions_score, r.recommendation)
           for r in H.detect_accounting(tables).collect()}
    assert got == {"chart": ("accounting", 0.95, 10, 0, "Process as accounting data"),
                   "snapshot": ("accounting", 0.85, 7, 3, "Process as accounting data"),
                   "payments": ("transactions", 0.85, 0, 7, "Process as transactions data"),
                   "dated": ("transactions", 0.7, 3, 4, "Manual review recommended"),
                   "empty": ("transactions", 0.65, 0, 3, "Manual review recommended")}


def test_whole_mapper_on_a_table(spark):
    rows = [(f"2024-01-{k:02d}", f"{k}.50", f"Vendor {k} Inc", "paid by card at the counter") for k in range(1, 25)]
    df = spark.createDataFrame(rows, "posting_date string, amount string, merchant string, notes string")
    got = {r.column: r.field for r in H.map_columns_enhanced({"t": df}).collect()}
    assert got == {"posting_date": "date", "amount": "amount", "merchant": "vendor", "notes": "memo"}
