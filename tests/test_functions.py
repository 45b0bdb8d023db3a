"""Scalar functions against the literal cases of FIXTURES.md (sections 2 and 3)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.amounts import amount_invalid, clean_amount
from tallyspark.functions.dates import detect_date_format, normalize_dates, standardize_date
from tallyspark.functions.similarity import indel_ratio, sequence_ratio_py, token_sort_ratio_py
from tallyspark.functions.text import capitalize_memo, capitalize_vendor, clean_text, extract_vendor, fill_memo

D = dt.date
SAME = ["2023-12-25", "12/25/2023", "25/12/2023", "Dec 25, 2023", "25 December 2023", "2023/12/25", "12-25-2023",
        "25.12.2023", "2023.12.25", "2023-12-25 14:30:00", "12/25/23", "25/12/23", "20231225"]


def _dates(spark, values, american):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    return [r.d for r in df.select(standardize_date("s", american).alias("d")).collect()]


@pytest.mark.parametrize("american", [True, False])
def test_unambiguous_dates(spark, american):
    assert _dates(spark, SAME, american) == [D(2023, 12, 25)] * len(SAME)


def test_serial_null_invalid(spark):
    got = _dates(spark, ["44924", None, "", "invalid date", "2023"], True)
    assert got == [D(2022, 12, 29), None, None, None, D(1905, 7, 15)]


def test_ambiguous_dates(spark):
    vals = ["01/02/2023", "12/01/2023", "03/04/2023"]
    assert _dates(spark, vals, True) == [D(2023, 1, 2), D(2023, 12, 1), D(2023, 3, 4)]
    assert _dates(spark, vals, False) == [D(2023, 2, 1), D(2023, 1, 12), D(2023, 4, 3)]


def test_own_date_additions(spark):
    got = _dates(spark, ["12/25/85", "02/30/2023", "5th March 2023", "Sept 5, 2023"], True)
    assert got == [D(1985, 12, 25), None, D(2023, 3, 5), D(2023, 9, 5)]


def test_detect_and_normalize(spark):
    df = spark.createDataFrame([("12/25/2023",), ("01/02/2023",), ("5th March 2023",), ("x",), (None,)], "date string")
    det = detect_date_format(df, "date").first()
    assert det.format == "%m/%d/%Y" and det.american_likely and det.non_null == 4
    rows = normalize_dates(df, "date").orderBy("date_original").collect()
    flags = {r.date_original: (r.date, r.date_invalid) for r in rows}
    assert flags["5th March 2023"] == (D(2023, 3, 5), False)
    assert flags["x"] == (None, True)
    assert flags[None] == (None, False)


AMOUNTS = [("$1,234.50", 1234.5, 1234.5, 1234.5, False), ("(99.00)", None, 99.0, -99.0, False),
           ("-12.50", -12.5, -12.5, -12.5, False), ("EUR 10", None, None, 10.0, False),
           ("abc", None, None, None, True), (None, None, None, None, False), ("", None, None, None, False)]


def test_amount_modes(spark):
    df = spark.createDataFrame([(a[0],) for a in AMOUNTS], "s string")
    got = df.select(clean_amount("s", "basic").alias("b"), clean_amount("s", "unsigned").alias("u"),
                    clean_amount("s", "robust").alias("r"), amount_invalid("s").alias("i")).collect()
    assert [(r.b, r.u, r.r, r.i) for r in got] == [a[1:] for a in AMOUNTS]


def test_text_helpers(spark):
    df = spark.createDataFrame([("  ACME corp  ", "POS STARBUCKS #123 NYC", None, 5.0),
                                ("nan", "PAYMENT ComEd bill", "memo", -3.0)], "v string, d string, m string, a double")
    r = df.select(clean_text("v").alias("t"), extract_vendor("d").alias("e"), capitalize_vendor("v").alias("cv"),
                  capitalize_memo("d").alias("cm"),
                  fill_memo("m", "v", F.lit("Travel"), "a").alias("fm")).collect()
    assert r[0].t == "ACME corp" and r[1].t is None
    assert r[0].e == "STARBUCKS" and r[1].e == "ComEd"
    assert r[0].cv == "ACME Corp"
    assert r[0].cm == "Pos Starbucks #123 Nyc"
    assert r[0].fm == "Travel expense from   ACME corp  " and r[1].fm == "memo"


def _lcs(a, b):
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            m[i + 1][j + 1] = m[i][j] + 1 if a[i] == b[j] else max(m[i][j + 1], m[i + 1][j])
    return m[-1][-1]


def test_similarity_helpers():
    import random
    rnd = random.Random(7)
    for _ in range(300):
        a = "".join(rnd.choice("abcde ") for _ in range(rnd.randint(0, 15)))
        b = "".join(rnd.choice("abcde ") for _ in range(rnd.randint(0, 15)))
        exp = 100.0 if not a and not b else 200.0 * _lcs(a, b) / (len(a) + len(b))
        assert abs(indel_ratio(a, b) - exp) < 1e-9
    assert token_sort_ratio_py("b a", "a b") == 100.0
    assert abs(sequence_ratio_py("customer#1,", "customer#1") - 2 * 10 / 21) < 1e-12


def test_amounts_are_parsed_once_a_row_in_filters(spark):
    from tallyspark.functions.amounts import clean_amount
    vals = [("(1,234.5)", -1234.5), ("-5", -5.0), ("USD 5", 5.0), ("u$sd 5", None), ("nan", None), ("(5", 5.0), ("5-", 5.0),
            (" 5\t0 ", 50.0), ("-inf", float("-inf")), ("", None), (None, None)]
    df = spark.createDataFrame([(v,) for v, _ in vals], "s string").select("s", clean_amount("s", "robust").alias("a"))
    assert {r.s: r.a for r in df.collect()} == dict(vals)
    kept = df.filter("a is not null")
    assert kept.count() == 7
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?i)(usd|eur|gbp") <= 2       # once in the filter, once in the output
