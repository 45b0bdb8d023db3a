"""Exact quantiles by ranges of counted values against numpy, and the plans of their users."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import aggregates as A, filters as FL, insights as K, sampling as M, validation as V
from tallyspark.operators.quantiles import exact_quantiles

POINTS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)


def columns(n, seed):
    r = random.Random(seed)
    one = [7.0 if k < n // 3 else r.choice([None, r.gauss(0, 100), float(r.randint(-3, 3))]) for k in range(n)]
    return one, [r.randint(0, 50) for _ in range(n)]


@pytest.mark.parametrize("n", [1, 2, 7, 3000])
def test_quantiles_equal_numpy(spark, n):
    a, b = columns(n, n)
    df = spark.createDataFrame(list(zip(a, b, [None] * n)), "a double, b int, c double").repartition(7)
    want = {f"{c}{k}": (F.col(c), p) for c in "abc" for k, p in enumerate(POINTS)}
    got = exact_quantiles(df, want).collect()
    assert len(got) == 1
    for c, values in (("a", [x for x in a if x is not None]), ("b", b)):
        for k, p in enumerate(POINTS):
            assert got[0][f"{c}{k}"] == (pytest.approx(np.quantile(values, p), abs=1e-9) if values else None)
    assert all(got[0][f"c{k}"] is None for k in range(len(POINTS)))


def test_quantiles_of_odd_values(spark):
    df = spark.createDataFrame([(x,) for x in (float("inf"), float("-inf"), 1.0, -0.0, 0.0)], "a double")
    got = exact_quantiles(df, {"lo": (F.col("a"), 0.0), "mid": (F.col("a"), 0.5), "hi": (F.col("a"), 1.0)}).first()
    assert (got.lo, got.mid, got.hi) == (float("-inf"), 0.0, float("inf"))
    assert exact_quantiles(df.limit(0), {"mid": (F.col("a"), 0.5)}).first().mid is None
    assert exact_quantiles(spark.createDataFrame([(float("nan"),), (1.0,), (2.0,)], "a double"), {"m": (F.col("a"), 0.5)}).first().m == 2.0


def test_no_plan_sorts_a_whole_column_in_one_task(spark):
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(days=k % 90), float(k % 17 - 4), f"v{k % 5}", "c", "m") for k in range(200)]
    df = spark.createDataFrame(rows, "row_id long, date timestamp, amount double, vendor string, category string, memo string")
    frames = [A.key_metrics(df), A.amount_moments(df.withColumn("abs_amount", F.abs("amount"))), K.amount_patterns(df),
              M.stratified_sample(df, 60), M.high_value_sample(df, 60), FL.fill_nulls(df)[0], V.validate_numeric(df, "amount"),
              V.validate_table(df)[0]]
    for frame in frames:
        plan = frame._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "percentile" not in plan and "median(" not in plan
        frame.collect()
    months = M.temporal_sample(df, 30)
    assert "WindowGroupLimit" in months._jdf.queryExecution().executedPlan().toString() and months.count() == 30


def test_validate_table_is_one_aggregate(spark):
    rows = [(1, 5.0, dt.date(2024, 1, 1), "x", True), (2, None, None, " ", False), (3, -900.0, dt.date(2024, 1, 2), None, None), (4, 6.0, None, "y", None)]
    df = spark.createDataFrame(rows, "a int, b double, d date, t string, f boolean")
    checks, score = V.validate_table(df)
    got = {(r.column, r.check): (r.passed, r.valid, r.invalid) for r in checks.collect()}
    assert got == {("a", "all_positive"): (True, 4, 0), ("a", "iqr_range"): (True, 4, 0), ("b", "all_positive"): (False, 2, 1),
                   ("b", "iqr_range"): (True, 3, 0), ("d", "not_null"): (False, 2, 2), ("t", "non_empty"): (False, 2, 2)}
    assert score.first().score == pytest.approx(0.5)
