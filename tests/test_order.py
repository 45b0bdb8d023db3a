"""The global time order and the greedy leader clusters against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import risk as R


def test_next_in_time_with_one_day_holding_a_third(spark):
    r = random.Random(4)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=r.randint(0, 40)) for _ in range(1600)] + [dt.date(2024, 1, 9)] * 800
    r.shuffle(days)
    rows = [(k, d, float(k % 11), f"v{k % 3}") for k, d in enumerate(days)] + [(5000 + k, None, 1.0, "x") for k in range(9)]
    df = spark.createDataFrame(rows, "row_id long, date date, amount double, vendor string").repartition(6)
    order = sorted((x for x in rows if x[1]), key=lambda x: (x[1], x[0]))
    want = {a[0]: (b[0], b[2]) for a, b in zip(order, order[1:])} | {order[-1][0]: (None, None)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {x.rid: (x.next_rid, x.next_amount) for x in R.next_in_time(df, cols=("amount",)).collect()}
        parts = df.filter("date is not null").repartitionByRange("date", "row_id").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == want
    assert max(p["count"] for p in parts) < 800     # the day is split
    assert R.next_in_time(df.limit(0)).count() == 0


def plain_clusters(rows, tol=0.05):
    clusters = {}
    for rid, a in sorted(rows):
        if a is None or a == 0:
            continue
        a = abs(a)
        for c in clusters:
            if abs(a - clusters[c][0]) / clusters[c][0] <= tol:
                clusters[c][1] += 1
                break
        else:
            clusters[rid] = [a, 1]
    out = {(str(rid), c, n) for rid, (c, n) in clusters.items() if n > 3}
    zeros = sum(a == 0 for _, a in rows)
    return out | ({("zero", 0.0, zeros)} if zeros > 3 else set())


def amounts(kind, n):
    r = random.Random(kind)
    if kind == "mixed":
        return [round(r.lognormvariate(5, 2), 2) * r.choice([1, -1]) for _ in range(n)]
    if kind == "chains":        # amounts a little below and above the tolerance apart, many ties
        return [round(100 * 1.0251 ** r.randint(0, 60) * r.choice([1, 1.0001]), 2) for _ in range(n)]
    return sorted(round(r.uniform(10, 40), 2) for _ in range(n))


@pytest.mark.parametrize("kind,n", [("mixed", 10_000), ("chains", 2000), ("sorted", 800)])
def test_leader_clusters_equal_a_plain_loop(spark, kind, n):
    rows = [(k, float(a)) for k, a in enumerate(amounts(kind, n))] + [(n + k, x) for k, x in enumerate([None, 0.0, 0.0, -0.0, 0.0, None])]
    df = spark.createDataFrame(rows, "row_id long, amount double").repartition(7)
    got = {(r.entity, r.threshold, int(r.metric)) for r in R.amount_leader_clusters(df).collect()}
    assert got == plain_clusters(rows) and len(got) > 3
    assert R.amount_leader_clusters(df.limit(0)).count() == 0
