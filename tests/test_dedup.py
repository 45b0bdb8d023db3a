"""De-duplication against brute-force Python versions of the pairwise rules."""

import datetime as dt
import difflib
import random
import re

import pytest

from tallyspark.operators import dedup as D


def _rows(seed, n=160):
    rnd = random.Random(seed)
    vendors = ["Acme Inc", "ACME INC,", "acme inc.", "Beta LLC", "beta llc", "Gamma", None, "Hot Vendor"]
    rows = []
    for i in range(n):
        v = "Hot Vendor" if rnd.random() < 0.33 else rnd.choice(vendors)      # one hot vendor, a third of rows
        d = None if rnd.random() < 0.1 else dt.date(2024, 1, 1) + dt.timedelta(days=rnd.randint(0, 20))
        a = rnd.choice([None, 0.0, 100.0, 101.0, 104.0, 98.0, 250.0, -100.0, 1000.0, 1015.0])
        rows.append((i, d, a, v, rnd.choice(["A", "B", None]), rnd.choice(["m1", "m2", None])))
    return rows


SCHEMA = "row_id long, date date, amount double, vendor string, category string, memo string"


def _norm(v):
    s = "nan" if v is None else v.lower()
    return re.sub(r"[^\w\s]", "", s).strip()


def brute_j5(rows):
    drop = set()
    for i in rows:
        for j in rows:
            if i[0] >= j[0] or _norm(i[3]) != _norm(j[3]):
                continue
            a1, a2 = abs(i[2]) if i[2] is not None else None, abs(j[2]) if j[2] is not None else None
            if a1 and a2 and abs(a1 - a2) / max(a1, a2) > 0.05:
                continue
            if i[1] is not None and j[1] is not None and abs((i[1] - j[1]).days) > 3:
                continue
            v1 = "nan" if i[3] is None else i[3].lower()
            v2 = "nan" if j[3] is None else j[3].lower()
            if difflib.SequenceMatcher(None, v1, v2).ratio() > 0.85:
                drop.add(j[0])
    return {r[0] for r in rows} - drop


def brute_pair(rows, days, tol):
    drop = set()
    for i in rows:
        for j in rows:
            if i[0] >= j[0] or i[3] is None or i[3] != j[3]:
                continue
            if i[1] is None or j[1] is None or i[2] is None or j[2] is None:
                continue
            a1, a2 = abs(i[2]), abs(j[2])
            if a1 > 0 and a2 > 0 and abs(a1 - a2) / max(a1, a2) <= tol and abs((i[1] - j[1]).days) <= days:
                drop.add(j[0])
    return {r[0] for r in rows} - drop


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_j5_matches_brute_force(spark, seed):
    rows = _rows(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.row_id for r in D.fuzzy_vendor_duplicates(df).collect()}
    assert got == brute_j5(rows)


@pytest.mark.parametrize("seed", [4, 5])
def test_j6_j7_match_brute_force(spark, seed):
    rows = _rows(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.row_id for r in D.date_proximity_duplicates(df).collect()} == brute_pair(rows, 1, 0.10)
    assert {r.row_id for r in D.amount_similarity_duplicates(df).collect()} == brute_pair(rows, 7, 0.02)


def test_j1_j2_keep_first(spark):
    rows = [(1, None, 5.0, "a", "c", "m"), (2, None, 5.0, "a", "c", "m"), (3, None, 6.0, "a", "c", "m")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.row_id for r in D.drop_exact_duplicates(df).collect()) == [1, 3]
    assert sorted(r.row_id for r in D.drop_key_duplicates(df, ("vendor",)).collect()) == [1]
    flags = {r.row_id: r.dup for r in D.drop_key_duplicates(df, ("vendor",), flag="dup").collect()}
    assert flags == {1: False, 2: True, 3: True}


def test_j4_adjacent(spark):
    d = dt.date(2024, 1, 1)
    rows = [(1, d, 10.0, "v", "c", "coffee beans"), (2, d, 10.0, "v", "c", "beans coffee"),
            (3, d, 10.0, "v", "c", "tea"), (4, d, 11.0, "v", "c", "tea"), (5, None, 10.0, "v", "c", "tea")]
    df = spark.createDataFrame(rows, SCHEMA)
    # text order puts "beans coffee" (row 2) first, so row 1 is the later near-copy
    assert sorted(r.row_id for r in D.fuzzy_adjacent_dedup(df).collect()) == [2, 3, 4, 5]


def test_a13_consolidate(spark):
    d = dt.date(2024, 1, 1)
    rows = [(1, d, 10.0, "v", "c", "m1"), (2, d, 5.0, "v", "c", "m2"), (3, d, 1.0, "v", "c", "m1"),
            (4, d, 7.0, "w", "c", "x"), (5, d, 7.0, "w", "k", "x")]
    out, det = D.consolidate_same_day(spark.createDataFrame(rows, SCHEMA))
    got = {r.row_id: (r.amount, r.memo) for r in out.collect()}
    assert got == {1: (16.0, "Consolidated 3 transactions: m1, m2"), 4: (7.0, "x"), 5: (7.0, "x")}
    assert [(r.vendor, r.original_count) for r in det.collect()] == [("v", 3)]


def _steps(df):
    return {"j5": D.fuzzy_vendor_duplicates(df), "j6": D.date_proximity_duplicates(df), "j7": D.amount_similarity_duplicates(df)}


@pytest.mark.parametrize("few", [0, 4, 1000])
def test_pairwise_steps_in_small_and_large_blocks(spark, monkeypatch, few):
    """Blocks on either side of the bound give the rows of the plain rules."""
    monkeypatch.setattr(D, "FEW", few)
    rows = _rows(7, 120)
    got = {k: {r.row_id for r in f.collect()} for k, f in _steps(spark.createDataFrame(rows, SCHEMA)).items()}
    assert got == {"j5": brute_j5(rows), "j6": brute_pair(rows, 1, 0.10), "j7": brute_pair(rows, 7, 0.02)}


def test_small_blocks_are_not_copied(spark):
    """Many vendors of few rows: no candidate is copied to neighbouring buckets."""
    rows = [(i, dt.date(2024, 1, 1) + dt.timedelta(days=i % 50), 100.0 + i % 7, f"Vendor {i % 40}", "A", "m") for i in range(400)]
    for f in _steps(spark.createDataFrame(rows, SCHEMA)).values():
        assert "Generate" not in f._jdf.queryExecution().executedPlan().toString()


def test_candidates_reach_every_bucket_of_their_window(spark):
    """One vendor, all days and amounts around the borders of buckets."""
    rows = [(i * 40 + k, dt.date(2024, 1, 1) + dt.timedelta(days=3 * k), 100.0 * 1.019 ** i, "V", "A", "m")
            for i in range(12) for k in range(12)]
    random.Random(5).shuffle(rows)
    rows = [(n, *r[1:]) for n, r in enumerate(rows)]
    got = {k: {r.row_id for r in f.collect()} for k, f in _steps(spark.createDataFrame(rows, SCHEMA)).items()}
    assert got == {"j5": brute_j5(rows), "j6": brute_pair(rows, 1, 0.10), "j7": brute_pair(rows, 7, 0.02)}


def test_ratio_of_a_string_within_another(spark):
    from pyspark.sql import functions as F

    from tallyspark.functions.similarity import sequence_ratio

    names = ["", "a", "ab", "ab,", "abab", "acme inc", "acme, inc.", "the acme inc", "x" * 150 + "ab", "x" * 230 + "ab", "ab" * 99, None]
    pairs = spark.createDataFrame([(x, y) for x in names for y in names], "a string, b string")
    for r in pairs.withColumn("r", sequence_ratio(F.col("a"), F.col("b"))).collect():
        want = None if r.a is None or r.b is None else difflib.SequenceMatcher(None, r.a, r.b).ratio()
        assert r.r == want, r
