"""J11 against brute force where words are common, sizes mix and blocks are large, and how its work grows."""

import datetime as dt
import random

import pytest

from tallyspark.operators import dedup as D, enrich as E

SCHEMA = "row_id long, date date, amount double, vendor string, memo string"


def words(row):
    return set(" ".join("nan" if t is None else t for t in row[3:5]).lower().split())


def brute(rows, least):
    """Row ids with an earlier similar row, by comparing all pairs."""
    drop = set()
    for i in rows:
        for j in rows:
            a, b = words(i), words(j)
            if i[0] is None or j[0] is None or i[0] >= j[0] or not a or not b or len(a & b) < least * len(a | b) - 1e-9:
                continue
            if i[1] is not None and j[1] is not None and abs((i[1] - j[1]).days) > 3:
                continue
            x, y = (abs(r[2]) if r[2] is not None else 0 for r in (i, j))
            if x and y and abs(x - y) / max(x, y) > 0.05:
                continue
            drop.add(j[0])
    return drop


def kept(df, **kw):
    return sorted(r.row_id for r in E.semantic_duplicates(df, **kw).collect() if r.row_id is not None)


def mixed(seed, n, spare):
    """Texts of none to seven words, some of them in most rows; unknown dates and amounts, repeated and missing ids."""
    r = random.Random(seed)
    rows = []
    for k in range(n):
        date = None if r.random() < spare else dt.date(2024, 1, 1) + dt.timedelta(days=r.randint(0, 40))
        amount = r.choice([None, 0.0, -0.0]) if r.random() < spare else r.choice([1, -1]) * round(100 * 1.01 ** r.randint(0, 150), 2)
        vendor = r.choice([f"v{r.randint(0, 60)}", f"V{r.randint(0, 60)}\tLtd", "Acme", "", None, f"a{k} b{k}"])
        memo = r.choice(["not specified", "Not  Specified", "low", "rent of flat not specified", " ".join(r.sample(["rent", "of", "flat", "may", "june"], 3)), "", None])
        rows.append((k if r.random() < 0.9 else r.choice([None, r.randint(0, n)]), date, amount, vendor, memo))
    return rows


@pytest.mark.parametrize("seed,spare,rare,few,kinds,least", [(1, 0.0, 10_000, 32, 8, 0.5), (2, 0.1, 20, 2, 8, 0.5), (3, 0.4, 20, 2, 0, 0.5),
                                                             (4, 0.1, 3, 4, 3, 0.7), (5, 0.1, 50, 8, 8, 0.34)])
def test_equals_brute_force(spark, monkeypatch, seed, spare, rare, few, kinds, least):
    from tallyspark.operators import common, similar_rows as S
    for at, name, value in ((S, "SPREAD_ROWS", rare), (common, "SPREAD_ROWS", rare), (S, "FEW", few), (S, "KINDS", kinds)):
        monkeypatch.setattr(at, name, value)
    rows = mixed(seed, 400, spare)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    drop = brute(rows, least)
    assert drop and kept(df, least_jaccard=least) == sorted(r[0] for r in rows if r[0] is not None and r[0] not in drop)


def test_rows_of_a_common_memo_meet_few_others(spark, monkeypatch):
    """A memo of two words makes all texts similar: the pairs that meet grow with the rows, not with their square."""
    met, plain = [], D._semi

    def counted(j, i, keys, cond):
        sides = [f.groupBy(*k).count().toDF(*keys, n) for f, k, n in ((j, keys, "n"), (i, ["c_" + k for k in keys], "m"))]
        met.append(sum(r.n * r.m for r in sides[0].join(sides[1], keys).collect()))
        return plain(j, i, keys, cond)

    monkeypatch.setattr(D, "_semi", counted)
    try:
        from tallyspark.operators import similar_rows
        monkeypatch.setattr(similar_rows, "_semi", counted)
    except ImportError:
        pass
    r = random.Random(3)
    rows = [(k, dt.date(2024, 1, 1) + dt.timedelta(days=r.randint(0, 29)), round(r.uniform(100, 200), 2), f"v{k}", "not specified") for k in range(1500)]
    got = kept(spark.createDataFrame(rows, SCHEMA))
    drop = brute(rows, 0.5)
    assert got == sorted(r[0] for r in rows if r[0] not in drop) and len(got) < 200
    assert sum(met) < 30 * len(rows)


def test_common_words_that_no_partner_shares_make_no_pairs(spark, monkeypatch):
    """Two texts of two words are similar only if equal, so a memo of one word brings rows of different vendors together nowhere."""
    from tallyspark.operators import similar_rows as S
    monkeypatch.setattr(S, "SPREAD_ROWS", 50)
    large, plain = [], S._in_large_blocks
    monkeypatch.setattr(S, "_in_large_blocks", lambda many, *a: large.append(many.count()) or plain(many, *a))
    rows = [(k, dt.date(2024, 1, 1 + k // 2 % 9), 100.0, f"v{k // 2}", "low") for k in range(400)]
    assert kept(spark.createDataFrame(rows, SCHEMA)) == list(range(0, 400, 2)) and large == [0]


def test_equal_rows_of_no_finite_amount(spark):
    inf, nan, d = float("inf"), float("nan"), dt.date(2024, 1, 1)
    rows = [(k, d if k < 40 else None, (inf, nan)[k % 2], "v", "m") for k in range(80)]
    assert kept(spark.createDataFrame(rows[:2] + rows[2:4], SCHEMA)) == [0, 1]
    assert kept(spark.createDataFrame(rows, SCHEMA)) == [0, 1, 40, 41]
