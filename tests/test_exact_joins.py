"""The prefix-filtered similarity joins (J5, J11) against brute force."""

import datetime as dt
import difflib
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import common, dedup as D, enrich as E, similarity_join as S

SCHEMA = "row_id long, date date, amount double, vendor string, memo string"


def texts(n, seed):
    r, common_words = random.Random(seed), [f"c{k}" for k in range(12)]
    out = []
    for k in range(n):
        w = r.sample(common_words, r.randint(1, 5)) + [f"r{r.randint(0, n)}" for _ in range(r.randint(0, 4))]
        out.append(" ".join(w))
        if k % 3 == 0 and len(w) > 2:
            out.append(" ".join(w[:-1] + [f"x{k}"]))
    return sorted(set(out))


def jac(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("least", [0.5, 0.75])
def test_jaccard_pairs_equal_brute_force_on_2000_texts(spark, least):
    ts = texts(1800, 5)[:2000]
    sets = [set(t.split()) for t in ts]
    want = sorted((i, j) for i in range(len(ts)) for j in range(i + 1, len(ts)) if jac(sets[i], sets[j]) >= least)
    df = spark.createDataFrame(list(enumerate(ts)), "id long, t string").withColumn("toks", F.array_distinct(F.split("t", " ")))
    got = S.jaccard_pairs(df, "id", "toks", least).collect()
    assert sorted((r.a, r.b) for r in got) == want and len(want) > 100
    assert all(abs(r.jaccard - jac(sets[r.a], sets[r.b])) < 1e-12 for r in got)
    assert S.jaccard_pairs(df.limit(0), "id", "toks", least).count() == 0


@pytest.mark.parametrize("ratio,few", [(0.85, 20), (0.6, 20), (0.85, 10_000)])
def test_sequence_ratio_pairs_equal_brute_force(spark, monkeypatch, ratio, few):
    monkeypatch.setattr(S, "FEW", few)
    r, names = random.Random(3), set()
    for base in ("acme industrial supplies", "acme", "a", "ab", "beta-gamma llc", "zz top", "co", "été café", "x" * 30):
        for _ in range(18):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                k = r.randrange(len(w) + 1)
                if r.random() < 0.5:
                    w.insert(k, r.choice(".,-! ab"))
                elif len(w) > 1:
                    w.pop(min(k, len(w) - 1))
            names.add("".join(w))
    rows = [(b, n) for b in ("p", "q") for n in sorted(names) if b == "p" or len(n) % 2]
    want = sorted((b, x, y) for b, x in rows for c, y in rows
                  if b == c and (x == y or difflib.SequenceMatcher(None, x, y).ratio() > ratio))
    got = S.sequence_ratio_pairs(spark.createDataFrame(rows, "blk string, name string"), "blk", "name", ratio)
    assert sorted((g.blk, g.i, g.j) for g in got.collect()) == want and len(want) > len(rows)


def test_candidates_of_many_spellings_stay_few(spark, monkeypatch):
    scored = []
    plain = S.sequence_ratio

    def counted(a, b):
        scored.append(1)
        return plain(a, b)

    r = random.Random(8)
    rows = [("v", "acme " + "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(24))) for _ in range(1500)]
    monkeypatch.setattr(S, "sequence_ratio", counted)
    kept = []
    cut = S.cut_lineage
    monkeypatch.setattr(S, "cut_lineage", lambda df: kept.append(cut(df)) or kept[-1])
    out = S.sequence_ratio_pairs(spark.createDataFrame(rows, "blk string, name string"), "blk", "name", 0.85)
    assert out.count() == len(set(rows)) and scored
    assert kept[-1].count() < len(rows)     # of 1.1 million pairs


def brute_j11(rows, least=0.5):
    drop = set()
    tok = {r[0]: set(f"{r[3] if r[3] is not None else 'nan'} {r[4] if r[4] is not None else 'nan'}".lower().split()) for r in rows}
    for i in rows:
        for j in rows:
            if i[0] >= j[0] or not tok[i[0]] or not tok[j[0]] or jac(tok[i[0]], tok[j[0]]) < least:
                continue
            a, b = (abs(x[2]) if x[2] is not None else None for x in (i, j))
            if a and b and abs(a - b) / max(a, b) > 0.05:
                continue
            if i[1] is not None and j[1] is not None and abs((i[1] - j[1]).days) > 3:
                continue
            drop.add(j[0])
    return {r[0] for r in rows} - drop


@pytest.mark.parametrize("seed", [1, 2])
def test_j11_equals_brute_force(spark, seed):
    r, words = random.Random(seed), [f"w{k}" for k in range(40)]
    rows = []
    for i in range(300):
        d = None if r.random() < 0.1 else dt.date(2024, 1, 1) + dt.timedelta(days=r.randint(0, 25))
        a = r.choice([None, 0.0, 100.0, 103.0, -98.0, 250.0, 1000.0, 1015.0])
        v = None if r.random() < 0.02 else "Hot Vendor" if r.random() < 0.3 else " ".join(r.sample(words, 2))
        rows.append((i, d, a, v, r.choice([None, "", "rent for office", "Rent  office", " ".join(r.sample(words, 2))])))
    rows.append((900, None, None, " ", " "))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert {x.row_id for x in E.semantic_duplicates(df).collect()} == brute_j11(rows)
    assert E.semantic_duplicates(df.limit(0)).count() == 0


def test_rows_without_date_and_amount_meet_one_candidate_a_name(spark, monkeypatch):
    rows = [(k, None if k % 2 else dt.date(2024, 1, 1 + k % 9), None if k % 2 else 100.0 + k, "Hot", "m") for k in range(400)]
    sizes, plain = [], D._semi
    monkeypatch.setattr(D, "_semi", lambda j, i, keys, cond: sizes.append((j.count(), i.count())) or plain(j, i, keys, cond))
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.row_id for r in D.fuzzy_vendor_duplicates(df).collect()} == {0} | {
        k for k in range(2, 400, 2) if not any(
            i < k and abs((rows[i][1] - rows[k][1]).days) <= 3 and abs(rows[i][2] - rows[k][2]) / max(rows[i][2], rows[k][2]) <= 0.05
            for i in range(0, 400, 2)) and k < 1}
    assert (1, 1) in sizes      # half of the rows have neither: one tuple against one


def test_spread_join_deals_out_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(common, "SPREAD_ROWS", 10)
    probe = spark.createDataFrame([(k, None if k % 5 == 0 else "a" if k % 3 else f"b{k}") for k in range(300)], "id long, k string")
    build = probe.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("s"))
    want = {r.k: r.s for r in build.collect()}
    for how in ("left", "inner"):
        got = common.spread_join(probe, build, ["k"], how).collect()
        assert sorted((r.id, r.s) for r in got if r.k is not None) == sorted((r.id, want[r.k]) for r in probe.collect() if r.k is not None)
        assert sum(r.k is None for r in got) == (60 if how == "left" else 0)


def test_insights_write_their_input_once(spark, monkeypatch):
    """The four columns go to the checkpoint folder once, for the metrics row and for all tables."""
    from tallyspark.operators import insights as K

    kept = []
    for name in ("cut_lineage", "written"):
        plain = getattr(K, name, None)
        monkeypatch.setattr(K, name, lambda df, plain=plain: kept.append(len(df.columns)) or plain(df), raising=False)
    rows = [(dt.date(2024, 1 + i % 12, 1 + i % 28), 10.0 * i - 200, f"V{i % 5}", "AB"[i % 2]) for i in range(60)]
    tables = K.business_insights(spark.createDataFrame(rows, "date date, amount double, vendor string, category string"))
    assert kept.count(4) == 1 and tables["key_metrics"].count() == 1
