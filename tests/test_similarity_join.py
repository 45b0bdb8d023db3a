"""J10 against a numpy brute force at thresholds where neighbours exist."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import vector_join as VJ
from tallyspark.operators.enrich import similar_label_transfer

PATH = "/root/testdata/sf0.001/embeddings.parquet"


def brute(rows, threshold, k=5):
    x = np.array([v for _, v, _ in rows], float)
    sim = x @ x.T
    out = {}
    for i, (vid, _, _) in enumerate(rows):
        near = sorted((-round(sim[i, j], 9), rows[j][0], rows[j][2]) for j in range(len(rows)) if rows[j][0] != vid and sim[i, j] > threshold)[:k]
        if near:
            out[vid] = (near[0][2], round(-near[0][0], 6), [n for _, n, _ in near])
    return out


def result(out):
    return {r.vec_id: (r.transferred_label, round(r.best_similarity, 6), r.neighbours) for r in out.collect() if r.best_similarity is not None}


@pytest.mark.parametrize("threshold", [0.3, 0.2])
def test_label_transfer_matches_brute_force(spark, threshold):
    t = pq.read_table(PATH).to_pandas()
    exp = brute([(int(i), v, int(lab)) for i, v, lab in zip(t.vec_id, t.embedding, t.label)], threshold)
    df = spark.read.parquet(PATH)
    got = result(similar_label_transfer(df, threshold=threshold, block_rows=64))
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in exp.items()} and len(exp) > 0
    assert sum(got[k][2] == exp[k][2] for k in exp) >= 0.99 * len(exp)      # order of near-equal products may differ


def clustered(n, centres, spread, seed, unit=True, dims=16):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, dims))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    x = c[r.integers(0, centres, n)] + r.normal(0, spread, (n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True) if unit else x * r.uniform(0.2, 3.0, (n, 1))


def frame(spark, x, extra=()):
    rows = [(k, v.tolist(), k % 7) for k, v in enumerate(x)] + list(extra)
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)


@pytest.mark.parametrize("unit,threshold", [(True, 0.9), (False, 2.0)])
def test_clustered_vectors_copies_and_lengths(spark, unit, threshold):
    x = clustered(600, 12, 0.05, 4, unit)
    x[100:300] = x[7]                       # a third of the rows are one vector
    rows, df = frame(spark, x)
    odd = spark.createDataFrame([(9001, None, 1), (9002, [1.0, None], 1), (9003, [float("nan")] * 16, 1), (9004, [1.0] * 3, 1),
                                 (9005, [0.0] * 16, 1)], "vec_id long, embedding array<double>, label int")
    got = similar_label_transfer(df.unionByName(odd), threshold=threshold, block_rows=50)
    exp = brute(rows, threshold)
    assert result(got) == exp and len(exp) > 300
    assert got.count() == 605
    assert all(r.neighbours == [] for r in got.filter("vec_id > 9000").collect())
    assert similar_label_transfer(df.limit(0)).count() == 0


def test_scored_pairs_grow_far_below_the_square(spark):
    scored = {}
    for n in (1000, 4000):
        _, df = frame(spark, clustered(n, n // 20, 0.02, 6, dims=64))
        classes = VJ.vector_classes(df, "vec_id", "embedding", "label", 6)
        members, probes = VJ.placed(classes, 0.9)
        m = members.groupBy("cell", "ring").agg(F.count("*").alias("m"))
        scored[n] = probes.groupBy("cell", "ring").agg(F.count("*").alias("p")).join(m, ["cell", "ring"]).agg(F.sum(F.col("p") * F.col("m"))).first()[0]
    assert scored[4000] < 0.02 * 4000 ** 2 and scored[4000] < 6 * scored[1000]


def test_vectors_without_structure_are_copied_once_a_cell(spark):
    x = np.random.default_rng(3).normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[1400:] = x[5] + np.random.default_rng(4).normal(0, 1e-3, (100, 64))      # a dense group among them
    rows, df = frame(spark, x)
    members, probes = VJ.placed(VJ.vector_classes(df, "vec_id", "embedding", "label", 6), 0.3)
    assert members.count() == 1500 and probes.count() <= VJ.VISITS * 1500
    exp, got = brute(rows, 0.3), result(similar_label_transfer(df, threshold=0.3, block_rows=200))
    assert got.keys() == exp.keys() and len(exp) > 1000
    assert all(got[k][0] == exp[k][0] and abs(got[k][1] - exp[k][1]) < 1e-5 for k in exp)


@pytest.mark.parametrize("threshold", [0.5, 0.0, -0.2])
def test_best_pairs_are_those_of_a_full_sort(threshold):
    r = np.random.default_rng(8)
    p, m = r.normal(size=(70, 5)) * 3, np.repeat(r.normal(size=(40, 5)), 2, axis=0)     # every product twice
    p[3], m[:6] = 0, 0
    sim = p @ m.T
    top = np.argsort(-sim, axis=1, kind="stable")[:, :4]
    exp = [(q, int(k)) for q in range(70) for k in top[q] if sim[q, k] > threshold]
    q, at, best = VJ.best_pairs(p, m, threshold, 4)
    assert list(zip(q.tolist(), at.tolist(), strict=True)) == exp and np.array_equal(best, sim[q, at])
