"""Line dedup, whitening and vector codes against plain versions, with awkward rows."""

import collections
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import catalog, common, op11_lines, op12_whitening, op13_codes, spectrum, vectors
from tallyspark.llm.common import read_table

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")
LOWER = str.maketrans(op11_lines.UPPER, op11_lines.LOWER)


def plain_lines(rows, chars=1, least=10):
    key = lambda line: line.translate(LOWER).strip(op11_lines.BLANK)
    split = [(i, (t or "").split("\n")) for i, t in rows]
    n = collections.Counter(k for _, lines in split for k in {key(x) for x in lines} if len(k) >= chars)
    out = []
    for i, lines in split:
        left = [x for x in lines if n[key(x)] < least or len(key(x)) < chars]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=str)


def lines_result(df, **kw):
    out = op11_lines.drop_lines(df, **kw)
    return sorted([(r.doc_id, r.l_n_lines, r.l_n_dropped, r.l_kept) for r in out.collect()], key=str)


def odd_lines():
    rows = [(k, f"Shared LINE\nown {k}\n\n \t\n shared line\x0b") for k in range(12)]
    rows += [(100, None), (101, ""), (102, "\n"), (103, "shared line"), (104, "SHARED LINE\r"), (None, "shared line\nx"),
             (105, "ÉCLAIR shared"), (106, "a\nshared line\n" * 3000), (107, "no"), (107, "no"), (107, "other\nshared line"),
             (108, " shared line"), (109, "y" * 200_000 + "\nshared line\n" + "z" * 9)]
    return rows + [(200 + k, "café É\nnine") for k in range(9)] + [(300 + k, "ten\nCAFÉ É") for k in range(10)]


def test_op11(spark):
    rows = odd_lines()
    df = spark.createDataFrame([(i, t, "k", [1]) for i, t in rows], "doc_id long, text string, l_kept string, h1 array<int>")
    assert lines_result(df) == plain_lines(rows)
    assert lines_result(df, least=2, chars=3) == plain_lines(rows, 3, 2)
    assert lines_result(df, least=1, chars=0) == plain_lines(rows, 0, 1)
    out = op11_lines.drop_lines(df)
    assert out.columns == ["doc_id", "text", "h1", "l_n_lines", "l_n_dropped", "l_kept"]
    assert op11_lines.drop_lines(df.limit(0)).count() == 0
    dropped = {r.doc_id: r.l_n_dropped for r in out.collect() if r.doc_id not in (None, 107)}
    assert (dropped[103], dropped[104], dropped[108], dropped[106]) == (1, 1, 0, 3000)


def test_op11_hot_key_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(common, "SPREAD_ROWS", 50)
    rows = [(k, f"everywhere\nown {k}\ntwin {k // 2}") for k in range(600)] + [(1000 + k, "everywhere") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert lines_result(df) == plain_lines(rows)
    assert lines_result(df, least=2) == plain_lines(rows, 1, 2)


def test_op11_is_native(spark):
    plan = op11_lines.op11_line_dedup(spark, SF)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "RDD"))


def test_spread_join_parts_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(common, "SPREAD_ROWS", 10)
    probe = spark.createDataFrame([(k, "a" if k % 3 else f"b{k}") for k in range(300)], "id long, k string")
    build = probe.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("s"))
    got = common.spread_join(probe, build, ["k"], "left").select("id", "k", "s").collect()
    want = collections.Counter()
    for r in probe.collect():
        want[r.k] += r.id
    assert sorted((r.id, r.s) for r in got) == [(k, want["a" if k % 3 else f"b{k}"]) for k in range(300)]


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rng = np.random.default_rng(3)
    good = [(k, (rng.normal(0, 0.3, 32)).tolist(), k % 3 if k % 7 else None) for k in range(400)]
    good += [(1000 + k, good[5][1], 1) for k in range(200)]                     # a group of copies
    good += [(5, good[5][1], 2), (5, good[5][1], 2), (None, good[9][1], 0), (2000, good[7][1][:20], 5), (2001, [40.5] * 32, 5)]
    bad = [(3000, None, 1), (3001, [0.1] * 31 + [None], 1), (3002, [NAN] * 32, 1), (3003, [INF] + [0.0] * 31, 1),
           (3004, [-INF] + [0.0] * 31, None), (3005, [1e30] * 32, 1)]
    df = spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in good + bad],
                               "vec_id long, embedding array<double>, label int, c_codes string, w_whitened int").repartition(5).cache()
    return good, df


def padded(rows, dims):
    return [(i, v + [0.0] * (dims - len(v)), lab) for i, v, lab in rows]


def plain_codes(rows, parts=16, entries=64, rounds=2, scale=256):
    rows = padded(rows, max(len(v) for _, v, _ in rows))
    cut = lambda v: [tuple(math.floor(scale * x) for x in v[p * w:(p + 1) * w]) for p in range(parts)]
    w = len(rows[0][1]) // parts
    points = [cut(v) for _, v, _ in rows]
    first = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, points[k]))[:entries]
    books = [[points[k][p] for k in first] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda x, book: min(range(len(book)), key=lambda e: (dist(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            held = collections.defaultdict(list)
            for x in points:
                held[best(x[p], books[p])].append(x[p])
            for e, members in held.items():
                books[p][e] = tuple(sum(c) // len(members) for c in zip(*members))
    out = []
    for (i, _, lab), x in zip(rows, points):
        code = [best(x[p], books[p]) for p in range(parts)]
        out.append((i, lab, tuple(code), sum(dist(x[p], books[p][c]) for p, c in enumerate(code))))
    return out, books


def test_op13(odd_vectors):
    rows, df = odd_vectors
    want, books = plain_codes(rows)
    coded, got_books = op13_codes.compress(df)
    assert got_books.tolist() == [[list(e) for e in b] for b in books]
    got = [(r.vec_id, r.label, tuple(r.c_codes), r.c_error) for r in coded.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert coded.columns == ["vec_id", "embedding", "label", "w_whitened", "c_codes", "c_error"]
    sums = collections.Counter()
    for _, lab, _, e in want:
        sums[lab] += e
    labelled = op13_codes.label_errors(coded).collect()
    assert len(labelled) == len(want) and all(r.label_error == sums[r.label] for r in labelled)


def test_op13_few_rows_odd_sizes_and_empty(spark, odd_vectors):
    rows, df = odd_vectors
    few = spark.createDataFrame([(1, [0.1, 0.2, 0.3]), (2, [0.1, 0.2, 0.3]), (2, [0.5])], "vec_id long, embedding array<float>")
    coded, books = op13_codes.compress(few)
    assert books.shape == (16, 3, 1) and all(r.c_error == 0 for r in coded.collect()) and coded.count() == 3
    none, books = op13_codes.compress(df.where("vec_id >= 3000"))
    assert none.count() == 0 and books.size == 0
    assert op13_codes.label_errors(none).count() == 0
    blank = spark.createDataFrame([(1, []), (2, [])], "vec_id long, embedding array<float>")
    assert op13_codes.compress(blank)[0].count() == 0


def test_op13_query_matches_plain_version(spark):
    rows = [(r.vec_id, [float(x) for x in r.embedding], r.label) for r in read_table(spark, SF, "embeddings").collect()]
    want, books = plain_codes(rows)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    got = {r.vec_id: r for r in catalog.QUERIES["op13_resident_lloyd"](spark, SF).collect()}
    assert len(got) == len(want)
    for i, _, code, error in want:
        assert (got[i].code, got[i].error, got[i].codebooks_sha256) == ("".join(f"{c:02x}" for c in code), error, digest)


def test_op13_only_changed_members_move(spark):
    books = np.array([[[0], [100]]])
    blocks = [(0, 0, 0, False, np.array([1, 2, 80, 49, 51], "<i4").tobytes())]
    df = spark.createDataFrame(blocks, op13_codes.BLOCK)
    got = {r.entry: (r.moved, np.frombuffer(r.members, "<i4").tolist())
           for r in df.mapInArrow(op13_codes._mover(books, 4), op13_codes.BLOCK).collect()}
    assert got == {0: (False, [1, 2, 49]), 1: (True, [80, 51])}


def check_whitening(rows, out, model, error, components=32):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v, _ in rows], dtype=object)
    n, total = len(x), x.sum(0)
    centred = np.array((x * n - total) / n, float)
    values = np.linalg.eigvalsh(centred.T @ centred / n)[::-1]
    k = len(model.values)
    assert np.allclose(model.values, values[:k], rtol=1e-9, atol=1e-12 * values[0]) and (np.diff(model.values) <= 1e-12 * values[0]).all()
    assert abs(model.trace - values.sum()) < 1e-9 * values.sum() and error < 1e-6
    want = collections.defaultdict(list)
    for (i, _, _), row, c in zip(rows, x, centred):
        want[i].append((int(((n * row - total) ** 2).sum()), c @ (model.vectors / np.sqrt(model.values)[:, None]).T))
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r.vec_id].append((r.w_deviation, np.array(r.w_whitened)))
    assert got.keys() == want.keys()
    for i in want:
        a, b = (sorted(z[i], key=lambda t: (t[0], t[1].tolist())) for z in (want, got))
        assert [t[0] for t in a] == [t[0] for t in b]
        assert all(np.allclose(s[1], t[1], atol=1e-8) for s, t in zip(a, b))
    w = np.array([t[1] for i in got for t in got[i]])
    assert np.abs(np.cov(w.T, bias=True) - np.eye(k)).max() < 1e-6


def test_op12(spark, odd_vectors):
    rows, df = odd_vectors
    out, model, error = op12_whitening.whiten(df)
    assert out.columns == ["vec_id", "embedding", "label", "c_codes", "w_whitened", "w_deviation"]
    check_whitening(padded(rows, 32), out, model, error)
    assert len(op12_whitening.whiten(df, components=5)[1].values) == 5


def test_op12_without_variance(spark, odd_vectors):
    _, df = odd_vectors
    for few in (df.where("vec_id >= 3000"), df.where("vec_id = 2001"), df.where("vec_id between 1000 and 1100")):
        out, model, error = op12_whitening.whiten(few)
        assert len(model.values) == 0 and error == 0 and all(r.w_whitened == [] for r in out.collect())
        assert out.count() == few.where("vec_id < 3000").count()
    two = spark.createDataFrame([(1, [1.0, 0.0, 5.0]), (2, [0.0, 1.0, 5.0]), (3, [0.0, 0.0, 5.0])], "vec_id long, embedding array<double>")
    assert len(op12_whitening.whiten(two)[1].values) == 2
    blank = spark.createDataFrame([(1, []), (2, None)], "vec_id long, embedding array<float>")
    assert [r.w_whitened for r in op12_whitening.whiten(blank)[0].collect()] == [[]]


def test_op12_query(spark):
    rows = catalog.QUERIES["op12_spectrum_whitening"](spark, SF).collect()
    ids = {r.vec_id for r in read_table(spark, SF, "embeddings").collect()}
    assert len(rows) == 32 * len(ids) and {r.component for r in rows} == set(range(1, 33))
    assert max(r.identity_error for r in rows) < 1e-9
    shares = [s for _, s in sorted({(r.component, r.explained) for r in rows})]
    assert len(shares) == 32 and shares == sorted(shares, reverse=True) and 0 < sum(shares) < 1


def test_inertia_counts_and_clusters():
    rng = np.random.default_rng(5)
    for size in (1, 2, 7, 30):
        q = np.linalg.qr(rng.normal(size=(size, size)))[0]
        for values in (rng.normal(size=size), np.repeat([3.0, -1.0], [(size + 1) // 2, size // 2]), np.ones(size),
                       1 + 1e-13 * rng.normal(size=size)):
            v = (q * values) @ q.T
            v = (v + v.T) / 2
            for shift in (-0.31, 0.07, 2.2, 5.0):
                assert spectrum.count_above(v, shift) == (values > shift).sum()
            found = [spectrum.eigenpair(v, k) for k in range(1, size + 1)]
            assert all(sure for _, _, sure in found)
            assert np.allclose([f[0] for f in found], np.sort(values)[::-1], atol=1e-9)
            basis = np.array([f[1] for f in found])
            assert np.allclose(basis @ basis.T, np.eye(size), atol=1e-7)
    swap = np.array([[0.0, 1.0], [1.0, 0.0]])       # no 1x1 pivot exists
    assert [spectrum.count_above(swap, s) for s in (-2.0, 0.0, 2.0)] == [2, 1, 0]


def test_exact_sums_near_the_limit():
    big = np.full((5, 4), vectors.LARGEST - 1, np.int64)
    assert (vectors.product(big.T, big) == 5 * (vectors.LARGEST - 1) ** 2).all()
    model = op12_whitening.Whitening(1 << 40, [0, 0], 1.0, np.zeros(0), np.zeros((0, 2)))
    assert model.deviation(np.array([[1 << 25, 0], [0, 0]])) == [None, 0]
