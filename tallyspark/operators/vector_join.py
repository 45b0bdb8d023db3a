"""Exact inner-product neighbours (J10) by a metric index: balls around pivots, cut into rings.

Vectors are put on one sphere, where an inner product above the threshold is an angle below a bound. Each
vector lives in the ball of its nearest pivot, in a ring of angles to it. A probe meets only the rings that
the triangle inequality leaves open, and what meets is scored in blocks. Where vectors have so little structure
that a probe meets most balls, balls are merged into few large cells, so that a probe is copied once a cell and
not once a ball. Copies of a vector are one class, so a vector that a third of the rows hold is scored once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from .common import spread_join

PIVOTS_MOST = 4096      # bound of the broadcast pivots, and a fourth of that of the sample they are taken
                        # from; below it they grow with the root of the table
SLACK = 1e-7            # radians added to every bound, for rounding
VISITS = 32             # balls a probe meets, on average, up to which balls are cells of their own
BLOCK_BYTES, BLOCK_MOST = 8 << 20, 1 << 14      # of a block of vectors: bytes and rows at most
SLICE = 1 << 22         # products of a block that are held at once


def vector_classes(df: DataFrame, id_col: str, vec: str, label: str, keep: int) -> DataFrame:
    """``(cid, v, n, least, rows)``: distinct vectors with their count and the ``keep`` rows of smallest id, as
    ``(nid, nlbl)``. Copies are counted and cut in the map tasks."""
    base = df.select(F.col(id_col).alias("nid"), F.col(vec).cast("array<double>").alias("v"), F.col(label).alias("nlbl")).filter(
        F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))
    dims = base.agg(F.max(F.size("v"))).first()[0] or 0
    base = base.filter(F.size("v") == dims)
    w = Window.partitionBy("v").orderBy("nid", "nlbl")
    some = (base.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= keep).groupBy("v")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "nid", "nlbl"))),
                             lambda r: F.struct(r["nid"].alias("nid"), r["nlbl"].alias("nlbl"))).alias("rows")))
    counts = base.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    return cut_lineage(some.join(counts, "v").withColumn("cid", F.monotonically_increasing_id())
                       .withColumn("least", F.col("rows")[0]["nid"]))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class Sphere:
    """Vectors as points of a unit sphere: members get a coordinate that makes their length ``most``, the largest
    of all, so that inner products stay and angles to a probe order them."""

    def __init__(self, most: float, threshold: float, pivots: np.ndarray):
        self.most, self.threshold = most, threshold
        self.pivots = self.members(pivots)

    def members(self, v: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.most ** 2 - (v * v).sum(1)))
        return np.hstack([v, rest[:, None]]) / self.most

    def probes(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Points, and the angle within which a member must lie to exceed the threshold."""
        size = np.sqrt((v * v).sum(1))
        unit = np.hstack([v, np.zeros((len(v), 1))]) / np.where(size > 0, size, 1.0)[:, None]
        cos = self.threshold / np.where(size > 0, size * self.most, 1.0)
        angle = np.where(size > 0, np.arccos(np.clip(cos, -1.0, 1.0)), math.pi if self.threshold < 0 else -1.0)
        return unit, np.where(cos > 1 + 1e-9, -1.0, angle)

    def spread(self, size: int) -> None:
        """Keep ``size`` of the pivots, each next one being that farthest from those taken, so that every cluster
        of the sample gets one and balls stay small."""
        at = [0]
        near = self.pivots @ self.pivots[0]
        while len(at) < min(size, len(self.pivots)) and near.min() < 1 - 1e-12:
            at.append(int(near.argmin()))
            near = np.maximum(near, self.pivots @ self.pivots[at[-1]])
        self.pivots = self.pivots[at]

    def angles(self, points: np.ndarray) -> np.ndarray:
        """Points x pivots."""
        return np.arccos(np.clip(points @ self.pivots.T, -1.0, 1.0))

    def open_balls(self, v: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probes x pivots: which balls the probes must visit, and between which angles to their pivots."""
        points, reach = self.probes(v)
        t = reach[:, None] + SLACK
        angle = self.angles(points)
        near, far = np.maximum(angle - t, low), np.minimum(angle + t, high)
        return (near <= far) & (angle <= angle.min(1, keepdims=True) + 2 * t) & (t >= SLACK), near, far

    def merged(self, cells: int) -> np.ndarray:
        """The cell of each ball if balls are merged into ``cells``, each with the nearest of the first pivots."""
        return self.angles(self.pivots)[:, :cells].argmin(1)


def block_size(dims: int) -> int:
    """Rows of a block of vectors of ``dims`` entries."""
    return max(1, min(BLOCK_MOST, BLOCK_BYTES // (8 * max(1, dims))))


def placed(classes: DataFrame, threshold: float, pivots: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, probes): the classes with the ``(cell, ring)`` they live in, and with each they must visit.

    A member y of ball c is within angle t of a probe x only if ``angle(x, c)`` is within t of the ring of y, and,
    c being nearest to y, at most 2 t above the angle of x to its own nearest pivot. A ball is a cell, unless probes
    of the sample meet more than ``VISITS`` balls; then balls are merged into cells without rings, about one a
    block of vectors, and a probe visits a cell once if it must visit any of its balls."""
    n, most, dims = classes.agg(F.count(F.lit(1)), F.max(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)), F.max(F.size("v"))).first()
    size = pivots or min(PIVOTS_MOST, 4 * math.ceil(math.sqrt(n)))
    sample = np.array([r.v for r in classes.orderBy(F.xxhash64("v"), "cid").limit(4 * size).select("v").collect()])
    sphere = Sphere(math.sqrt(most) or 1.0, threshold, sample)
    sphere.spread(size)
    width = max(0.02, math.acos(min(1.0, max(-1.0, threshold / sphere.most ** 2))))

    @F.arrow_udf("struct<cell: int, angle: double>")
    def home(column: pa.Array) -> pa.Array:
        angle = sphere.angles(sphere.members(_matrix(column))) if len(column) else np.zeros((0, 1))
        at = angle.argmin(1)
        return pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(angle[np.arange(len(at)), at])], names=["cell", "angle"])

    balls_of = cut_lineage(classes.withColumn("home", home("v")).select("cid", "v", "least", "home.cell", "home.angle"))
    balls = balls_of.groupBy("cell").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi")).collect()   # a row a pivot
    low, high = np.full(len(sphere.pivots), np.inf), np.full(len(sphere.pivots), -np.inf)
    for b in balls:
        low[b.cell], high[b.cell] = b.lo, b.hi

    met = sphere.open_balls(sample[:256], low, high)[0].sum(1).mean()
    large = sphere.merged(max(VISITS, -(-n // block_size(dims)))) if met > VISITS else None
    if large is None:
        members = balls_of.select("cid", "v", "least", "cell", F.floor(F.col("angle") / width).cast("int").alias("ring"))
    else:
        cell_of = F.array(*[F.lit(int(c)) for c in large])      # a number a pivot
        members = balls_of.select("cid", "v", "least", F.get(cell_of, "cell").alias("cell"), F.lit(0).alias("ring"))

    @F.arrow_udf("array<struct<cell: int, first: int, last: int>>")
    def visits(column: pa.Array) -> pa.Array:
        v, out = _matrix(column), []
        for k in range(0, len(v), 256):        # 256 x pivots at a time
            open_, near, far = sphere.open_balls(v[k:k + 256], low, high)
            if large is not None:
                rows, at = np.nonzero(open_)
                met = np.zeros((len(open_), large.max() + 1), bool)
                met[rows, large[at]] = True
                out += [[{"cell": int(c), "first": 0, "last": 0} for c in np.flatnonzero(r)] for r in met]
                continue
            first, last = np.floor(np.where(open_, near, 0) / width), np.floor(np.where(open_, far, 0) / width)
            for r in range(len(open_)):
                at = np.flatnonzero(open_[r])
                out.append([{"cell": int(c), "first": int(first[r, c]), "last": int(last[r, c])} for c in at])
        kind = pa.list_(pa.struct([("cell", pa.int32()), ("first", pa.int32()), ("last", pa.int32())]))
        return pa.array(out, kind)

    # a row a class is written; its copies are made when read
    probes = (cut_lineage(classes.select("cid", "v", visits("v").alias("to"))).select("cid", "v", F.explode("to").alias("to"))
              .select("cid", "v", "to.cell", F.explode(F.sequence("to.first", "to.last")).alias("ring")))
    return members, probes


def best_pairs(p: np.ndarray, m: np.ndarray, threshold: float, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of p, row of m, product) of the ``keep`` largest products above the threshold of each row of ``p``, of
    equal ones those of the first rows of ``m``. Single precision, with a bound of its error, shows which rows of
    ``p`` can have such products; those are multiplied in double precision."""
    span = lambda x: float(np.sqrt((x * x).sum(1).max())) or 1.0
    ps, ms = span(p), span(m)
    least = threshold / ps / ms - (p.shape[1] + 8) * 2.0 ** -22
    p32, m32 = (p / ps).astype(np.float32), (m / ms).astype(np.float32).T
    found = []
    for lo in range(0, len(p), step := max(1, SLICE // len(m))):
        rows = lo + np.flatnonzero((p32[lo:lo + step] @ m32).max(1) > least)
        if not len(rows):
            continue
        sim = p[rows] @ m.T
        if sim.shape[1] > keep:         # the products below the last wanted one are left out
            sim[sim < np.partition(sim, -keep, axis=1)[:, -keep, None]] = -np.inf
        q, at = np.nonzero(sim > threshold)
        best = sim[q, at]
        order = np.lexsort((at, -best, q))
        q, at, best = q[order], at[order], best[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        found.append((rows[q[place < keep]], at[place < keep], best[place < keep]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def best_classes(members: DataFrame, probes: DataFrame, threshold: float, keep: int, block_rows: int) -> DataFrame:
    """``(qid, cid, sim)``: for each probe class the ``keep`` member classes of largest inner product above the
    threshold, ties by smallest id. A ring is scored in blocks of about ``block_rows`` probes and
    members by a matrix product; a block returns at most ``keep`` classes a probe."""
    key = ["cell", "ring"]
    chunks = lambda df, name: df.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(name))
    grid = cut_lineage(chunks(probes, "pn").join(chunks(members, "mn"), key))       # rings that both sides have
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    p = (probes.join(grid, key).withColumn("pc", F.pmod(F.xxhash64("cid"), "pn").cast("int")).withColumn("mc", every("mn"))
         .select(*[F.col(c).alias(c) for c in (*key, "pc", "mc")], F.col("cid").alias("qid"), F.col("v").alias("pv")))
    m = (members.join(grid, key).withColumn("mc", F.pmod(F.xxhash64("cid"), "mn").cast("int")).withColumn("pc", every("pn"))
         .select(*[F.col(c).alias(c) for c in (*key, "pc", "mc", "cid", "least")], F.col("v").alias("mv")))

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"qid": [], "cid": [], "sim": [], "least": []})
        b = b.sort_values("least", kind="stable")       # of equal products the smallest ids come first
        q, at, sim = best_pairs(np.stack(a["pv"].to_numpy()), np.stack(b["mv"].to_numpy()), threshold, keep)
        return pd.DataFrame({"qid": a["qid"].to_numpy()[q], "cid": b["cid"].to_numpy()[at], "sim": sim, "least": b["least"].to_numpy()[at]})

    kind = members.schema["least"].dataType.simpleString()
    by = [*key, "pc", "mc"]
    found = p.groupBy(*by).cogroup(m.groupBy(*by)).applyInPandas(score, f"qid long, cid long, sim double, least {kind}")
    w = Window.partitionBy("qid").orderBy(F.desc("sim"), "least", "cid")
    return found.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= keep).select("qid", "cid", "sim")


def neighbours(df: DataFrame, id_col: str, vec: str, label: str, threshold: float, k: int, pivots: int | None = None,
               block_rows: int | None = None) -> DataFrame:
    """``(v, best)`` of each distinct vector with neighbours: its k + 1 nearest rows as an array of ``(sim, nid, nlbl)``,
    nearest first, ties by id; the rows of the vector itself are among them."""
    classes = vector_classes(df, id_col, vec, label, k + 1)
    if classes.isEmpty():
        return classes.select("cid", "v", "n", F.transform("rows", lambda r: F.struct(
            F.lit(0.0).alias("sim"), r["nid"].alias("nid"), r["nlbl"].alias("nlbl"))).alias("best"))
    members, probes = placed(classes, threshold, pivots)
    pairs = best_classes(members, probes, threshold, k + 1, block_rows or block_size(classes.agg(F.max(F.size("v"))).first()[0]))
    rows = pairs.join(classes.select("cid", F.explode("rows").alias("r")), "cid").select("qid", "sim", "r.nid", "r.nlbl")
    w = Window.partitionBy("qid").orderBy(F.desc("sim"), "nid")
    top = rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k + 1)
    best = top.groupBy(F.col("qid").alias("cid")).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rn", "sim", "nid", "nlbl"))),
        lambda r: F.struct(r["sim"].alias("sim"), r["nid"].alias("nid"), r["nlbl"].alias("nlbl"))).alias("best"))
    return classes.select("cid", "v", "n").join(best, "cid")


def transfer(df: DataFrame, id_col: str, vec: str, near: DataFrame, k: int) -> DataFrame:
    """``df`` with ``transferred_label``, ``best_similarity`` and ``neighbours`` (ids) from ``near``, without the row itself."""
    key = df.withColumn("v", F.col(vec).cast("array<double>"))
    joined = spread_join(key, cut_lineage(near.drop("cid")), ["v"], "left")
    others = F.slice(F.filter(F.coalesce("best", F.array()), lambda r: ~r["nid"].eqNullSafe(F.col(id_col))), 1, k)
    out = joined.withColumn("_o", others)
    return out.select(*df.columns, F.get("_o", 0)["nlbl"].alias("transferred_label"), F.get("_o", 0)["sim"].alias("best_similarity"),
                      F.transform("_o", lambda r: r["nid"]).alias("neighbours"))
