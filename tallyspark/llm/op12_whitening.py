"""Operator 12, whitening of embeddings by spectrum slicing.

Sums and centred products of the integer forms are exact and come from one row a task. Each leading
eigenpair of the covariance is then a Spark task of its own: LDL^T inertia counts isolate the
eigenvalue, Rayleigh quotient iteration finds it, counts certify its number (see ``spectrum``).
Vectors are centred, projected and divided by the root of the eigenvalue in a last pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import query, read_table, staged
from .spectrum import EPS, eigenpair
from .vectors import dimension, matrix, product, scaled, summed, usable

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Largest entry of |covariance of the whitened rows - identity| that a result may have.
TOLERANCE = 1e-4
LONG = 1 << 63


class Whitening:
    """A fitted transform: ``n``, ``total`` (exact sums by dimension of the vectors without OFFSET), ``trace``,
    ``values`` (falling) and ``vectors`` (components x dimensions)."""

    def __init__(self, n, total, trace, values, vectors):
        self.n, self.total, self.trace, self.values, self.vectors = n, total, trace, values, vectors
        self.dims = len(total)

    def apply(self, points: np.ndarray) -> np.ndarray:
        """Rows x components of integer vectors without OFFSET."""
        centre = np.array([s // self.n for s in self.total], np.int64)      # whole part first: exact differences
        rest = np.array([(s % self.n) / self.n for s in self.total])
        return ((points - centre) - rest) @ (self.vectors / np.sqrt(self.values)[:, None]).T

    def deviation(self, points: np.ndarray) -> list:
        """Exact sum over dimensions of (n x - S)^2 for each row, None where it needs more than a long."""
        most = max((abs(self.n * int(m) - s) for s, col in zip(self.total, points.T) for m in (col.min(), col.max())),
                   default=0) if len(points) else 0
        if most * most * self.dims < LONG:
            off = self.n * points - np.array(self.total, np.int64)
            return (off * off).sum(1).tolist()
        off = [[self.n * x - s for x, s in zip(row, self.total)] for row in points.tolist()]
        return [d if (d := sum(x * x for x in row)) < LONG else None for row in off]


def covariance(kept: DataFrame, column: str, dims: int) -> tuple[int, list[int], list[list[int]]]:
    """Count, sums and ``n^2`` times the covariance of integer vectors, all exact. Vectors are centred at the
    rounded mean before they are multiplied; the fraction left is taken off the products afterwards."""
    first = summed(kept.select(column), lambda b: np.append(matrix(b.column(0), dims).sum(0), b.num_rows), (dims + 1,))
    n, total = int(first[dims]), [int(s) for s in first[:dims]]
    if not n:
        return 0, total, []
    centre = np.array([(2 * s + n) // (2 * n) for s in total], np.int64)

    def products(batch: pa.RecordBatch) -> np.ndarray:
        points = matrix(batch.column(0), dims) - centre
        return np.triu(product(points.T, points))

    half = summed(kept.select(column), products, (dims, dims))
    off = [s - n * int(c) for s, c in zip(total, centre)]
    return n, total, [[n * int(half[min(i, j), max(i, j)]) - off[i] * off[j] for j in range(dims)] for i in range(dims)]


def leading(spark: SparkSession, v: np.ndarray, components: int) -> list:
    """The leading eigenpairs of ``v``, one Spark task a component: ``(k, value, vector, certified)`` by k."""
    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids in batches:
            found = [(int(k), *eigenpair(v, int(k))) for k in ids["id"]]
            yield pd.DataFrame([(k, value, vector.tolist(), sure) for k, value, vector, sure in found],
                               columns=["k", "value", "vector", "certified"])

    ids = spark.range(1, components + 1, 1, max(components, 1))
    return sorted(ids.mapInPandas(solve, "k long, value double, vector array<double>, certified boolean").collect())


def fit(kept: DataFrame, column: str, components: int = COMPONENTS) -> Whitening:
    """Fit on all rows of ``kept``. Components without variance (beyond rounding) are left out."""
    dims = dimension(kept, column)
    n, total, exact = covariance(kept, column, dims)
    size = len(exact)
    v = np.array([[x / (n * n) for x in row] for row in exact]).reshape(size, size)     # correctly rounded quotients
    trace = sum(exact[i][i] for i in range(dims)) / (n * n) if n else 0.0
    pairs = [p for p in leading(kept.sparkSession, v, min(components, size)) if p["value"] > 4 * size * EPS * trace] if trace else []
    if not all(p["certified"] for p in pairs):
        raise ArithmeticError("the inertia counts do not certify the numbers of the components")
    return Whitening(n, total, trace, np.array([p["value"] for p in pairs]),
                     np.array([p["vector"] for p in pairs]).reshape(len(pairs), size))


def identity_error(kept: DataFrame, column: str, model: Whitening) -> float:
    """Largest absolute entry of the covariance of all whitened rows minus the identity, measured on the rows."""
    k, dims = len(model.values), model.dims
    if not k:
        return 0.0

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = model.apply(matrix(batch.column(0), dims))
            total += np.vstack([w.sum(0), w.T @ w])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int64()), pa.array(total.reshape(-1))], names=["at", "s"])

    sums = np.zeros((k + 1) * k)
    for r in kept.select(column).mapInArrow(products, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).collect():
        sums[r["at"]] = r["s"]
    mean, second = sums[:k] / model.n, sums[k:].reshape(k, k) / model.n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE,
           prefix: str = "w_") -> tuple[DataFrame, Whitening, float]:
    """``df``'s rows with a usable vector, with ``whitened`` (array of double, one a component) and ``deviation``
    (long), each name after ``prefix``; the fitted transform; and the identity error of all rows.

    Rows whose vector is null or holds a null, infinite or NaN entry, or one of ``LARGEST`` or more once scaled,
    are dropped; vectors shorter than the longest one end in zeros; empty vectors of an otherwise empty table are
    vectors of no dimension. Repeated rows count each. Components without variance are left out, so one row, or
    rows that are all equal, have none. Of equal eigenvalues any orthonormal vectors of their space are taken, the same
    for all rows. A deviation that needs more than a long is null. Columns with the name of an appended one are replaced.
    """
    new = {prefix + "whitened", prefix + "deviation"}
    keep = [c for c in df.columns if c not in new]
    kept = staged(df.where(usable(F.col(vector), scale))
                  .select(*[F.col(f"`{c}`") for c in keep], scaled(F.col(vector), scale).alias("__llm_v")), "vectors")
    model = fit(kept, "__llm_v", components)
    error = identity_error(kept, "__llm_v", model)
    if error > TOLERANCE:
        raise ArithmeticError(f"whitened covariance is off the identity by {error}")
    k, dims = len(model.values), model.dims

    @F.arrow_udf("struct<whitened: array<double>, deviation: long>")
    def applied(column: pa.Array) -> pa.Array:
        points = matrix(column, dims)
        w = model.apply(points) if k else np.zeros((len(points), 0))
        ends = pa.array(np.arange(len(points) + 1) * k, pa.int32())
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(w.reshape(-1), pa.float64())),
                                           pa.array(model.deviation(points), pa.int64())], names=["whitened", "deviation"])

    out = kept.withColumn("__llm_w", applied("__llm_v"))
    return (out.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"__llm_w.{n}").alias(prefix + n) for n in ("whitened", "deviation")]),
            model, error)


@query("op12_spectrum_whitening")
def op12_spectrum_whitening(spark, sf_dir):
    """Per usable vector and component: the whitened coordinate, with the fit's count, the vector's deviation, the
    component's share of the variance, and the identity error (no SQL for eigenvectors)."""
    rows, model, error = whiten(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.values]) if len(model.values) else F.array().cast("array<double>")
    return (rows.select("vec_id", "w_deviation", F.posexplode("w_whitened").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"),
                    F.col("w_deviation").alias("deviation"), "whitened", F.get(share, "at").alias("explained"),
                    F.lit(error).alias("identity_error")))
