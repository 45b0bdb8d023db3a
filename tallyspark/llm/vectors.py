"""Integer forms of embedding vectors and exact sums over them, for the operators on ``embeddings``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Scaled entries of this size or more count as not finite: below it, squares and their sums over
#: 500 entries stay within 64 bits.
LARGEST = 1 << 26


def usable(vector: Column, scale: int) -> Column:
    """Whether a vector is not null and holds finite entries only, none of ``LARGEST`` or more once scaled."""
    # a comparison with NaN is false for <, as NaN is the largest value
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) * scale < F.lit(float(LARGEST)), F.lit(False)))


def scaled(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of every entry x."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The rows of a list column as an int64 matrix; vectors shorter than ``dims`` end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten()).astype(np.int64)
    size = np.asarray(column.value_lengths()).astype(np.int64)
    if (size == dims).all():
        return flat.reshape(len(size), dims)
    out = np.zeros((len(size), dims), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``left @ right`` of integers, exact: by doubles while no sum can leave 53 bits, else by 64-bit integers."""
    most = int(np.abs(left).max(initial=0)) * int(np.abs(right).max(initial=0)) * left.shape[1]
    if most < 1 << 53:
        return (left.astype(np.float64) @ right.astype(np.float64)).astype(np.int64)
    return left @ right


def dimension(df: DataFrame, column: str) -> int:
    """Length of the longest vector, 0 for an empty table."""
    return df.agg(F.max(F.size(column))).first()[0] or 0


def summed(df: DataFrame, part, shape: tuple[int, ...]) -> np.ndarray:
    """The exact sum over all Arrow batches of ``part(batch)``, an int64 array of ``shape``.

    A task adds up its batches and passes one row a place that is not zero, so what is shuffled and comes to
    the driver is bounded by ``shape``, whatever the rows. Returns Python integers.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            flat = total.reshape(-1)
            at = np.flatnonzero(flat)
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(flat[at], pa.int64())], names=["at", "s"])

        total, bound = np.zeros(shape, np.int64), 0
        for batch in batches:
            values = part(batch)
            most = int(np.abs(values).max(initial=0))
            if bound + most >= 1 << 62:     # before 64 bits are full, pass the sum on and begin anew
                yield out()
                total, bound = np.zeros(shape, np.int64), 0
            total += values
            bound += most
        yield out()

    rows = (df.mapInArrow(run, "at long, s long").groupBy("at")
            .agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())
    flat = np.zeros(int(np.prod(shape)), object)
    for r in rows:
        flat[r["at"]] = int(r["s"])
    return flat.reshape(shape)
