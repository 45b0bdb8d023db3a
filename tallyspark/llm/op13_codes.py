"""Operator 13, vector code compression: a product code trained by member-resident Lloyd rounds.

Vectors are cut into parts; each part position has a codebook of entries. The parts themselves live
as rows dealt by (position, entry, salt): the partition that owns an entry holds the entry's members.
A round sums the members where they are, replaces the entries, lets each member look for its nearest new
entry, and moves only the members whose entry changed, in the next shuffle. Members are packed, some
thousand a row, without ids. All arithmetic is on integers, so results do not depend on how
rows are dealt. The trained codebooks, of a size set by parameters, then encode every vector.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import query, read_table, spread_join, staged
from .vectors import dimension, matrix, product, scaled, summed, usable

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Members that one (position, entry, salt) should hold if all parts of a position choose one entry.
OWNER_MEMBERS = 100_000

BLOCK = "part int, entry int, salt int, moved boolean, members binary"


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of ``book`` for each row, the lowest of equal ones, and its squared distance."""
    far = (points * points).sum(1)[:, None] - 2 * product(points, book.T) + (book * book).sum(1)[None, :]
    at = far.argmin(1)
    return at, far[np.arange(len(points)), at]


def _blocks(part: int, points: np.ndarray, entry: np.ndarray, salts: int, moved) -> Iterator[tuple]:
    """Rows of ``BLOCK``: the points of each entry packed in one value; the salt follows from their bytes."""
    order = np.argsort(entry, kind="stable")
    edges = np.flatnonzero(np.diff(entry[order], prepend=-1, append=-1))
    for lo, hi in zip(edges[:-1], edges[1:]):
        data = points[order[lo:hi]].astype("<i4").tobytes()
        e = int(entry[order[lo]])
        yield part, e, zlib.crc32(data) % salts, moved(e), data


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                      names=["part", "entry", "salt", "moved", "members"])


def _settled(df: DataFrame) -> DataFrame:
    """Members at their owners: those that stay are read where they are, those that moved are shuffled."""
    moved = df.where("moved").repartition("part", "entry", "salt")
    return df.where("not moved").unionByName(moved)


def first_books(kept: DataFrame, dims: int, parts: int, entries: int, order: list) -> np.ndarray:
    """Parts x entries x width: the parts of the first vectors in ``order``."""
    rows = kept.orderBy(*order).limit(entries).select("__llm_v").collect()
    start = np.zeros((len(rows), dims), np.int64)
    for k, r in enumerate(rows):
        start[k, :len(r[0])] = r[0]
    return np.ascontiguousarray(start.reshape(len(rows), parts, dims // parts).transpose(1, 0, 2))


def train(kept: DataFrame, books: np.ndarray, rounds: int, salts: int) -> np.ndarray:
    """``rounds`` of Lloyd over the vectors ``kept.__llm_v``; returns the codebooks."""
    parts, entries, width = books.shape

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = matrix(batch.column(0), parts * width)
            rows = []
            for p in range(parts if len(points) else 0):
                own = points[:, p * width:(p + 1) * width]
                rows += _blocks(p, own, nearest(own, books[p])[0], salts, lambda e: True)
            if rows:
                yield _batch(rows)

    members = None
    for _ in range(rounds):
        if members is None:
            members = staged(kept.select("__llm_v").mapInArrow(placed, BLOCK).repartition("part", "entry", "salt"), "owners")
        else:
            members = staged(_settled(staged(members.mapInArrow(_mover(books, salts), BLOCK), "moves")), "owners")

        def sums(batch: pa.RecordBatch) -> np.ndarray:
            total = np.zeros((parts, entries, width + 1), np.int64)
            for p, e, data in zip(*(batch.column(c).to_pylist() for c in ("part", "entry", "members"))):
                points = np.frombuffer(data, "<i4").reshape(-1, width)
                total[p, e, :width] += points.sum(0, dtype=np.int64)
                total[p, e, width] += len(points)
            return total

        total = summed(members, sums, (parts, entries, width + 1))
        used = total[:, :, width] > 0
        books = books.copy()
        books[used] = (total[:, :, :width][used] // total[:, :, width:][used]).astype(np.int64)
    return books


def _mover(books: np.ndarray, salts: int):
    """A map over blocks: members that stay with their entry, and those that must move, as blocks of the new one."""
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p, e, data in zip(*(batch.column(c).to_pylist() for c in ("part", "entry", "members"))):
                points = np.frombuffer(data, "<i4").reshape(-1, width).astype(np.int64)
                rows += _blocks(p, points, nearest(points, books[p])[0], salts, lambda n, e=e: n != e)
            if rows:
                yield _batch(rows)
    return run


def compress(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS, scale: int = SCALE, prefix: str = "c_") -> tuple[DataFrame, np.ndarray]:
    """``df``'s rows with a usable vector, with ``codes`` (array of entry indexes by part) and ``error`` (squared
    distance to the decoded vector, long), each name after ``prefix``; and the codebooks, parts x entries x width.

    Rows whose vector is null or holds a null, infinite or NaN entry, or one of ``LARGEST`` or more once
    scaled, are dropped. Vectors shorter than the longest one, or than the next multiple of ``parts``, end in zeros.
    Codebooks start from the smallest ids, nulls last, equal ids by their vector; repeated rows count each
    and get equal codes. With fewer vectors than ``entries`` the codebooks are smaller. An empty table, or one
    of empty vectors, gives no rows and codebooks without entries. Columns with the name of an appended one are replaced.
    """
    new = {prefix + "codes", prefix + "error"}
    keep = [c for c in df.columns if c not in new]
    kept = staged(df.where(usable(F.col(vector), scale)).where(F.size(vector) > 0)
                  .select(*[F.col(f"`{c}`") for c in keep], scaled(F.col(vector), scale).alias("__llm_v")), "vectors")
    longest = dimension(kept, "__llm_v")
    dims = -(-longest // parts) * parts
    books = first_books(kept, dims, parts, entries, [F.col(f"`{vec_id}`").asc_nulls_last(), "__llm_v"])
    if dims:
        salts = max(1, -(-kept.count() // OWNER_MEMBERS))
        books = train(kept, books, rounds, salts)
    width = dims // parts

    @F.arrow_udf("struct<codes: array<int>, error: long>")
    def encoded(column: pa.Array) -> pa.Array:
        points = matrix(column, dims)
        code, error = np.zeros((len(points), parts), np.int32), np.zeros(len(points), np.int64)
        for p in range(parts):
            code[:, p], far = nearest(points[:, p * width:(p + 1) * width], books[p])
            error += far
        ends = pa.array(np.arange(0, parts * len(points) + 1, parts), pa.int32())
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(code.reshape(-1))), pa.array(error)],
                                          names=["codes", "error"])

    out = kept.withColumn("__llm_c", encoded("__llm_v"))
    return out.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"__llm_c.{n}").alias(prefix + n) for n in ("codes", "error")]), books


def label_errors(coded: DataFrame, label: str = "label", error: str = "c_error") -> DataFrame:
    """``coded`` with ``label_error``, the sum of ``error`` over the rows of equal labels, nulls being equal. Read
    ``coded`` from a staged table: it is used twice. A label that most rows have is dealt over many tasks."""
    keyed = coded.withColumn("__llm_label", F.struct(F.col(label)))
    sums = staged(keyed.groupBy("__llm_label").agg(F.sum(error).alias("label_error"), F.count(F.lit(1)).alias("n")), "labels")
    return spread_join(keyed, sums, ["__llm_label"], "left").drop("__llm_label")


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


@query("op13_resident_lloyd")
def op13_resident_lloyd(spark, sf_dir):
    """Per usable vector: its code, error, the error of its label, and the digest of the codebooks (no SQL for
    Lloyd rounds of this size; tests compare with a plain version)."""
    coded, books = compress(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    coded = staged(coded.select("vec_id", "label", "c_codes", "c_error"), "codes")
    hexes = F.array_join(F.transform("c_codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return label_errors(coded).select("vec_id", hexes.alias("code"), F.col("c_error").alias("error"), "label_error",
                                      F.lit(books_sha256(books)).alias("codebooks_sha256"))
