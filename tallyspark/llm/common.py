"""Helpers shared by the corpus operators: query registry, table reading, staged tables,
and connected components as joins and aggregations."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Word of a text as a Java/Python pattern: a run without space, tab, LF, VT, FF or CR.
WORD = r"[^\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``sql`` is the DuckDB equivalent, where there is one."""
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


#: Most bytes of one Arrow batch between Spark and a Python worker (one row at least).
BATCH_BYTES = 8 << 20
SPARK_BATCH_BYTES = "67108864b"     # Spark's default of the limit


def bounded_batches(df: DataFrame) -> DataFrame:
    """Lower the session's limit of an Arrow batch to BATCH_BYTES and return ``df``.

    Texts pass to Python workers in batches; Spark's defaults (10,000 rows, 64 MB) let a worker and
    the JVM's buffers hold some hundred MB a task. A limit that the user has set is kept.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) == SPARK_BATCH_BYTES:
        conf.set(key, f"{BATCH_BYTES}b")
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, shared by driver and executors.

    The folder is read from the session; a folder of the session's own is made only where
    the setting is absent (tests on one machine). Paths are grouped by application, so
    that ``<dir>/llm-<application id>`` can be deleted when the application has ended.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/llm-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: later jobs and
    retries after a lost executor start from the files instead of the whole lineage."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_staged(spark: SparkSession, df: DataFrame | None = None) -> None:
    """Delete this application's staged tables (or those ``df`` reads); call it only when no
    DataFrame built from them will run again."""
    jvm, sc = spark._jvm, spark.sparkContext
    if df is None:
        base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
        paths = [f"{base.rstrip('/')}/llm-{sc.applicationId}"]
    else:
        paths = sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()})
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def worker_cached(key, make):
    """``make()`` once a Python worker. Functions travel to workers by value, so the globals of
    their modules last for one task; the interpreter's ``sys`` module lasts as long as the worker."""
    import sys

    held = sys.__dict__.setdefault("_llm_worker_cache", {})
    if key not in held:
        held[key] = make()
    return held[key]


FEW_EDGES = 1 << 18         # edges (4 MB) up to which a step of the components is one task; more are dealt out


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; component is the smallest node
    reachable. Alternates large-star and small-star rounds until the edges stop changing, so
    the rounds grow with the logarithm of the longest chain; each round is a staged table. Edges are dealt
    out by their node once a step, for its minimum and the join with it; at most FEW_EDGES of them
    are no work for more than one task.

    Edges with a null end and self-loops are ignored. A node that meets a third of all rows
    is a key of two aggregations with partial sums (``min``), not of a collected group.
    """
    cur = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                 .where("a is not null and b is not null and a <> b").distinct(), "edges")
    before = _sum_of(cur)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        few = before[0] <= FEW_EDGES
        cur = staged(_small_star(_large_star(cur, few), few), "edges")
        now = _sum_of(cur)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected components did not settle")
    # settled: every edge (u, v) points at the component's smallest node
    return (cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())


def _sum_of(edges: DataFrame) -> tuple:
    """Number of the edges and sum of their hashes; equal sets have equal sums."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _dealt(e: DataFrame, few: bool) -> DataFrame:
    return e.coalesce(1) if few else e.repartition("u")


def _large_star(e: DataFrame, few: bool) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = _dealt(e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), few)
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return _dealt(moved, few).distinct()


def _small_star(e: DataFrame, few: bool) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them (edges have u > v)."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _dealt(moved.unionByName(low.select("u", F.col("m").alias("v"))), few).distinct()


FILTER_BITS = 1 << 24       # size of the broadcast bit set of ``only_wanted``: 2 MB


def only_wanted(rows: DataFrame, wanted: DataFrame, key: str = "row") -> DataFrame:
    """``rows`` whose ``key``, a hash, may be in ``wanted(key)``: a bit set of FILTER_BITS bits, whatever the
    size of the tables, is broadcast, so that rows that nothing needs aren't shuffled."""
    place = F.pmod(key, F.lit(FILTER_BITS))
    sets = (wanted.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("set")))
    near = rows.withColumn("p", place).join(F.broadcast(sets), F.bitmap_bucket_number("p") == F.col("bucket"))
    at = F.bitmap_bit_position("p")
    byte = F.conv(F.hex(F.substring("set", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return near.where(F.getbit(byte, (at % 8).cast("int")) == 1).drop("p", "bucket", "set")


#: No group of probe rows that meets one row in ``spread_join`` is larger than this or a 4096th of all.
SPREAD_ROWS, SPREAD_SHARES = 10_000, 4096


def spread_join(probe: DataFrame, build: DataFrame, keys: list[str], how: str, rows: str = "n") -> DataFrame:
    """``probe`` joined (``left`` or ``left_semi``) with ``build``, which has one row a key and counts in ``rows`` how
    often the key stands in ``probe``. Read ``build`` from a staged table: it is used three times.

    A key with more than ``limit`` rows is dealt over numbered parts by the hash of its rows' other columns, so
    that it fills no task of its own; its row of ``build`` is repeated once a part. ``limit`` is at least a 4096th of all rows, so fewer than 4,096 keys
    are above it: their part counts are broadcast, a table of proven size.
    """
    total = build.agg(F.sum(rows)).first()[0] or 0
    limit = max(SPREAD_ROWS, -(-total // SPREAD_SHARES))
    parts = F.ceil(F.col(rows) / F.lit(limit)).cast("int")
    hot = build.where(F.col(rows) > limit).select(*keys, parts.alias("__parts"))
    dealt = (probe.join(F.broadcast(hot), keys, "left")
             .withColumn("__part", F.when(F.col("__parts").isNull(), F.lit(0))
                         .otherwise(F.pmod(F.xxhash64(*[c for c in probe.columns if c not in keys]), "__parts").cast("int")))
             .drop("__parts"))
    copies = build.withColumn("__part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).drop(rows)
    return dealt.join(copies, [*keys, "__part"], how).drop("__part")
