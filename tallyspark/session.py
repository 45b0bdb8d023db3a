"""Session construction and lineage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


PIECE_BYTES = 16 << 20      # of a written file, the least that a task reads


def get_spark(master: str | None = None, app: str = "tallyspark", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume.

    On a cluster the master and ``spark.checkpoint.dir`` come from the submit
    configuration; a local scratch checkpoint folder is only set when none is given
    (tests, benchmarks on one machine).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if master and master.startswith("local"):
        conf["spark.driver.memory"] = os.environ.get("TALLYSPARK_DRIVER_MEMORY", "16g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder; create a local one only when unset."""
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder: lineage cuts must survive executor loss")
    local = tempfile.mkdtemp(prefix="tallyspark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss).

    Used where one intermediate result fans out into many downstream jobs. Never a
    local checkpoint: those blocks die with their executor.
    """
    from pyspark import StorageLevel
    ensure_checkpoint_dir(df.sparkSession)
    # persisted first so the plan runs once: the checkpoint write reads the cached
    # partitions instead of recomputing them; released once the files are written
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet files in the shared checkpoint folder: one pass instead of the two of ``cut_lineage``, and each
    reader scans only the columns that it uses, in pieces of ``PIECE_BYTES``, however few tasks wrote them. Columns that Parquet doesn't hold are checkpointed instead."""
    from pyspark.sql.types import AtomicType, NullType
    names = [f.name.lower() for f in df.schema.fields]
    plain = lambda t: isinstance(t, AtomicType) and not isinstance(t, NullType) and "interval" not in t.simpleString()
    held = lambda t: plain(getattr(t, "elementType", t))
    if not names or len(set(names)) < len(names) or not all(held(f.dataType) for f in df.schema.fields):
        return cut_lineage(df)
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", PIECE_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
