"""Structured Streaming variants (Q1-Q4): the same Column / DataFrame operators on
unbounded input. Every query needs a checkpoint location (in the shared folder on a
cluster) so it restarts exactly where it stopped after a failure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.amounts import clean_amount
from ..functions.dates import standardize_date
from ..functions.text import clean_text
from ..operators import categorize as C


def clean_stream(stream: DataFrame) -> DataFrame:
    """Q1 transform: stateless per-row cleaning (dates, amounts, text, simple category)."""
    out = stream.withColumns({"date": standardize_date(F.col("date")), "amount": clean_amount(F.col("amount"), "robust"),
                              "vendor": clean_text(F.col("vendor"))})
    if "category" in out.columns:
        out = C.apply_simple(out)
    return out


def stream_clean(spark: SparkSession, in_dir: str, schema: str, fmt: str = "csv") -> DataFrame:
    """Q1: clean every file arriving in ``in_dir`` (all-STRING CSV by default)."""
    r = spark.readStream.schema(schema)
    if fmt == "csv":
        r = r.option("header", True)
    return clean_stream(r.format(fmt).load(in_dir))


def stream_dedup(stream: DataFrame, keys: list[str], event_time: str, watermark: str = "7 days") -> DataFrame:
    """Q2: drop repeated keys arriving within the watermark (state is bounded by it); rows later than the
    watermark are dropped too. For a bounded table see ``batch_dedup``."""
    return stream.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(keys)


def batch_dedup(df: DataFrame, keys: list[str]) -> DataFrame:
    """Q2 on a bounded table: one row a key."""
    return df.dropDuplicates(keys)


def stream_daily_flow(stream: DataFrame, event_time: str = "date", amount: str = "amount",
                      watermark: str = "1 day") -> DataFrame:
    """Q3: event-time tumbling daily count / inflow / outflow / net."""
    a = F.col(amount)
    src = stream.withWatermark(event_time, watermark) if stream.isStreaming else stream
    return (src.groupBy(F.window(F.col(event_time), "1 day").alias("w"))
            .agg(F.count("*").alias("n"), F.sum(F.when(a > 0, a).otherwise(0.0)).alias("inflow"),
                 F.sum(F.when(a < 0, -a).otherwise(0.0)).alias("outflow"), F.sum(a).alias("net"))
            .select(F.col("w.start").alias("day_start"), F.col("w.end").alias("day_end"), "n", "inflow", "outflow",
                    "net"))


def epoch_sink(out_dir: str):
    """A sink ``(name, frame, epoch)`` for ``foreachBatch`` with exactly-once results: the output of an epoch is a folder of
    its own, written over when the epoch is run again after a failure. Read ``out_dir/name`` back as one table with
    the column ``epoch``."""
    def write(name: str, frame: DataFrame, epoch: int) -> None:
        frame.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/{name}/epoch={epoch}")
    return write


def stream_insights(stream: DataFrame, sink, checkpoint: str, detectors=None, trigger: str | None = None,
                    available_now: bool = False, output_mode: str = "append"):
    """Q4: run the batch detectors on each micro-batch (``foreachBatch``); ``sink(name, frame, epoch)``, such as
    ``epoch_sink``, receives every detector's output. The micro-batch is cached while its detectors read it."""
    from ..operators import risk as R
    detectors = detectors or {"flags": R.all_flags}

    def each(batch: DataFrame, epoch: int):
        held = batch.persist()
        try:
            for name, fn in detectors.items():
                sink(name, fn(held), epoch)
        finally:
            held.unpersist()
    w = stream.writeStream.foreachBatch(each).outputMode(output_mode).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    elif trigger:
        w = w.trigger(processingTime=trigger)
    return w.start()
