"""Structured Streaming variants on a folder of CSV files (memory sink)."""

import os
import tempfile

from tallyspark.streaming.streams import clean_stream, stream_daily_flow


def test_stream_clean_and_daily_flow(spark):
    src = tempfile.mkdtemp(prefix="tallyspark-stream-src-")
    with open(os.path.join(src, "a.csv"), "w") as f:
        f.write("date,amount,vendor,category\n12/25/2023,$10.00,Uber,\n2023-12-25,(5.00),nan,Other\n")
    schema = "date string, amount string, vendor string, category string"
    stream = spark.readStream.schema(schema).option("header", True).csv(src)
    ckpt = tempfile.mkdtemp(prefix="tallyspark-stream-ckpt-")
    q = (clean_stream(stream).writeStream.format("memory").queryName("cleaned").outputMode("append")
         .option("checkpointLocation", ckpt).start())
    q.processAllAvailable()
    q.stop()
    rows = spark.sql("SELECT * FROM cleaned ORDER BY amount").collect()
    assert [r.amount for r in rows] == [-5.0, 10.0]
    assert rows[1].category == "Travel & Transportation"

    from pyspark.sql import functions as F
    flow_src = clean_stream(spark.readStream.schema(schema).option("header", True).csv(src)) \
        .withColumn("date", F.col("date").cast("timestamp"))
    ckpt2 = tempfile.mkdtemp(prefix="tallyspark-stream-ckpt-")
    q2 = (stream_daily_flow(flow_src).writeStream.format("memory").queryName("flow").outputMode("complete")
          .option("checkpointLocation", ckpt2).start())
    q2.processAllAvailable()
    q2.stop()
    r = spark.sql("SELECT * FROM flow").collect()
    assert len(r) == 1 and r[0].n == 2 and r[0].inflow == 10.0 and r[0].outflow == 5.0
