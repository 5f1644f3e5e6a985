"""Variant frequencies of an event stream: session windows close cases, closed cases are counted and merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session_traces(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """``user_id, start, seq`` of closed sessions; later events than ``lateness`` are dropped by the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    cases = timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("e"))
    return cases.select("user_id", F.col("w.start").alias("start"), F.col("e.event_type").alias("seq"))


def run_available(spark: SparkSession, source: str, out: str, checkpoint: str, gap: str = "30 minutes", lateness: str = "1 hour") -> None:
    """Reads what is there, appends the closed sessions' variant counts batch by batch (a batch that is run again replaces itself), and ends."""
    schema = spark.read.parquet(source).schema
    events = spark.readStream.schema(schema).parquet(source)

    def merge(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy(F.array_join("seq", "|").alias("node")).agg(F.count("*").alias("freq"))
        counts.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = session_traces(events, gap, lateness).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(merge).trigger(availableNow=True).start()
    query.awaitTermination()


def merged(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).groupBy("node").agg(F.sum("freq").alias("freq"))
