"""Counts of open cases: any order of arrival within the lateness gives the counts of a batch."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tracefold.operators import traces as tr
from tracefold.streaming.state import ngram_changes

SCHEMA = "log string, case_id string, event_id long, activity string, ts timestamp"


@pytest.mark.parametrize("n", [2, 4])
def test_any_order_of_arrival(spark, tmp_path, n):
    rng, rows = random.Random(n), []
    for c in range(12):
        start = 1_700_000_000 + rng.randrange(5000)
        for i in range(rng.randrange(1, 9)):
            rows.append(("l" if c % 2 else "m", f"c{c}", c * 100 + i, rng.choice("abc"), start + rng.randrange(0, 3000)))
    # events come in five files, out of order by up to the lateness; a last event far ahead closes all cases
    arrival = sorted(rows, key=lambda r: r[4] + rng.randrange(3000))
    files = [arrival[i::5] if i == 9 else arrival[len(arrival) * i // 5 : len(arrival) * (i + 1) // 5] for i in range(5)] + [[("z", "far", 1, "a", 1_800_000_000)], [("z", "farther", 2, "a", 1_900_000_000)]]
    frame = lambda part: spark.createDataFrame(part, "log string, case_id string, event_id long, activity string, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    for i, part in enumerate(files):
        frame(part).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i:02d}"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        query = ngram_changes(stream, n, "6000 seconds", 100_000_000).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    sent = spark.read.parquet(str(tmp_path / "out")).where("log <> 'z'")
    got = {(r.log, tuple(r.node)): r.n for r in sent.groupBy("log", "node").agg(F.sum("delta").alias("n")).collect() if r.n}
    batch = tr.traces(frame(rows).withColumn("o", F.struct("ts", "event_id")))
    want = {(r.log, tuple(r.node)): r.freq for r in tr.frequencies(batch, f"n{n}").collect()}
    assert got == want and sent.where("delta < 0").count() > 0  # something came late and was corrected


def test_orders(spark):
    with pytest.raises(ValueError, match="no state"):
        ngram_changes(spark.createDataFrame([], SCHEMA), 1)
