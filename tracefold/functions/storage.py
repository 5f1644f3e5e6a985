"""Tables kept in the folder that driver and executors share, and global numbering without a single-task window."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of our own, if driver and executors are one process (as in tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder or f"file://{os.path.join(tempfile.gettempdir(), 'tracefold-shared')}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so that its lineage ends there. The table is deleted when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: 0-based dense positions in the total order ``order``.

    Rows are range-partitioned and sorted; a row's position is its place in its partition plus the rows of the partitions before. Only the
    partitions' row counts meet in one task.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "numbered")
    counts = sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect())  # one row a partition
    offsets, total = [], 0
    for part, count in counts:
        offsets.append((part, total))
        total += count
    before = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_part int, _before long")
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")
