"""Column helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

from tracefold.functions import storage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; texts that lie in fewer pieces than there are cores (as one small file does) are dealt out first."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("documents", "pages") and df.rdd.getNumPartitions() < cores else df


def whole_key(df: DataFrame, name: str) -> Column:
    """The key column as a long; a key of another kind is refused rather than turned into nulls."""
    kind = df.schema[name].dataType
    if not isinstance(kind, IntegralType | NullType):
        raise TypeError(f"the key {name} must hold whole numbers, not {kind.simpleString()}")
    return F.col(name).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row.

    A plain alias would be inlined into lambdas that use it and evaluated again for each element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of runs of non-space, null and empty: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def most_frequent(counts: DataFrame, limit: int, n: str = "n") -> DataFrame:
    """The rows of ``counts`` from the lowest count on that at most ``limit`` rows reach.

    The cut comes from the counts' own histogram, so the rows themselves are never ranked in one place.
    """
    histogram = counts.groupBy(n).agg(F.count("*").alias("rows")).orderBy(F.desc(n)).limit(limit).collect()  # distinct counts
    cut, total = None, 0
    for row in histogram:
        total += row["rows"]
        if total > limit:
            break
        cut = row[n]
    return counts.where(F.col(n) >= cut) if cut is not None else counts.limit(0)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, which also becomes the checkpoint folder where none is set."""
    folder = storage.shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there, so lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return storage.stored(df, name)
