"""Sinks: attachments, XES, result tables that several runs fill."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATTACHMENT = "attachment_time string, attachment_index long, node_id string"


def save_attachments(df: DataFrame, path: str, csv: bool = False) -> None:
    """Parquet, or gzip CSV with header for exchange."""
    rows = df.select("attachment_time", "attachment_index", "node_id")
    if csv:
        rows.write.mode("overwrite").option("header", True).option("compression", "gzip").option("nullValue", "\\N").csv(path)
    else:
        rows.write.mode("overwrite").parquet(path)


def load_attachments(spark: SparkSession, path: str, csv: bool = False) -> DataFrame:
    """Typed also when empty; labels such as ``NA`` or ``null`` stay labels. A file without the columns raises."""
    if not csv:
        df = spark.read.parquet(path)
        missing = {"attachment_time", "attachment_index", "node_id"} - set(df.columns)
        if missing:
            raise ValueError(f"attachments lack {sorted(missing)}")
        return df.orderBy("attachment_index")
    return spark.read.schema(ATTACHMENT).option("header", True).option("enforceSchema", False).option("nullValue", "\\N").option("emptyValue", "").csv(path).orderBy("attachment_index")


def save_xes(traces: DataFrame, path: str, start: str = "2020-01-01 00:00:00") -> None:
    """``case_id, seq`` as XES traces, a file a partition; events an hour apart from ``start`` in every case."""
    entry = lambda k, v: F.struct(F.lit(k).alias("_key"), v.alias("_value"))
    stamp = lambda i: F.date_format(F.to_timestamp(F.lit(start)) + F.make_interval(hours=i), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    events = F.transform("seq", lambda a, i: F.struct(F.array(entry("concept:name", a)).alias("string"), F.array(entry("time:timestamp", stamp(i))).alias("date")))
    rows = traces.select(F.array(entry("concept:name", F.col("case_id"))).alias("string"), events.alias("event"))
    rows.write.mode("overwrite").format("xml").option("rootTag", "log").option("rowTag", "trace").save(path)


def append_results(df: DataFrame, path: str, partitions: tuple[str, ...] = ("model", "concept", "log")) -> None:
    """A unit's rows replace that unit's earlier rows only, so a broken run resumes where it stopped."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def missing_units(wanted: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Units that still have to be computed."""
    return wanted.join(done.select(*key).distinct(), key, "left_anti")


def combine(parts: list[DataFrame], order: list[str]) -> DataFrame:
    """The union of shards by column name, missing columns null, sorted."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.orderBy(*[c for c in order if c in out.columns])


def save_report(df: DataFrame, path: str, missing: str = "NA") -> None:
    """A small report as one CSV file, missing values (also not-a-numbers) written as ``missing``: ``NA`` or ``NaN``."""
    shown = {c: F.when(~F.isnan(c), F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")}
    df.withColumns(shown).coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", missing).csv(path)


def save_seed(spark: SparkSession, path: str, seed: int) -> None:
    """The seed of an experiment beside its results."""
    spark.createDataFrame([(seed,)], "seed long").coalesce(1).write.mode("overwrite").json(path)


def register_dataset(spark: SparkSession, path: str, key: str, name: str, short_name: str, kind: str, source: str) -> DataFrame:
    """The registry table with the entry added or replaced, written to ``path`` and returned."""
    entry = spark.createDataFrame([(key, name, short_name, kind, source)], "key string, name string, short_name string, type string, path string")
    entry.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key").json(path)
    return spark.read.schema(entry.schema).json(path)
