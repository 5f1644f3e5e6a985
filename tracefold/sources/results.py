"""Saved results: partitioned tables that runs append to, read back as one, and the cache of finished units."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.sources.sinks import missing_units


def stacked(spark: SparkSession, root: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """All units under ``root`` (folders ``model=/concept=/log=``) with those parts as columns; pruning reads only wanted units."""
    reader = spark.read.schema(schema).option("basePath", root)
    return reader.option("header", True).csv(root) if fmt == "csv" else reader.parquet(root)


def for_log(results: DataFrame, log: str, model: str = "lower_bounded_power_law") -> DataFrame:
    """One log and model, n-grams by their order, then other concepts."""
    gram = F.regexp_extract("concept", "^n0*([0-9]+)$", 1)
    return results.where((F.col("log") == log) & (F.col("model") == model)).orderBy(gram == "", F.length(gram), gram, "concept")


def selected(results: DataFrame, logs: Sequence[str] | None) -> DataFrame:
    """The results of the given logs; None keeps all."""
    return results if logs is None else results.where(F.col("log").isin(list(logs)))


def with_cache(wanted: DataFrame, cached: DataFrame, needed: Sequence[str], compute: Callable[[DataFrame], DataFrame], key: str = "log") -> DataFrame:
    """Cached rows that have every needed statistic, and computed rows for the other units. ``compute`` gets the units that lack a row."""
    complete = cached
    for c in needed:
        complete = complete.where(F.col(c).isNotNull())
    kept = complete.join(wanted.select(key).distinct(), key, "left_semi").dropDuplicates([key])
    return kept.unionByName(compute(missing_units(wanted.select(key).distinct(), kept, [key])), allowMissingColumns=True)


def occurrence_totals(attachments: DataFrame, summaries: DataFrame) -> DataFrame:
    """``log, concept, counted, saved, agrees``: attachment rows against the summaries' totals. A summary that repeats a unit raises."""
    counted = attachments.groupBy("log", "concept").agg(F.count("*").alias("counted"))
    saved = summaries.groupBy("log", "concept").agg(F.first("n_occurrences").alias("saved"), F.count("*").alias("_n"))
    saved = saved.withColumn("saved", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("summary repeats "), "log", F.lit(" "), "concept")).cast("long")).otherwise(F.col("saved"))).drop("_n")
    out = counted.join(saved, ["log", "concept"], "full")
    return out.withColumn("agrees", F.coalesce(F.col("counted") == F.col("saved"), F.lit(True)))
