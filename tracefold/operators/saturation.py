"""Saturation: how far n-grams of order k swallow whole traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefold.operators.traces import occurrence_weight

KS = (1, 2, 3, 5, 10, 15, 20)
THRESHOLDS = (50, 60, 70, 80, 90, 100)


def _weight(k):
    return F.when(k == 1, F.col("length")).otherwise(F.greatest(F.lit(1), F.col("length") + 3 - k))


def histogram(traces: DataFrame) -> DataFrame:
    """``log, length, cases, variants`` of the traces with events; all that saturation needs."""
    rows = traces.where(F.size("seq") > 0).groupBy("log", "seq").agg(F.count("*").alias("n"))
    return rows.groupBy("log", F.size("seq").cast("long").alias("length")).agg(F.sum("n").alias("cases"), F.count("*").alias("variants"))


def diagnose(lengths: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """Per log and k: cases, variants, median and maximum length, what one node covers, occurrences and their excess over cases.

    Occurrences are sums of closed-form weights over the length histogram; no n-gram is made.
    """
    rows = lengths.withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks)))).withColumn("weight", _weight(F.col("k")))
    whole = F.col("weight") == 1
    out = rows.groupBy("log", "k").agg(
        F.sum("cases").alias("n_cases"), F.sum("variants").alias("n_variants"), F.percentile("length", 0.5, F.col("cases")).alias("median_length"), F.max("length").alias("max_length"),
        F.sum(F.when(whole, F.col("cases")).otherwise(0)).alias("complete_cases"), F.sum(F.when(whole, F.col("variants")).otherwise(0)).alias("complete_variants"),
        F.sum(F.col("cases") * F.col("weight")).alias("n_occurrences"))
    return out.withColumns({
        "complete_case_share": F.col("complete_cases") / F.col("n_cases"), "complete_variant_share": F.col("complete_variants") / F.col("n_variants"),
        "complete_occurrence_share": F.col("complete_cases") / F.col("n_occurrences"), "excess": F.col("n_occurrences") - F.col("n_cases"), "excess_per_case": (F.col("n_occurrences") - F.col("n_cases")) / F.col("n_cases")})


def with_status(logs: DataFrame, diagnosed: DataFrame, traces: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """A row for each log and k: numbers are NULL, never 0, where the log is ``missing_log`` or ``empty_log``."""
    present = traces.groupBy("log").agg(F.count("*").alias("t"), F.count_if(F.size("seq") > 0).alias("f"))
    grid = logs.select("log").distinct().withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks)))).join(present, "log", "left")
    status = F.when(F.col("t").isNull(), "missing_log").when(F.col("f") == 0, "empty_log").otherwise("ok")
    return grid.select("log", "k", status.alias("status")).join(diagnosed, ["log", "k"], "left")


def shown_percent(share):
    """The one-decimal percentage as it is printed; thresholds compare this, not the share."""
    return F.format_string("%.1f", share * 100).cast("double")


def cross_log(diagnosed: DataFrame, thresholds: Sequence[int] = THRESHOLDS) -> DataFrame:
    """Per k: the logs, the median share of complete cases (each log once), and the logs whose printed share reaches each threshold."""
    shown = shown_percent(F.col("complete_case_share"))
    return diagnosed.where(F.col("n_cases").isNotNull()).groupBy("k").agg(F.count("*").alias("logs"), F.median("complete_case_share").alias("median_share"), *(F.count_if(shown >= t).alias(f"logs_{t}") for t in thresholds))


def order_table(diagnosed: DataFrame, value: str = "complete_case_share", ks: Sequence[int] = KS) -> DataFrame:
    """Log x k."""
    return diagnosed.groupBy("log").pivot("k", list(ks)).agg(F.first(value))


def violations(diagnosed: DataFrame) -> DataFrame:
    """Rows that break an identity: with growing k occurrences can't grow beyond order 2, completeness can't shrink, excess can't be negative."""
    w = Window.partitionBy("log").orderBy("k")
    rows = diagnosed.withColumns({"k0": F.lag("k").over(w), "o0": F.lag("n_occurrences").over(w), "c0": F.lag("complete_cases").over(w)})
    bad = ((F.col("k0") >= 2) & (F.col("n_occurrences") > F.col("o0"))) | ((F.col("k0") >= 2) & (F.col("complete_cases") < F.col("c0"))) | (F.col("excess") < 0) | (F.col("complete_cases") > F.col("n_cases"))
    return rows.where(bad).drop("k0", "o0", "c0")


def extracted_totals(occurrence_counts: DataFrame, diagnosed: DataFrame) -> DataFrame:
    """``log, k, n_occurrences, extracted, agrees``: closed-form totals against counted ones; both sides kept."""
    joined = diagnosed.select("log", "k", "n_occurrences").join(occurrence_counts.select("log", "k", "extracted"), ["log", "k"], "full")
    return joined.withColumn("agrees", F.col("n_occurrences").eqNullSafe(F.col("extracted")))


def checked_totals(occurrence_counts: DataFrame, diagnosed: DataFrame) -> DataFrame:
    """``extracted_totals``; a row that disagrees raises when it is computed."""
    rows = extracted_totals(occurrence_counts, diagnosed)
    said = F.format_string("occurrences of %s at k=%s disagree: %s computed, %s extracted", "log", F.col("k").cast("string"), F.col("n_occurrences").cast("string"), F.col("extracted").cast("string"))
    return rows.withColumn("agrees", F.when(F.col("agrees"), True).otherwise(F.raise_error(said).cast("boolean")))


def log_order(rows: DataFrame, position: str) -> DataFrame:
    """``log, place``: logs by their first appearance, from 0."""
    firsts = rows.groupBy("log").agg(F.min(position).alias("at"))
    return firsts.select("log", (F.row_number().over(Window.orderBy("at", "log")) - 1).alias("place"))  # one row a log


def with_median(table: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """The log x k table with a last row ``median``: each order's median over the logs that have a value."""
    median = table.agg(*(F.median(str(k)).alias(str(k)) for k in ks)).select(F.lit("median").alias("log"), *(F.col(str(k)) for k in ks))
    return table.select("log", *(F.col(str(k)) for k in ks)).unionByName(median)


__all__ = ["histogram", "diagnose", "with_status", "cross_log", "order_table", "violations", "extracted_totals", "checked_totals", "with_median", "occurrence_weight", "shown_percent"]
