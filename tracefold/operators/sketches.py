"""Approximate statistics of logs for any range of days, from sketches kept by log and day. Opt-in: the exact operators don't use them.

A day's sketches are made once by ordinary aggregation and merged for a range without a look at its traces: distinct variants and activities (HyperLogLog),
quantiles of trace lengths (KLL), the most frequent activities (frequent-items sketch).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers of a distinct count as a power of two, size of a quantile sketch, items that a frequency sketch follows.
REGISTER_BITS, QUANTILE_K, ITEMS = 14, 400, 1024
#: Three standard errors of a distinct count at ``REGISTER_BITS``, and of a rank at ``QUANTILE_K``.
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (REGISTER_BITS / 2), 0.02
SEPARATOR = "\u0001"


def daily(traces: DataFrame) -> DataFrame:
    """``log, day`` (of completion) with ``n_cases, n_events`` and the sketches ``variants, lengths, activities, frequent``. Traces without events or completion are left out."""
    rows = traces.where((F.size("seq") > 0) & F.col("completion").isNotNull()).select("log", F.to_date("completion").alias("day"), "seq")
    size = F.size("seq").cast("long")
    whole = rows.groupBy("log", "day").agg(
        F.count("*").alias("n_cases"), F.sum(size).alias("n_events"), F.hll_sketch_agg(F.array_join("seq", SEPARATOR, "\u0002"), F.lit(REGISTER_BITS)).alias("variants"),
        F.kll_sketch_agg_bigint(size, F.lit(QUANTILE_K)).alias("lengths"))
    labels = rows.select("log", "day", F.explode("seq").alias("label")).groupBy("log", "day").agg(F.hll_sketch_agg("label", F.lit(REGISTER_BITS)).alias("activities"), F.expr(f"approx_top_k_accumulate(label, {ITEMS})").alias("frequent"))
    return whole.join(labels, ["log", "day"])


def over_days(sketches: DataFrame, first: str | None = None, last: str | None = None, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75), top: int = 5) -> DataFrame:
    """``log, n_cases, n_events, n_variants, n_activities, length_quantiles, top_activities`` over the days from ``first`` to ``last`` (both included; None: no bound)."""
    here = F.lit(True)
    if first is not None:
        here = here & (F.col("day") >= F.lit(first).cast("date"))
    if last is not None:
        here = here & (F.col("day") <= F.lit(last).cast("date"))
    merged = sketches.where(here).groupBy("log").agg(
        F.sum("n_cases").alias("n_cases"), F.sum("n_events").alias("n_events"), F.hll_union_agg("variants").alias("v"), F.hll_union_agg("activities").alias("a"),
        F.kll_merge_agg_bigint("lengths").alias("l"), F.expr(f"approx_top_k_combine(frequent, {ITEMS})").alias("f"))
    cuts = F.array(*(F.kll_sketch_get_quantile_bigint("l", F.lit(q)) for q in quantiles))
    return merged.select("log", "n_cases", "n_events", F.hll_sketch_estimate("v").alias("n_variants"), F.hll_sketch_estimate("a").alias("n_activities"), cuts.alias("length_quantiles"), F.expr(f"approx_top_k_estimate(f, {top})").alias("top_activities"))


def near(estimate: Column, exact: Column, error: float = DISTINCT_ERROR) -> Column:
    """Whether an estimate is within the stated relative error of the exact number; one is allowed to small numbers."""
    return F.abs(estimate - exact) <= F.greatest(F.lit(1.0), error * exact)
