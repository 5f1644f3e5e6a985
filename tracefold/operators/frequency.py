"""Statistics of frequencies and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ranks that one row is expanded to at most.
RANKS = 1 << 16


def rank_frequency(freqs: DataFrame, by: list[str]) -> DataFrame:
    """``by, rank, freq``: the rank-frequency curve. Equal frequencies are counted before they are ranked, so the window sees distinct values only."""
    placed = rank_ranges(freqs, by)
    # ranks of one frequency are made in blocks, dealt anew, so that a million singletons aren't one row's work
    blocks = placed.withColumn("from", F.explode(F.sequence("first", "last", F.lit(RANKS)))).withColumn("to", F.least("last", F.col("from") + RANKS - 1))
    return blocks.repartition(*by, "from").select(*by, F.explode(F.sequence("from", "to")).alias("rank"), "freq")


def rank_ranges(freqs: DataFrame, by: list[str]) -> DataFrame:
    """``by, freq, types, first, last``: each frequency's types and the ranks that they have; a row for each distinct frequency."""
    values = freqs.where(F.col("freq") > 0).groupBy(*by, "freq").agg(F.count("*").alias("types"))
    before = F.sum("types").over(Window.partitionBy(*by).orderBy(F.desc("freq")).rowsBetween(Window.unboundedPreceding, -1))
    first = F.coalesce(before, F.lit(0)) + 1
    return values.select(*by, "freq", "types", first.alias("first"), (first + F.col("types") - 1).alias("last"))


def describe(freqs: DataFrame, by: list[str]) -> DataFrame:
    """``n_occurrences, n_types, n_singletons, singleton_share``."""
    return freqs.groupBy(*by).agg(F.sum("freq").alias("n_occurrences"), F.count("*").alias("n_types"), F.count_if(F.col("freq") == 1).alias("n_singletons"), (F.count_if(F.col("freq") == 1) / F.count("*")).alias("singleton_share"))


def tail_counts(freqs: DataFrame, by: list[str], xmin: Column) -> DataFrame:
    """Types and occurrences below and from ``xmin`` on."""
    low = F.col("freq") < xmin
    return freqs.groupBy(*by).agg(F.count_if(low).alias("types_below"), F.count_if(~low).alias("types_from"), F.sum(F.when(low, F.col("freq")).otherwise(0)).alias("occurrences_below"), F.sum(F.when(low, 0).otherwise(F.col("freq"))).alias("occurrences_from"))


def log_statistics(traces: DataFrame) -> DataFrame:
    """Per log: cases (empty ones too), events, variants and activities (of traces with events), median length (half to even) and maximum."""
    size = F.size("seq")
    base = traces.groupBy("log").agg(F.count("*").alias("n_cases"), F.sum(size).cast("long").alias("n_events"), F.count_distinct(F.when(size > 0, F.col("seq"))).alias("n_variants"), F.bround(F.percentile(size, 0.5), 0).cast("long").alias("median_length"), F.max(size).cast("long").alias("max_length"))
    labels = traces.select("log", F.explode("seq").alias("a")).groupBy("log").agg(F.count_distinct("a").alias("n_activities"))
    return base.join(labels, "log", "left").select("log", "n_cases", "n_events", "n_variants", F.coalesce("n_activities", F.lit(0)).alias("n_activities"), "median_length", "max_length")


def length_profile(traces: DataFrame) -> DataFrame:
    """``n, mean, median, q1, q3, min, max`` of the trace lengths."""
    size = F.size("seq")
    q = F.percentile(size, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    rows = traces.groupBy("log").agg(F.count("*").alias("n"), F.avg(size).alias("mean"), q.alias("q"), F.min(size).alias("min"), F.max(size).alias("max"))
    return rows.select("log", "n", "mean", F.col("q")[1].alias("median"), F.col("q")[0].alias("q1"), F.col("q")[2].alias("q3"), "min", "max")


def length_cdf(traces: DataFrame) -> DataFrame:
    """``length, n, cdf``: the share of traces no longer; lengths are counted first."""
    counts = traces.groupBy("log", F.size("seq").alias("length")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("log")
    upto = F.sum("n").over(w.orderBy("length").rowsBetween(Window.unboundedPreceding, 0))
    return counts.select("log", "length", "n", (upto / F.sum("n").over(w)).alias("cdf"))


def xmax_candidates(freqs: DataFrame, by: list[str], exclude: tuple[int, ...] = (0, 1, 2, 3, 5, 10)) -> DataFrame:
    """``exclude_k, xmax, excluded``: the value at each position of the descending frequencies; repeats keep the first; excluded: types strictly above."""
    ranges = rank_ranges(freqs, by)
    wanted = F.filter(F.array(*(F.lit(k) for k in exclude)), lambda k: (k + 1 >= F.col("first")) & (k + 1 <= F.col("last")))
    return ranges.where(F.size(wanted) > 0).select(*by, F.array_min(wanted).alias("exclude_k"), F.col("freq").alias("xmax"), (F.col("first") - 1).alias("excluded"))


def next_activity_map(edges: DataFrame) -> DataFrame:
    """``src, dst, n, cum_p`` from ``log, src, dst, first_seen``-ordered pair counts: cumulative transition probabilities, the last one exactly 1."""
    w = Window.partitionBy("log", "src").orderBy("first_seen", "dst")
    total = F.sum("n").over(Window.partitionBy("log", "src"))
    cum = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return edges.select("log", "src", "dst", "n", F.when(cum == total, 1.0).otherwise(cum / total).alias("cum_p"))


def ccdf_points(freqs: DataFrame, by: list[str]) -> DataFrame:
    """``freq, p_at_least, p_less``: the empirical tail and the left distribution function at each observed value."""
    values = freqs.groupBy(*by, "freq").agg(F.count("*").alias("t"))
    w = Window.partitionBy(*by)
    below = F.coalesce(F.sum("t").over(w.orderBy("freq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("t").over(w)
    return values.select(*by, "freq", (1 - below / total).alias("p_at_least"), (below / total).alias("p_less"))


def log_binned_pdf(freqs: DataFrame, by: list[str], per_decade: int = 5) -> DataFrame:
    """``bin, types, density`` on logarithmic bins."""
    b = F.floor(F.log10(F.col("freq").cast("double")) * per_decade).cast("int")
    counts = freqs.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("types"))
    low, high = F.pow(F.lit(10.0), F.col("bin") / per_decade), F.pow(F.lit(10.0), (F.col("bin") + 1) / per_decade)
    return counts.withColumn("density", F.col("types") / F.sum("types").over(Window.partitionBy(*by)) / (high - low))
