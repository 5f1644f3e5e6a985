"""Queries: replayed and random logs sized by the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.operators import frequency, simulate
from tracefold.operators import traces as tr
from tracefold.plans.core import _BASE, log_traces, node_key


def markov_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many walks over the log's directly-follows chances as it has cases."""
    rows = log_traces(spark, sf_dir, "events_by_day")
    pairs = tr.occurrences(rows, "n2").where(F.size("node") == 2)
    edges = pairs.groupBy("log", F.col("node")[0].alias("src"), F.col("node")[1].alias("dst")).agg(F.count("*").alias("n"), F.min(F.struct("case_id", "pos")).alias("first_seen"))
    longest = rows.agg(F.coalesce(F.max(F.size("seq")), F.lit(0))).first()[0]
    out = simulate.markov_replay(rows.select("case_id"), frequency.next_activity_map(edges), longest)
    return frequency.log_statistics(out.withColumn("log", F.lit("replay"))).drop("log")


def monkey_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each case of the log with as many activities as it has, all drawn from the log's alphabet alike: what the frequencies would be without order."""
    rows = log_traces(spark, sf_dir, "events_by_day")
    names = [r.a for r in rows.select(F.explode("seq").alias("a")).distinct().orderBy("a").collect()]  # the alphabet
    out = simulate.uniform_traces(rows, names or ["a"], F.size("seq")).withColumn("log", F.lit("monkey"))
    return tr.frequencies(out, "variants").select(node_key("node").alias("node"), "freq")


def xor_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case of a branching process for each case of the log; its choices have the chances of the log's most frequent activities."""
    rows = log_traces(spark, sf_dir, "events_by_day")
    top = rows.select(F.explode("seq").alias("a")).groupBy("a").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a").limit(3).collect()
    total = sum(r.n for r in top)
    gate = ([r.a for r in top], [r.n / total for r in top])
    out = simulate.process_traces(rows.select("case_id"), [[gate, gate], [gate, gate]] if top else [])
    return frequency.describe(tr.frequencies(out.withColumn("log", F.lit("xor")), "variants"), ["log"]).drop("log")


def composed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each case followed by a random one of the same log, the halves told apart by prefixes."""
    rows = log_traces(spark, sf_dir, "events_by_day")
    out = tr.paired_traces(rows, rows, 7, "a", "b")
    return out.agg(F.count("*").alias("n_cases"), F.sum(F.size("seq")).cast("long").alias("n_events"), F.count_distinct("seq").alias("n_variants"))


def composed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every case takes part in ``composed_log`` once on each side, whatever the pairs."""
    return composed_log(spark, sf_dir).select("n_cases", "n_events")


def drift_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's earlier and later cases (by the middle of its time) as two processes, one after the other, told apart by prefixes."""
    rows = log_traces(spark, sf_dir, "events_by_day")
    first, last = rows.agg(F.unix_micros(F.min(F.col("completion").cast("timestamp"))), F.unix_micros(F.max(F.col("completion").cast("timestamp")))).first()
    early = F.unix_micros(F.col("completion").cast("timestamp")) * 2 <= F.lit((first or 0) + (last or 0))
    out = simulate.with_drift(rows.where(early), rows.where(~early), overlapping=False).withColumn("log", F.lit("drift"))
    return frequency.log_statistics(out).drop("log")


QUERIES = {f.__name__: f for f in (markov_replay, monkey_log, xor_log, composed_log, composed_cases, drift_log)}
SQL = {
    "drift_log": f"""
WITH t AS ({_BASE["events_by_day"]}), m AS (SELECT epoch_us(min(completion)) + epoch_us(max(completion)) AS s FROM t),
d AS (SELECT list_transform(seq, lambda a: concat(CASE WHEN epoch_us(completion) * 2 <= s THEN 'a:' ELSE 'b:' END, a)) AS seq FROM t, m),
h AS (SELECT median(len(seq)) AS m FROM d)
SELECT count(*) AS n_cases, CAST(sum(len(seq)) AS BIGINT) AS n_events, count(DISTINCT array_to_string(seq, '|')) AS n_variants, (SELECT count(DISTINCT a) FROM (SELECT unnest(seq) AS a FROM d)) AS n_activities,
 (SELECT CAST(CASE WHEN m - floor(m) = 0.5 THEN 2 * round(m / 2) ELSE round(m) END AS BIGINT) FROM h) AS median_length, max(len(seq)) AS max_length FROM d""",
    "composed_cases": f"""WITH t AS ({_BASE["events_by_day"]}) SELECT count(*) AS n_cases, CAST(2 * sum(len(seq)) AS BIGINT) AS n_events FROM t""",
}
