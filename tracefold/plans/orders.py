"""Queries: the n-grams of all orders in one job, and their profile; the SQL joins what the orders give one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.functions import sql
from tracefold.functions.storage import stored
from tracefold.operators import orders, sketches
from tracefold.operators.traces import ORDERS
from tracefold.plans.core import _BASE, LOGS, _nodes_sql, log_traces


def _all_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for log in LOGS:
        part = log_traces(spark, sf_dir, log)
        out = part if out is None else out.unionByName(part)
    return out


def frequency_all_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All logs' n-grams of the orders 1 to 20 with their frequencies."""
    return orders.all_orders(_all_traces(spark, sf_dir)).select("log", F.col("n").cast("int").alias("n"), F.array_join("node", "|").alias("node"), "freq")


def order_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the n-grams of each log and order behave; activities and the greatest order, which have continuations of another kind or none, are left out."""
    return orders.order_profile(orders.all_orders(_all_traces(spark, sf_dir))).where(F.col("n").between(2, ORDERS[-1] - 1)).withColumn("n", F.col("n").cast("int"))


def order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types, occurrences and median frequencies by log and order, by log, by order, and of all."""
    return orders.totals(_all_traces(spark, sf_dir)).withColumn("n", F.col("n").cast("int"))


def sql_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of all logs and what follows directly, asked for in SQL text by lateral table functions."""
    sql.register(spark)
    # equal traces are one weighted row; completion is null or not, its value doesn't count here
    kept = _all_traces(spark, sf_dir).where(F.size("seq") > 0).groupBy("log", "seq", F.col("completion").isNull().alias("open"))
    return spark.sql(
        """SELECT log, 'n3' AS kind, array_join(node, '|') AS node, sum(w) AS freq FROM {t}, LATERAL trace_ngrams(seq, 3) GROUP BY ALL
        UNION ALL SELECT log, 'dfrs', concat(src, '|', dst), sum(w) FROM {t}, LATERAL trace_links(seq) GROUP BY ALL
        UNION ALL SELECT log, 'attached', CAST(count(DISTINCT node) AS STRING), sum(w) FROM {t}, LATERAL trace_attachments(seq, completion, 20) GROUP BY log""",
        t=stored(kept.agg(F.max("completion").cast("timestamp").alias("completion"), F.count("*").alias("w")), "weighted"),
    )


#: Ranges of days that sketches are merged over.
_RANGES = (("all", None, None), ("until_1997", None, "1997-12-31"), ("from_2024", "2024-01-05", None))


def sketch_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate statistics of ranges of days beside the exact ones, and whether each is within its stated error."""
    rows = stored(_all_traces(spark, sf_dir).where((F.size("seq") > 0) & F.col("completion").isNotNull()), "completed")
    kept = stored(sketches.daily(rows), "sketches")
    # the exact side: equal traces of a day are one weighted row
    done = stored(rows.groupBy("log", F.to_date("completion").alias("day"), "seq").agg(F.count("*").alias("w")).withColumn("length", F.size("seq").cast("long")), "counted")
    share = lambda c: F.sum(F.when(c, F.col("w")).otherwise(0)) / F.sum("w")
    out = None
    for name, first, last in _RANGES:
        inside = done.where((F.lit(first is None) | (F.col("day") >= F.lit(first or "1970-01-01").cast("date"))) & (F.lit(last is None) | (F.col("day") <= F.lit(last or "1970-01-01").cast("date"))))
        guess = sketches.over_days(kept, first, last)
        labels = inside.select("log", "w", F.explode("seq").alias("a")).groupBy("log", "a").agg(F.sum("w").alias("n")).groupBy("log").agg(F.count("*").alias("activities"), F.max("n").alias("top"))
        exact = inside.groupBy("log").agg(F.sum("w").alias("cases"), F.sum(F.col("w") * F.col("length")).alias("events"), F.count_distinct("seq").alias("variants")).join(labels, "log")
        ranks = inside.join(guess.select("log", F.col("length_quantiles")[1].alias("q")), "log").groupBy("log").agg(share(F.col("length") < F.col("q")).alias("under"), share(F.col("length") <= F.col("q")).alias("upto"))
        part = exact.join(guess, "log").join(ranks, "log").select(
            F.lit(name).alias("range"), "log", F.col("cases").alias("n_cases"), F.col("events").alias("n_events"), F.col("variants").alias("exact_variants"), F.col("activities").alias("exact_activities"), F.col("top").alias("exact_top"),
            ((F.col("n_cases") == F.col("cases")) & (F.col("n_events") == F.col("events"))).alias("sums_same"), sketches.near(F.col("n_variants"), F.col("variants")).alias("variants_near"),
            sketches.near(F.col("n_activities"), F.col("activities")).alias("activities_near"), ((F.col("under") <= 0.5 + sketches.RANK_ERROR) & (F.col("upto") >= 0.5 - sketches.RANK_ERROR)).alias("median_near"),
            sketches.near(F.col("top_activities")[0]["count"], F.col("top")).alias("top_near"))
        out = part if out is None else out.unionByName(part)
    return out


def _ranges_sql() -> str:
    within = lambda first, last: " AND ".join(["completion IS NOT NULL", "len(seq) > 0", *([f"CAST(completion AS DATE) >= DATE '{first}'"] if first else []), *([f"CAST(completion AS DATE) <= DATE '{last}'"] if last else [])])
    parts = " UNION ALL ".join(f"SELECT '{n}' AS range, log, seq FROM t WHERE {within(a, b)}" for n, a, b in _RANGES)
    return f"""WITH {_TRACES}, r AS ({parts}), l AS (SELECT range, log, count(*) AS activities, max(n) AS top FROM (SELECT range, log, a, count(*) AS n FROM (SELECT range, log, unnest(seq) AS a FROM r) GROUP BY ALL) GROUP BY ALL)
SELECT range, log, count(*) AS n_cases, CAST(sum(len(seq)) AS BIGINT) AS n_events, count(DISTINCT seq) AS exact_variants, any_value(activities) AS exact_activities, any_value(top) AS exact_top, true AS sums_same, true AS variants_near, true AS activities_near, true AS median_near, true AS top_near
FROM r JOIN l USING (range, log) GROUP BY range, log"""


_TRACES = "t AS (" + " UNION ALL ".join(f"SELECT '{k}' AS log, CAST(completion AS TIMESTAMP) AS completion, seq FROM ({_BASE[k]})" for k in LOGS) + ")"
_EACH = " UNION ALL ".join(f"SELECT log, {n} AS n, array_to_string(node, '|') AS node FROM (SELECT log, unnest({_nodes_sql(f'n{n}')}) AS node FROM t WHERE len(seq) > 0)" for n in ORDERS)
_PLACED = f"""w AS (SELECT log, list_concat(['START'], seq, ['END']) AS s FROM t WHERE len(seq) > 0),
g AS (SELECT log, n, CASE WHEN len(s) <= n THEN s ELSE s[i:i + n - 1] END AS node, len(s) <= n AS whole, CASE WHEN len(s) > n AND i + n <= len(s) THEN s[i + n] END AS next
 FROM w, (SELECT unnest(range(2, {ORDERS[-1]})) AS n), LATERAL (SELECT unnest(range(1, greatest(len(s) - n + 1, 1) + 1)) AS i)),
k AS (SELECT log, n, array_to_string(node, '|') AS node, bool_or(whole) AS whole, count(*) AS freq, count(DISTINCT next) AS children FROM g GROUP BY ALL)"""
QUERIES = {f.__name__: f for f in (frequency_all_orders, order_profile, order_totals, sql_ngrams, sketch_ranges)}
SQL = {
    "order_totals": f"""WITH {_TRACES}, f AS (SELECT log, n, node, count(*) AS freq FROM ({_EACH}) GROUP BY ALL)
SELECT log, n, CASE WHEN log IS NOT NULL AND n IS NOT NULL THEN 'log_order' WHEN log IS NOT NULL THEN 'log' WHEN n IS NOT NULL THEN 'order' ELSE 'all' END AS level, count(DISTINCT concat(n, ':', node)) AS types, CAST(sum(freq) AS BIGINT) AS occurrences, median(freq) AS median_freq
FROM (SELECT *, log AS l, n AS o FROM f) GROUP BY GROUPING SETS ((log, n), (log), (n), ())""",
    "sketch_ranges": _ranges_sql(),
    "sql_ngrams": f"""WITH {_TRACES} SELECT log, 'n3' AS kind, node, count(*) AS freq FROM (SELECT log, array_to_string(unnest({_nodes_sql("n3")}), '|') AS node FROM t WHERE len(seq) > 0) GROUP BY ALL
 UNION ALL SELECT log, 'dfrs', node, count(*) FROM (SELECT log, array_to_string(unnest({_nodes_sql("dfrs")}), '|') AS node FROM t WHERE len(seq) > 1) GROUP BY ALL
 UNION ALL SELECT log, 'attached', CAST(count(DISTINCT node) AS VARCHAR), count(*) FROM (SELECT log, unnest({_nodes_sql("n20")}) AS node FROM t WHERE len(seq) > 0 AND completion IS NOT NULL) GROUP BY log""",
    "frequency_all_orders": f"WITH {_TRACES} SELECT log, n, node, count(*) AS freq FROM ({_EACH}) GROUP BY ALL",
    "order_profile": f"""WITH {_TRACES}, {_PLACED} SELECT log, CAST(n AS INTEGER) AS n, count(*) AS types, CAST(sum(freq) AS BIGINT) AS occurrences, count(*) FILTER (freq = 1) AS singletons, count(*) FILTER (whole) AS complete_types,
 count(*) FILTER (NOT whole AND children > 1) AS branching_types, count(*) FILTER (NOT whole AND children = 1) AS single_types, count(*) FILTER (NOT whole AND children = 0) AS exhausted_types FROM k GROUP BY log, n""",
}
