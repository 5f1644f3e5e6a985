"""Queries over the driver's tables as event logs: concepts, frequencies, curves, statistics; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.operators import fits, frequency
from tracefold.operators import traces as tr
from tracefold.sources.logs import table_log

LOGS = ("events_by_day", "lineitem", "conversations", "orders")
_BASE = {
    "events_by_day": "SELECT concat(user_id, '_', strftime(ts, '%Y-%m-%d')) AS case_id, max(ts) AS completion, list(event_type ORDER BY ts, event_id) AS seq FROM events GROUP BY 1",
    "lineitem": "SELECT CAST(l_orderkey AS VARCHAR) AS case_id, max(l_shipdate) AS completion, list(concat(l_returnflag, '+', l_linestatus) ORDER BY l_shipdate, l_linenumber, concat(l_returnflag, '+', l_linestatus)) AS seq FROM lineitem GROUP BY 1",
    "conversations": "SELECT CAST(conv_id AS VARCHAR) AS case_id, CAST(NULL AS TIMESTAMP) AS completion, list(role ORDER BY turn, role) AS seq FROM conversations GROUP BY 1",
    "orders": "SELECT CAST(o_custkey AS VARCHAR) AS case_id, max(o_orderdate) AS completion, list(o_orderpriority ORDER BY o_orderdate, o_orderkey) AS seq FROM orders GROUP BY 1",
}


def log_traces(spark: SparkSession, sf_dir: str, log: str) -> DataFrame:
    return tr.traces(table_log(spark, sf_dir, log))


def node_key(node) -> object:
    return F.array_join(node, "|")


def _nodes_sql(concept: str) -> str:
    """SQL for the list of nodes (lists) of ``seq``."""
    if concept == "variants":
        return "[seq]"
    if concept == "dfrs":
        return "list_transform(range(1, len(seq)), lambda i: seq[i:i+1])"
    n = 1 if concept == "activities" else int(concept[1:])
    if n == 1:
        return "list_transform(seq, lambda x: [x])"
    whole = "list_concat(['START'], seq, ['END'])"
    return f"CASE WHEN len(seq) + 2 <= {n} THEN [{whole}] ELSE list_transform(range(1, len(seq) + 2 - {n} + 2), lambda i: ({whole})[i:i+{n - 1}]) END"


def freq_sql(log: str, concept: str) -> str:
    return f"WITH t AS ({_BASE[log]}), o AS (SELECT unnest({_nodes_sql(concept)}) AS node FROM t), f AS (SELECT array_to_string(node, '|') AS node, count(*) AS freq FROM o GROUP BY 1)"


def concept_frequency(log: str, concept: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = tr.frequencies(log_traces(spark, sf_dir, log), concept)
        return out.select(node_key("node").alias("node"), "freq")

    return run, freq_sql(log, concept) + " SELECT node, freq FROM f"


def rank_curve(log: str, concept: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return frequency.rank_frequency(tr.frequencies(log_traces(spark, sf_dir, log), concept), ["log", "concept"]).select("rank", "freq")

    return run, freq_sql(log, concept) + " SELECT row_number() OVER (ORDER BY freq DESC) AS rank, freq FROM f"


def description(log: str, concept: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return frequency.describe(tr.frequencies(log_traces(spark, sf_dir, log), concept), ["log", "concept"]).select("n_occurrences", "n_types", "n_singletons", F.round("singleton_share", 9).alias("singleton_share"))

    return run, freq_sql(log, concept) + " SELECT CAST(sum(freq) AS BIGINT) AS n_occurrences, count(*) AS n_types, count(*) FILTER (freq = 1) AS n_singletons, round(count(*) FILTER (freq = 1) / count(*), 9) AS singleton_share FROM f"


def curve_fit(log: str, concept: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        points = frequency.rank_frequency(tr.frequencies(log_traces(spark, sf_dir, log), concept), ["log", "concept"])
        out = fits.curve_fits(points, ["log", "concept"])
        numbers = [c for c, t in out.dtypes if t == "double"]
        return out.select(*((F.round(c, 5) + 0.0).alias(c) for c in numbers), "best_fit")

    sql = freq_sql(log, concept) + """,
p AS (SELECT CAST(row_number() OVER (ORDER BY freq DESC) AS DOUBLE) AS x, CAST(freq AS DOUBLE) AS y FROM f),
c AS (SELECT regr_slope(y, x) AS lin_a, regr_intercept(y, x) AS lin_b, CASE WHEN count(*) >= 2 THEN exp(regr_intercept(ln(y), x)) END AS exp_c, CASE WHEN count(*) >= 2 THEN regr_slope(ln(y), x) END AS exp_r,
 CASE WHEN count(*) >= 2 THEN exp(regr_intercept(ln(y), ln(x))) END AS pl_c, CASE WHEN count(*) >= 2 THEN -regr_slope(ln(y), ln(x)) END AS pl_alpha,
 CASE WHEN count(*) FILTER (y >= 2) >= 2 THEN exp(regr_intercept(ln(y), ln(x)) FILTER (y >= 2)) END AS bpl_c, CASE WHEN count(*) FILTER (y >= 2) >= 2 THEN -(regr_slope(ln(y), ln(x)) FILTER (y >= 2)) END AS bpl_alpha FROM p),
q AS (SELECT y, CASE WHEN lin_a IS NOT NULL THEN greatest(lin_a * x + lin_b, 1e-12) END AS a, CASE WHEN exp_c IS NOT NULL THEN greatest(exp_c * exp(exp_r * x), 1e-12) END AS b,
 CASE WHEN pl_c IS NOT NULL THEN greatest(pl_c * pow(x, -pl_alpha), 1e-12) END AS d, CASE WHEN bpl_c IS NOT NULL THEN greatest(bpl_c * pow(x, -bpl_alpha), 1e-12) END AS e FROM p, c),
s AS (SELECT sum(a) AS sa, sum(b) AS sb, sum(d) AS sd, sum(e) AS se FROM q),
n AS (SELECT -sum(y * ln(a / sa + 1e-12)) AS nll_linear, -sum(y * ln(b / sb + 1e-12)) AS nll_exponential, -sum(y * ln(d / sd + 1e-12)) AS nll_power_law, -sum(y * ln(e / se + 1e-12)) AS nll_bounded_power_law FROM q, s)
SELECT round(lin_a, 5) + 0 AS lin_a, round(lin_b, 5) + 0 AS lin_b, round(exp_c, 5) + 0 AS exp_c, round(exp_r, 5) + 0 AS exp_r, round(pl_c, 5) + 0 AS pl_c, round(pl_alpha, 5) + 0 AS pl_alpha, round(bpl_c, 5) + 0 AS bpl_c, round(bpl_alpha, 5) + 0 AS bpl_alpha,
 round(nll_linear, 5) + 0 AS nll_linear, round(nll_exponential, 5) + 0 AS nll_exponential, round(nll_power_law, 5) + 0 AS nll_power_law, round(nll_bounded_power_law, 5) + 0 AS nll_bounded_power_law,
 CASE least(nll_linear, nll_exponential, nll_power_law, nll_bounded_power_law) WHEN nll_linear THEN 'linear' WHEN nll_exponential THEN 'exponential' WHEN nll_power_law THEN 'power_law' ELSE 'bounded_power_law' END AS best_fit FROM c, n"""
    return run, sql


def statistics(log: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return frequency.log_statistics(log_traces(spark, sf_dir, log)).drop("log")

    sql = f"""WITH t AS ({_BASE[log]}), m AS (SELECT median(len(seq)) AS m FROM t)
SELECT count(*) AS n_cases, CAST(sum(len(seq)) AS BIGINT) AS n_events, count(DISTINCT array_to_string(seq, '|')) AS n_variants, (SELECT count(DISTINCT a) FROM (SELECT unnest(seq) AS a FROM t)) AS n_activities,
 (SELECT CAST(CASE WHEN m - floor(m) = 0.5 THEN 2 * round(m / 2) ELSE round(m) END AS BIGINT) FROM m) AS median_length, max(len(seq)) AS max_length FROM t"""
    return run, sql


def lengths(log: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = frequency.length_profile(log_traces(spark, sf_dir, log))
        return out.select("n", F.round("mean", 9).alias("mean"), "median", "q1", "q3", F.col("min").cast("long").alias("min"), F.col("max").cast("long").alias("max"))

    sql = f"""WITH t AS (SELECT len(seq) AS l FROM ({_BASE[log]}))
SELECT count(*) AS n, round(avg(l), 9) AS mean, CAST(quantile_cont(CAST(l AS DOUBLE), 0.5) AS DOUBLE) AS median, CAST(quantile_cont(CAST(l AS DOUBLE), 0.25) AS DOUBLE) AS q1, CAST(quantile_cont(CAST(l AS DOUBLE), 0.75) AS DOUBLE) AS q3, min(l) AS min, max(l) AS max FROM t"""
    return run, sql


def length_distribution(log: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return frequency.length_cdf(log_traces(spark, sf_dir, log)).select(F.col("length").cast("long").alias("length"), "n", F.round("cdf", 9).alias("cdf"))

    return run, f"WITH t AS (SELECT len(seq) AS length, count(*) AS n FROM ({_BASE[log]}) GROUP BY 1) SELECT length, n, round(sum(n) OVER (ORDER BY length) / sum(n) OVER (), 9) AS cdf FROM t"


def candidates(log: str, concept: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = frequency.xmax_candidates(tr.frequencies(log_traces(spark, sf_dir, log), concept), ["log", "concept"])
        return out.select(F.col("exclude_k").cast("long").alias("exclude_k"), "xmax", F.col("excluded").cast("long").alias("excluded"))

    sql = freq_sql(log, concept) + ", r AS (SELECT row_number() OVER (ORDER BY freq DESC) - 1 AS k, freq FROM f) SELECT CAST(min(k) AS BIGINT) AS exclude_k, freq AS xmax, (SELECT count(*) FROM f WHERE f.freq > r.freq) AS excluded FROM r WHERE k IN (0, 1, 2, 3, 5, 10) GROUP BY freq"
    return run, sql


def tail(log: str, concept: str, xmin: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return frequency.tail_counts(tr.frequencies(log_traces(spark, sf_dir, log), concept), ["log"], F.lit(xmin)).drop("log")

    sql = freq_sql(log, concept) + f" SELECT count(*) FILTER (freq < {xmin}) AS types_below, count(*) FILTER (freq >= {xmin}) AS types_from, CAST(coalesce(sum(freq) FILTER (freq < {xmin}), 0) AS BIGINT) AS occurrences_below, CAST(coalesce(sum(freq) FILTER (freq >= {xmin}), 0) AS BIGINT) AS occurrences_from FROM f"
    return run, sql


def ccdf(log: str, concept: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return frequency.ccdf_points(tr.frequencies(log_traces(spark, sf_dir, log), concept), ["log"]).select("freq", F.round("p_at_least", 9).alias("p_at_least"), F.round("p_less", 9).alias("p_less"))

    return run, freq_sql(log, concept) + " SELECT DISTINCT freq, round(1 - (SELECT count(*) FROM f g WHERE g.freq < f.freq) / (SELECT count(*) FROM f), 9) AS p_at_least, round((SELECT count(*) FROM f g WHERE g.freq < f.freq) / (SELECT count(*) FROM f), 9) AS p_less FROM f"


def next_activities(log: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = log_traces(spark, sf_dir, log)
        pairs = tr.occurrences(rows, "n2").where(F.size("node") == 2)
        edges = pairs.groupBy("log", F.col("node")[0].alias("src"), F.col("node")[1].alias("dst")).agg(F.count("*").alias("n"), F.min(F.struct("case_id", "pos")).alias("first_seen"))
        return frequency.next_activity_map(edges).select("src", "dst", "n", F.round("cum_p", 9).alias("cum_p"))

    sql = f"""WITH t AS ({_BASE[log]}), w AS (SELECT case_id, list_concat(['START'], seq, ['END']) AS s FROM t),
p AS (SELECT case_id, i - 1 AS pos, s[i] AS src, s[i + 1] AS dst FROM (SELECT *, unnest(range(1, len(s))) AS i FROM w)),
e AS (SELECT src, dst, count(*) AS n, min(row(case_id, pos)) AS first FROM p GROUP BY 1, 2)
SELECT src, dst, n, round(sum(n) OVER (PARTITION BY src ORDER BY first, dst) / sum(n) OVER (PARTITION BY src), 9) AS cum_p FROM e"""
    return run, sql


def attachment_list(log: str, concept: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tr.attachments(log_traces(spark, sf_dir, log), concept).select("attachment_index", "node_id")

    inner = "node[1]" if concept in ("activities", "n1") else "concat('(', array_to_string(list_transform(node, lambda x: concat('''', x, '''')), ', '), CASE WHEN len(node) = 1 THEN ',' ELSE '' END, ')')"
    sql = f"WITH t AS ({_BASE[log]}), o AS (SELECT completion, case_id, unnest(n) AS node, unnest(range(len(n))) AS p FROM (SELECT *, {_nodes_sql(concept)} AS n FROM t) WHERE len(seq) > 0 AND completion IS NOT NULL) SELECT row_number() OVER (ORDER BY completion, case_id, p) - 1 AS attachment_index, {inner} AS node_id FROM o"
    return run, sql


def normalised(log: str, concept: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = tr.frequencies(log_traces(spark, sf_dir, log), concept)
        total = f.groupBy("log").agg(F.sum("freq").alias("total"))
        return f.join(total, "log").select(node_key("node").alias("node"), F.round(F.when(F.col("total") > 0, F.col("freq") / F.col("total")).otherwise(F.col("freq")), 9).alias("share"))

    return run, freq_sql(log, concept) + " SELECT node, round(freq / (SELECT sum(freq) FROM f), 9) AS share FROM f"


def binned_pdf(log: str, concept: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return frequency.log_binned_pdf(tr.frequencies(log_traces(spark, sf_dir, log), concept), ["log"]).select("bin", "types", F.round("density", 9).alias("density"))

    return run, freq_sql(log, concept) + ", b AS (SELECT CAST(floor(log10(CAST(freq AS DOUBLE)) * 5) AS INTEGER) AS bin, count(*) AS types FROM f GROUP BY 1) SELECT bin, types, round(types / sum(types) OVER () / (pow(10.0::DOUBLE, (bin + 1) / 5) - pow(10.0::DOUBLE, bin / 5)), 9) AS density FROM b"


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30-minute sessions of a user's events as cases."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("e"))
    f = rows.select(F.lit("sessions").alias("log"), F.concat_ws("_", F.col("user_id").cast("string"), F.col("w.start").cast("string")).alias("case_id"), F.element_at("e.ts", -1).alias("completion"), F.col("e.event_type").alias("seq"))
    return tr.frequencies(f, "variants").select(node_key("node").alias("node"), "freq")


_SESSIONS_SQL = """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g),
t AS (SELECT list(event_type ORDER BY ts, event_id) AS seq FROM s GROUP BY user_id, sid)
SELECT array_to_string(seq, '|') AS node, count(*) AS freq FROM t GROUP BY 1"""


def build() -> tuple[dict, dict]:
    made = {"variant_rank_frequency": rank_curve("events_by_day", "variants")}
    for log in LOGS:
        made[f"log_statistics_{log}"] = statistics(log)
        made[f"trace_lengths_{log}"] = lengths(log)
        made[f"variant_frequency_{log}"] = concept_frequency(log, "variants")
        made[f"variant_curve_fits_{log}"] = curve_fit(log, "variants")
    for concept in ("activities", "dfrs", *(f"n{i}" for i in range(1, 21))):
        made[f"frequency_{concept}"] = concept_frequency("events_by_day", concept)
    for concept in ("variants", "n2", "n5", "n10", "n20"):
        made[f"description_{concept}"] = description("events_by_day", concept)
        made[f"rank_curve_{concept}"] = rank_curve("lineitem", concept)
        made[f"xmax_candidates_{concept}"] = candidates("events_by_day", concept)
        made[f"tail_counts_{concept}"] = tail("events_by_day", concept, 3)
    for concept in ("n3", "n8"):
        made[f"curve_fits_{concept}"] = curve_fit("events_by_day", concept)
    made["length_cdf"] = length_distribution("events_by_day")
    made["ccdf_points"] = ccdf("events_by_day", "variants")
    made["log_binned_pdf"] = binned_pdf("events_by_day", "variants")
    made["normalised_frequency"] = normalised("events_by_day", "activities")
    made["next_activity_map"] = next_activities("events_by_day")
    for concept in ("activities", "dfrs", "n3", "variants"):
        made[f"attachments_{concept}"] = attachment_list("events_by_day", concept)
    made["session_variants"] = (_sessions, _SESSIONS_SQL)
    return {k: v[0] for k, v in made.items()}, {k: v[1] for k, v in made.items()}


QUERIES, SQL = build()
