"""Queries: report tables over the derived fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.operators import decision, reports
from tracefold.operators import traces as tr
from tracefold.plans.core import _BASE, _nodes_sql, log_traces
from tracefold.plans.outcomes import _BASE_SETTING, _BEST, _FITS, _coded, _coded_sql, derived_comparisons, derived_fits


def variant_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.variant_table(*_coded(spark, sf_dir))
    return out.select("log", "n_fitted", F.round("gof_p", 9).alias("gof_p"), "fit_valid", "code", "best", "best_R", F.round("best_p", 9).alias("best_p"), "significant")


def fitted_types_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.field_table(derived_fits(spark, sf_dir), "n_fitted", integer=True)


def best_alternative_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.best_alternative_tables(derived_comparisons(derived_fits(spark, sf_dir)))["best"]


def gof_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.gof_by_order(_coded(spark, sf_dir)[0], "L03").withColumn("gof_p", F.round("gof_p", 9))


def outcome_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.outcome_shares(decision.outcome_counts(_coded(spark, sf_dir)[0]))


def outcome_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.outcome_stack(decision.outcome_counts(_coded(spark, sf_dir)[0]))
    return out.withColumns({c: F.round(c, 9) for c in ("share", "upto")})


def experiment_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    freqs = None
    for log in ("events_by_day", "lineitem", "orders"):
        part = tr.frequencies(log_traces(spark, sf_dir, log), "n3")
        freqs = part if freqs is None else freqs.unionByName(part)
    return reports.experiment_overview(freqs, ["log"])


QUERIES = {f.__name__: f for f in (variant_table, fitted_types_table, best_alternative_table, gof_by_order, outcome_shares, outcome_stack, experiment_overview)}
_CODED = _coded_sql(_BASE_SETTING)
_COUNTS = _CODED + ", o AS (SELECT concept, " + ", ".join(f"count(*) FILTER (code = '{c}') AS {c}" for c in "ABCDE") + ", count(*) AS total FROM k GROUP BY concept)"
SQL = {
    "variant_table": _CODED + f", b AS ({_BEST}) SELECT l.log, n_fitted, round(gof_p, 9) AS gof_p, fit_valid, coalesce(code, '?') AS code, best, best_R, best_p, significant FROM (SELECT DISTINCT log FROM f) l LEFT JOIN k ON k.log = l.log AND k.concept = 'variants' LEFT JOIN b ON b.log = l.log AND b.concept = 'variants'",
    "fitted_types_table": _FITS + " SELECT log, " + ", ".join(f"coalesce(max(CAST(n_fitted AS VARCHAR)) FILTER (concept = '{s}'), '?') AS {s}" for s in decision.SCALES) + " FROM f GROUP BY log",
    "best_alternative_table": _FITS + f", b AS ({_BEST}) SELECT log, " + ", ".join(f"coalesce(max(best) FILTER (concept = '{s}'), '?') AS {s}" for s in decision.SCALES) + " FROM b GROUP BY log",
    "gof_by_order": _CODED + " SELECT concept, n_fitted, round(gof_p, 9) AS gof_p, code FROM k WHERE log = 'L03'",
    "outcome_shares": _COUNTS + " SELECT concept, " + ", ".join(f"concat({c}, '/', total) AS {c}" for c in "ABCDE") + " FROM o",
    "outcome_stack": _COUNTS + " SELECT concept, unnest(['A', 'B', 'C', 'D', 'E']) AS code, unnest([A, B, C, D, E]) AS n, unnest([round(A / total, 9), round(B / total, 9), round(C / total, 9), round(D / total, 9), round(E / total, 9)]) AS share, unnest([round(A / total, 9), round((A + B) / total, 9), round((A + B + C) / total, 9), round((A + B + C + D) / total, 9), round((A + B + C + D + E) / total, 9)]) AS upto FROM o",
    "experiment_overview": "WITH t AS (" + " UNION ALL ".join(f"SELECT '{k}' AS log, seq FROM ({_BASE[k]})" for k in ("events_by_day", "lineitem", "orders")) + f"), o AS (SELECT log, unnest({_nodes_sql('n3')}) AS node FROM t), f AS (SELECT log, array_to_string(node, '|') AS node, count(*) AS freq FROM o GROUP BY 1, 2) SELECT log, count(*) AS n_types, CAST(sum(freq) AS BIGINT) AS n_occurrences, max(freq) AS top, count(*) FILTER (freq = 1) AS n_singletons FROM f GROUP BY log",
}
