"""Queries: outcomes, paired tests, sensitivity, over fit and comparison tables that Spark derives from ``lineitem``; and real fits of the logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.functions.storage import stored
from tracefold.operators import decision, paired, powerlaw, sensitivity, xmin_scan
from tracefold.operators import traces as tr
from tracefold.plans.core import LOGS as ALL_LOGS
from tracefold.plans.core import _BASE, _nodes_sql, log_traces

LOGS = 24


def derived_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fit row for each of 24 logs and 21 concepts, its figures arithmetic on the log's line items."""
    k = (F.col("l_partkey") % 21).alias("k")
    g = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy((F.col("l_suppkey") % LOGS).alias("g"), k).agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("s"), F.sum("l_orderkey").alias("o"))
    concept = F.when(F.col("k") == 20, "variants").otherwise(F.concat(F.lit("n"), (F.col("k") + 1).cast("string")))
    name = F.concat(F.lit("L"), F.lpad(F.col("g").cast("string"), 2, "0"))
    return g.select(name.alias("log"), concept.alias("concept"), (F.col("n") % 120).alias("n_fitted"), ((F.col("s") % 97) / 97.0).alias("gof_p"), (F.col("n") % 11 != 0).alias("fit_valid"), "o")


def derived_comparisons(fits: DataFrame) -> DataFrame:
    models = F.array(*(F.struct(F.lit(i).alias("j"), F.lit(m).alias("m")) for i, m in enumerate(powerlaw.ALTERNATIVES)))
    rows = fits.withColumn("x", F.explode(models))
    j = F.col("x.j")
    return rows.select("log", "concept", F.col("x.m").alias("model_2"), ((F.col("o") * (j + 3)) % 41 - 12).cast("double").alias("R"), (((F.col("o") + j * 7) % 53) / 106.0).alias("p"))


_FITS = """WITH g AS (SELECT l_suppkey % 24 AS g, l_partkey % 21 AS k, count(*) AS n, sum(l_linenumber) AS s, sum(l_orderkey) AS o FROM lineitem GROUP BY 1, 2),
f AS (SELECT concat('L', lpad(CAST(g AS VARCHAR), 2, '0')) AS log, CASE WHEN k = 20 THEN 'variants' ELSE concat('n', k + 1) END AS concept, n % 120 AS n_fitted, CAST(s % 97 AS DOUBLE) / 97 AS gof_p, n % 11 <> 0 AS fit_valid, o FROM g),
c AS (SELECT log, concept, m AS model_2, CAST((o * (j + 3)) % 41 - 12 AS DOUBLE) AS R, CAST((o + j * 7) % 53 AS DOUBLE) / 106 AS p FROM f, (SELECT unnest([0, 1, 2, 3]) AS j, unnest(['lognormal', 'exponential', 'stretched_exponential', 'truncated_power_law']) AS m)),
u AS (SELECT * FROM c WHERE model_2 <> 'truncated_power_law')"""


def _coded_sql(settings: str = "SELECT 'baseline' AS setting, 50 AS min_types, 0.10 AS p_gof, 0.10 AS p_comp") -> str:
    return _FITS + f""", s AS ({settings}),
pr AS (SELECT setting, log, concept, bool_or(p < p_comp AND R < 0) AS lost, bool_and(p < p_comp AND R > 0) AND count(DISTINCT model_2) = 3 AS won FROM u, s GROUP BY 1, 2, 3),
k AS (SELECT f.*, s.*, CASE WHEN NOT fit_valid OR n_fitted < min_types THEN 'A' WHEN gof_p < p_gof THEN 'B' WHEN lost THEN 'C' WHEN won THEN 'D' ELSE 'E' END AS code FROM f, s LEFT JOIN pr ON pr.setting = s.setting AND pr.log = f.log AND pr.concept = f.concept)"""


#: The best distribution of each log and concept of ``u``; the power law has no R and p of its own.
_BEST = """SELECT log, concept, CASE WHEN won THEN 'power_law' ELSE model END AS best, CASE WHEN NOT won THEN R END AS best_R,
 CASE WHEN NOT won THEN round(p, 9) END AS best_p, CASE WHEN won THEN sure ELSE p < 0.1 END AS significant
FROM (SELECT log, concept, bool_and(R > 0) AND count(DISTINCT model_2) = 3 AS won, bool_and(p < 0.1) AS sure,
 arg_min(model_2, row(R, model_2)) AS model, min(R) AS R, arg_min(p, row(R, model_2)) AS p FROM u GROUP BY 1, 2)"""
_SETTINGS = " UNION ALL ".join(f"SELECT '{s}' AS setting, {m} AS min_types, CAST({g} AS DOUBLE) AS p_gof, CAST({c} AS DOUBLE) AS p_comp" for s, m, g, c in sensitivity.CONFIGURATIONS)
_BASE_SETTING = _SETTINGS.split(" UNION ALL ")[0]


def _coded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    fits = derived_fits(spark, sf_dir)
    comps = derived_comparisons(fits)
    return decision.classified(fits, comps), comps


def outcome_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coded(spark, sf_dir)[0].select("log", "concept", "code")


def scaling_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision.scaling_table(_coded(spark, sf_dir)[0])


def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision.outcome_counts(_coded(spark, sf_dir)[0])


def best_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decision.best_distributions(derived_comparisons(derived_fits(spark, sf_dir)), ["log", "concept"])
    return out.select("log", "concept", "best", "best_R", F.round("best_p", 9).alias("best_p"), "significant")


def comparison_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision.comparison_counts(*_coded(spark, sf_dir))


def paired_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired.paired_cells(paired.endpoints(derived_fits(spark, sf_dir).withColumn("xmin", F.lit(None).cast("double"))), [])


def paired_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = paired.holm(paired.paired_effects(paired_cells(spark, sf_dir)).withColumn("family", F.lit(0)), "p_value", ["family"], "k")
    return out.select("k", "n", *(F.round(c, 7).alias(c) for c in ("p_k", "p_variants", "difference", "lower", "upper", "p_value", "holm_p")), "status")


_CELLS = _FITS + """, e AS (SELECT log, concept, CASE WHEN gof_p >= 0.1 THEN 1 ELSE 0 END AS y FROM f WHERE fit_valid AND n_fitted >= 50),
c0 AS (SELECT CAST(substr(a.concept, 2) AS INTEGER) AS k, count(*) FILTER (a.y = 0 AND v.y = 0) AS n00, count(*) FILTER (a.y = 0 AND v.y = 1) AS n01, count(*) FILTER (a.y = 1 AND v.y = 0) AS n10, count(*) FILTER (a.y = 1 AND v.y = 1) AS n11 FROM e a LEFT JOIN e v ON v.log = a.log AND v.concept = 'variants' WHERE a.concept <> 'variants' GROUP BY 1),
cells AS (SELECT k, coalesce(n00, 0) AS n00, coalesce(n01, 0) AS n01, coalesce(n10, 0) AS n10, coalesce(n11, 0) AS n11 FROM (SELECT CAST(unnest(range(1, 21)) AS INTEGER) AS k) LEFT JOIN c0 USING (k))"""
_EFFECTS = _CELLS + """, n AS (SELECT *, n00 + n01 + n10 + n11 AS n, CAST(n11 AS DOUBLE) AS e, CAST(n01 AS DOUBLE) AS f, CAST(n10 AS DOUBLE) AS g, CAST(n00 AS DOUBLE) AS h, 1.959963984540054::DOUBLE AS z FROM cells),
w AS (SELECT *, (e + f) / n AS p1, (e + g) / n AS p2, (((e + f) / n + z * z / (2 * n)) - z * sqrt((e + f) / n * (1 - (e + f) / n) / n + z * z / (4.0 * n * n))) / (1 + z * z / n) AS l1, (((e + f) / n + z * z / (2 * n)) + z * sqrt((e + f) / n * (1 - (e + f) / n) / n + z * z / (4.0 * n * n))) / (1 + z * z / n) AS u1,
 (((e + g) / n + z * z / (2 * n)) - z * sqrt((e + g) / n * (1 - (e + g) / n) / n + z * z / (4.0 * n * n))) / (1 + z * z / n) AS l2, (((e + g) / n + z * z / (2 * n)) + z * sqrt((e + g) / n * (1 - (e + g) / n) / n + z * z / (4.0 * n * n))) / (1 + z * z / n) AS u2,
 (e + f) * (g + h) * (e + g) * (f + h) AS m, e * h - f * g AS x FROM n WHERE n > 0),
ph AS (SELECT *, CASE WHEN m = 0 THEN 0 ELSE (CASE WHEN x > 0 THEN greatest(x - n / 2, 0) ELSE x END) / sqrt(greatest(m, 1e-300)) END AS phi FROM w),
r AS (SELECT k, p2 AS p_k, p1 AS p_variants, p1 - p2 AS difference, greatest(-1, p1 - p2 - sqrt(greatest(0, pow(p1 - l1, 2) - 2 * phi * (p1 - l1) * (u2 - p2) + pow(u2 - p2, 2)))) AS lower, least(1, p1 - p2 + sqrt(greatest(0, pow(u1 - p1, 2) - 2 * phi * (u1 - p1) * (p2 - l2) + pow(p2 - l2, 2)))) AS upper FROM ph),
mc AS (SELECT k, n, n01 + n10 AS d, CASE WHEN n = 0 THEN NULL WHEN n01 + n10 = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(CAST(factorial(CAST(n01 + n10 AS INTEGER)) AS DOUBLE) / CAST(factorial(CAST(i AS INTEGER)) AS DOUBLE) / CAST(factorial(CAST(n01 + n10 - i AS INTEGER)) AS DOUBLE)) FROM (SELECT unnest(range(0, least(n01, n10) + 1)) AS i)) / pow(2, n01 + n10)) END AS p_value FROM n),
ho AS (SELECT *, row_number() OVER (ORDER BY coalesce(p_value, 1), k) AS i, count(*) OVER () AS size FROM mc),
h2 AS (SELECT k, CASE WHEN p_value IS NOT NULL THEN least(1.0, max((size - i + 1) * coalesce(p_value, 1)) OVER (ORDER BY i)) END AS holm_p FROM ho)
SELECT mc.k, mc.n, round(p_k, 7) AS p_k, round(p_variants, 7) AS p_variants, round(difference, 7) AS difference, round(lower, 7) AS lower, round(upper, 7) AS upper, round(p_value, 7) AS p_value, round(holm_p, 7) AS holm_p, CASE WHEN mc.n = 0 THEN 'unavailable' WHEN d = 0 THEN 'no_discordance' ELSE 'ok' END AS status FROM mc LEFT JOIN r USING (k) JOIN h2 USING (k)"""


def _settings_effects(settings: str) -> str:
    """The paired effects of each setting and order (``fx``), with exact p (``mc``), from ``_FITS`` on."""
    return _FITS + f""", s AS ({settings}),
e AS (SELECT setting, log, concept, CASE WHEN gof_p >= p_gof THEN 1 ELSE 0 END AS y FROM f, s WHERE fit_valid AND n_fitted >= min_types),
pc AS (SELECT a.setting, CAST(substr(a.concept, 2) AS INTEGER) AS k, {", ".join(f"count(*) FILTER (a.y = {x} AND v.y = {y}) AS n{x}{y}" for x in (0, 1) for y in (0, 1))} FROM e a JOIN e v ON v.setting = a.setting AND v.log = a.log AND v.concept = 'variants' WHERE a.concept <> 'variants' GROUP BY 1, 2),
cells AS (SELECT s.setting, o.k, {", ".join(f"coalesce(n{x}{y}, 0) AS n{x}{y}" for x in (0, 1) for y in (0, 1))} FROM s CROSS JOIN (SELECT CAST(unnest(range(1, 21)) AS INTEGER) AS k) o LEFT JOIN pc ON pc.setting = s.setting AND pc.k = o.k),
n AS (SELECT *, n00 + n01 + n10 + n11 AS n, CAST(n11 AS DOUBLE) AS e, CAST(n01 AS DOUBLE) AS f, CAST(n10 AS DOUBLE) AS g, CAST(n00 AS DOUBLE) AS h, 1.959963984540054::DOUBLE AS z FROM cells),
w0 AS (SELECT *, (e + f) / n AS p1, (e + g) / n AS p2, (e + f) * (g + h) * (e + g) * (f + h) AS m, e * h - f * g AS x FROM n WHERE n > 0),
w AS (SELECT *, ((p1 + z * z / (2 * n)) - z * sqrt(p1 * (1 - p1) / n + z * z / (4.0 * n * n))) / (1 + z * z / n) AS l1, ((p1 + z * z / (2 * n)) + z * sqrt(p1 * (1 - p1) / n + z * z / (4.0 * n * n))) / (1 + z * z / n) AS u1,
 ((p2 + z * z / (2 * n)) - z * sqrt(p2 * (1 - p2) / n + z * z / (4.0 * n * n))) / (1 + z * z / n) AS l2, ((p2 + z * z / (2 * n)) + z * sqrt(p2 * (1 - p2) / n + z * z / (4.0 * n * n))) / (1 + z * z / n) AS u2,
 CASE WHEN m = 0 THEN 0 ELSE (CASE WHEN x > 0 THEN greatest(x - n / 2, 0) ELSE x END) / sqrt(greatest(m, 1e-300)) END AS phi FROM w0),
mc AS (SELECT setting, k, n, n01 + n10 AS d, CASE WHEN n = 0 THEN NULL WHEN n01 + n10 = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(CAST(factorial(CAST(n01 + n10 AS INTEGER)) AS DOUBLE) / CAST(factorial(CAST(i AS INTEGER)) AS DOUBLE) / CAST(factorial(CAST(n01 + n10 - i AS INTEGER)) AS DOUBLE)) FROM (SELECT unnest(range(0, least(n01, n10) + 1)) AS i)) / pow(2, n01 + n10)) END AS p FROM n),
fx AS (SELECT mc.setting, mc.k, mc.n, mc.p, p1 - p2 AS difference, CASE WHEN mc.n > 0 THEN greatest(-1, p1 - p2 - sqrt(greatest(0, pow(p1 - l1, 2) - 2 * phi * (p1 - l1) * (u2 - p2) + pow(u2 - p2, 2)))) END AS lower,
 CASE WHEN mc.n > 0 THEN least(1, p1 - p2 + sqrt(greatest(0, pow(u1 - p1, 2) - 2 * phi * (u1 - p1) * (p2 - l2) + pow(p2 - l2, 2)))) END AS upper FROM mc LEFT JOIN w ON w.setting = mc.setting AND w.k = mc.k)"""


def _holm_sql(name: str, most: int) -> str:
    """Holm's p of each setting's orders up to ``most``: p = 1 stands in for a missing one, which stays missing."""
    return f"""{name} AS (SELECT setting, k, CASE WHEN p IS NOT NULL THEN least(1.0, max((size - i + 1) * coalesce(p, 1)) OVER (PARTITION BY setting ORDER BY i)) END AS holm
 FROM (SELECT *, row_number() OVER (PARTITION BY setting ORDER BY coalesce(p, 1), k) AS i, count(*) OVER (PARTITION BY setting) AS size FROM mc WHERE k <= {most}))"""


def _paper_sql() -> str:
    parts = {"paired_N": "n::DOUBLE", "difference_pp": "100 * difference", "ci95_lower_pp": "100 * lower", "ci95_upper_pp": "100 * upper", "mcnemar_p_raw": "fx.p"} | {f"mcnemar_p_holm_k_le_{m}": f"h{m}.holm" for m in (20, 10, 3)}
    rows = " UNION ALL ".join(f"SELECT '{name}' AS statistic, k, {value} AS value FROM all_" for name, value in ((n, n) for n in parts))
    columns = ", ".join(f"round(max(value) FILTER (k = {k}), 7) AS \"k={k}\"" for k in paired.PAPER_KS)
    return _settings_effects(f"SELECT 'paper' AS setting, {paired.PAPER_MIN_TYPES} AS min_types, 0.10::DOUBLE AS p_gof") + f""",
{", ".join(_holm_sql(f"h{m}", m) for m in (20, 10, 3))},
all_ AS (SELECT fx.k, {", ".join(f"{v} AS {n}" for n, v in parts.items())} FROM fx LEFT JOIN h20 ON h20.k = fx.k LEFT JOIN h10 ON h10.k = fx.k LEFT JOIN h3 ON h3.k = fx.k)
SELECT statistic, {columns} FROM ({rows}) GROUP BY statistic"""


def _sensitivity_paired_sql() -> str:
    sign = lambda c: f"CASE WHEN abs({c}) <= 1e-11 THEN 0 ELSE sign({c}) END"
    return _settings_effects(_SETTINGS) + f""",
{_holm_sql("adjusted", 20)},
j AS (SELECT fx.*, adjusted.holm, b.difference AS base FROM fx JOIN adjusted ON adjusted.setting = fx.setting AND adjusted.k = fx.k LEFT JOIN fx b ON b.setting = 'baseline' AND b.k = fx.k)
SELECT setting, min(n) FILTER (n > 0) AS paired_min, max(n) FILTER (n > 0) AS paired_max, round(100 * min(difference), 7) AS difference_min, round(100 * max(difference), 7) AS difference_max,
 coalesce(string_agg(k::VARCHAR, ', ' ORDER BY k) FILTER (holm < 0.05), '') AS holm_orders, coalesce(string_agg(k::VARCHAR, ', ' ORDER BY k) FILTER ({sign("difference")} * {sign("base")} < 0), '') AS reversed_orders FROM j GROUP BY setting"""


_REASON = "CASE WHEN NOT fit_valid THEN 'invalid_fit' WHEN n_fitted < 50 THEN 'below_min_fitted_types' END"


def _tally_sql(column: str) -> str:
    parts = ", ".join(f"CASE WHEN count(*) FILTER ({column} = '{r}') > 0 THEN concat('{r}=', count(*) FILTER ({column} = '{r}')) END" for r in paired.REASONS)
    return f"coalesce(nullif(concat_ws(', ', {parts}), ''), 'none')"


_AUDIT = _FITS + """, st AS (SELECT m AS min_types, g AS gof FROM (SELECT unnest([15, 30, 50]) AS m), (SELECT unnest([0.05::DOUBLE, 0.10::DOUBLE]) AS g)),
pl AS (SELECT log, c AS concept FROM (SELECT DISTINCT log FROM f), (SELECT unnest(['n1', 'n2', 'n3', 'n4', 'n20', 'variants']) AS c)),
q AS (SELECT min_types, gof, pl.log, pl.concept, n_fitted, gof_p, array_to_string(list_filter([CASE WHEN f.log IS NULL THEN 'missing_result' END,
 CASE WHEN NOT fit_valid THEN 'invalid_fit' END, CASE WHEN n_fitted < min_types THEN 'below_min_fitted_types' END], lambda x: x IS NOT NULL), ';') AS reasons
 FROM pl CROSS JOIN st LEFT JOIN f ON f.log = pl.log AND f.concept = pl.concept),
e AS (SELECT *, CASE WHEN reasons = '' THEN CASE WHEN gof_p >= gof THEN 1 ELSE 0 END END AS outcome, nullif(split_part(reasons, ';', 1), '') AS prime FROM q),
a AS (SELECT x.min_types, x.gof, x.log, CAST(substr(x.concept, 2) AS INTEGER) AS k, x.n_fitted AS n_fitted_k, x.gof_p AS gof_p_k, x.reasons AS reasons_k, x.outcome AS outcome_k, x.prime AS primary_k,
 v.n_fitted AS n_fitted_variants, v.gof_p AS gof_p_variants, v.reasons AS reasons_variants, v.outcome AS outcome_variants, v.prime AS primary_variants
 FROM e x JOIN e v ON v.log = x.log AND v.min_types = x.min_types AND v.gof = x.gof AND v.concept = 'variants' WHERE x.concept <> 'variants')"""


def paired_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = paired.paired_audit(derived_fits(spark, sf_dir))
    rounded = {c: F.round(c, 9) for c in ("gof_p_k", "gof_p_variants")}
    return out.withColumns(rounded).drop("fit_valid_k", "fit_valid_variants", "eligible_k", "eligible_variants", "primary_k", "primary_variants")


def paired_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = paired.paired_grid(paired.paired_audit(derived_fits(spark, sf_dir)))
    return out.select("min_types", "gof", "k", "n_logs", "n_eligible_k", "n_eligible_variants", "n00", "n01", "n10", "n11", "excluded_k", "excluded_variants", "status")


def derived_results(fits: DataFrame) -> DataFrame:
    """Saved results of three xmin settings with clashes, repeats, gaps and foreign xmins, arithmetic on the derived fits."""
    rows = fits.withColumn("x", F.explode(F.array(*(F.struct(F.lit(j).alias("j"), F.lit(s).alias("s")) for j, s in enumerate(("1", "2", "None"))))))
    o, j = F.col("o"), F.col("x.j")
    xmin = F.when(j == 2, 1 + o % 5).when(o % 17 == 0, 3).otherwise(j + 1).cast("double")
    return rows.where((o + j) % 19 != 0).select(
        F.col("x.s").alias("xmin_setting"), "log", "concept", xmin.alias("xmin"), ((F.col("n_fitted") + 13 * j) % 120).alias("n_fitted"), (((o + 7 * j) % 97) / 97.0).alias("gof_p"), "fit_valid",
        F.when(o % 31 == 0, "skipped").otherwise("refit_all_parameters").alias("gof_kind"), ((o + j) % 23 == 0).alias("disagrees"), ((o + j) % 29 == 0).alias("repeated"))


def _settings_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = derived_fits(spark, sf_dir)
    return paired.settings_audit(derived_results(fits), fits.select("log"))


def paired_settings_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every log, order, grid cell and xmin setting with both endpoints' figures and reasons."""
    out = _settings_audit(spark, sf_dir).withColumns({c: F.round(c, 9) for c in ("gof_p_k", "gof_p_variants")} | {c: F.col(c).cast("int") for c in ("fit_valid_k", "fit_valid_variants")})
    return out.select("xmin_setting", "xmin_policy", "source_experiment", "min_types", "gof", "k", "log", *(f"{c}_{s}" for s in ("k", "variants") for c in ("fitted_xmin", "n_fitted", "gof_p", "fit_valid", "gof_kind", "reasons", "outcome")), "included")


def paired_settings_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of each xmin setting, grid cell and order; Holm's family is a cell's orders."""
    out = paired.paired_grid(_settings_audit(spark, sf_dir), ["xmin_setting"])
    return out.select("xmin_setting", "min_types", "gof", "k", "n_logs", "n_eligible_k", "n_eligible_variants", "n00", "n01", "n10", "n11", F.round("difference", 9).alias("difference"), F.round("p_value", 9).alias("p_value"), F.round("holm_p", 9).alias("holm_p"), "excluded_k", "excluded_variants", "status")


_SETTINGS_AUDIT = _FITS + """, rs AS (SELECT CASE j WHEN 0 THEN '1' WHEN 1 THEN '2' ELSE 'None' END AS xmin_setting, log, concept, CASE WHEN j = 2 THEN 1 + o % 5 WHEN o % 17 = 0 THEN 3 ELSE j + 1 END::DOUBLE AS xmin,
 (n_fitted + 13 * j) % 120 AS n_fitted, ((o + 7 * j) % 97)::DOUBLE / 97 AS gof_p, fit_valid, CASE WHEN o % 31 = 0 THEN 'skipped' ELSE 'refit_all_parameters' END AS gof_kind, (o + j) % 23 = 0 AS disagrees, (o + j) % 29 = 0 AS repeated
 FROM f, (SELECT unnest([0, 1, 2]) AS j) WHERE (o + j) % 19 <> 0),
pl AS (SELECT log, concept, xmin_setting, min_types, gof FROM (SELECT DISTINCT log FROM f), (SELECT unnest(['n1', 'n2', 'n3', 'n4', 'n20', 'variants']) AS concept), (SELECT unnest(['1', '2', 'None']) AS xmin_setting), (SELECT unnest([15, 30, 50]) AS min_types), (SELECT unnest([0.05::DOUBLE, 0.10::DOUBLE]) AS gof)),
q0 AS (SELECT pl.*, rs.* EXCLUDE (log, concept, xmin_setting), rs.log IS NULL AS missing, coalesce(disagrees, false) OR coalesce(repeated, false) AS clash FROM pl LEFT JOIN rs ON rs.log = pl.log AND rs.concept = pl.concept AND rs.xmin_setting = pl.xmin_setting),
q AS (SELECT *, array_to_string(list_filter([CASE WHEN repeated THEN 'duplicate_results' END, CASE WHEN disagrees THEN 'incompatible_run_configuration' END,
 CASE WHEN NOT clash AND NOT missing AND xmin_setting <> 'None' AND abs(xmin - TRY_CAST(xmin_setting AS DOUBLE)) > 1e-6 THEN 'incompatible_xmin_configuration' END, CASE WHEN missing THEN 'missing_result' END,
 CASE WHEN NOT clash AND NOT missing AND (NOT fit_valid OR gof_kind = 'skipped') THEN 'invalid_fit' END, CASE WHEN NOT clash AND NOT missing AND n_fitted < min_types THEN 'below_min_fitted_types' END], lambda x: x IS NOT NULL), ';') AS reasons FROM q0),
e AS (SELECT *, CASE WHEN reasons = '' THEN CASE WHEN gof_p >= gof THEN 1 ELSE 0 END END AS outcome, nullif(split_part(reasons, ';', 1), '') AS prime FROM q),
a AS (SELECT x.xmin_setting, CASE WHEN x.xmin_setting = 'None' THEN 'adaptive' ELSE 'fixed' END AS xmin_policy, CASE WHEN x.xmin_setting = 'None' THEN 'xmin-adaptive' ELSE concat('xmin', lpad(x.xmin_setting, 2, '0')) END AS source_experiment, x.min_types, x.gof, CAST(substr(x.concept, 2) AS INTEGER) AS k, x.log,
""" + ", ".join(f"CASE WHEN NOT {t}.clash THEN {t}.{c} END AS {n}_{s}" for t, s in (("x", "k"), ("v", "variants")) for c, n in (("xmin", "fitted_xmin"), ("n_fitted", "n_fitted"), ("gof_p", "gof_p"), ("fit_valid", "fit_valid"), ("gof_kind", "gof_kind"))) + """,
 x.reasons AS reasons_k, x.outcome AS outcome_k, x.prime AS primary_k, v.reasons AS reasons_variants, v.outcome AS outcome_variants, v.prime AS primary_variants, x.outcome IS NOT NULL AND v.outcome IS NOT NULL AS included
 FROM e x JOIN e v ON v.log = x.log AND v.xmin_setting = x.xmin_setting AND v.min_types = x.min_types AND v.gof = x.gof AND v.concept = 'variants' WHERE x.concept <> 'variants')"""
_SETTINGS_GRID = _SETTINGS_AUDIT + ", gr AS (SELECT xmin_setting, min_types, gof, k, count(*) AS n_logs, count(outcome_k) AS n_eligible_k, count(outcome_variants) AS n_eligible_variants, " + ", ".join(f"count(*) FILTER (outcome_k = {x} AND outcome_variants = {y}) AS n{x}{y}" for x in (0, 1) for y in (0, 1)) + f", {_tally_sql('primary_k')} AS excluded_k, {_tally_sql('primary_variants')} AS excluded_variants FROM a GROUP BY 1, 2, 3, 4)" + """,
mp AS (SELECT *, n00 + n01 + n10 + n11 AS n, CASE WHEN n00 + n01 + n10 + n11 = 0 THEN NULL WHEN n01 + n10 = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(CAST(factorial(CAST(n01 + n10 AS INTEGER)) AS DOUBLE) / CAST(factorial(CAST(i AS INTEGER)) AS DOUBLE) / CAST(factorial(CAST(n01 + n10 - i AS INTEGER)) AS DOUBLE)) FROM (SELECT unnest(range(0, least(n01, n10) + 1)) AS i)) / pow(2, n01 + n10)) END AS p FROM gr),
ho AS (SELECT *, row_number() OVER (PARTITION BY xmin_setting, min_types, gof ORDER BY coalesce(p, 1), k) AS i, count(*) OVER (PARTITION BY xmin_setting, min_types, gof) AS size FROM mp)
SELECT xmin_setting, min_types, gof, k, n_logs, n_eligible_k, n_eligible_variants, n00, n01, n10, n11, round(CASE WHEN n > 0 THEN (n01 - n10) / n END, 9) AS difference, round(p, 9) AS p_value,
 round(CASE WHEN p IS NOT NULL THEN least(1.0, max((size - i + 1) * coalesce(p, 1)) OVER (PARTITION BY xmin_setting, min_types, gof ORDER BY i)) END, 9) AS holm_p, excluded_k, excluded_variants,
 CASE WHEN n = 0 THEN 'unavailable' WHEN n01 + n10 = 0 THEN 'no_discordance' ELSE 'ok' END AS status FROM ho"""


def paper_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = derived_fits(spark, sf_dir).withColumn("xmin", F.lit(None).cast("double"))
    effects = paired.paired_effects(paired.paired_cells(paired.endpoints(fits, paired.PAPER_MIN_TYPES), []))
    out = paired.paper_table(effects)
    return out.select("statistic", *(F.round(f"`{c}`", 7).alias(c) for c in out.columns[1:]))


def reason_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired.reason_tally(paired.endpoints(derived_fits(spark, sf_dir)), ["concept"])


def sensitivity_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = derived_fits(spark, sf_dir)
    return sensitivity.category_table(sensitivity.coded(fits, derived_comparisons(fits)))


def sensitivity_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = derived_fits(spark, sf_dir)
    return sensitivity.changed_logs(sensitivity.coded(fits, derived_comparisons(fits)))


def sensitivity_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sensitivity.paired_summary(derived_fits(spark, sf_dir))
    return out.withColumns({c: F.round(c, 7) for c in ("difference_min", "difference_max")})


def _log_frequencies(spark: SparkSession, sf_dir: str, concepts=("variants", "n3"), logs=ALL_LOGS) -> DataFrame:
    """The frequencies of several concepts and logs; each log's traces are built once, and equal ones are one weighted row from then on."""
    variants = stored(reduce(DataFrame.unionByName, [tr.counted(log_traces(spark, sf_dir, log)) for log in logs]), "variants")
    parts = [variants.select("log", F.lit(c).alias("concept"), F.col("seq").alias("node"), F.col("w").alias("freq")) if c == "variants" else tr.counted_frequencies(variants, c) for c in concepts]
    return stored(reduce(DataFrame.unionByName, parts), "frequencies")


def powerlaw_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three models' fits of all logs' variants and triples, over all xmins and heads that may be left out."""
    out = xmin_scan.fits(_log_frequencies(spark, sf_dir), ["log", "concept"])
    digits = {"alpha": 4, "ks": 5, "type_share": 9, "occurrence_share": 9, "log_range": 9}
    return out.where("alpha is not null").withColumns({c: F.round(c, d) for c, d in digits.items()})


FIXED_XMIN = 2


def powerlaw_fixed_xmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximum-likelihood fits of all logs' variants and triples from a fixed xmin, which have SQL."""
    out = xmin_scan.fits(_log_frequencies(spark, sf_dir, ("variants", "n3"), ALL_LOGS), ["log", "concept"], ("lower_bounded_power_law",), FIXED_XMIN)
    return out.where("n_fitted >= 2").select("log", "concept", "n_fitted", F.round("alpha", 4).alias("alpha"), F.round("ks", 4).alias("ks"), "fit_valid")


def _zeta_sql(alpha: str, low: str) -> str:
    """The sum of x^-alpha from ``low`` on: twelve terms, then Euler and Maclaurin's formula."""
    terms = " + ".join(f"pow({low} + {i}, -({alpha}))" for i in range(12))
    a = f"({low} + 12)"
    rest = f"pow({a}, 1 - ({alpha})) / (({alpha}) - 1) + pow({a}, -({alpha})) / 2 + ({alpha}) * pow({a}, -({alpha}) - 1) / 12"
    third = f"({alpha}) * (({alpha}) + 1) * (({alpha}) + 2) * pow({a}, -({alpha}) - 3) / 720"
    fifth = f"({alpha}) * (({alpha}) + 1) * (({alpha}) + 2) * (({alpha}) + 3) * (({alpha}) + 4) * pow({a}, -({alpha}) - 5) / 30240"
    return f"({terms} + {rest} - {third} + {fifth})"


def _fixed_fit_sql(then: str = "") -> str:
    """Ternary search of alpha over the likelihood, then the distance of the two distribution functions; ``then`` goes on from these fits (``fitted``, with their size)."""
    logs = " UNION ALL ".join(f"SELECT '{k}' AS log, seq FROM ({_BASE[k]})" for k in ALL_LOGS)
    cost = lambda a: f"({a}) * total + n * ln({_zeta_sql(a, str(FIXED_XMIN) + '.0')})"
    left, right = "lo + (hi - lo) / 3", "hi - (hi - lo) / 3"
    last = f"""SELECT log, concept, CAST(n AS BIGINT) AS n_fitted, round(alpha, 4) AS alpha, round(CASE WHEN alpha >= 4 THEN 1 - 1 / n ELSE max(apart) END, 4) AS ks, alpha < 4 AS fit_valid
FROM d WHERE n >= 2 GROUP BY log, concept, n, alpha"""
    last = f""",
fitted AS ({last}),
{then}""" if then else f"\n{last}"
    return f"""WITH RECURSIVE t AS ({logs}),
o AS (SELECT log, 'variants' AS concept, seq AS node FROM t WHERE len(seq) > 0 UNION ALL SELECT log, 'n3' AS concept, unnest({_nodes_sql("n3")}) AS node FROM t WHERE len(seq) > 0),
f AS (SELECT log, concept, count(*) AS freq FROM o GROUP BY log, concept, array_to_string(node, '|')),
v AS (SELECT log, concept, CAST(freq AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS c FROM f WHERE freq >= {FIXED_XMIN} GROUP BY 1, 2, 3),
s AS (SELECT log, concept, sum(c) AS n, sum(c * ln(x)) AS total FROM v GROUP BY 1, 2),
b AS (SELECT log, concept, n, total, 1.0::DOUBLE + 1e-9 AS lo, 4.0::DOUBLE AS hi, 0 AS i FROM s
 UNION ALL SELECT log, concept, n, total, CASE WHEN {cost(left)} < {cost(right)} THEN lo ELSE {left} END, CASE WHEN {cost(left)} < {cost(right)} THEN {right} ELSE hi END, i + 1 FROM b WHERE i < 50),
a AS (SELECT log, concept, n, CASE WHEN 4 - (lo + hi) / 2 < 1e-5 THEN 4.0 ELSE (lo + hi) / 2 END AS alpha FROM b WHERE i = 50),
d AS (SELECT log, concept, n, alpha, abs(coalesce(sum(c) OVER (PARTITION BY log, concept ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / n
 - (1 - {_zeta_sql("alpha", "x")} / {_zeta_sql("alpha", str(FIXED_XMIN) + ".0")})) AS apart FROM v JOIN a USING (log, concept)){last}"""


def _sum_sql(alpha: str, low: str, top: str) -> str:
    """The sum of x^-alpha from ``low`` to ``top``, to infinity where that is null."""
    fixes = lambda x: f"({alpha}) * pow({x}, -({alpha}) - 1) / 12 - ({alpha}) * (({alpha}) + 1) * (({alpha}) + 2) * pow({x}, -({alpha}) - 3) / 720 + ({alpha}) * (({alpha}) + 1) * (({alpha}) + 2) * (({alpha}) + 3) * (({alpha}) + 4) * pow({x}, -({alpha}) - 5) / 30240"
    terms = " + ".join(f"CASE WHEN {low} + {i} > {top} THEN 0 ELSE pow({low} + {i}, -({alpha})) END" for i in range(12))
    a = f"({low} + 12)"
    between = f"CASE WHEN abs(({alpha}) - 1) < 1e-9 THEN ln({top}) - ln({a}) ELSE (pow({top}, 1 - ({alpha})) - pow({a}, 1 - ({alpha}))) / (1 - ({alpha})) END"
    return f"""({terms} + CASE WHEN {top} IS NULL THEN pow({a}, 1 - ({alpha})) / (({alpha}) - 1) + pow({a}, -({alpha})) / 2 + {fixes(a)}
 WHEN {a} <= {top} THEN {between} + pow({a}, -({alpha})) / 2 + pow({top}, -({alpha})) / 2 + {fixes(a)} - ({fixes(top)}) ELSE 0 END)"""


def _free_fit_sql() -> str:
    """All candidates of the three models: ternary search of alpha, distances at all values, the least of them."""
    logs = " UNION ALL ".join(f"SELECT '{k}' AS log, seq FROM ({_BASE[k]})" for k in ALL_LOGS)
    cost = lambda a: f"{a} * total + n * ln({_sum_sql(a, 'xmin', 'xmax')})"
    heads = ", ".join(map(str, powerlaw.EXCLUDE_HEAD))
    return f"""WITH RECURSIVE t AS ({logs}),
o AS (SELECT log, 'variants' AS concept, seq AS node FROM t WHERE len(seq) > 0 UNION ALL SELECT log, 'n3' AS concept, unnest({_nodes_sql("n3")}) AS node FROM t WHERE len(seq) > 0),
f AS (SELECT log, concept, count(*) AS freq FROM o GROUP BY log, concept, array_to_string(node, '|')),
v AS (SELECT log, concept, CAST(freq AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS c FROM f GROUP BY 1, 2, 3),
w AS (SELECT *, sum(c) OVER (PARTITION BY log, concept ORDER BY x DESC) AS rank_to, sum(c) OVER (PARTITION BY log, concept) AS types, max(x) OVER (PARTITION BY log, concept) AS largest FROM v),
problems AS (
 SELECT DISTINCT log, concept, 'full_range_power_law' AS model, NULL::DOUBLE AS xmax, NULL::INTEGER AS exclude_k, largest, types FROM w WHERE types >= 2
 UNION ALL SELECT DISTINCT log, concept, 'lower_bounded_power_law', NULL, NULL, largest, types FROM w WHERE types >= 2
 UNION ALL SELECT log, concept, 'doubly_bounded_power_law', x, min(k), x, types FROM w, (SELECT unnest([{heads}]) AS k) WHERE types >= 2 AND k + 1 > rank_to - c AND k + 1 <= rank_to GROUP BY log, concept, x, types),
posed AS (SELECT *, 1.0::DOUBLE AS xmin FROM problems WHERE model = 'full_range_power_law' UNION ALL SELECT p.*, v.x FROM problems p JOIN v USING (log, concept) WHERE model <> 'full_range_power_law' AND v.x < p.largest),
candidates AS (SELECT row_number() OVER () AS id, p.*, s.n, s.total FROM posed p, LATERAL (SELECT sum(c) AS n, sum(c * ln(x)) AS total FROM v WHERE v.log = p.log AND v.concept = p.concept AND v.x >= p.xmin AND v.x <= p.largest) s),
b AS (SELECT id, xmin, xmax, n, total, CASE WHEN xmax IS NULL THEN 1.0 + 1e-9 ELSE 0.0 END::DOUBLE AS lo, 4.0::DOUBLE AS hi, 0 AS i FROM candidates
 UNION ALL SELECT id, xmin, xmax, n, total, CASE WHEN f1 < f2 THEN lo ELSE a1 END, CASE WHEN f1 < f2 THEN a2 ELSE hi END, i + 1
 FROM (SELECT *, {cost("a1")} AS f1, {cost("a2")} AS f2 FROM (SELECT *, lo + (hi - lo) / 3 AS a1, hi - (hi - lo) / 3 AS a2 FROM b WHERE i < 60))),
a AS (SELECT c.*, CASE WHEN 4 - (lo + hi) / 2 < 1e-6 THEN 4.0 WHEN c.xmax IS NOT NULL AND (lo + hi) / 2 < 1e-6 THEN 0.0 ELSE (lo + hi) / 2 END AS alpha FROM b JOIN candidates c USING (id) WHERE i = 60),
d AS (SELECT a.id, max(abs((SELECT coalesce(sum(c), 0) FROM v u WHERE u.log = a.log AND u.concept = a.concept AND u.x >= a.xmin AND u.x < v.x) / a.n
 - (1 - {_sum_sql("a.alpha", "v.x", "a.xmax")} / {_sum_sql("a.alpha", "a.xmin", "a.xmax")}))) AS apart
 FROM a JOIN v ON v.log = a.log AND v.concept = a.concept AND v.x >= a.xmin AND v.x <= a.largest GROUP BY a.id),
scored AS (SELECT a.*, CASE WHEN alpha >= 4 THEN 1 - 1 / n ELSE apart END AS ks FROM a JOIN d USING (id)),
best AS (SELECT *, row_number() OVER (PARTITION BY log, concept, model ORDER BY CASE WHEN ks < 1e-6 THEN 0 ELSE round(ks, 11) END, CASE WHEN coalesce(exclude_k, 0) = 0 THEN 1000000000 ELSE exclude_k END, n DESC) AS place FROM scored),
sizes AS (SELECT b.id, sum(v.c) FILTER (v.x > b.xmax) AS above, max(v.x) FILTER (v.x >= b.xmin AND v.x <= b.largest) AS top, sum(v.x * v.c) FILTER (v.x >= b.xmin AND v.x <= b.largest) / sum(v.x * v.c) AS share
 FROM best b JOIN v ON v.log = b.log AND v.concept = b.concept WHERE place = 1 GROUP BY b.id)
SELECT log, concept, model, xmin, xmax, exclude_k, round(alpha, 4) AS alpha, round(ks, 5) AS ks, CAST(n AS BIGINT) AS n_fitted, CAST(coalesce(above, 0) AS BIGINT) AS excluded, top,
 round(n / types, 9) AS type_share, round(share, 9) AS occurrence_share, round(log10(top / xmin), 9) AS log_range, alpha < 4 AS fit_valid FROM best JOIN sizes USING (id) WHERE place = 1"""


def saved_fit_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The saved fits (exponents as printed, four digits) of all logs against the data, with the place of the largest gap."""
    freqs = _log_frequencies(spark, sf_dir)
    fitted = xmin_scan.fits(freqs, ["log", "concept"], ("lower_bounded_power_law",), FIXED_XMIN).where("fit_valid AND n_fitted >= 2").withColumn("alpha", F.round("alpha", 4))
    out = xmin_scan.saved_fit_curve(freqs, fitted, ["log", "concept"])
    return out.select("log", "concept", "x", *(F.round(c, 9).alias(c) for c in ("p_data", "p_fit", "gap")), "largest")


_CURVE = f"""points AS (SELECT v.log, v.concept, v.x, coalesce(sum(v.c) OVER (PARTITION BY v.log, v.concept ORDER BY v.x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / n_fitted AS p_data,
 1 - {_zeta_sql("fitted.alpha", "v.x")} / {_zeta_sql("fitted.alpha", str(FIXED_XMIN) + ".0")} AS p_fit FROM v JOIN fitted USING (log, concept) WHERE fit_valid)
SELECT log, concept, x, round(p_data, 9) AS p_data, round(p_fit, 9) AS p_fit, round(p_data - p_fit, 9) AS gap, row_number() OVER (PARTITION BY log, concept ORDER BY abs(p_data - p_fit) DESC, x) = 1 AS largest FROM points"""


def powerlaw_gof(spark: SparkSession, sf_dir: str) -> DataFrame:
    freqs = _log_frequencies(spark, sf_dir, ("variants",))
    fits = stored(xmin_scan.fits(freqs, ["log", "concept"], ("lower_bounded_power_law",)), "fits")
    return powerlaw.goodness_of_fit(freqs, fits, ["log", "concept"])


def powerlaw_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    freqs = _log_frequencies(spark, sf_dir)
    return powerlaw.comparisons(freqs, xmin_scan.fits(freqs, ["log", "concept"], ("lower_bounded_power_law",)), ["log", "concept"])


def powerlaw_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain on the logs: fit, bootstrap, comparison, code."""
    freqs = _log_frequencies(spark, sf_dir, ("variants",))
    by = ["log", "concept"]
    fits = stored(xmin_scan.fits(freqs, by, ("lower_bounded_power_law",)), "fits")
    gof = powerlaw.goodness_of_fit(freqs, fits, by)
    return decision.classified(fits.join(gof.drop("model"), by, "left"), powerlaw.comparisons(freqs, fits, by)).select(*by, "n_fitted", "gof_p", "code")


QUERIES = {f.__name__: f for f in (outcome_codes, scaling_table, outcome_counts, best_distributions, comparison_counts, paired_cells, paired_effects, paired_audit, paired_grid, paired_settings_audit, paired_settings_grid, paper_table, reason_tally, sensitivity_categories, sensitivity_changes, sensitivity_paired, powerlaw_fits, powerlaw_fixed_xmin, saved_fit_curve, powerlaw_gof, powerlaw_comparisons, powerlaw_outcomes)}
_V = _coded_sql(_SETTINGS) + ", v AS (SELECT k.setting, k.log, k.code, b.code AS base FROM k JOIN (SELECT log, code FROM k WHERE setting = 'baseline' AND concept = 'variants') b ON b.log = k.log WHERE concept = 'variants')"
SQL = {
    "powerlaw_fixed_xmin": _fixed_fit_sql(),
    "powerlaw_fits": _free_fit_sql(),
    "saved_fit_curve": _fixed_fit_sql(_CURVE),
    "outcome_codes": _coded_sql(_BASE_SETTING) + " SELECT log, concept, code FROM k",
    "scaling_table": _coded_sql(_BASE_SETTING) + " SELECT log, " + ", ".join(f"coalesce(max(code) FILTER (concept = '{s}'), '?') AS {s}" for s in decision.SCALES) + " FROM k GROUP BY log",
    "outcome_counts": _coded_sql(_BASE_SETTING) + " SELECT concept, " + ", ".join(f"count(*) FILTER (code = '{c}') AS {c}" for c in "ABCDE") + ", count(*) AS total FROM k GROUP BY concept",
    "best_distributions": _FITS + " " + _BEST,
    "comparison_counts": _coded_sql(_BASE_SETTING) + " SELECT model_2, count(*) FILTER (p < 0.1 AND R < 0) AS other, count(*) FILTER (p >= 0.1 OR R = 0) AS inconclusive, count(*) FILTER (p < 0.1 AND R > 0) AS power_law FROM u JOIN k USING (log, concept) WHERE concept = 'variants' AND code NOT IN ('A', 'B') GROUP BY 1",
    "paired_cells": _CELLS + " SELECT * FROM cells",
    "paired_effects": _EFFECTS,
    "paper_table": _paper_sql(),
    "paired_settings_audit": _SETTINGS_AUDIT + " SELECT * EXCLUDE (primary_k, primary_variants) REPLACE (round(gof_p_k, 9) AS gof_p_k, round(gof_p_variants, 9) AS gof_p_variants, CAST(fit_valid_k AS INTEGER) AS fit_valid_k, CAST(fit_valid_variants AS INTEGER) AS fit_valid_variants) FROM a",
    "paired_settings_grid": _SETTINGS_GRID,
    "sensitivity_paired": _sensitivity_paired_sql(),
    "reason_tally": _FITS + f", r AS (SELECT concept, {_REASON} AS reason FROM f) SELECT concept, {_tally_sql('reason')} AS tally FROM r GROUP BY 1",
    "paired_audit": _AUDIT + " SELECT min_types, gof, log, k, n_fitted_k, round(gof_p_k, 9) AS gof_p_k, reasons_k, outcome_k, n_fitted_variants, round(gof_p_variants, 9) AS gof_p_variants, reasons_variants, outcome_variants, outcome_k IS NOT NULL AND outcome_variants IS NOT NULL AS included FROM a",
    "paired_grid": _AUDIT + ", gr AS (SELECT min_types, gof, k, count(*) AS n_logs, count(outcome_k) AS n_eligible_k, count(outcome_variants) AS n_eligible_variants, " + ", ".join(f"count(*) FILTER (outcome_k = {x} AND outcome_variants = {y}) AS n{x}{y}" for x in (0, 1) for y in (0, 1)) + f", {_tally_sql('primary_k')} AS excluded_k, {_tally_sql('primary_variants')} AS excluded_variants FROM a GROUP BY 1, 2, 3) SELECT *, CASE WHEN n00 + n01 + n10 + n11 = 0 THEN 'unavailable' WHEN n01 + n10 = 0 THEN 'no_discordance' ELSE 'ok' END AS status FROM gr",
    "sensitivity_categories": _V + " SELECT setting, " + ", ".join(f"count(*) FILTER (code = '{c}') AS {c}" for c in "ABCDE") + ", count(*) FILTER (code <> 'A') AS eligible, count(*) FILTER (code NOT IN ('A', 'B')) AS not_rejected, count(*) FILTER (code <> base) AS changed FROM v GROUP BY setting",
    "sensitivity_changes": _V + " SELECT setting, coalesce(string_agg(log, ', ' ORDER BY log) FILTER (base = 'A' AND code <> 'A'), '') AS added, coalesce(string_agg(log, ', ' ORDER BY log) FILTER (base <> 'A' AND code = 'A'), '') AS removed, coalesce(string_agg(concat(log, ':', base, '>', code), ', ' ORDER BY log) FILTER (base <> code), '') AS transitions FROM v WHERE setting <> 'baseline' GROUP BY setting",
}
