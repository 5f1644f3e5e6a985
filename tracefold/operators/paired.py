"""Paired comparison of outcomes at order k and at variants: cells, McNemar, Newcombe's interval, Holm; all Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.959963984540054
# Exclusion reasons by priority; an endpoint's first one is its primary reason.
REASONS = (
    "duplicate_results",
    "incompatible_run_configuration",
    "incompatible_xmin_configuration",
    "missing_result",
    "invalid_fit",
    "n_fitted_types_missing",
    "below_min_fitted_types",
    "gof_p_out_of_range",
    "gof_p_unavailable",
)
# The planned orders of the comparison and of the paper's table, and the thresholds of the grid.
COMPARISON_KS = (1, 2, 3, 4, 20)
PAPER_KS = tuple(range(1, 21))
MIN_TYPES_GRID = (15, 30, 50)
# The xmin settings of the study (None: adaptive), and the kinds of saved results that have no bootstrap.
XMIN_SETTINGS = (1, 2, None)
SKIPPED_KINDS = ("skipped_invalid_fit", "skipped")
GOF_GRID = (0.05, 0.10)


def wilson(successes: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    p, zz = successes / n, z * z
    centre = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return centre - half, centre + half


def newcombe(e: Column, f: Column, g: Column, h: Column, z: float = Z) -> tuple[Column, Column]:
    """Method 10 for p_first - p_second from cells both, first only, second only, neither."""
    e, f, g, h = (c.cast("double") for c in (e, f, g, h))
    n = e + f + g + h
    (l1, u1), (l2, u2), p1, p2 = wilson(e + f, n, z), wilson(e + g, n, z), (e + f) / n, (e + g) / n
    margins = (e + f) * (g + h) * (e + g) * (f + h)
    cross = e * h - f * g
    corrected = F.when(cross > 0, F.greatest(cross - n / 2, F.lit(0.0))).otherwise(cross)
    phi = F.when(margins == 0, 0.0).otherwise(corrected / F.sqrt(F.greatest(margins, F.lit(1e-300))))
    width = lambda a, b: F.sqrt(F.greatest(a * a - 2 * phi * a * b + b * b, F.lit(0.0)))
    limit = lambda x: F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0))
    return limit(p1 - p2 - width(p1 - l1, u2 - p2)), limit(p1 - p2 + width(u1 - p1, p2 - l2))


def mcnemar(n01: Column, n10: Column) -> Column:
    """Two-sided exact test; without discordant pairs 1. Binomial coefficients grow term by term."""
    n, low = (n01 + n10).cast("int"), F.least(n01, n10).cast("int")
    zero = F.struct(F.lit(1.0).alias("c"), F.lit(1.0).alias("s"))
    step = lambda a, i: F.struct((a["c"] * (n - i + 1) / i).alias("c"), (a["s"] + a["c"] * (n - i + 1) / i).alias("s"))
    terms = F.when(low >= 1, F.sequence(F.lit(1), F.greatest(low, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(terms, zero, step, lambda a: a["s"]) / F.pow(F.lit(2.0), n)))


def holm(df: DataFrame, p: str, family: list[str], order: str, name: str = "holm_p") -> DataFrame:
    """Step-down adjusted p within each planned family; a missing p holds its place as 1 and stays missing."""
    filled = F.coalesce(p, F.lit(1.0))
    by_p = Window.partitionBy(*family).orderBy(filled, order)
    at, size = F.row_number().over(by_p), F.count("*").over(Window.partitionBy(*family))
    ranked = df.withColumn("_step", (size - at + 1) * filled)
    upto = F.max("_step").over(by_p.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn(name, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), upto))).drop("_step")


def planned(fits: DataFrame, by: list[str], ks: Sequence[int] = PAPER_KS) -> DataFrame:
    """A row for each log of ``fits`` and each planned concept; ``missing`` marks those that ``fits`` has no row for."""
    concepts = F.array(*(F.lit(f"n{k}") for k in ks), F.lit("variants"))
    wanted = fits.select(*by, "log").distinct().withColumn("concept", F.explode(concepts))
    found = fits.withColumn("_found", F.lit(True))
    return wanted.join(found, [*by, "log", "concept"], "left").withColumn("missing", F.col("_found").isNull()).drop("_found")


def endpoints(fits: DataFrame, min_types: Column | int = 50, gof: Column | float = 0.1, fixed_xmin: Column | float | None = None) -> DataFrame:
    """``reasons, eligible, outcome`` (1: not rejected) of each ``log, concept`` row; optional columns ``disagrees, repeated, missing, gof_kind``."""
    has = fits.columns
    no = F.lit(False)
    disagrees = F.coalesce("disagrees", no) if "disagrees" in has else no
    repeated = F.coalesce("repeated", no) if "repeated" in has else no
    missing = F.coalesce("missing", no) if "missing" in has else no
    clash = disagrees | repeated | missing
    p = F.col("gof_p")
    flags = {
        "duplicate_results": repeated, "incompatible_run_configuration": disagrees, "missing_result": missing & ~disagrees & ~repeated,
        "incompatible_xmin_configuration": no if fixed_xmin is None else ~clash & ((F.abs(F.col("xmin") - fixed_xmin) > 1e-6) | (F.coalesce("fit_valid", no) & F.col("xmin").isNull())),
        "invalid_fit": ~clash & (~F.coalesce("fit_valid", no) | (F.coalesce(F.col("gof_kind").isin(*SKIPPED_KINDS), no) if "gof_kind" in has else no)), "n_fitted_types_missing": ~clash & F.col("n_fitted").isNull(), "below_min_fitted_types": ~clash & (F.col("n_fitted") < min_types),
        "gof_p_out_of_range": ~clash & ((p < 0) | (p > 1)), "gof_p_unavailable": ~clash & (p.isNull() | F.isnan(p))}
    reasons = F.array_compact(F.array(*(F.when(F.coalesce(flags[r], no), r) for r in REASONS if r in flags)))
    out = fits.withColumn("reasons", reasons).withColumn("eligible", F.size("reasons") == 0)
    return out.withColumn("outcome", F.when(F.col("eligible"), (p >= gof).cast("int")))


def settings_audit(results: DataFrame, logs: DataFrame, settings: Sequence[int | None] = XMIN_SETTINGS, ks: Sequence[int] = COMPARISON_KS, min_types: Sequence[int] = MIN_TYPES_GRID, gofs: Sequence[float] = GOF_GRID) -> DataFrame:
    """The audit over all xmin settings: a row for each setting, grid cell, planned k and log of the study, also where no result is saved.

    ``results``: one row for each ``xmin_setting`` (text, ``None`` for the adaptive one), ``log`` and ``concept``, as ``runs.reconciled`` gives it; the folder of a setting says how it
    was run, whatever xmin came out of it. ``logs``: the study's logs.
    """
    names = F.array(*(F.lit("None" if s is None else str(s)) for s in settings))
    grid = F.array(*(F.struct(F.lit(m).alias("min_types"), F.lit(g).alias("gof")) for m in min_types for g in gofs))
    concepts = F.array(*(F.lit(f"n{k}") for k in ks), F.lit("variants"))
    wanted = logs.select("log").distinct().withColumn("xmin_setting", F.explode(names)).withColumn("concept", F.explode(concepts))
    rows = wanted.join(results.withColumn("_found", F.lit(True)), ["xmin_setting", "log", "concept"], "left")
    rows = rows.withColumn("missing", F.col("_found").isNull()).drop("_found").withColumn("s", F.explode(grid)).select("*", "s.*").drop("s")
    locked = F.col("xmin_setting").try_cast("double")
    rows = endpoints(rows, F.col("min_types"), F.col("gof"), locked)
    setting = ["xmin_setting", "min_types", "gof", "log"]
    clash = F.coalesce("disagrees", F.lit(False)) | F.coalesce("repeated", F.lit(False))
    shown = {"xmin": "fitted_xmin", "n_fitted": "n_fitted", "gof_p": "gof_p", "fit_valid": "fit_valid", "gof_kind": "gof_kind", "input_path": "input_path"}

    def side(df: DataFrame, suffix: str, *more: str) -> DataFrame:
        figures = [F.when(~clash, F.col(c)).alias(f"{name}_{suffix}") for c, name in shown.items() if c in df.columns]
        first = F.when(F.size("reasons") > 0, F.element_at("reasons", 1))
        return df.select(*setting, *more, *figures, F.col("eligible").alias(f"eligible_{suffix}"), F.col("outcome").alias(f"outcome_{suffix}"), F.array_join("reasons", ";").alias(f"reasons_{suffix}"), first.alias(f"primary_{suffix}"))

    orders = rows.where(F.col("concept") != "variants").withColumn("k", F.substring("concept", 2, 9).cast("int"))
    both = side(orders, "k", "k").join(side(rows.where(F.col("concept") == "variants"), "variants"), setting)
    policy = F.when(F.col("xmin_setting") == "None", "adaptive").otherwise("fixed")
    folder = F.when(F.col("xmin_setting") == "None", "xmin-adaptive").otherwise(F.concat(F.lit("xmin"), F.lpad("xmin_setting", 2, "0")))
    return both.withColumns({"included": F.col("eligible_k") & F.col("eligible_variants"), "xmin_policy": policy, "source_experiment": folder})


def paired_cells(assessed: DataFrame, by: list[str], ks: Sequence[int] = PAPER_KS) -> DataFrame:
    """``by, k, n00, n01, n10, n11``: logs eligible at both ends; the first digit is the outcome at k, the second at variants.

    Every planned ``k`` has a row, also without an eligible log, so that Holm's family keeps its size.
    """
    side = lambda cond, name: assessed.where(cond).select(*by, "log", "concept", F.col("outcome").alias(name))
    k_side = side(F.col("eligible") & F.col("concept").rlike("^n[0-9]+$"), "at_k").withColumn("k", F.substring("concept", 2, 9).cast("int")).drop("concept")
    v_side = side(F.col("eligible") & (F.col("concept") == "variants"), "at_v").drop("concept")
    both = k_side.join(v_side, [*by, "log"], "left")
    cell = lambda a, b: F.count_if((F.col("at_k") == a) & (F.col("at_v") == b)).alias(f"n{a}{b}")
    cells = both.groupBy(*by, "k").agg(cell(0, 0), cell(0, 1), cell(1, 0), cell(1, 1))
    groups = assessed.select(*by).distinct() if by else assessed.sparkSession.range(1).select()
    wanted = groups.withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks))))
    return wanted.join(cells, [*by, "k"], "left").na.fill(0, ["n00", "n01", "n10", "n11"])


def paired_audit(fits: DataFrame, ks: Sequence[int] = COMPARISON_KS, min_types: Sequence[int] = MIN_TYPES_GRID, gofs: Sequence[float] = GOF_GRID, fixed_xmin: float | None = None) -> DataFrame:
    """A row for each setting of the grid, planned k and log: both endpoints' figures, reasons and outcomes, and whether the pair counts."""
    grid = F.array(*(F.struct(F.lit(m).alias("min_types"), F.lit(g).alias("gof")) for m in min_types for g in gofs))
    rows = planned(fits, [], ks).withColumn("s", F.explode(grid)).select("*", "s.*").drop("s")
    rows = endpoints(rows, F.col("min_types"), F.col("gof"), fixed_xmin)
    setting = ["min_types", "gof", "log"]

    def side(df: DataFrame, suffix: str, *more: str) -> DataFrame:
        first = F.when(F.size("reasons") > 0, F.element_at("reasons", 1))
        figures = [F.col(c).alias(f"{c}_{suffix}") for c in ("n_fitted", "gof_p", "fit_valid", "eligible", "outcome")]
        return df.select(*setting, *more, *figures, F.array_join("reasons", ";").alias(f"reasons_{suffix}"), first.alias(f"primary_{suffix}"))

    orders = rows.where(F.col("concept") != "variants").withColumn("k", F.substring("concept", 2, 9).cast("int"))
    both = side(orders, "k", "k").join(side(rows.where(F.col("concept") == "variants"), "variants"), setting)
    return both.withColumn("included", F.col("eligible_k") & F.col("eligible_variants"))


def paired_grid(audit: DataFrame, axes: Sequence[str] = ()) -> DataFrame:
    """The summary of an audit: per setting (``axes``, least types, threshold) and k the eligible logs, cells, effects, Holm's p within the setting, and tallies of primary reasons."""
    by = [*axes, "min_types", "gof", "k"]
    cell = lambda a, b: F.count_if(F.col("included") & (F.col("outcome_k") == a) & (F.col("outcome_variants") == b)).alias(f"n{a}{b}")
    cells = audit.groupBy(*by).agg(
        F.count("*").alias("n_logs"), F.count_if("eligible_k").alias("n_eligible_k"), F.count_if("eligible_variants").alias("n_eligible_variants"),
        cell(0, 0), cell(0, 1), cell(1, 0), cell(1, 1),
        _tallied("primary_k").alias("excluded_k"), _tallied("primary_variants").alias("excluded_variants"))
    return holm(paired_effects(cells), "p_value", [*axes, "min_types", "gof"], "k")


# The published table's rows and its least number of fitted types.
PAPER_ROWS = (
    "paired_N",
    "difference_pp",
    "ci95_lower_pp",
    "ci95_upper_pp",
    "mcnemar_p_raw",
    "mcnemar_p_holm_k_le_20",
    "mcnemar_p_holm_k_le_10",
    "mcnemar_p_holm_k_le_3",
)
PAPER_MIN_TYPES = 30


def _tallied(reason: str) -> Column:
    """``reason=count`` of the rows' reasons by priority, or ``none``."""
    shown = [F.when(F.count_if(F.col(reason) == r) > 0, F.concat(F.lit(f"{r}="), F.count_if(F.col(reason) == r).cast("string"))) for r in REASONS]
    return F.coalesce(F.nullif(F.concat_ws(", ", *shown), F.lit("")), F.lit("none"))


def paired_effects(cells: DataFrame) -> DataFrame:
    """Proportions, variants minus k difference with interval, exact p; NULL where no log is paired."""
    n = F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11")
    lower, upper = newcombe(F.col("n11"), F.col("n01"), F.col("n10"), F.col("n00"))
    some = lambda c: F.when(n > 0, c)
    status = F.when(n == 0, "unavailable").when(F.col("n01") + F.col("n10") == 0, "no_discordance").otherwise("ok")
    return cells.withColumns({"n": n, "p_k": some((F.col("n10") + F.col("n11")) / n), "p_variants": some((F.col("n01") + F.col("n11")) / n), "difference": some((F.col("n01") - F.col("n10")) / n), "lower": some(lower), "upper": some(upper), "p_value": some(mcnemar(F.col("n01"), F.col("n10"))), "status": status})


def paper_table(effects: DataFrame) -> DataFrame:
    """The published table of the orders 1 to 20 against variants: a row a statistic, a column an order, in percentage points where it says so.

    Each of Holm's rows is a family of its own, made anew from the raw p of its orders; an order without pairs counts in it with p = 1 and stays blank.
    """
    base = effects.select("k", F.col("n").cast("double").alias("paired_N"), *((100 * F.col(c)).alias(name) for c, name in zip(("difference", "lower", "upper"), PAPER_ROWS[1:4], strict=True)), F.col("p_value").alias("mcnemar_p_raw"))
    for name in PAPER_ROWS[5:]:
        family = base.where(F.col("k") <= int(name.rpartition("_")[2])).select("k", "mcnemar_p_raw", F.lit(0).alias("family"))
        base = base.join(holm(family, "mcnemar_p_raw", ["family"], "k", name).select("k", name), "k", "left")
    rows = base.select("k", F.posexplode(F.array(*(F.struct(F.lit(c).alias("statistic"), F.col(c).alias("value")) for c in PAPER_ROWS))).alias("place", "r")).select("k", "place", "r.*")
    wide = rows.groupBy("place", "statistic").pivot("k", list(PAPER_KS)).agg(F.first("value")).orderBy("place")
    return wide.select("statistic", *(F.col(f"`{k}`").alias(f"k={k}") for k in PAPER_KS))


def violations(grid: DataFrame, audit: DataFrame) -> DataFrame:
    """``rule, min_types, gof, k``: rows of a grid that break an identity, alone, against the grid's other rows, or against the audit. None if all is well.

    Holm's p is made anew from the raw p of the family; swapping the endpoints must mirror the interval; raising the least number of types can't
    make more logs eligible, and the goodness-of-fit threshold can't change who is eligible.
    """
    key = ["min_types", "gof", "k"]
    n = F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11")
    near = lambda a, b: F.coalesce(F.abs(a - b) <= 1e-9, a.isNull() & b.isNull())
    lower, upper = newcombe(F.col("n11"), F.col("n01"), F.col("n10"), F.col("n00"))
    swapped_lower, swapped_upper = newcombe(F.col("n11"), F.col("n10"), F.col("n01"), F.col("n00"))
    some = n > 0
    result = ["p_k", "p_variants", "difference", "lower", "upper", "p_value"]
    empty = F.lit(True)
    for c in result:
        empty = empty & F.col(c).isNull()
    again = holm(grid.drop("holm_p"), "p_value", ["min_types", "gof"], "k", "holm_again").select(*key, "holm_again")
    wider = Window.partitionBy("gof", "k").orderBy("min_types")
    others = Window.partitionBy("min_types", "k")
    rows = grid.join(again, key)
    grows, moves = F.lit(False), F.lit(False)
    for c in ("n", "n_eligible_k", "n_eligible_variants"):
        rows = rows.withColumns({f"_before_{c}": F.lag(c).over(wider), f"_least_{c}": F.min(c).over(others), f"_most_{c}": F.max(c).over(others)})
        grows = grows | F.coalesce(F.col(c) > F.col(f"_before_{c}"), F.lit(False))
        moves = moves | (F.col(f"_least_{c}") != F.col(f"_most_{c}"))
    rules = {
        "cells do not sum to n": F.col("n") != n,
        "figures without pairs": ~some & (~empty | (F.col("status") != "unavailable")),
        "difference": some & ~(near(F.col("difference"), (F.col("n01") - F.col("n10")) / n) & near(F.col("difference"), F.col("p_variants") - F.col("p_k"))),
        "interval": some & ~(near(F.col("lower"), lower) & near(F.col("upper"), upper) & near(swapped_lower, -upper) & near(swapped_upper, -lower)),
        "exact p": some & ~near(F.col("p_value"), mcnemar(F.col("n01"), F.col("n10"))),
        "no discordance": some & (F.col("n01") + F.col("n10") == 0) & ((F.col("status") != "no_discordance") | (F.col("p_value") != 1)),
        "adjusted p": ~near(F.col("holm_p"), F.col("holm_again")),
        "more eligible by a higher bound": grows,
        "threshold changes eligibility": moves,
    }
    found = rows.withColumn("rule", F.explode(F.array_compact(F.array(*(F.when(cond, name) for name, cond in rules.items())))))
    counted = audit.groupBy(*key).agg(
        F.count("*").alias("a_logs"), F.count_if("included").alias("a_n"), F.count_if("eligible_k").alias("a_k"), F.count_if("eligible_variants").alias("a_v"),
        F.count_if(F.col("included") != (F.col("eligible_k") & F.col("eligible_variants"))).alias("a_odd"))
    same = (F.col("a_logs") == F.col("n_logs")) & (F.col("a_n") == F.col("n")) & (F.col("a_k") == F.col("n_eligible_k")) & (F.col("a_v") == F.col("n_eligible_variants")) & (F.col("a_odd") == 0)
    unlike = grid.join(counted, key, "full").where(~F.coalesce(same, F.lit(False)))
    return found.select("rule", *key).unionByName(unlike.select(F.lit("audit and summary differ").alias("rule"), *key))


def reason_tally(assessed: DataFrame, by: list[str]) -> DataFrame:
    """``tally``: excluded endpoints by their primary reason, as ``reason=count`` text by priority; ``none`` where all are eligible."""
    primary = F.when(F.size("reasons") > 0, F.element_at("reasons", 1))
    return assessed.withColumn("_primary", primary).groupBy(*by).agg(_tallied("_primary").alias("tally"))
