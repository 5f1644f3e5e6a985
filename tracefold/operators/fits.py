"""Curve fits of rank-frequency curves and their negative log-likelihoods, all as aggregates over points ``by, rank, freq``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions.storage import stored

MODELS = ("linear", "exponential", "power_law", "bounded_power_law")
TINY = 1e-12


def coefficients(points: DataFrame, by: list[str], bounded_min: int = 2) -> DataFrame:
    """Least squares: linear in (x, y), exponential in (x, ln y), power law in (ln x, ln y) over all points and over ``freq >= bounded_min``."""
    x, y = F.col("rank").cast("double"), F.col("freq").cast("double")
    upper = F.col("freq") >= bounded_min
    enough = lambda value, cond=F.lit(True): F.when(F.count_if(cond) >= 2, value)
    in_bound = lambda c: F.when(upper, c)
    return points.groupBy(*by).agg(
        F.regr_slope(y, x).alias("lin_a"), F.regr_intercept(y, x).alias("lin_b"),
        enough(F.exp(F.regr_intercept(F.ln(y), x))).alias("exp_c"), enough(F.regr_slope(F.ln(y), x)).alias("exp_r"),
        enough(F.exp(F.regr_intercept(F.ln(y), F.ln(x)))).alias("pl_c"), enough(-F.regr_slope(F.ln(y), F.ln(x))).alias("pl_alpha"),
        enough(F.exp(F.regr_intercept(in_bound(F.ln(y)), in_bound(F.ln(x)))), upper).alias("bpl_c"), enough(-F.regr_slope(in_bound(F.ln(y)), in_bound(F.ln(x))), upper).alias("bpl_alpha"))


def predictions() -> dict[str, Column]:
    x = F.col("rank").cast("double")
    return {"linear": F.col("lin_a") * x + F.col("lin_b"), "exponential": F.col("exp_c") * F.exp(F.col("exp_r") * x), "power_law": F.col("pl_c") * F.pow(x, -F.col("pl_alpha")), "bounded_power_law": F.col("bpl_c") * F.pow(x, -F.col("bpl_alpha"))}


def curve_fits(points: DataFrame, by: list[str], bounded_min: int = 2) -> DataFrame:
    """Coefficients, ``nll_<model>`` on all points, and ``best_fit`` (least finite; ties in the order of ``MODELS``).

    A model's probabilities are its predictions, at least ``TINY``, over their sum; the sum is a second aggregate joined by ``by``.
    """
    points = stored(points.select(*by, "rank", "freq"), "curve-points")  # read three times
    fits = coefficients(points, by, bounded_min)
    rows = points.join(fits, by)
    shown = {m: F.when(p.isNotNull() & ~F.isnan(p), F.greatest(p, F.lit(TINY))) for m, p in predictions().items()}
    totals = rows.groupBy(*by).agg(*(F.sum(p).alias(f"sum_{m}") for m, p in shown.items()))
    f = F.col("freq").cast("double")
    scored = rows.join(totals, by).groupBy(*by).agg(*((-F.sum(f * F.ln(shown[m] / F.col(f"sum_{m}") + TINY))).alias(f"nll_{m}") for m in MODELS))
    best = F.array_min(F.array(*(F.when(F.col(f"nll_{m}").isNotNull() & (F.abs(F.col(f"nll_{m}")) < float("inf")), F.struct(F.col(f"nll_{m}").alias("v"), F.lit(i).alias("i"), F.lit(m).alias("m"))) for i, m in enumerate(MODELS))))
    return fits.join(scored, by).withColumn("best_fit", best["m"])
