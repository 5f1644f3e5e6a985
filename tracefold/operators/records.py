"""One run over many units: fits, bootstrap, comparisons and the summary record of each unit and model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.functions.storage import stored
from tracefold.functions.text import error_class
from tracefold.operators import decision, frequency, powerlaw, xmin_scan

# How a unit's goodness of fit came about.
REFITTED, SKIPPED = "refit_all_parameters", "skipped_invalid_fit"
#: Fields that an invalid fit leaves blank in the summary, but not in the goodness-of-fit rows.
INFERRED = ("alpha", "ks", "gof_p", "n_success", "n_failed", "best_other")


def gof_rows(fits: DataFrame, gof: DataFrame, by: list[str]) -> DataFrame:
    """A row for each unit and model: the fit with its bootstrap; invalid fits have no p and no replicates, and say so."""
    valid = F.coalesce("fit_valid", F.lit(False))
    joined = fits.join(gof, [*by, "model"], "left")
    return joined.withColumns({
        "gof_p": F.when(valid, F.col("gof_p")), "n_success": F.when(valid, F.col("n_success")).otherwise(0), "n_failed": F.when(valid, F.col("n_failed")).otherwise(0),
        "alpha_at_boundary": F.col("alpha") >= powerlaw.ALPHA_MAX - powerlaw.BOUNDARY, "fit_valid": valid, "gof_kind": F.when(valid, REFITTED).otherwise(SKIPPED)})


def best_other(comparisons: DataFrame, by: list[str]) -> DataFrame:
    """``by, model, best_other``: the counted alternative of least R."""
    return decision.usable(comparisons).groupBy(*by, "model").agg(F.min(F.struct("R", "model_2"))["model_2"].alias("best_other"))


def summaries(freqs: DataFrame, rows: DataFrame, comparisons: DataFrame, by: list[str], min_types: int = 50, significance: float = 0.1) -> DataFrame:
    """The compact record of each unit and model: sizes, bounds, fit, p, code. An invalid fit's inferred fields are blank, so that they don't look like results."""
    described = frequency.describe(freqs, by)
    prefer = decision.preferences(comparisons, [*by, "model"], significance)
    joined = rows.join(described, by, "left").join(best_other(comparisons, by), [*by, "model"], "left").join(prefer, [*by, "model"], "left")
    coded = decision.code(F.col("n_fitted"), F.col("gof_p"), F.col("fit_valid"), F.coalesce("preference", F.lit("inconclusive")), min_types, significance)
    out = joined.withColumn("code", coded).drop("preference", "alpha_at_boundary")
    return out.withColumns({c: F.when(F.col("fit_valid"), F.col(c)) for c in INFERRED})


def checked(freqs: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Frequencies of sound units, and ``by, message`` for units with a frequency that isn't a positive whole number."""
    number = F.col("freq").cast("double")
    sound = F.coalesce(~F.isnan(number) & (number > 0) & (number < float("inf")) & (F.abs(number - F.rint(number)) <= 1e-8 + 1e-5 * number), F.lit(False))
    units = freqs.groupBy(*by).agg(F.bool_and(sound).alias("sound"))
    bad = units.where(~F.col("sound")).select(*by, F.lit("frequencies must be positive whole numbers").alias("message"))
    return freqs.join(units.where("sound").select(*by), by, "left_semi"), bad


def run(freqs: DataFrame, by: list[str], models: tuple[str, ...] = powerlaw.MODELS, replicates: int = 1000, min_types: int = 50, significance: float = 0.1, fixed_xmin: int | None = None) -> dict[str, DataFrame]:
    """``gof``, ``comparisons`` and ``summary`` of all units and models. A unit that can't be worked on has a summary row with an error class and nothing else."""
    good, bad = checked(freqs, by)
    fits = stored(xmin_scan.fits(good, by, models, fixed_xmin), "run-fits")
    gof = stored(powerlaw.goodness_of_fit(good, fits, by, replicates, fixed_xmin=fixed_xmin), "run-gof")
    comparisons = stored(powerlaw.comparisons(good, fits, by, significance), "run-comparisons")
    rows = gof_rows(fits, gof, by)
    summary = summaries(good, rows, comparisons, by, min_types, significance).withColumn("error", F.lit(None).cast("string"))
    failed = bad.withColumn("model", F.explode(F.array(*(F.lit(m) for m in models)))).select(*by, "model", F.lit("A").alias("code"), error_class(F.col("message")).alias("error"))
    return {"gof": rows, "comparisons": comparisons, "summary": summary.unionByName(failed, allowMissingColumns=True)}
