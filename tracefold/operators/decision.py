"""From fits and comparisons to outcomes A-E and the tables over logs and orders. Rows in, rows out; nothing here leaves the JVM.

Fits have ``log, concept, n_fitted, gof_p, fit_valid`` (and more), comparisons ``log, concept, model_2, R, p``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COUNTED = ("exponential", "lognormal", "stretched_exponential")
CODES = ("A", "B", "C", "D", "E")
SCALES = (*(f"n{i}" for i in range(1, 21)), "variants")


def usable(comparisons: DataFrame) -> DataFrame:
    """Finite rows of the counted alternatives (the truncated power law never counts)."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return comparisons.where(finite("R") & finite("p") & F.col("model_2").isin(*COUNTED))


def preferences(comparisons: DataFrame, by: list[str], significance: float | Column = 0.1) -> DataFrame:
    """``preference``: alternative if any is significantly better, power_law if all three are significantly worse, else inconclusive."""
    sure = F.col("p") < significance
    rows = usable(comparisons).groupBy(*by).agg(F.bool_or(sure & (F.col("R") < 0)).alias("lost"), (F.bool_and(sure & (F.col("R") > 0)) & (F.count_distinct("model_2") == len(COUNTED))).alias("won"))
    return rows.select(*by, F.when(F.col("lost"), "alternative").when(F.col("won"), "power_law").otherwise("inconclusive").alias("preference"))


def best_distributions(comparisons: DataFrame, by: list[str], significance: float = 0.1) -> DataFrame:
    """``best, best_R, best_p, significant``: power_law if all three R are positive, else the alternative of least R (also when that is positive).

    The power law isn't compared with itself, so it has no R and p; it is significant if all three comparisons are.
    """
    rows = usable(comparisons).groupBy(*by).agg(
        F.bool_and(F.col("R") > 0).alias("won"), F.count_distinct("model_2").alias("k"),
        F.min(F.struct("R", "model_2", "p")).alias("least"), F.bool_and(F.col("p") < significance).alias("sure"))
    all_three = F.col("won") & (F.col("k") == len(COUNTED))
    other = lambda c: F.when(~all_three, F.col(f"least.{c}"))
    significant = F.when(all_three, F.col("sure")).otherwise(F.col("least.p") < significance)
    return rows.select(*by, F.when(all_three, "power_law").otherwise(F.col("least.model_2")).alias("best"), other("R").alias("best_R"), other("p").alias("best_p"), significant.alias("significant"))


def code(n_fitted: Column, gof_p: Column, fit_valid: Column, preference: Column, min_types: Column | int = 50, gof: Column | float = 0.1) -> Column:
    """A: no sound fit; B: rejected; C: an alternative is better; D: the power law is better; E: inconclusive."""
    weak = ~F.coalesce(fit_valid, F.lit(True)) | (F.coalesce(n_fitted, F.lit(0)) < min_types) | gof_p.isNull() | F.isnan(gof_p)
    return F.when(weak, "A").when(gof_p < gof, "B").when(preference == "alternative", "C").when(preference == "power_law", "D").otherwise("E")


def classified(fits: DataFrame, comparisons: DataFrame, min_types: int = 50, gof: float = 0.1, significance: float = 0.1) -> DataFrame:
    prefer = preferences(comparisons, ["log", "concept"], significance)
    joined = fits.join(prefer, ["log", "concept"], "left")
    return joined.withColumn("code", code(F.col("n_fitted"), F.col("gof_p"), F.col("fit_valid"), F.coalesce("preference", F.lit("inconclusive")), min_types, gof))


def scaling_table(coded: DataFrame, scales=SCALES, value: str = "code") -> DataFrame:
    """Log x scale; ``?`` where there is no result."""
    return coded.groupBy("log").pivot("concept", list(scales)).agg(F.first(F.col(value).cast("string"))).na.fill("?")


def outcome_counts(coded: DataFrame) -> DataFrame:
    """``concept, A .. E, total``; anything unknown counts as A."""
    known = F.when(F.col("code").isin(*CODES), F.col("code")).otherwise("A")
    return coded.groupBy("concept").agg(*(F.count_if(known == c).alias(c) for c in CODES), F.count("*").alias("total"))


def comparison_counts(coded: DataFrame, comparisons: DataFrame, significance: float = 0.1) -> DataFrame:
    """Per alternative, over the logs whose variants are neither A nor B: how often it is better, inconclusive, or worse; a missing row is inconclusive."""
    logs = coded.where((F.col("concept") == "variants") & ~F.col("code").isin("A", "B")).select("log", "concept").withColumn("model_2", F.explode(F.array(*(F.lit(m) for m in COUNTED))))
    joined = logs.join(usable(comparisons).select("log", "concept", "model_2", "R", "p"), ["log", "concept", "model_2"], "left")
    sure = F.coalesce(F.col("p") < significance, F.lit(False))
    return joined.groupBy("model_2").agg(F.count_if(sure & (F.col("R") < 0)).alias("other"), F.count_if(~sure | (F.col("R") == 0)).alias("inconclusive"), F.count_if(sure & (F.col("R") > 0)).alias("power_law"))


def concept_order(concept: Column) -> list[Column]:
    """n-grams by their order, then others by name."""
    gram = concept.rlike("^n[0-9]+$")
    return [F.when(gram, 0).otherwise(1), F.when(gram, F.regexp_extract(concept, "([0-9]+)", 1).try_cast("int")), concept]


def reconciled(shards: DataFrame, combined: DataFrame, key: list[str], fields: list[str], tolerance: float = 1e-8) -> DataFrame:
    """Rows of both sources with ``disagrees`` and ``repeated``: values must match within the tolerance, keys be unique in each source."""
    once = Window.partitionBy(*key)
    mark = lambda df, p: df.withColumn(f"{p}n", F.count("*").over(once)).select(*key, f"{p}n", *(F.col(f).alias(f"{p}{f}") for f in fields))
    joined = mark(shards, "a_").join(mark(combined, "b_"), key, "full")

    def equal(f: str) -> Column:
        a, b = F.col(f"a_{f}"), F.col(f"b_{f}")
        return a.eqNullSafe(b) | F.coalesce(F.abs(a.try_cast("double") - b.try_cast("double")) <= tolerance, F.lit(False))

    both = F.col("a_n").isNotNull() & F.col("b_n").isNotNull()
    same = F.lit(True)
    for f in fields:
        same = same & equal(f)
    out = joined.withColumns({"disagrees": both & ~same, "repeated": (F.coalesce("a_n", F.lit(1)) > 1) | (F.coalesce("b_n", F.lit(1)) > 1)})
    return out.select(*key, *(F.coalesce(f"a_{f}", f"b_{f}").alias(f) for f in fields), "disagrees", "repeated")
