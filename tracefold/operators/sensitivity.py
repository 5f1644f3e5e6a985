"""One-at-a-time threshold sensitivity: every setting recomputed from the same fits in one job and held against the baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.operators import paired
from tracefold.operators.decision import code, usable

# Setting, minimum fitted types, goodness-of-fit threshold, comparison threshold.
CONFIGURATIONS = [
    ("baseline", 50, 0.10, 0.10),
    ("min_types_0", 0, 0.10, 0.10),
    ("min_types_15", 15, 0.10, 0.10),
    ("min_types_30", 30, 0.10, 0.10),
    ("gof_005", 50, 0.05, 0.10),
    ("gof_020", 50, 0.20, 0.10),
    ("comp_005", 50, 0.10, 0.05),
    ("comp_020", 50, 0.10, 0.20),
]


def configurations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONFIGURATIONS, "setting string, min_types int, p_gof double, p_comp double")


def coded(fits: DataFrame, comparisons: DataFrame) -> DataFrame:
    """A row for each setting and fit with its code. The eight settings are exploded from a literal, so fits are read once."""
    rows = F.array(*(F.struct(F.lit(s).alias("setting"), F.lit(m).alias("min_types"), F.lit(g).alias("p_gof"), F.lit(c).alias("p_comp")) for s, m, g, c in CONFIGURATIONS))
    spread = lambda df: df.withColumn("c", F.explode(rows)).select("*", "c.setting", "c.min_types", "c.p_gof", "c.p_comp").drop("c")
    sure = F.col("p") < F.col("p_comp")
    prefer = spread(usable(comparisons)).groupBy("setting", "log", "concept").agg(F.bool_or(sure & (F.col("R") < 0)).alias("lost"), (F.bool_and(sure & (F.col("R") > 0)) & (F.count_distinct("model_2") == 3)).alias("won"))
    joined = spread(fits).join(prefer, ["setting", "log", "concept"], "left")
    preference = F.when(F.col("lost"), "alternative").when(F.col("won"), "power_law").otherwise("inconclusive")
    return joined.withColumn("code", code(F.col("n_fitted"), F.col("gof_p"), F.col("fit_valid"), preference, F.col("min_types"), F.col("p_gof"))).drop("lost", "won")


def category_table(rows: DataFrame) -> DataFrame:
    """Per setting: variants' codes, eligible logs, those not rejected, and how many codes differ from the baseline."""
    v = rows.where("concept = 'variants'")
    base = v.where("setting = 'baseline'").select("log", F.col("code").alias("base_code"))
    joined = v.join(base, "log", "left")
    sound = F.col("code") != "A"
    return joined.groupBy("setting").agg(*(F.count_if(F.col("code") == c).alias(c) for c in "ABCDE"), F.count_if(sound).alias("eligible"), F.count_if(sound & (F.col("code") != "B")).alias("not_rejected"), F.count_if(F.col("code") != F.col("base_code")).alias("changed"))


def changed_logs(rows: DataFrame) -> DataFrame:
    """``setting, added, removed, transitions``: logs that become eligible or stop being so, and codes that change, as text."""
    v = rows.where("concept = 'variants'").select("setting", "log", "code")
    base = v.where("setting = 'baseline'").select("log", F.col("code").alias("base_code"))
    joined = v.where("setting <> 'baseline'").join(base, "log", "left")
    texts = lambda cond, text: F.array_join(F.array_sort(F.collect_list(F.when(cond, text))), ", ")
    return joined.groupBy("setting").agg(
        texts((F.col("base_code") == "A") & (F.col("code") != "A"), F.col("log")).alias("added"), texts((F.col("base_code") != "A") & (F.col("code") == "A"), F.col("log")).alias("removed"),
        texts(F.col("base_code") != F.col("code"), F.concat("log", F.lit(":"), "base_code", F.lit(">"), "code")).alias("transitions"))


def paired_summary(fits: DataFrame) -> DataFrame:
    """Per setting: range of paired logs and of differences in percentage points, orders whose Holm p is under .05, and orders of reversed sign."""
    rows = F.array(*(F.struct(F.lit(s).alias("setting"), F.lit(m).alias("min_types"), F.lit(g).alias("p_gof")) for s, m, g, _ in CONFIGURATIONS))
    spread = fits.withColumn("c", F.explode(rows)).select("*", "c.setting", "c.min_types", "c.p_gof").drop("c")
    effects = paired.paired_effects(paired.paired_cells(paired.endpoints(spread, F.col("min_types"), F.col("p_gof")), ["setting"]))
    adjusted = paired.holm(effects, "p_value", ["setting"], "k")
    base = adjusted.where("setting = 'baseline'").select("k", F.col("difference").alias("base_difference"))
    joined = adjusted.join(base, "k", "left")
    sign = lambda c: F.when(F.abs(F.col(c)) <= 1e-11, 0).otherwise(F.signum(c))
    orders = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.col("k")))), lambda x: x.cast("string")), ", ")
    return joined.groupBy("setting").agg(
        F.min(F.when(F.col("n") > 0, F.col("n"))).alias("paired_min"), F.max(F.when(F.col("n") > 0, F.col("n"))).alias("paired_max"), (100 * F.min("difference")).alias("difference_min"), (100 * F.max("difference")).alias("difference_max"),
        orders(F.col("holm_p") < 0.05).alias("holm_orders"), orders(sign("difference") * sign("base_difference") < 0).alias("reversed_orders"))
