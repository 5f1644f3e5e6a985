"""Report tables over logs and concepts, as DataFrames ready to be written or rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.operators.decision import SCALES, best_distributions, concept_order, scaling_table


def variant_table(coded: DataFrame, comparisons: DataFrame, significance: float = 0.1) -> DataFrame:
    """Per log: the variants' fit, its code, the best other distribution with R and p. Every log of ``coded`` has a row."""
    variants = coded.where("concept = 'variants'")
    best = best_distributions(comparisons.where("concept = 'variants'"), ["log"], significance)
    other = best.select("log", F.col("best"), "best_R", "best_p", "significant")
    return coded.select("log").distinct().join(variants.select("log", "n_fitted", "gof_p", "fit_valid", "code"), "log", "left").join(other, "log", "left").withColumn("code", F.coalesce("code", F.lit("?")))


def field_table(coded: DataFrame, field: str, integer: bool = False, scales=SCALES) -> DataFrame:
    """Log x concept of one field as text, ``?`` where there is none."""
    value = F.col(field).cast("long").cast("string") if integer else F.format_string("%.3f", F.col(field).cast("double"))
    return scaling_table(coded.withColumn("_v", F.when(F.col(field).isNotNull(), value)), scales, "_v")


def best_alternative_tables(comparisons: DataFrame, significance: float = 0.1, scales=SCALES) -> dict[str, DataFrame]:
    """Four matrices log x concept: the best distribution, its R, its p, and whether that is significant."""
    best = best_distributions(comparisons, ["log", "concept"], significance)
    number = lambda c: F.format_string("%.3f", F.col(c))
    text = {"best": F.col("best"), "R": number("best_R"), "p": number("best_p"), "significant": F.when(F.col("significant"), "yes").otherwise("no")}
    return {name: scaling_table(best.withColumn("_v", v), scales, "_v") for name, v in text.items()}


def gof_by_order(coded: DataFrame, log: str) -> DataFrame:
    """One log's goodness-of-fit p over the concepts in order."""
    return coded.where(F.col("log") == log).orderBy(*concept_order(F.col("concept"))).select("concept", "n_fitted", "gof_p", "code")


def outcome_shares(counts: DataFrame) -> DataFrame:
    """``concept`` with each code as ``m/n``."""
    return counts.select("concept", *(F.format_string("%d/%d", F.col(c), F.col("total")).alias(c) for c in "ABCDE"))


def outcome_stack(counts: DataFrame) -> DataFrame:
    """``concept, code, n, share, upto``: the points of a stacked chart, codes from A up."""
    long = counts.unpivot(["concept", "total"], list("ABCDE"), "code", "n")
    before: Column = F.lit(0)
    for c in "ABCDE":
        before = before + F.when(F.col("code") >= c, F.col(f"_{c}")).otherwise(0)
    wide = counts.select("concept", *(F.col(c).alias(f"_{c}") for c in "ABCDE"))
    joined = long.join(wide, "concept")
    return joined.select("concept", "code", "n", (F.col("n") / F.col("total")).alias("share"), (before / F.col("total")).alias("upto"))


def experiment_overview(df: DataFrame, by: list[str]) -> DataFrame:
    """Types, occurrences, the largest frequency and singletons of each experiment's frequencies."""
    return df.groupBy(*by).agg(F.count("*").alias("n_types"), F.sum("freq").alias("n_occurrences"), F.max("freq").alias("top"), F.count_if(F.col("freq") == 1).alias("n_singletons"))
