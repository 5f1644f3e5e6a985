"""From order k to k + 1: which n-grams branch, continue, end, or are introduced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.operators.traces import concept_nodes, occurrences


def links(traces: DataFrame, k: int) -> DataFrame:
    """``log, case_id, at, child, child_complete, introduced, parent, parent_complete``: each child occurrence with its parent by position.

    From order 1 to 2 the child at position p (padded) ends in activity p and has parent p - 1; the one that starts with the padding is introduced.
    From order 2 on child p has parent p; a whole-trace child has the parent at 0. Both lists are made from the trace's own row, so nothing is shuffled.
    """
    size = F.size("seq") + 2
    parent_complete, child_complete = (size <= k) if k >= 2 else F.lit(False), size <= k + 1

    def linked(parents, children):
        def one(child, p):
            introduced = (p == 0) if k == 1 else F.lit(False)
            at = F.when(child_complete, 0).otherwise(p - (1 if k == 1 else 0))
            parent = F.when(~introduced, F.get(parents, at))
            return F.struct(
                at.cast("long").alias("at"), child.alias("child"), child_complete.alias("child_complete"), introduced.alias("introduced"),
                parent.alias("parent"), F.when(parent.isNotNull(), parent_complete).alias("parent_complete"))

        return F.transform(children, one)

    both = F.array(F.struct(concept_nodes(F.col("seq"), f"n{k}").alias("p"), concept_nodes(F.col("seq"), f"n{k + 1}").alias("c")))
    pairs = F.element_at(F.transform(both, lambda s: linked(s["p"], s["c"])), 1)
    return traces.where(F.size("seq") > 0).select("log", "case_id", F.explode(pairs).alias("l")).select("log", "case_id", "l.*")


def summary(traces: DataFrame, k: int) -> DataFrame:
    """One row a log: types and occurrences on both sides, and how the parents' types behave.

    A type is ``branching`` with more than one child type, ``single`` with one, ``exhausted`` with none (its occurrences end their traces), ``complete`` if
    it covers a whole padded trace.
    """
    joined = links(traces, k)
    source = occurrences(traces, f"n{k}").groupBy("log", "node").agg(F.count("*").alias("n"), F.bool_or("is_complete").alias("complete"))
    children = joined.where(F.col("parent").isNotNull()).groupBy("log", F.col("parent").alias("node")).agg(F.count_distinct("child").alias("children"), F.count("*").alias("linked"))
    types = source.join(children, ["log", "node"], "left").withColumn("children", F.coalesce("children", F.lit(0)))
    parents = types.groupBy("log").agg(
        F.count("*").alias("source_types"), F.sum("n").alias("source_occurrences"), F.count_if("complete").alias("complete_types"), F.count_if(~F.col("complete") & (F.col("children") > 1)).alias("branching_types"),
        F.count_if(~F.col("complete") & (F.col("children") == 1)).alias("single_types"), F.count_if(~F.col("complete") & (F.col("children") == 0)).alias("exhausted_types"), F.sum(F.coalesce("linked", F.lit(0))).alias("linked_occurrences"))
    target = joined.groupBy("log", "child").agg(F.count("*").alias("n"), F.bool_or("child_complete").alias("complete"), F.bool_or("introduced").alias("introduced"))
    target = target.groupBy("log").agg(F.count("*").alias("target_types"), F.sum("n").alias("target_occurrences"), F.count_if("complete").alias("target_complete_types"), F.sum(F.when(F.col("introduced"), F.col("n")).otherwise(0)).alias("introduced_occurrences"))
    newly = occurrences(traces, f"n{k + 1}").where("is_complete").select("log", "node").distinct().join(occurrences(traces, f"n{k}").where("is_complete").select("log", "node").distinct(), ["log", "node"], "left_anti").groupBy("log").agg(F.count("*").alias("newly_complete_types"))
    return parents.join(target, "log").join(newly, "log", "left").withColumn("newly_complete_types", F.coalesce("newly_complete_types", F.lit(0))).withColumn("k", F.lit(k))


def overview(traces: DataFrame, ks: list[int], xmins: DataFrame | None = None) -> DataFrame:
    """``log, metric`` x k: the transition figures of all orders in one table; ``xmins`` (log, k, xmin) adds the fitted xmin of each source order."""
    out = None
    for k in ks:
        part = summary(traces, k)
        names = [c for c in part.columns if c not in ("log", "k")]
        part = part.unpivot(["log", "k"], names, "metric", "value")
        out = part if out is None else out.unionByName(part)
    if xmins is not None:
        out = out.unionByName(xmins.select("log", "k", F.lit("xmin").alias("metric"), F.col("xmin").cast("long").alias("value")))
    return out.groupBy("log", "metric").pivot("k", ks).agg(F.first("value"))
