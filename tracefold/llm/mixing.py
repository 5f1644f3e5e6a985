"""Mixing sources to target weights by entropy balancing.

Targets: sources are numbered in order, weighted, and share the budget by weight; what exceeds a source's limit is shared again until none is above.
Each document gets the rate w = min(cap, exp(l * size / mean size of its source)), the rates nearest to one copy each in relative
entropy under the constraint that a source's rates times sizes sum to its target. The multipliers l, one a source, maximise
the convex dual; they are found by safeguarded Newton steps whose sums are computed in Spark over a (source, size) histogram, an exact
and much smaller statement of the documents. Rates are then rounded to whole copies block by block: blocks are hash
groups of a source of bounded size, each carries its rounding error from its largest document to its smallest, so a
source misses its target by about one small document a block. Sources, like documents, stay in Spark tables, so there may be any number of them.

Defined cases: null text has size 0 and is taken 0 times; null sources form one source, ordered last; an empty table gives no
rows; repeated rows are each given a rate (rows of one key and text share a block); keys must be whole numbers.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.functions.storage import numbered
from tracefold.llm.common import WORD, stored, table, whole_key, word_count

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
#: Documents of a source that are rounded together, about.
BLOCK = 4_000


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``sizes`` (source, source_size) numbered in source order, null last (``gid``), with ``target``.

    Each round shares what the full sources leave among the others by weight; the sources that become full by it are full in the next one.
    """
    rows = numbered(sizes, [F.col("source").isNull(), F.col("source")], "gid")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("gid") % len(weights) + 1).cast("int"))
    rows = stored(rows.withColumns({"weight": weight, "limit": cap * F.col("source_size")}), "mix-sources")
    total = share * float(rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level, full = 0.0, -1
    while True:
        is_full = F.col("limit") <= level * F.col("weight")
        n, used, open_ = rows.agg(F.count_if(is_full), F.sum(F.when(is_full, F.col("limit")).otherwise(0.0)), F.sum(F.when(is_full, 0.0).otherwise(F.col("weight")))).first()
        if n == full or not open_:
            break
        full, level = n, (total - used) / open_
    return rows.withColumn("target", F.least(F.col("limit"), F.lit(level) * F.col("weight"))).drop("weight", "limit")


def multipliers(histogram: DataFrame, goals: DataFrame, cap: float = CAP, rounds: int = 60, tolerance: float = 1e-7) -> DataFrame:
    """``goals`` (gid, source_size, target, mean) with ``lam``: Newton on the dual, one Spark job a round for all sources."""
    full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)
    start = F.when(F.col("target") <= 0, -60.0).when(full, 60.0).otherwise(0.0)
    g = goals.withColumns({"lam": start, "lo": F.lit(-60.0), "hi": F.lit(60.0), "done": (F.col("target") <= 0) | full})
    x = F.col("size") / F.col("mean")
    tilt, top = F.col("lam") * x, math.log(cap)
    rate = F.when(tilt >= top, float(cap)).otherwise(F.exp(tilt))
    slope = F.when(tilt >= top, 0.0).otherwise(F.exp(tilt) * x)
    g = stored(g, "mix-goals")
    for _ in range(rounds):
        if g.where(~F.col("done")).isEmpty():
            break
        now = g.where(~F.col("done")).select("gid", "lam", "mean")
        got = histogram.join(now, "gid").groupBy("gid").agg(F.sum(F.col("n") * F.col("size") * rate).alias("got"), F.sum(F.col("n") * F.col("size") * slope).alias("slope"))
        off = F.col("got") - F.col("target")
        settled = F.abs(off) <= tolerance * F.col("target")
        lo, hi = F.when(off < 0, F.col("lam")).otherwise(F.col("lo")), F.when(off > 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - off / F.nullif(F.col("slope"), F.lit(0.0))
        safe = F.when((step > F.col("lo")) & (step < F.col("hi")), step).otherwise((F.col("lo") + F.col("hi")) / 2)
        moved = g.join(got, "gid", "left").withColumns({"lo": F.when(F.col("done"), F.col("lo")).otherwise(lo), "hi": F.when(F.col("done"), F.col("hi")).otherwise(hi)})
        ended = F.col("done") | settled | (F.col("hi") - F.col("lo") <= 1e-9)
        g = stored(moved.withColumn("lam", F.when(F.col("done") | settled, F.col("lam")).otherwise(safe)).withColumn("done", ended).drop("got", "slope"), "mix-goals")
    return g.withColumn("lam", F.round("lam", 7)).drop("lo", "hi", "done")


def round_block(block: pd.DataFrame) -> pd.DataFrame:
    """Whole copies: down the sizes, each takes the floor or ceiling of its rate that keeps the running sum nearest its goal."""
    block = block.sort_values(["size", "key", "rank"], ascending=[False, True, True], kind="stable")
    size, rate = block["size"].to_numpy(float), block["rate"].to_numpy(float)
    low, want, taken = np.floor(rate + 1e-9), np.cumsum(rate * size), 0.0
    copies = np.empty(len(block))
    for i in range(len(block)):
        c = low[i]
        if rate[i] - low[i] > 1e-9 and want[i] - taken - c * size[i] >= size[i] / 2:
            c += 1
        copies[i] = c
        taken += c * size[i]
    return block.assign(copies=copies.astype("int64"))


def mix(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK) -> DataFrame:
    """Per document: ``key, rank`` (hash of the text), ``size, source_size, target, rate, copies``."""
    keyed = docs.select(whole_key(docs, key_col).alias("key"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("rank"))
    keyed = stored(keyed, "mix-sizes")
    sums = keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"), F.count_if(F.col("size") > 0).alias("filled"))
    goals = targets(sums, weights, share, cap)
    goals = goals.withColumns({"mean": F.col("source_size") / F.greatest("filled", F.lit(1)), "blocks": F.floor(F.col("n") / block) + 1}).drop("n", "filled")
    goals = stored(goals, "mix-goals")
    names = goals.select("gid", F.col("source").alias("name"))
    same = keyed["source"].eqNullSafe(names["name"])
    counts = keyed.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    histogram = stored(counts.join(names, counts["source"].eqNullSafe(names["name"])).select("gid", "size", "n"), "mix-histogram")
    plan = stored(multipliers(histogram, goals.drop("source"), cap), "mix-plan")
    tilt = F.col("lam") * F.col("size") / F.col("mean")
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("target") >= cap * F.col("source_size") * (1 - 1e-12), float(cap)).otherwise(F.when(tilt >= math.log(cap), float(cap)).otherwise(F.exp(tilt)))
    named = keyed.join(names, same, "inner").drop("name")
    rated = named.join(plan, "gid").withColumn("rate", rate).withColumn("block", F.pmod(F.xxhash64("key", "rank"), F.col("blocks")))
    out = "key long, rank long, gid long, size long, source_size long, target double, rate double, copies long"
    fit = lambda pdf: round_block(pdf)[["key", "rank", "gid", "size", "source_size", "target", "rate", "copies"]]
    return rated.select("key", "rank", "gid", "block", "size", "source_size", "target", "rate").groupBy("gid", "block").applyInPandas(fit, out)


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", F.round("rate", 6).alias("rate"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes and targets of ``op5_mix``, which have SQL; no copies are rounded for them."""
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    goals = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-targets").withColumnRenamed("source", "name")
    return sized.join(goals, sized["source"].eqNullSafe(goals["name"])).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


QUERIES = {"op5_mix": op5_mix, "mix_targets": mix_targets}
SQL = {
    # the level at which the full sources' limits and the others' weights use up the budget: the first one that none of the open sources exceeds
    "mix_targets": rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY source),
r AS (SELECT *, {CAP} * source_size AS cap, {CAP} * source_size / weight AS ratio FROM s),
o AS (SELECT ratio, source, ({SHARE} * (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
 FROM r WINDOW w AS (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT coalesce(arg_min(level, row(ratio, source)) FILTER (level <= ratio), 1e300) AS level FROM o)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, round(least(cap, level * weight), 6) AS target FROM d JOIN r ON r.source IS NOT DISTINCT FROM d.source, l
""",
}
