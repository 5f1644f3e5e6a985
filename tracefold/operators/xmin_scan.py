"""Power-law fits of units of any size: all candidate xmins are scored over many tasks, and bounds spare most of the distance pairs.

A unit's distinct frequencies are range-partitioned; tail sums of counts, of ``n * ln x`` and of occurrences come from sums within partitions and the totals of
those after them. Rows of at most ``CHUNK`` neighbouring values are what tasks work on.

1. Likelihood: a candidate needs its tail sums only; the exponents of a chunk's candidates are found together.
2. Bound: the distance at a few values of the unit (the first of each step of ``STEP`` in size, so their number grows with the logarithm of the largest value) is at
   most the candidate's KS distance.
3. Search: rounds of exact distances for the candidates of least bound, each a join of candidate chunks with the value chunks that hold values from
   them on. A candidate whose bound is above the least distance so far can't win and is never looked at. Rounds grow, and end when nobody is left, so
   the answer is that of all pairs.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.functions import zeta
from tracefold.functions.storage import stored
from tracefold.operators import powerlaw

CHUNK, STEP = 2048, 1.04
#: Candidates of a unit and model whose exact distances are found in the first round; pairs up to which a unit's first round takes them all.
FIRST, AT_ONCE = 64, 1 << 23
CELLS = ("x", "n", "tail_n", "tail_l")


def tail_sums(freqs: DataFrame, by: list[str]) -> DataFrame:
    """``by, x, n, tail_n, tail_l, tail_o, tail_d``: for each distinct frequency its types, and from it on: types, sum of n * ln x, occurrences, distinct frequencies."""
    counts = powerlaw.frequency_counts(freqs, by).select(*by, F.col("freq").cast("double").alias("x"), F.col("types").alias("n"))
    placed = stored(counts.repartitionByRange(*by, "x").withColumn("part", F.spark_partition_id()), "frequencies")
    parts = {"n": F.col("n"), "l": F.col("n") * F.log("x"), "o": F.col("n") * F.col("x"), "d": F.lit(1)}
    totals = placed.groupBy(*by, "part").agg(*(F.sum(c).alias(f"part_{k}") for k, c in parts.items()))
    later = Window.partitionBy(*by).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)  # a row a partition that the unit lies in
    after = totals.select(*by, "part", *(F.coalesce(F.sum(f"part_{k}").over(later), F.lit(0)).alias(f"after_{k}") for k in parts))
    inside = Window.partitionBy(*by, "part").orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, 0)  # a partition's rows
    return placed.join(after, [*by, "part"]).select(*by, "x", "n", *((F.col(f"after_{k}") + F.sum(c).over(inside)).alias(f"tail_{k}") for k, c in parts.items()))


def value_chunks(sums: DataFrame, by: list[str]) -> DataFrame:
    """``by, chunk, x, n, tail_n, tail_l`` (arrays, ascending), chunks counted from the largest value down."""
    chunk = F.floor((F.col("tail_d") - 1) / CHUNK).cast("long")
    rows = sums.groupBy(*by, chunk.alias("chunk")).agg(F.array_sort(F.collect_list(F.struct(*(F.col(c).cast("double").alias(c) for c in CELLS)))).alias("cells"))
    return rows.select(*by, "chunk", *(F.col(f"cells.{c}").alias(c) for c in CELLS))


def edges(sums: DataFrame, by: list[str]) -> DataFrame:
    """``by, edge_x, edge_n``: the first value of each step in size, with the types from it on."""
    step = F.floor(F.log("x") / np.log(STEP))
    first = sums.groupBy(*by, step.alias("step")).agg(F.min(F.struct("x", F.col("tail_n").cast("double").alias("n"))).alias("e"))
    return first.groupBy(*by).agg(F.array_sort(F.collect_list("e")).alias("e")).select(*by, F.col("e.x").alias("edge_x"), F.col("e.n").alias("edge_n"))


def problems(sums: DataFrame, by: list[str], models: tuple[str, ...], fixed_xmin: int | None) -> DataFrame:
    """``by, model, xmax, exclude_k, above_n, above_l, last, single``: what each model leaves above, and the one xmin of models without a choice."""
    unit = sums.groupBy(*by).agg(F.max("x").alias("largest"), F.max("tail_n").alias("types")).where("types >= 2")
    none, out = F.lit(None), []
    for model in models:
        single = F.lit(float(fixed_xmin or 1) if model == "full_range_power_law" else None if fixed_xmin is None else float(fixed_xmin)).cast("double")
        if model == "doubly_bounded_power_law":
            first, last = F.col("tail_n") - F.col("n") + 1, F.col("tail_n")
            heads = F.array_compact(F.array(*(F.when(F.lit(k + 1).between(first, last), k) for k in powerlaw.EXCLUDE_HEAD)))
            rows = sums.join(unit.select(*by), by, "left_semi").withColumn("heads", heads).where(F.size("heads") > 0)
            above = (F.col("x").alias("xmax"), F.array_min("heads").alias("exclude_k"), (first - 1).alias("above_n"), (F.col("tail_l") - F.col("n") * F.log("x")).alias("above_l"), F.col("x").alias("last"))
        else:
            rows = unit
            above = (none.cast("double").alias("xmax"), none.cast("int").alias("exclude_k"), F.lit(0).cast("long").alias("above_n"), F.lit(0.0).alias("above_l"), F.col("largest").alias("last"))
        out.append(rows.select(*by, F.lit(model).alias("model"), *above, single.alias("single")))
    return reduce(DataFrame.unionByName, out)


def _lists(batch: pa.RecordBatch, *names: str):
    columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
    for i in range(batch.num_rows):
        yield [c[i].values.to_numpy(zero_copy_only=False) if hasattr(c[i], "values") else c[i].as_py() for c in columns]


def _columns_of(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def _scored(keys: list[str]):
    """Exponent and bound of each candidate of a row's chunk."""

    def run(batches):
        for batch in batches:
            rows = list(_lists(batch, "x", "n", "tail_n", "tail_l", "above_n", "above_l", "xmax", "last", "single", "edge_x", "edge_n"))
            for i, (x, _, tail_n, tail_l, above_n, above_l, xmax, last, single, edge_x, edge_n) in enumerate(rows):
                use = x <= last if single is not None else x < last
                x, base = x[use], tail_n[use]
                if not len(x):
                    continue
                count, total, top = base - above_n, tail_l[use] - above_l, np.inf if xmax is None else xmax
                alpha = powerlaw.exponents(count, total, x, top)
                z, valid = powerlaw.power_sum(alpha, x, top), powerlaw.ALPHA_MAX - alpha > powerlaw.BOUNDARY
                # an invalid fit's distance is defined by its size; any other is at least that at the edges
                bound = np.where(valid, 0.0, 1 - 1 / np.maximum(count, 1))
                live = np.flatnonzero(valid)
                bound[live] = distances(x[live], alpha[live], z[live], count[live], base[live], top, edge_x, edge_n)
                ks = np.where(valid, np.nan, bound)
                made = [pa.array(x), pa.array(alpha), pa.array(z), pa.array(count), pa.array(base), pa.array(bound), pa.array(ks, mask=valid)]
                key = batch.select(keys).slice(i, 1)
                names = [*keys, "xmin", "alpha", "z", "count", "base", "bound", "ks"]
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(np.zeros(len(x), np.int64))) for c in key.columns), *made], names=names)

    return run


def distances(xmin, alpha, z, count, base, top, x, tail_n) -> np.ndarray:
    """The largest gap of the two distribution functions of each candidate at the values ``x`` from its xmin up to ``top`` (0 if there is none)."""
    out = np.zeros(len(xmin))
    x, tail_n = x[x <= top], tail_n[x <= top]
    if not len(x):
        return out
    rows = max(1, powerlaw.PAIRS // len(x))
    for b in range(0, len(xmin), rows):
        s = slice(b, b + rows)
        survive = powerlaw.power_sum(alpha[s, None], x[None], top, head=6) / z[s, None]
        apart = np.abs((base[s, None] - tail_n[None]) / count[s, None] - (1 - survive))
        out[s] = np.where(x[None] >= xmin[s, None], apart, 0.0).max(axis=1)
    return out


def _measured(keys: list[str]):
    """The exact distances of a row's candidates on its chunk of values."""

    def run(batches):
        for batch in batches:
            rows = list(_lists(batch, "xmin", "alpha", "z", "count", "base", "xmax", "x", "tail_n"))
            for i, (xmin, alpha, z, count, base, xmax, x, tail_n) in enumerate(rows):
                got = distances(xmin, alpha, z, count, base, np.inf if xmax is None else xmax, x, tail_n)
                key = batch.select(keys).slice(i, 1)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(np.zeros(len(xmin), np.int64))) for c in key.columns), pa.array(xmin), pa.array(got)], names=[*keys, "xmin", "apart"])

    return run


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def candidates(sums: DataFrame, by: list[str], models: tuple[str, ...], fixed_xmin: int | None) -> tuple[DataFrame, DataFrame]:
    """``by, model, xmax, exclude_k, chunk, xmin, alpha, z, count, base, bound, ks`` of every candidate (``ks``: of invalid fits only), and the value chunks."""
    chunks = stored(value_chunks(sums, by), "chunks")
    posed = problems(sums, by, models, fixed_xmin)
    free = posed.where("single is null").join(chunks, by)
    # a single xmin needn't be a value: its tail is that of the first value from it on
    alone = posed.where("single is not null").join(sums.select(*by, F.col("x").alias("v"), "tail_n", "tail_l"), by).where("v >= single and v <= last")
    keys = [*by, "model", "xmax", "exclude_k", "above_n", "above_l", "last", "single"]
    tail = F.min(F.struct("v", F.col("tail_n").cast("double").alias("n"), "tail_l")).alias("t")
    alone = alone.groupBy(*keys).agg(tail).select(*keys, F.lit(-1).cast("long").alias("chunk"), F.array("single").alias("x"), F.array(F.lit(0.0)).alias("n"), F.array("t.n").alias("tail_n"), F.array("t.tail_l").alias("tail_l"))
    named = [*by, "model", "xmax", "exclude_k", "chunk"]
    rows = free.unionByName(alone).join(edges(sums, by), by).repartition(*by, "model", "xmax", "chunk")
    schema = _columns_of(rows, named) + ", xmin double, alpha double, z double, count double, base double, bound double, ks double"
    return stored(rows.mapInArrow(_scored(named), schema), "candidates"), chunks


def scanned(found: DataFrame, chunks: DataFrame, by: list[str], first: int = FIRST, at_once: int = AT_ONCE) -> DataFrame:
    """``found`` with ``ks`` of all candidates that can be best."""
    group, places, take = [*by, "model"], chunks.select(*by, "chunk", "x", "tail_n"), first
    problem = [*group, "xmax", "exclude_k", "chunk"]
    while True:
        best = found.groupBy(*group).agg(F.min("ks").alias("best"), F.count("*").alias("all"))
        open_ = found.where("ks is null").join(best, group).where(F.col("best").isNull() | (F.col("bound") <= F.greatest(F.col("best") + 10.0**-powerlaw.DIGITS, F.lit(powerlaw.PERFECT))))
        # the least bounds first; where a unit has few pairs, all of its candidates at once
        share = F.least(F.lit(1.0), F.when(F.first("all") * F.first("all") <= at_once, 1.0).otherwise(F.lit(float(take)) / F.count("*")))
        cut = open_.groupBy(*group).agg(share.alias("share"), F.percentile_approx("bound", F.array(*(F.lit(2.0**-i) for i in range(24))), F.lit(10_000)).alias("q"))
        cut = stored(cut.select(*group, F.element_at("q", F.greatest(F.lit(1), F.least(F.lit(24), F.floor(-F.log2("share")).cast("int") + 1))).alias("cut")), "cuts")
        if cut.isEmpty():
            return found
        chosen = open_.join(cut, group).where("bound <= cut")
        lists = chosen.groupBy(*problem).agg(F.array_sort(F.collect_list(F.struct("xmin", "alpha", "z", "count", "base"))).alias("c"), F.min("xmin").alias("lowest"))
        lists = lists.select(*problem, "lowest", *(F.col(f"c.{c}").alias(c) for c in ("xmin", "alpha", "z", "count", "base")))
        pairs = lists.join(places.withColumnRenamed("chunk", "place"), by).where("element_at(x, -1) >= lowest and (xmax is null or x[0] <= xmax)")
        rows = pairs.repartition(*problem, "place").mapInArrow(_measured(problem), _columns_of(pairs, problem) + ", xmin double, apart double")
        exact = rows.groupBy(*problem, "xmin").agg(F.max("apart").alias("apart")).select(*(F.col(c).alias(f"_{c}") for c in (*problem, "xmin")), "apart")
        joined = found.join(exact, reduce(Column.__and__, (_same(c, f"_{c}") for c in (*problem, "xmin"))), "left")
        found = stored(joined.withColumn("ks", F.coalesce("ks", "apart")).select(found.columns), "candidates")
        take *= 4


def fits(freqs: DataFrame, by: list[str], models: tuple[str, ...] = powerlaw.MODELS, fixed_xmin: int | None = None, first: int = FIRST, at_once: int = AT_ONCE) -> DataFrame:
    """A row for each unit and model: the fit of least KS distance (ties: an excluded head, then more fitted types); units that can't be fitted have nulls and ``fit_valid`` false."""
    sums = stored(tail_sums(freqs, by), "tails")
    found = scanned(*candidates(sums, by, models, fixed_xmin), by, first, at_once)
    head = F.when(F.coalesce("exclude_k", F.lit(0)) == 0, 10**9).otherwise(F.col("exclude_k"))
    best = found.where("ks is not null").groupBy(*by, "model").agg(F.min(F.struct(F.when(F.col("ks") < powerlaw.PERFECT, 0.0).otherwise(F.round("ks", powerlaw.DIGITS)).alias("r"), head.alias("head"), (-F.col("count")).alias("m"), "xmin", "xmax", "exclude_k", "alpha", "ks")).alias("b"))
    best = best.select(*by, "model", "b.ks", "b.xmin", "b.xmax", "b.exclude_k", "b.alpha", (-F.col("b.m")).cast("long").alias("n_fitted"))
    inside = (F.col("x") >= F.col("xmin")) & (F.col("xmax").isNull() | (F.col("x") <= F.col("xmax")))
    over = F.col("x") > F.col("xmax")
    sizes = sums.select(*by, "x", "n").join(best, by).groupBy(*by, "model").agg(
        F.sum(F.when(over, F.col("n")).otherwise(0)).alias("excluded"), F.max(F.when(inside, F.col("x"))).alias("top"), F.sum("n").alias("types"),
        (F.sum(F.when(inside, F.col("x") * F.col("n"))) / F.sum(F.col("x") * F.col("n"))).alias("occurrence_share"),
    )
    units = sums.select(*by).distinct().withColumn("model", F.explode(F.array(*(F.lit(m) for m in models))))
    out = units.join(best.join(sizes, [*by, "model"]), [*by, "model"], "left")
    valid = F.coalesce(powerlaw.ALPHA_MAX - F.col("alpha") > powerlaw.BOUNDARY, F.lit(False))
    return out.select(
        *by, "model", "xmin", "xmax", "exclude_k", "alpha", "ks", "n_fitted", "excluded", "top", (F.col("n_fitted") / F.col("types")).alias("type_share"), "occurrence_share",
        F.log10(F.col("top") / F.col("xmin")).alias("log_range"), valid.alias("fit_valid"),
    )


def saved_fit_curve(freqs: DataFrame, fitted: DataFrame, by: list[str]) -> DataFrame:
    """``by, model, x, p_data, p_fit, gap, largest``: both distribution functions, P(X < x) from the fit's xmin on, at each observed frequency of a saved fit.

    ``fitted`` has ``by, model, alpha, xmin`` and perhaps ``xmax``; fits without an exponent or without data from xmin on have no curve. ``largest`` marks
    the place of the largest absolute gap, the smallest frequency among equals.
    """
    if "xmax" not in fitted.columns:
        fitted = fitted.withColumn("xmax", F.lit(None).cast("double"))
    points = tail_sums(freqs, by).join(fitted.select(*by, "model", "alpha", "xmin", "xmax").where("alpha is not null"), by)
    points = stored(points.where("x >= xmin and (xmax is null or x <= xmax)"), "curve")
    unit = [*by, "model"]
    span = points.groupBy(*unit).agg(F.max("tail_n").alias("from_xmin"), F.min(F.col("tail_n") - F.col("n")).alias("above"))
    top = F.when(F.col("xmax").isNotNull(), F.col("xmax"))
    left = zeta.power_sum(F.col("alpha"), F.col("x"), top) / zeta.power_sum(F.col("alpha"), F.col("xmin"), top)
    rows = points.join(span, unit).select(*unit, "x", ((F.col("from_xmin") - F.col("tail_n")) / (F.col("from_xmin") - F.col("above"))).alias("p_data"), (1 - left).alias("p_fit"))
    rows = rows.withColumn("gap", F.col("p_data") - F.col("p_fit"))
    largest = rows.groupBy(*unit).agg(F.max(F.struct(F.abs("gap").alias("g"), (-F.col("x")).alias("m"))).alias("most")).select(*unit, (-F.col("most.m")).alias("at"))
    return rows.join(largest, unit).select(*unit, "x", "p_data", "p_fit", "gap", (F.col("x") == F.col("at")).alias("largest"))
