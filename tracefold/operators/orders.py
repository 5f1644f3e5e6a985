"""The n-grams of all orders at once, from one weighted order of suffixes.

Equal traces become one weighted row. Every place of a padded trace gives its suffix, cut at the greatest order; the suffixes are range-partitioned and sorted,
so the n-grams of every order are runs of neighbours that have n tokens in common. One pass over a partition with the common prefix of each pair of
neighbours closes the runs of all orders. A run can go on in a neighbouring partition only if it is a prefix of the partition's first or last suffix: at most two for
each order, which are summed apart; all others are finished where they lie and are not shuffled again.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.functions.storage import stored
from tracefold.operators.traces import ORDERS, counted, padded

BATCH = 8192
RUN = "log string, n int, node array<string>, freq long, real long, children long, open boolean"


def suffixes(variants: DataFrame, most: int) -> DataFrame:
    """``log, gram, w, real``: up to ``most`` tokens from each place of the padded ``counted`` traces, with the traces' number; real: the place holds an activity."""
    rows = variants.select("log", "w", padded(F.col("seq"), 2).alias("whole"))
    places = F.explode(F.sequence(F.lit(1), F.size("whole") - 1)).alias("at")  # the end alone is no n-gram
    rows = rows.select("log", "w", "whole", places)
    return rows.select("log", F.slice("whole", F.col("at"), most).alias("gram"), "w", (F.col("at") > 1).alias("real"))


def _runs(most: int):
    """Runs of sorted suffixes: a row for each node of each order, ``open`` where another partition may have more of it."""
    kinds = [pa.string(), pa.int32(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    schema = pa.schema(list(zip((c.split()[0] for c in RUN.split(", ")), kinds, strict=True)))

    def close(stack, out, log, gram, keep, last):
        """Close runs deeper than ``keep``; a stack entry is [weight, real weight, finished children, on the first suffix]."""
        while len(stack) > keep:
            w, real, children, first = stack.pop()
            loose = first or last
            out.append((log, len(stack) + 1, gram[: len(stack) + 1], w, real, children, loose))
            if stack:
                up = stack[-1]
                up[0], up[1], up[2] = up[0] + w, up[1] + real, up[2] + (not loose)

    def run(batches):
        stack, log, gram, out, start = [], None, None, [], True
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("log", "gram", "w", "real")]
            for here, new, w, real in zip(*columns, strict=True):
                shared = 0
                if gram is not None and here == log:
                    for a, b in zip(gram, new, strict=False):
                        if a != b:
                            break
                        shared += 1
                if gram is not None:
                    close(stack, out, log, gram, shared, False)
                start = gram is None
                for _ in range(shared, len(new)):
                    stack.append([0, 0, 0, start])
                stack[-1][0] += w
                stack[-1][1] += w if real else 0
                log, gram = here, new
                if len(out) >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], schema=schema)
                    out.clear()
        if gram is not None:
            close(stack, out, log, gram, 0, True)
        for i in range(0, len(out), BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + BATCH], strict=True), kinds, strict=True)], schema=schema)

    return run


def all_orders(traces: DataFrame, most: int = ORDERS[-1]) -> DataFrame:
    """``log, n, node, freq, children, is_complete``: the n-grams of the orders 1 to ``most`` with their occurrences, and how many different ones of the next order go on from each.

    As for single orders: activities stand alone, longer n-grams are padded, and a padded trace no longer than n is one node, complete. ``children`` of the
    greatest order and of complete nodes are 0; those of activities count what follows them.
    """
    variants = stored(counted(traces), "variants")
    deep = suffixes(variants, most + 1)
    runs = stored(deep.repartitionByRange("log", "gram").sortWithinPartitions("log", "gram").mapInArrow(_runs(most), RUN), "runs")
    loose = runs.where("open").groupBy("log", "n", "node").agg(*(F.sum(c).alias(c) for c in ("freq", "real", "children")))
    # children that lie open themselves are counted once each
    born = loose.where("n > 1").groupBy("log", (F.col("n") - 1).alias("n"), F.slice("node", F.lit(1), F.col("n") - 1).alias("node")).agg(F.count("*").alias("more"))
    joined = loose.join(born, ["log", "n", "node"], "left").withColumn("children", F.col("children") + F.coalesce("more", F.lit(0)))
    nodes = runs.where("not open").select("log", "n", "node", "freq", "real", "children").unionByName(joined.select("log", "n", "node", "freq", "real", "children"))
    # an activity's occurrences are those at places that hold one
    nodes = nodes.withColumn("freq", F.when(F.col("n") == 1, F.col("real")).otherwise(F.col("freq"))).where((F.col("n") <= most) & (F.col("freq") > 0))
    whole = padded(F.col("seq"), 2)
    size = F.size("seq") + 2
    short = variants.where(size <= most).select("log", F.col("w").alias("freq"), whole.alias("node"), F.explode(F.sequence(size, F.lit(most))).alias("n"))
    ended = short.where(F.col("n") == F.size("node")).select("log", "n", "node", F.lit(True).alias("_complete"))
    nodes = nodes.join(ended, ["log", "n", "node"], "left")
    complete = F.coalesce("_complete", F.lit(False))
    last = (F.col("n") == most) | complete
    out = nodes.select("log", "n", "node", "freq", F.when(last, 0).otherwise(F.col("children")).cast("long").alias("children"), complete.alias("is_complete"))
    longer = short.where(F.col("n") > F.size("node")).select("log", "n", "node", "freq", F.lit(0).cast("long").alias("children"), F.lit(True).alias("is_complete"))
    return out.unionByName(longer)


def order_profile(nodes: DataFrame) -> DataFrame:
    """Per log and order: types, occurrences, singletons, and how many types branch (more than one continuation), go on one way, end, or are whole traces."""
    open_ = ~F.col("is_complete")
    return nodes.groupBy("log", "n").agg(
        F.count("*").alias("types"), F.sum("freq").alias("occurrences"), F.count_if(F.col("freq") == 1).alias("singletons"), F.count_if("is_complete").alias("complete_types"),
        F.count_if(open_ & (F.col("children") > 1)).alias("branching_types"), F.count_if(open_ & (F.col("children") == 1)).alias("single_types"), F.count_if(open_ & (F.col("children") == 0)).alias("exhausted_types"))


def order_totals(nodes: DataFrame) -> DataFrame:
    """``log, n, level, types, occurrences, median_freq``: totals by log and order, by log, by order over all logs, and of all, by grouping sets.

    ``level``: ``log_order``, ``log``, ``order`` or ``all``; a type of several logs counts once where logs are taken together. The median is that of the frequencies
    of the types of one log and order.

    ``nodes`` has a row for each type of a log and order, so the sets are made over the histogram of frequencies, a row for each distinct one; only the types that
    several logs share are looked for among the types themselves.
    """
    nodes = stored(nodes.select("log", "n", "node", "freq"), "types")
    values = nodes.groupBy("log", "n", "freq").agg(F.count("*").alias("types"))
    sets = values.groupingSets([["log", "n"], ["log"], ["n"], []], "log", "n")
    level = F.when(F.grouping_id() == 0, "log_order").when(F.grouping_id() == 1, "log").when(F.grouping_id() == 2, "order").otherwise("all")
    totals = sets.agg(level.alias("level"), F.sum("types").alias("rows"), F.sum(F.col("freq") * F.col("types")).alias("occurrences"), F.percentile("freq", 0.5, F.col("types")).alias("median_freq"))
    # rows beyond a type's first, by order and of all
    again = nodes.groupBy("n", "node").agg((F.count("*") - 1).alias("again")).where("again > 0").rollup("n").agg(F.sum("again").alias("again"), F.when(F.grouping_id() == 0, "order").otherwise("all").alias("_level"))
    again = again.select(F.col("n").alias("_n"), "_level", "again")
    joined = totals.join(F.broadcast(again), (F.col("level") == F.col("_level")) & F.col("n").eqNullSafe(F.col("_n")), "left")
    return joined.select("log", "n", "level", (F.col("rows") - F.coalesce("again", F.lit(0))).alias("types"), "occurrences", "median_freq")


def totals(traces: DataFrame, most: int = ORDERS[-1]) -> DataFrame:
    return order_totals(all_orders(traces, most))
