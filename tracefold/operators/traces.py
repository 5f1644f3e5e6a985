"""Traces and the concepts cut from them: activities, directly-follows pairs, n-grams, variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions.storage import numbered

START, END = "START", "END"
ORDERS = range(1, 21)


def traces(events: DataFrame, order: str = "o") -> DataFrame:
    """``log, case_id, completion, seq``: a case's activities in order. A trace is as long as its case, no longer group is gathered."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("activity"), F.col("ts"))))  # no element is null; array_sort would call its comparator row by row
    rows = events.groupBy("log", "case_id").agg(ordered.alias("e"))
    return rows.select("log", "case_id", F.element_at("e.ts", -1).alias("completion"), F.col("e.activity").alias("seq"))


def completed(df: DataFrame) -> DataFrame:
    """Traces that attachments are made of: not empty, with a completion time."""
    return df.where((F.size("seq") > 0) & F.col("completion").isNotNull())


def padded(seq: Column, n: int, add_start_end: bool = True) -> Column:
    return F.concat(F.array(F.lit(START)), seq, F.array(F.lit(END))) if n >= 2 and add_start_end else seq


def ngrams(seq: Column, n: int, add_start_end: bool = True) -> Column:
    """Windows of ``n``; a (padded) trace no longer than that is one node."""
    whole = padded(seq, n, add_start_end)

    def windows(w: Column) -> Column:
        return F.when(F.size(w) == 0, F.array().cast("array<array<string>>")).when(F.size(w) <= n, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.slice(w, i, n)))

    return F.element_at(F.transform(F.array(whole), windows), 1)


def concept_nodes(seq: Column, concept: str, add_start_end: bool = True) -> Column:
    """The nodes of a trace for ``variants``, ``activities``, ``dfrs`` or ``n1`` .. ``n20``."""
    if concept == "variants":
        return F.array(seq)
    if concept == "activities":
        return ngrams(seq, 1, add_start_end)
    if concept == "dfrs":
        pairs = F.transform(F.sequence(F.lit(1), F.size(seq) - 1), lambda i: F.slice(seq, i, 2))
        return F.when(F.size(seq) > 1, pairs).otherwise(F.array().cast("array<array<string>>"))
    if concept.startswith("n") and concept[1:].isdigit() and int(concept[1:]) in ORDERS:
        return ngrams(seq, int(concept[1:]), add_start_end)
    raise ValueError(f"unknown concept {concept!r}")


def occurrences(df: DataFrame, concept: str, add_start_end: bool = True) -> DataFrame:
    """``log, case_id, pos, node, is_complete``: a row for each node of each trace; complete: it covers the whole padded trace."""
    rows = df.where(F.size("seq") > 0).select("log", "case_id", F.col("seq"), F.posexplode(concept_nodes(F.col("seq"), concept, add_start_end)).alias("pos", "node"))
    n = int(concept[1:]) if concept[1:].isdigit() else 1
    size = F.size("seq") + (2 if n >= 2 and add_start_end else 0)
    complete = F.lit(True) if concept == "variants" else (size <= n if n >= 2 else F.lit(False))
    return rows.select("log", "case_id", F.col("pos").cast("long"), "node", complete.alias("is_complete"))


def counted(df: DataFrame) -> DataFrame:
    """``log, seq, w``: the different traces with events, and how many are equal."""
    return df.where(F.size("seq") > 0).groupBy("log", "seq").agg(F.count("*").alias("w"))


def counted_frequencies(variants: DataFrame, concept: str, add_start_end: bool = True) -> DataFrame:
    """``log, concept, node, freq`` as ``frequencies``, from ``counted`` traces."""
    rows = variants.select("log", "w", F.explode(concept_nodes(F.col("seq"), concept, add_start_end)).alias("node"))
    return rows.groupBy("log", "node").agg(F.sum("w").alias("freq")).select("log", F.lit(concept).alias("concept"), "node", "freq")


def frequencies(df: DataFrame, concept: str, add_start_end: bool = True) -> DataFrame:
    """``log, concept, node, freq``."""
    rows = df.where(F.size("seq") > 0).select("log", F.explode(concept_nodes(F.col("seq"), concept, add_start_end)).alias("node"))
    return rows.groupBy("log", "node").agg(F.count("*").alias("freq")).select("log", F.lit(concept).alias("concept"), "node", "freq")


def attachments(df: DataFrame, concept: str, add_start_end: bool = True, order: str = "case_id") -> DataFrame:
    """``attachment_time, attachment_index, node_id``: all nodes in the order of completion, numbered from 0 without a global window."""
    done = completed(df)
    rows = done.select("log", "completion", F.col(order).alias("_o"), F.posexplode(concept_nodes(F.col("seq"), concept, add_start_end)).alias("_p", "node"))
    out = numbered(rows, [F.col("completion").asc(), F.col("_o").asc(), F.col("_p").asc()], "attachment_index")
    return out.select("log", F.date_format("completion", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("attachment_time"), "attachment_index", node_text(F.col("node"), concept).alias("node_id"))


def node_text(node: Column, concept: str = "n2") -> Column:
    """A node as text: activities bare, others as a tuple with quoted labels (single quotes unless the label has one and no double one)."""
    if concept in ("activities", "n1"):
        return F.element_at(node, 1)

    def quoted(label: Column) -> Column:
        safe = F.replace(label, F.lit("\\"), F.lit("\\\\"))
        safe = F.replace(F.replace(F.replace(safe, F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t")), F.lit("\r"), F.lit("\\r"))
        both = F.concat(F.lit("'"), F.replace(safe, F.lit("'"), F.lit("\\'")), F.lit("'"))
        return F.when(~label.contains("'"), F.concat(F.lit("'"), safe, F.lit("'"))).when(~label.contains('"'), F.concat(F.lit('"'), safe, F.lit('"'))).otherwise(both)

    inner = F.array_join(F.transform(node, quoted), ", ")
    return F.concat(F.lit("("), inner, F.when(F.size(node) == 1, ",").otherwise(""), F.lit(")"))


def boundary_collisions(df: DataFrame) -> DataFrame:
    """``log, label``: real activities that are called like the padding."""
    return df.select("log", F.explode(F.array_intersect("seq", F.array(F.lit(START), F.lit(END)))).alias("label")).distinct()


def occurrence_weight(length: Column, k: int) -> Column:
    """How many nodes of order ``k`` a padded trace of ``length`` has, without making them."""
    return length if k == 1 else F.greatest(F.lit(1), length + 3 - k)


def complete_length(k: int) -> int:
    """The longest trace that one node of order ``k`` covers."""
    return 1 if k == 1 else max(k - 2, 1)


def prefixed(events: DataFrame, prefix: str) -> DataFrame:
    return events.withColumn("activity", F.concat(F.lit(f"{prefix}:"), "activity"))


def relabelled(events: DataFrame, start: int = 1) -> DataFrame:
    """Cases renamed ``case_{start + i}`` by first appearance (``event_pos``)."""
    cases = numbered(events.groupBy("case_id").agg(F.min("event_pos").alias("first")), [F.col("first").asc(), F.col("case_id").asc()], "i")
    names = cases.select("case_id", F.concat(F.lit("case_"), (F.col("i") + start).cast("string")).alias("renamed"))
    return events.join(names, "case_id").drop("case_id").withColumnRenamed("renamed", "case_id")


def combined(logs: list[DataFrame]) -> DataFrame | None:
    """UNION ALL with case numbers that run on from log to log."""
    out, start = None, 1
    for events in logs:
        n = events.select("case_id").distinct().count()
        part = relabelled(events, start)
        out = part if out is None else out.unionByName(part)
        start += n
    return out


def paired_traces(a: DataFrame, b: DataFrame, seed: int, prefix_a: str | None = None, prefix_b: str | None = None) -> DataFrame:
    """Each trace of ``a`` followed by one of ``b``, paired by a seeded permutation; the logs must have equally many traces."""
    if a.count() != b.count():
        raise ValueError("logs of unequal length can't be paired")
    label = lambda seq, p: F.transform(seq, lambda x: F.concat(F.lit(f"{p}:"), x)) if p else seq
    left = numbered(a.select(F.col("case_id").alias("case_a"), label(F.col("seq"), prefix_a).alias("seq_a")), [F.col("case_a").asc()], "i")
    right = numbered(b.select(F.col("case_id").alias("case_b"), label(F.col("seq"), prefix_b).alias("seq_b"), F.xxhash64(F.lit(seed), F.col("case_id")).alias("r")), [F.col("r").asc(), F.col("case_b").asc()], "i")
    return left.join(right, "i").select("i", "case_a", "case_b", F.concat("seq_a", "seq_b").alias("seq"))
