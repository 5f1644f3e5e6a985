"""Simulated logs: branching processes, Markov replay, uniform traces. Cases are rows; each draws from its own seed, so partitions don't matter."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRACE = "case_id string, seq array<string>"


def xor_probabilities(options: int, kind: str = "equal", majority: float = 0.8, alpha: float = 1.5) -> list[float]:
    if options < 2:
        raise ValueError("a choice needs two options")
    if kind == "equal":
        return [1 / options] * options
    if kind == "majority":
        return [majority] + [(1 - majority) / (options - 1)] * (options - 1)
    if kind == "power_law":
        w = np.arange(1, options + 1, dtype=float) ** -alpha
        return (w / w.sum()).tolist()
    raise ValueError(kind)


def parallel_xor_model(gates: int, options: int, branches: int, kind: str = "equal", majority: float = 0.8, alpha: float = 1.5, prefix: str | None = None) -> list[list[tuple[list[str], list[float]]]]:
    """Branches of serial XOR gates: activities and their probabilities."""
    p, head = xor_probabilities(options, kind, majority, alpha), f"{prefix}_" if prefix else ""
    return [[([f"{head}parallel_{i}_xor_{j}_option_{k}" for k in range(1, options + 1)], p) for j in range(1, gates + 1)] for i in range(1, branches + 1)]


def bpmn(spark: SparkSession, model: list) -> tuple[DataFrame, DataFrame]:
    """The model's graph as nodes ``id, kind, name`` and edges ``src, dst, probability``."""
    nodes, edges = [("start", "start_event", "start"), ("split", "parallel_gateway", ""), ("join", "parallel_gateway", ""), ("loop", "exclusive_gateway", ""), ("end", "end_event", "end")], [("start", "split", 1.0)]
    for i, branch in enumerate(model):
        last = "split"
        for j, (names, p) in enumerate(branch):
            a, b = f"x{i}_{j}", f"m{i}_{j}"
            nodes += [(a, "exclusive_gateway", ""), (b, "exclusive_gateway", ""), *((n, "task", n) for n in names)]
            edges += [(last, a, 1.0), *((a, n, q) for n, q in zip(names, p, strict=True)), *((n, b, 1.0) for n in names)]
            last = b
        edges.append((last, "join", 1.0))
    edges += [("join", "loop", 1.0), ("loop", "end", None), ("loop", "split", None)]
    return spark.createDataFrame(nodes, "id string, kind string, name string"), spark.createDataFrame(edges, "src string, dst string, probability double")


def process_traces(cases: DataFrame, model: list, loop: float = 0.2, seed: int = 123) -> DataFrame:
    """A trace for each row of ``cases`` (``case_id``): start, branches interleaved at random, completion, repeated with probability ``loop``."""

    def one(rng: np.random.Generator) -> list[str]:
        out = ["start"]
        while True:
            left = [[names[rng.choice(len(names), p=p)] for names, p in branch] for branch in model]
            turns = rng.permutation(np.repeat(np.arange(len(left)), [len(b) for b in left]))
            its = [iter(b) for b in left]
            out += [next(its[t]) for t in turns]
            out.append("parallel_block_complete")
            if rng.random() >= loop:
                return out
            out.append("loop_back")

    return _per_case(cases, one, seed)


def _per_case(cases: DataFrame, draw, seed: int) -> DataFrame:
    keyed = cases.select("case_id", F.xxhash64(F.lit(seed), F.col("case_id")).alias("h"))

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"case_id": pdf["case_id"], "seq": [draw(np.random.default_rng(h & 0xFFFFFFFFFFFFFFFF)) for h in pdf["h"].tolist()]})

    return keyed.mapInPandas(run, TRACE)


def timed(traces: DataFrame, start: str = "2020-01-01 00:00:00", seed: int = 5, longest_gap: int = 20) -> DataFrame:
    """Traces as a flat log; each event 1 to ``longest_gap`` seconds after the one before, from ``start`` in every case."""
    from pyspark.sql import Window

    rows = traces.select("case_id", F.posexplode("seq").alias("event_pos", "activity"))
    gap = F.pmod(F.xxhash64(F.lit(seed), "case_id", "event_pos"), F.lit(longest_gap)) + 1
    clock = F.sum(gap).over(Window.partitionBy("case_id").orderBy("event_pos"))
    return rows.select("case_id", F.col("event_pos").cast("long"), "activity", F.timestamp_seconds(F.unix_timestamp(F.lit(start)) + clock).alias("ts"))


def markov_replay(cases: DataFrame, edges: DataFrame, longest: int, seed: int = 42, max_edges: int = 1_000_000) -> DataFrame:
    """First-order walks from START to END, cut off at ten times the longest trace; ``edges``: ``src, dst, cum_p``. One walk a case, empty ones too."""
    got = edges.select("src", "dst", "cum_p").limit(max_edges + 1).toPandas()  # pairs of activities, checked
    if len(got) > max_edges:
        raise ValueError("too many pairs of activities for a broadcast")
    table = {s: (g["dst"].tolist(), g["cum_p"].to_numpy()) for s, g in got.sort_values(["src", "cum_p"]).groupby("src")}

    def walk(rng: np.random.Generator) -> list[str]:
        out, at = [], "START"
        while len(out) < 10 * longest and at in table:
            names, cum = table[at]
            at = names[min(int(np.searchsorted(cum, rng.random(), "right")), len(names) - 1)]
            if at == "END":
                break
            out.append(at)
        return out

    return _per_case(cases, walk, seed)


def alphabet(n: int) -> list[str]:
    return [chr(97 + i) for i in range(n)] if n <= 26 else [f"a{i}" for i in range(n)]


def uniform_traces(cases: DataFrame, activities: list[str], length: int | Column, seed: int = 42) -> DataFrame:
    """Independent uniform activities, as many as ``length`` says, all within the JVM: the choice is a hash of seed, case and position."""
    length = F.lit(length) if isinstance(length, int) else length
    names = F.array(*(F.lit(a) for a in activities))
    pick = F.transform(F.slice(F.sequence(F.lit(1), F.greatest(length, F.lit(1))), F.lit(1), length), lambda i: F.get(names, F.pmod(F.xxhash64(F.lit(seed), F.col("case_id"), i), F.lit(len(activities))).cast("int")))
    return cases.select("case_id", pick.alias("seq"))


def with_drift(a: DataFrame, b: DataFrame, overlapping: bool = True) -> DataFrame:
    """Both processes' traces one after the other; without overlap their activities are prefixed ``a:`` and ``b:``."""
    mark = lambda df, p: df.select(F.concat(F.lit(f"{p}_"), "case_id").alias("case_id"), "seq" if overlapping else F.transform("seq", lambda x: F.concat(F.lit(f"{p}:"), x)).alias("seq"))
    return mark(a, "a").unionByName(mark(b, "b"))
