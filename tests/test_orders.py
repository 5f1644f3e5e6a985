"""The n-grams of all orders against those of each order alone."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from tracefold.functions import sql
from tracefold.operators import orders
from tracefold.operators import traces as tr


def traces(spark, logs):
    rows = [(log, str(i), None, seq) for log, seqs in logs.items() for i, seq in enumerate(seqs)]
    return spark.createDataFrame(rows, "log string, case_id string, completion timestamp, seq array<string>")


def brute(logs, most):
    """Counts, continuations and completeness of each order's nodes, trace by trace."""
    freq, after, whole = defaultdict(int), defaultdict(set), set()
    for log, seqs in logs.items():
        for seq in seqs:
            if not seq:
                continue
            s = ["START", *seq, "END"]
            for n in range(1, most + 1):
                if n == 1:
                    nodes = [(tuple(s[i : i + 1]), i) for i in range(1, len(s) - 1)]
                elif len(s) <= n:
                    nodes = [(tuple(s), 0)]
                    whole.add((log, n, tuple(s)))
                else:
                    nodes = [(tuple(s[i : i + n]), i) for i in range(len(s) - n + 1)]
                for node, i in nodes:
                    freq[log, n, node] += 1
                    if i + n < len(s):
                        after[log, n, node].add(s[i + n])
            # what follows an activity at any place, the padding's own included
            for i in range(len(s) - 1):
                after[log, 1, (s[i],)].add(s[i + 1])
    out = {}
    for (log, n, node), f in freq.items():
        done = (log, n, node) in whole
        out[log, n, node] = (f, 0 if done or n == most else len(after[log, n, node]), done)
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_all_orders_are_the_orders(spark, parts):
    """Repeated and short traces, empty ones, labels that look like the padding, one log with a third of all traces equal; over one partition and several."""
    rng = random.Random(3)
    logs = {
        "mixed": [[rng.choice("ab") for _ in range(rng.randrange(12))] for _ in range(120)],
        "hot": [["a", "b", "a", "c"]] * 60 + [["a"], [], ["START", "a", "END"], ["END"]],
        "long": [[rng.choice("abc") for _ in range(200)], list("ab" * 40)],
    }
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {(r.log, r.n, tuple(r.node)): (r.freq, r.children, r.is_complete) for r in orders.all_orders(traces(spark, logs), 6).collect()}
        assert got == brute(logs, 6)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert orders.all_orders(traces(spark, logs).limit(0), 6).count() == 0


def test_totals_of_grouping_sets(spark):
    """A type of two logs counts once where logs are taken together."""
    logs = {"x": [["a", "b"]] * 3 + [["a"]], "y": [["a", "b"], ["c"]]}
    got = {(r.log, r.n): (r.level, r.types, r.occurrences, r.median_freq) for r in orders.totals(traces(spark, logs), 2).collect()}
    assert got["x", 1] == ("log_order", 2, 7, 3.5) and got["y", 1] == ("log_order", 3, 3, 1.0) and got[None, 1] == ("order", 3, 10, 1.0)
    assert got["x", None][:3] == ("log", 6, 18) and got[None, None][0] == "all" and got[None, None][2] == got["x", None][2] + got["y", None][2]
    assert got[None, None][1] == got[None, 1][1] + got[None, 2][1] == 3 + 6 and len(got) == 9


def test_sql_functions_are_their_twins(spark):
    """Lateral table functions give what the DataFrame operators give, with no Python in the plan."""
    df = traces(spark, {"x": [["a", "b", "c", "a"], ["a"], []], "y": [["b", "c"]]})
    sql.register(spark)
    for n in (1, 2, 3, 4, 20):
        asked = spark.sql("SELECT log, case_id, pos, node, is_complete FROM {t}, LATERAL trace_ngrams(seq, " + str(n) + ")", t=df)
        twin = tr.occurrences(df, f"n{n}").select("log", "case_id", "pos", "node", "is_complete")
        assert sorted(map(str, map(tuple, asked.collect()))) == sorted(map(str, map(tuple, twin.collect())))
        assert "Python" not in asked._jdf.queryExecution().executedPlan().toString()
    pairs = spark.sql("SELECT log, src, dst FROM {t}, LATERAL trace_links(seq)", t=df).collect()
    assert sorted(map(tuple, pairs)) == [("x", "a", "b"), ("x", "b", "c"), ("x", "c", "a"), ("y", "b", "c")]
    assert spark.sql("SELECT * FROM {t}, LATERAL trace_attachments(seq, completion, 2)", t=df).count() == 0


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_totals_expand_the_histogram(spark):
    """Grouping sets copy rows of distinct frequencies, not types, and nothing counts distinct types in them; a type of three logs counts once."""
    logs = {"x": [["a", "b"]] * 3, "y": [["a", "b"], ["c"]], "z": [["a"], ["a", "b"]]}
    out = orders.totals(traces(spark, logs), 3)
    assert "distinct" not in plan(out) and "order_node" not in plan(out)
    nodes = {k: f for k, (f, _, _) in brute(logs, 3).items()}
    for r in out.collect():
        mine = {k: f for k, f in nodes.items() if r.log in (None, k[0]) and r.n in (None, k[1])}
        assert (r.types, r.occurrences) == (len({k[1:] for k in mine}), sum(mine.values()))
    assert orders.totals(traces(spark, logs).limit(0), 3).count() == 0


def test_all_orders_build_traces_once(spark):
    """Suffixes and short traces come from one table of different traces; events are put in order without a comparator called row by row."""
    events = spark.createDataFrame([("l", str(i % 9), i, "ab"[i % 2], None) for i in range(50)], "log string, case_id string, o long, activity string, ts timestamp")
    rows = tr.traces(events)
    assert "lambda" not in plan(rows)
    assert {r.case_id: r.seq for r in rows.collect()} == {str(c): ["ab"[i % 2] for i in range(c, 50, 9)] for c in range(9)}
    assert "collect_list" not in plan(orders.all_orders(rows, 4))
    one = tr.counted(rows).collect()
    assert sorted((tuple(r.seq), r.w) for r in one) == sorted({s: [tuple(x.seq) for x in rows.collect()].count(s) for s in {tuple(x.seq) for x in rows.collect()}}.items())
    for c in ("variants", "activities", "n3"):
        assert sorted(map(str, tr.counted_frequencies(tr.counted(rows), c).collect())) == sorted(map(str, tr.frequencies(rows, c).collect()))


def test_queries_build_traces_once(spark):
    """The plans that are left when traces have been built don't gather events again."""
    from tracefold.plans import orders as queries

    for name in ("sql_ngrams", "sketch_ranges"):
        assert "collect_list" not in plan(queries.QUERIES[name](spark, "/root/testdata/sf0.001"))
