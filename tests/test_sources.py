from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from tracefold.functions import text
from tracefold.operators import attributes, simulate
from tracefold.operators import traces as tr
from tracefold.sources import logs, sinks
from tracefold.streaming import sessions

XES = """<?xml version="1.0"?><log><classifier name="Activity classifier" keys="concept:name lifecycle:transition"/>
<trace><string key="concept:name" value="t1"/><string key="color" value="red"/>
<event><string key="concept:name" value="B"/><date key="time:timestamp" value="2020-01-01T02:00:00.000+00:00"/><string key="lifecycle:transition" value="complete"/></event>
<event><string key="concept:name" value="A"/><date key="time:timestamp" value="2020-01-01T01:00:00.000+00:00"/><string key="org" value="x"/></event>
<event><string key="concept:name" value="C"/><date key="time:timestamp" value="2020-01-01T02:00:00.000+00:00"/></event></trace>
<trace><string key="color" value="blue"/></trace></log>"""


@pytest.mark.parametrize("packed", [False, True])
def test_xes(spark, tmp_path, packed):
    path = tmp_path / ("l.xes.gz" if packed else "l.xes")
    path.write_bytes(gzip.compress(XES.encode()) if packed else XES.encode())
    rows = logs.read_xes(spark, str(path), "l")
    assert rows.count() == 2
    keys = logs.classifier_keys(spark, str(path))
    assert keys == ["concept:name", "lifecycle:transition"]
    flat = logs.flatten(rows, keys).orderBy("event_pos").collect()
    assert [r.activity for r in flat] == ["A+", "B+complete", "C+"]
    assert sorted(r.case_id for r in rows.collect()) == ["case_1", "t1"]
    got = {r.attribute: r.value for r in attributes.case_table(rows).collect()}
    assert got == {"color": "red", "org__first": "x"}


def test_xes_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("c1", ["a", "b"]), ("c2", ["x"])], "case_id string, seq array<string>")
    sinks.save_xes(rows, str(tmp_path / "out"))
    back = logs.flatten(logs.read_xes(spark, str(tmp_path / "out"), "l")).orderBy("case_id", "event_pos").collect()
    assert [(r.case_id, r.activity) for r in back] == [("c1", "a"), ("c1", "b"), ("c2", "x")]


def test_attachments_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("2020-01-01", i, n) for i, n in enumerate(["NA", "null", "a,b", "None"])], sinks.ATTACHMENT)
    for csv in (False, True):
        sinks.save_attachments(df, str(tmp_path / f"a{csv}"), csv)
        assert [r.node_id for r in sinks.load_attachments(spark, str(tmp_path / f"a{csv}"), csv).collect()] == ["NA", "null", "a,b", "None"]


def test_registry(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text('{"A": {"name": "a", "short_name": "A", "type": "real", "path": "p"}, "B": {"name": "b", "short_name": "B", "type": "synthetic", "path": "q"}}')
    assert [r.key for r in logs.read_registry(spark, str(path)).collect()] == ["A"]
    assert logs.read_registry(spark, str(path), False, False).count() == 0
    with pytest.raises(KeyError):
        logs.registry_path(logs.read_registry(spark, str(path)), "B")


def test_dataset_inputs():
    assert logs.parse_dataset_inputs(["a=x", "b=y=z"]) == [("a", "x"), ("b", "y=z")]
    for bad in (["a"], ["=x"], ["a="], ["a=x", "a=y"]):
        with pytest.raises(ValueError):
            logs.parse_dataset_inputs(bad)


def test_results_replace_their_unit(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = lambda log, v: spark.createDataFrame([(v, "m", "n1", log)], "v int, model string, concept string, log string")
    for log, v in (("a", 1), ("b", 2), ("a", 3)):
        sinks.append_results(rows(log, v), path)
    assert {(r.log, r.v) for r in spark.read.parquet(path).collect()} == {("a", 3), ("b", 2)}
    assert sinks.missing_units(spark.createDataFrame([("a",), ("z",)], "log string"), spark.read.parquet(path), ["log"]).collect()[0].log == "z"


def test_names():
    assert text.concept_of_folder(text.concept_folder("n7")) == "n7" and text.concept_folder("variants") == "variants"
    assert text.xmin_of_folder(text.xmin_folder(1)) == 1 and text.xmin_of_folder(text.xmin_folder(None)) is None
    assert text.config_of_folder(text.config_folder(30, 0.1, 0.1)) == (30, 0.1, 0.1)
    assert text.duration(3723.4) == "1h02m03.4s"


def test_counts_as_text(spark):
    df = spark.createDataFrame([("1,234",), ("5",), (" ",), ("x",)], "t string")
    assert [r[0] for r in df.select(text.parse_count(F.col("t"))).collect()] == [1234.0, 5.0, None, None]


def test_simulation_is_seeded(spark):
    cases = spark.range(50).select(F.col("id").cast("string").alias("case_id"))
    model = simulate.parallel_xor_model(2, 3, 2)
    a, b = ({r.case_id: r.seq for r in simulate.process_traces(cases.repartition(n), model, seed=9).collect()} for n in (1, 5))
    assert a == b
    assert all(s[0] == "start" and s[-1] == "parallel_block_complete" and s.count("loop_back") == s.count("parallel_block_complete") - 1 for s in a.values())
    nodes, edges = simulate.bpmn(spark, model)
    assert nodes.where("kind = 'task'").count() == 12 and edges.where("src = 'start'").count() == 1
    timed = simulate.timed(cases.limit(2).select("case_id", F.array(F.lit("a"), F.lit("b")).alias("seq"))).orderBy("case_id", "event_pos").collect()
    assert timed[0].ts < timed[1].ts


def test_markov_walks_end(spark):
    edges = spark.createDataFrame([("START", "a", 1.0), ("a", "a", 0.5), ("a", "END", 1.0)], "src string, dst string, cum_p double")
    got = simulate.markov_replay(spark.range(30).select(F.col("id").cast("string").alias("case_id")), edges, 3).collect()
    assert len(got) == 30 and all(set(r.seq) == {"a"} and len(r.seq) <= 30 for r in got)


def test_stream_counts_closed_sessions(spark, tmp_path):
    rows = [(i, f"2020-01-01 {h:02d}:{m:02d}:00", u, t) for i, (h, m, u, t) in enumerate([(0, 0, 1, "a"), (0, 10, 1, "b"), (5, 0, 1, "a"), (0, 0, 2, "a"), (0, 5, 2, "b"), (23, 0, 9, "z")])]
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string").select("event_id", F.to_timestamp("t").alias("ts"), "user_id", "event_type")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    sessions.run_available(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert {r.node: r.freq for r in sessions.merged(spark, str(tmp_path / "out")).collect()} == {"a|b": 2, "a": 1}


def test_collisions_are_reported(spark):
    df = spark.createDataFrame([("l", ["START", "a"])], "log string, seq array<string>")
    assert [r.label for r in tr.boundary_collisions(df).collect()] == ["START"]
