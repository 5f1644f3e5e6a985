from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tracefold.operators import frequency, saturation
from tracefold.operators import traces as tr

SCHEMA = "log string, case_id string, completion timestamp, seq array<string>"


def log(spark, *seqs):
    return spark.createDataFrame([("l", f"c{i}", None, list(s)) for i, s in enumerate(seqs)], SCHEMA)


def test_windows_equal_weights(spark):
    lengths = range(1, 31)
    rows = log(spark, *([f"a{i}" for i in range(n)] for n in lengths))
    for k in (1, 5, 10, 15, 20):
        got = {r[0]: (r[1], r[2]) for r in rows.select(F.size("seq"), F.size(tr.concept_nodes(F.col("seq"), f"n{k}")), tr.occurrence_weight(F.size("seq"), k)).collect()}
        assert got == {n: (got[n][1], n if k == 1 else max(1, n + 3 - k)) for n in lengths}


def test_concepts(spark):
    rows = log(spark, "a", "", "ab", "abc")
    nodes = lambda c: sorted(tuple(r.node) for r in tr.occurrences(rows, c).collect())
    assert nodes("dfrs") == [("a", "b"), ("a", "b"), ("b", "c")]
    assert nodes("n5") == [("START", "a", "END"), ("START", "a", "b", "END"), ("START", "a", "b", "c", "END")]
    assert nodes("variants") == [("a",), ("a", "b"), ("a", "b", "c")]
    assert len(nodes("activities")) == 6
    with pytest.raises(ValueError):
        tr.concept_nodes(F.col("seq"), "n21")


def test_node_text(spark):
    rows = spark.createDataFrame([(["a", "b"],), (["a"],), (["it's"],), (["it's \"x\""],), (["b\\s"],)], "n array<string>")
    assert [r[0] for r in rows.select(tr.node_text(F.col("n"))).collect()] == [repr(tuple(r.n)) for r in rows.collect()]


def test_saturation_fixture(spark):
    rows = log(spark, "a", "a", "bcde")
    got = {r.k: r for r in saturation.diagnose(saturation.histogram(rows), (1, 5, 10)).collect()}
    assert (got[1].complete_cases, got[1].complete_variants, got[1].n_occurrences, got[1].excess, got[1].excess_per_case) == (2, 1, 6, 3, 1.0)
    assert (got[5].n_cases, got[5].n_variants, got[5].median_length, got[5].max_length, got[5].n_occurrences, got[5].complete_occurrence_share) == (3, 2, 1.0, 4, 4, 0.5)
    assert (got[10].n_occurrences, got[10].complete_case_share, got[10].excess) == (3, 1.0, 0)
    assert saturation.diagnose(saturation.histogram(log(spark, "a", "bb")), (5,)).first().median_length == 1.5


def test_status_rows(spark):
    rows = log(spark, "ab").unionByName(spark.createDataFrame([("e", "c", None, [])], SCHEMA))
    logs = spark.createDataFrame([("l",), ("e",), ("m",)], "log string")
    got = {r.log: r for r in saturation.with_status(logs, saturation.diagnose(saturation.histogram(rows)), rows).where("k = 5").collect()}
    assert [got[x].status for x in "lem"] == ["ok", "empty_log", "missing_log"]
    assert got["e"].n_occurrences is None and got["m"].n_cases is None


def test_statistics_of_empty_traces(spark):
    got = frequency.log_statistics(log(spark, "ab", "", "a")).first()
    assert (got.n_cases, got.n_events, got.n_variants, got.n_activities, got.median_length, got.max_length) == (3, 3, 2, 2, 1, 2)


def test_xmax_candidates(spark):
    freqs = spark.createDataFrame([("l", f) for f in (1, 5, 10, 20, 20, 50)], "log string, freq long")
    got = frequency.xmax_candidates(freqs, ["log"], (0, 1, 2, 3, 99)).orderBy("exclude_k").collect()
    assert [(r.exclude_k, r.xmax, r.excluded) for r in got] == [(0, 50, 0), (1, 20, 1), (3, 10, 3)]


def test_partitions_do_not_matter(spark):
    rows = spark.createDataFrame([("l", f"c{i:03d}", None, list("abcab"[: i % 5 + 1])) for i in range(200)], SCHEMA).withColumn("completion", F.timestamp_seconds(F.lit(1000)))
    results = [[(r.attachment_index, r.node_id) for r in tr.attachments(rows.repartition(n), "n2").orderBy("attachment_index").collect()] for n in (1, 8)]
    assert results[0] == results[1]
    assert [i for i, _ in results[0]] == list(range(len(results[0])))


def test_combined_logs_run_on(spark):
    part = lambda names: spark.createDataFrame([(c, i, "a") for i, c in enumerate(names)], "case_id string, event_pos long, activity string")
    got = tr.combined([part(["x", "y", "x"]), part(["z"])])
    assert sorted(r.case_id for r in got.collect()) == ["case_1", "case_1", "case_2", "case_3"]


def test_pairing_needs_equal_lengths(spark):
    with pytest.raises(ValueError):
        tr.paired_traces(log(spark, "a"), log(spark, "a", "b"), 1)
    got = tr.paired_traces(log(spark, "ab", "c"), log(spark, "d", "e"), 1, "p", "q").collect()
    assert sorted(x for r in got for x in r.seq) == ["p:a", "p:b", "p:c", "q:d", "q:e"]
