from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tracefold.sources import results, sinks


def test_saved_results_come_back_as_one(spark, tmp_path):
    rows = spark.createDataFrame([(0.5, "lower_bounded_power_law", c, log) for c in ("n10", "n2", "variants") for log in ("a", "b")], "gof_p double, model string, concept string, log string")
    path = str(tmp_path / "r")
    sinks.append_results(rows, path)
    back = results.stacked(spark, path, "gof_p double, model string, concept string, log string")
    assert back.count() == 6
    assert [r.concept for r in results.for_log(back, "a").collect()] == ["n2", "n10", "variants"]
    assert results.selected(back, ["b"]).count() == 3 and results.selected(back, None).count() == 6


def test_complete_cached_rows_are_kept(spark):
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "log string")
    cached = spark.createDataFrame([("a", 1), ("b", None), ("z", 9)], "log string, n int")
    asked = []

    def compute(units):
        asked.extend(sorted(r.log for r in units.collect()))
        return units.withColumn("n", F.lit(7))

    got = {r.log: r.n for r in results.with_cache(wanted, cached, ["n"], compute).collect()}
    assert got == {"a": 1, "b": 7, "c": 7} and asked == ["b", "c"]


def test_totals_must_agree(spark):
    rows = spark.createDataFrame([("a", "n1"), ("a", "n1"), ("b", "n1")], "log string, concept string")
    saved = spark.createDataFrame([("a", "n1", 2), ("b", "n1", 5)], "log string, concept string, n_occurrences long")
    assert {r.log: r.agrees for r in results.occurrence_totals(rows, saved).collect()} == {"a": True, "b": False}
    with pytest.raises(Exception, match="repeats"):
        results.occurrence_totals(rows, saved.union(saved)).collect()
