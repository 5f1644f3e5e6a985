"""Small operators that no query runs: overrides, resolutions, recommendations, value counts, order of logs, reports and the registry."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tracefold.operators import attributes, saturation
from tracefold.sources import sinks
from tracefold.sources.logs import read_registry


def test_overrides_survive_a_new_inventory(spark):
    """Filled override cells stay, blank ones don't count, rows only in the old table go, repeated old rows count once."""
    schema = "attribute string, include string, note string"
    new = spark.createDataFrame([("a", "yes", None), ("b", "no", None), ("c", "yes", "own")], schema)
    old = spark.createDataFrame([("a", "no", "seen"), ("b", " ", ""), ("gone", "yes", "x"), ("c", None, "first"), ("c", "no", "second")], schema)
    got = {r.attribute: (r.include, r.note) for r in attributes.merge_overrides(new, old, ["include", "note"]).collect()}
    assert got == {"a": ("no", "seen"), "b": ("no", None), "c": ("no", "first")}


def test_override_then_suggestion_then_default(spark):
    rows = spark.createDataFrame([("s", "o"), ("s", " "), ("", None), (None, "")], "suggested string, override string")
    c = attributes.resolved(F.col("suggested"), F.col("override"), F.lit("d"))
    assert [r[0] for r in rows.select(c).collect()] == ["o", "s", "d", "d"]
    assert [r[0] for r in rows.select(attributes.resolved(F.col("suggested"), F.col("override"))).collect()] == ["o", "s", None, None]


def test_second_step_recommendation(spark):
    schema = "attribute string, inferred_type string, include_suggested boolean, is_near_constant boolean, n_cases long, n_missing long, n_distinct long, whole_numbers boolean, ner double"
    rows = [
        ("out", "categorical", False, False, 100, 0, 60, False, 0.5), ("date", "datetime", True, False, 100, 0, 60, False, 0.5), ("flat", "continuous", True, True, 100, 0, 60, True, 0.5),
        ("few", "continuous", True, False, 60, 20, 60, True, 0.5), ("kinds", "categorical", True, False, 100, 0, 20, False, 0.5), ("size", "continuous", True, False, 100, 0, 90, True, 0.01),
        ("price", "continuous", True, False, 100, 0, 90, False, 0.2), ("label", "categorical", True, False, 100, 0, 50, False, 0.995),
    ]
    got = {r.attribute: (r.powerlaw_include, r.powerlaw_discrete, r.powerlaw_reason) for r in attributes.recommend_powerlaw(spark.createDataFrame(rows, schema)).collect()}
    assert {k: v[0] for k, v in got.items()} == {"out": False, "date": False, "flat": False, "few": False, "kinds": False, "size": True, "price": True, "label": True}
    assert [got[k][2] for k in ("out", "date", "flat", "few", "kinds")] == ["not included in the first step", "unsuitable type", "near constant", "too few observations", "too few values"]
    assert got["size"][1:] == (True, "magnitudes") and got["price"][1:] == (False, "relevant to variants; magnitudes") and got["label"][1:] == (True, "may encode the variant; frequencies")


def test_value_counts(spark):
    values = spark.createDataFrame([(2.5,), (None,), (2.5,), (1.0,), (None,), (None,)], "x double")
    assert [(r.value, r.n) for r in attributes.value_counts(values, "x").collect()] == [(None, 3), ("2.5", 2), ("1.0", 1)]


def test_logs_in_the_order_of_their_first_row(spark):
    rows = spark.createDataFrame([("b", 3), ("a", 5), ("b", 9), ("c", 1), ("d", 5)], "log string, i int")
    assert {r.log: r.place for r in saturation.log_order(rows, "i").collect()} == {"c": 0, "b": 1, "a": 2, "d": 3}


def test_reports_keep_their_numbers(spark, tmp_path):
    """Doubles come back to the last bit; missing cells and not-a-numbers are written as asked."""
    values = [0.1, 1 / 3, 1e-300, 2.0**53 + 2, float("nan"), None]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double").withColumn("t", F.when(F.col("i") == 0, "a, \"b\""))
    for missing in ("NA", "NaN"):
        sinks.save_report(df.orderBy("i"), str(tmp_path / missing), missing)
        back = spark.read.option("header", True).option("nullValue", missing).option("escape", "\"").schema("i int, x double, t string").csv(str(tmp_path / missing)).orderBy("i").collect()
        assert [r.x for r in back] == [*values[:4], None, None]
        assert len(list((tmp_path / missing).glob("part-*"))) == 1


def test_datasets_are_added_and_replaced(spark, tmp_path):
    root = str(tmp_path / "registry")
    sinks.register_dataset(spark, root, "one", "One", "o", "real", "/1")
    sinks.register_dataset(spark, root, "two", "Two", "t", "synthetic", "/2")
    got = {r.key: r.path for r in sinks.register_dataset(spark, root, "one", "One", "o", "real", "/new").collect()}
    assert got == {"one": "/new", "two": "/2"}
    (tmp_path / "data.json").write_text('{"k": {"name": "N", "short_name": "n", "type": "real", "path": "/p"}}')
    assert [r.key for r in read_registry(spark, str(tmp_path / "data.json")).collect()] == ["k"]
    with pytest.raises(Exception, match="nowhere"):
        read_registry(spark, str(tmp_path / "nowhere")).collect()
