"""Attributes of semi-structured events, and what counts as missing."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tracefold.operators import attributes
from tracefold.sources import semi

EVENTS = [
    ("a", 0, '{"k": 1, "who": {"name": "x", "at": {"room": 7}}, "tags": [1, {"deep": 2}]}'),
    ("a", 1, '{"k": "text", "who": "plain", "empty": {}, "nothing": null}'),
    ("b", 0, None),
    ("b", 1, "no json"),
    ("b", 2, "[1, 2]"),
    ("b", 3, '{"k": null, "late": {"only": {"here": true}}}'),
    ("b", 4, '{"k": 2.5, "a.b": "dot"}'),
]


def rows(spark, events=EVENTS):
    return semi.parsed(spark.createDataFrame(events, "case_id string, pos int, props string"), "props")


def test_leaves_of_open_objects(spark):
    """Nested keys, values of several types, arrays, nulls, no JSON, nothing."""
    found = {(r.case_id, r.pos, r.attribute): (r.value, r.type) for r in semi.attribute_rows(rows(spark), ["case_id", "pos"]).collect()}
    assert found == {
        ("a", 0, "k"): ("1", "BIGINT"), ("a", 0, "who.name"): ("x", "STRING"), ("a", 0, "who.at.room"): ("7", "BIGINT"), ("a", 0, "tags"): ('[1,{"deep":2}]', found["a", 0, "tags"][1]),
        ("a", 1, "k"): ("text", "STRING"), ("a", 1, "who"): ("plain", "STRING"), ("a", 1, "nothing"): (None, "VOID"), ("b", 3, "k"): (None, "VOID"),
        ("b", 3, "late.only.here"): ("true", "BOOLEAN"), ("b", 4, "k"): ("2.5", found["b", 4, "k"][1]), ("b", 4, "a.b"): ("dot", "STRING"),
    }
    assert semi.attribute_rows(rows(spark, [("a", 0, None)]), ["case_id"]).count() == 0 == semi.attribute_rows(rows(spark).limit(0), ["case_id"]).count()


def test_schema_of_all_rows(spark):
    schema = semi.schema_of(rows(spark, EVENTS[:1] + EVENTS[5:6]))
    assert "late" in schema and "who" in schema and semi.depth_of(schema) == 3
    assert [semi.depth_of(s) for s in ("VOID", "OBJECT<>", "OBJECT<a: BIGINT>", "OBJECT<a: ARRAY<OBJECT<b: OBJECT<c: STRING>>>>", "OBJECT<a: OBJECT<b: STRING>, c: OBJECT<d: OBJECT<e: STRING>>>")] == [0, 1, 1, 1, 3]


def test_first_values_make_a_case_table(spark):
    found = semi.first_of_case(semi.attribute_rows(rows(spark), ["case_id", "pos"]), ["case_id"], F.col("pos"))
    cases = spark.createDataFrame([("a", "v"), ("b", "w"), ("c", "w")], "case_id string, variant string")
    table = {(r.case_id, r.attribute): (r.variant, r.level, r.value) for r in semi.with_absent(found, cases, ["case_id"]).collect()}
    assert table["a", "k__first"] == ("v", "event", "1") and table["b", "k__first"] == ("w", "event", "2.5") and table["c", "k__first"] == ("w", "event", None)
    assert len(table) == 3 * found.select("attribute").distinct().count() and ("a", "nothing__first") not in table
    with pytest.raises(ValueError, match="look like data"):
        semi.with_absent(found, cases, ["case_id"], most=2)


def test_only_nulls_are_missing(spark):
    """Texts are values, whatever they say; a not-a-number is missing."""
    wide = spark.createDataFrame([("1", "nan", float("nan")), ("2", "", 1.5), ("3", None, None)], "id string, label string, x double")
    got = {(r.case_id, r.attribute): r.value for r in attributes.long_form(wide, "id", ["label", "x"]).collect()}
    assert got == {("1", "label"): "nan", ("2", "label"): "", ("3", "label"): None, ("1", "x"): None, ("2", "x"): "1.5", ("3", "x"): None}
    inv = {r.attribute: (r.n_missing, r.n_distinct) for r in attributes.inventory(attributes.long_form(wide, "id", ["label", "x"])).collect()}
    assert inv == {"label": (1, 2), "x": (2, 1)}


def test_classifier_fields_are_no_attributes(spark):
    event = lambda p, **kv: (p, None, {"concept:name": "n", **kv})
    traces = spark.createDataFrame([("l", "c", {"region": "r"}, [event(0, code="A", part="1"), event(1, code="B", cost="")])], "log string, case_id string, case_attrs map<string,string>, events array<struct<pos:long, ts:timestamp, attrs:map<string,string>>>")
    names = lambda **args: sorted((r.attribute, r.value) for r in attributes.case_table(traces, **args).collect())
    assert names() == [("code__first", "A"), ("cost__first", ""), ("part__first", "1"), ("region", "r")]
    assert names(classifier=["code", "part"]) == [("cost__first", ""), ("region", "r")]
