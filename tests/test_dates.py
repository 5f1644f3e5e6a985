"""Dates by their shape: layouts, order of day and month, zones, and what is no date."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefold.operators import attributes, dates

VALUES = {
    "iso": (["2020-01-31", "2020-1-5", "2020-02-30", "no"], ["2020-01-31 00:00:00", "2020-01-05 00:00:00", None, None]),
    "day_first": (["31/12/2020", "05/06/2020", "30/01/2021 7:05"], ["2020-12-31 00:00:00", "2020-06-05 00:00:00", "2021-01-30 07:05:00"]),
    "month_first": (["12/31/2020", "05/06/2020", "13/01/2020", "1/20/2020 07:05:09 PM"], ["2020-12-31 00:00:00", "2020-05-06 00:00:00", None, "2020-01-20 19:05:09"]),
    "tied_slash": (["05/06/2020"], ["2020-05-06 00:00:00"]),
    "tied_dot": (["05.06.2020", "5.6.2020 12:30"], ["2020-06-05 00:00:00", "2020-06-05 12:30:00"]),
    "named": (["Fri, 31 Jan 2020", "1 may 2020", "March 3, 2021 10:00", "3. December 2020", "02-FEB-2020"], ["2020-01-31 00:00:00", "2020-05-01 00:00:00", "2021-03-03 10:00:00", "2020-12-03 00:00:00", "2020-02-02 00:00:00"]),
    "zones": (["2020-01-31T10:00:00.123+02:00", "2020-01-31T10:00:00Z", "2020-01-31 10:00:00 +0130", "2020-01-31 10:00 UTC", "2020-01-31T10:00:00,5-03"], ["2020-01-31 08:00:00.123", "2020-01-31 10:00:00", "2020-01-31 08:30:00", "2020-01-31 10:00:00", "2020-01-31 13:00:00.5"]),
    "numbers": (["2011", "20200131", "1.5", "12:30", None, "", "1-2-3", "x" * 5000, "2020-01-31 and more"], [None] * 9),
}


def rows(spark):
    data = [(a, i, v) for a, (values, _) in VALUES.items() for i, v in enumerate(values)]
    return spark.createDataFrame(data, "attribute string, i int, value string")


def test_values_are_parsed_by_their_attributes_layout(spark):
    got = {(r.attribute, r.i): r.t for r in dates.with_moments(rows(spark)).select("attribute", "i", F.col("moment").cast("string").alias("t")).collect()}
    assert got == {(a, i): t for a, (_, times) in VALUES.items() for i, t in enumerate(times)}


def test_layouts(spark):
    found = {(a, s): p for a, s, p, _ in dates.date_layouts(rows(spark))}
    assert found["day_first", "N2/N2/N4"] == "d/M/yyyy" and found["month_first", "N2/N2/N4"] == "M/d/yyyy" == found["tied_slash", "N2/N2/N4"] and found["tied_dot", "N2.N2.N4"] == "d.M.yyyy"
    assert not [k for k in found if k[0] == "numbers"] and dates.date_layouts(rows(spark).limit(0)) == []
    assert dates.with_moments(rows(spark).where("attribute = 'numbers'")).where("moment is not null").isEmpty()


def test_dates_in_the_inventory(spark):
    """Four of five values are dates: a datetime attribute; three of five are not."""
    data = [(str(i), "v", a, v) for a, values in {"most": ["31.12.2020", "1.2.2020", "3.4.2020", "30.1.2021", "soon"], "some": ["2020-01-01", "2020-01-02", "2020-01-03", "a", "b"]}.items() for i, v in enumerate(values)]
    inv = {r.attribute: r.inferred_type for r in attributes.inventory(spark.createDataFrame(data, "case_id string, variant string, attribute string, value string")).collect()}
    assert inv["most"] == "datetime" and inv["some"] != "datetime"


def test_repeated_values_are_shaped_once(spark, monkeypatch):
    """The inventory asks for layouts of different values with their numbers, which decide as all rows would."""
    from tracefold.operators import attributes

    rows = spark.createDataFrame([("1", "v", "d", t) for t in ["13/01/2024"] * 5 + ["01/14/2024", "01/15/2024", "01/16/2024"]] + [("1", "v", "d", None)], "case_id string, variant string, attribute string, value string")
    asked, whole = [], dates.date_layouts
    monkeypatch.setattr(dates, "date_layouts", lambda r, *a: asked.append(r.count()) or whole(r, *a))
    out = attributes.inventory(rows).collect()[0]
    assert asked == [5] and out.n_missing == 1 and out.n_distinct == 4
    assert whole(rows.groupBy("attribute", "value").count(), "count") == whole(rows) and whole(rows)[0][2] == "d/M/yyyy"
