"""XES files in many ranges: every trace once, in its place."""

from __future__ import annotations

import gzip

import pytest

from tracefold.sources import sinks, xes
from tracefold.sources.logs import flatten, read_xes

HEAD = """<?xml version="1.0" encoding="{}"?>
<log xes.version="1.0" xmlns="http://www.xes-standard.org/">
<extension name="Concept" prefix="concept" uri="http://c"/><classifier name="Activity classifier" keys="concept:name lifecycle:transition"/>
<!-- <trace> in a comment <trace></trace> -->
"""


def trace(i, events=3, name=True):
    said = "".join(f'<event><string key="concept:name" value="a{(i + k) % 4} &lt;é&gt;"/><date key="time:timestamp" value="2020-01-01T0{(k * 5) % 9}:00:00.000+00:00"/><int key="n" value="{k}"><string key="deep" value="x"/></int></event>' for k in range(events))
    own = f'<string key="concept:name" value="t{i}"/>' if name else ""
    return f'<trace>{own}<string key="kind" value="k{i % 2}"/><string key="kind" value="again"/>{said}</trace>\n'


def written(path, text, encoding="utf-8"):
    data = text.encode(encoding)
    path.write_bytes(gzip.compress(data) if path.suffix == ".gz" else data)


@pytest.fixture
def folder(tmp_path):
    long = trace(3, 400)
    written(tmp_path / "b.xes", HEAD.format("UTF-8") + "".join(trace(i) for i in range(20)) + long + "<trace/>\n<trace ></trace><!-- <trace>x</trace> -->" + trace(99, 0, False) + "</log>")
    written(tmp_path / "a.xes", HEAD.format("ISO-8859-1") + "".join(trace(i) for i in range(100, 110)) + "</log>", "latin-1")
    written(tmp_path / "c.xes.gz", HEAD.format("UTF-8") + "".join(trace(i) for i in range(200, 230)) + "</log>")
    written(tmp_path / "empty.xes", HEAD.format("UTF-8") + "</log>")
    (tmp_path / "_SUCCESS").write_text("")
    return tmp_path


@pytest.mark.parametrize("size", [1 << 25, 5000, 700])
def test_ranges_keep_the_order(spark, folder, size):
    rows = xes.read_xes_ranges(spark, str(folder), "l", size).orderBy("case_pos").collect()
    names = [f"t{i}" for i in range(100, 110)] + [f"t{i}" for i in range(20)] + ["t3", "case_31", "case_32", "case_33"] + [f"t{i}" for i in range(200, 230)]
    assert [r.case_id for r in rows] == names and [r.case_pos for r in rows] == list(range(len(names)))
    first = rows[0]
    assert first.case_attrs == {"concept:name": "t100", "kind": "k0"} and [e.attrs["n"] for e in first.events] == ["0", "2", "1"] and first.events[0].attrs["concept:name"] == "a0 <é>"
    assert len(rows[30].events) == 400 and rows[31].events == [] == rows[32].events and rows[33].case_attrs == {"kind": "k1"}


def test_same_as_the_xml_reader(spark, folder):
    path = str(folder / "b.xes")
    one = {r.case_id: r for r in read_xes(spark, path, "l").where("case_id like 't%'").collect()}
    two = {r.case_id: r for r in xes.read_xes_ranges(spark, f"file://{path}", "l", 4000).where("case_id like 't%'").collect()}
    assert set(one) == set(two)
    for k in one:
        assert [(e.ts, e.pos, e.attrs) for e in one[k].events] == [(e.ts, e.pos, e.attrs) for e in two[k].events]


def test_headers(spark, folder):
    got = {r.file.rpartition("/")[2]: r for r in xes.xes_header(spark, str(folder)).collect()}
    assert sorted(got) == ["a.xes", "b.xes", "c.xes.gz", "empty.xes"]
    assert all(r.classifiers == {"Activity classifier": "concept:name lifecycle:transition"} and r.extensions == {"concept": "http://c"} for r in got.values())


def test_round_trip(spark, tmp_path):
    traces = spark.createDataFrame([("l", f"c{i}", [f"a{k}" for k in range(i % 5)]) for i in range(40)], "log string, case_id string, seq array<string>").repartition(3)
    sinks.save_xes(traces, str(tmp_path / "out"))
    got = flatten(xes.read_xes_ranges(spark, str(tmp_path / "out"), "l", 900)).groupBy("case_id").count()
    assert {r["case_id"]: r["count"] for r in got.collect()} == {f"c{i}": i % 5 for i in range(40) if i % 5}


def test_broken_logs(spark, tmp_path):
    (tmp_path / "x.xes").write_text("<log><trace><string key='concept:name' value='a'/>")
    with pytest.raises(Exception, match="has no end"):
        xes.read_xes_ranges(spark, str(tmp_path / "x.xes"), "l").collect()
    with pytest.raises(Exception, match="nowhere"):
        xes.read_xes_ranges(spark, str(tmp_path / "nowhere"), "l").collect()
