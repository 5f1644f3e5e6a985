"""Saved runs found by their places: types of shards, both sources reconciled, and the paired audit that they feed."""

from __future__ import annotations

import pytest

from tracefold.operators import paired
from tracefold.sources import runs


def put(root, place, text):
    path = root / place
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_types_come_back(spark, tmp_path):
    """Shards with gaps, other columns in other order, quoted cells, no rows, no line at all."""
    put(tmp_path, "a.csv", 'log,valid,n,share,label,mixed,late\nA,True,12,0.5,"x, ""y""",1,NA\n')
    put(tmp_path, "b.csv", "valid,log,n,share,label,mixed,gap\n,B,,,NA,text,\n")
    put(tmp_path, "c.csv", "log,valid,n,share,label,mixed,frac\nC,False,7,2,,2,1.0\nD,True,8,3,z,3,2.5\n")
    put(tmp_path, "none.csv", "")
    put(tmp_path, "header.csv", "log,valid\n")
    rows = runs.read_shards(spark, str(tmp_path))
    types = runs.column_types(rows)
    assert types == {"log": "string", "valid": "boolean", "n": "bigint", "share": "double", "label": "string", "mixed": "bigint", "late": "string", "gap": "string", "frac": "double"}
    got = {r.log: r.asDict() for r in runs.combined_shards(spark, str(tmp_path), ["log", "absent"]).collect()}
    assert list(got) == ["A", "B", "C", "D"]
    assert got["A"] == {"log": "A", "valid": True, "n": 12, "share": 0.5, "label": 'x, "y"', "mixed": 1, "late": "NA", "gap": None, "frac": None}
    assert (got["B"]["valid"], got["B"]["n"], got["B"]["share"], got["B"]["label"]) == (None, None, None, "NA") and got["D"]["frac"] == 2.5


def test_whole_and_boolean_columns_with_gaps(spark):
    """Within one shard a gap hides the type; another shard without gaps shows it; a fraction anywhere makes the column decimal."""
    frame = lambda rows: spark.createDataFrame(rows, "_file string, b string, i string, f string")
    assert runs.column_types(frame([("1", "True", "1", "1"), ("1", "NA", "NA", "")])) == {"b": "string", "i": "double", "f": "double"}
    both = frame([("1", "True", "1", "1"), ("1", "NA", "NA", ""), ("2", "false", "3", "4"), ("3", "1.0", "398.0", "0.5")])
    assert runs.column_types(both) == {"b": "boolean", "i": "bigint", "f": "double"}
    assert [tuple(r)[1:] for r in runs.typed(both, runs.column_types(both)).collect()] == [(True, 1, 1.0), (None, None, None), (False, 3, 4.0), (True, 398, 0.5)]


HEADER = "log_name,xmin,n_fitted_types,fit_valid,gof_p,gof_kind\n"


@pytest.fixture
def study(tmp_path):
    def one(setting, concept, shards, combined=None, model="lower_bounded_power_law"):
        for name, text in shards.items():
            put(tmp_path, f"{setting}/raw_results/{concept}/{model}/log-results/summary_{name}.csv", HEADER + text)
        if combined is not None:
            put(tmp_path, f"{setting}/raw_results/{concept}/{model}/summary.csv", HEADER + combined)

    good = "{},{},60,True,{},refit_all_parameters\n"
    for setting, xmin in (("xmin01", 1), ("xmin02", 2), ("xmin-adaptive", 5)):
        one(setting, "variants", {}, "".join(good.format(n, xmin, 0.5) for n in "ABCDE"))
        one(setting, "n001", {n: good.format(n, xmin, 0.01) for n in "AB"}, good.format("A", xmin, 0.01 + 1e-10) + good.format("C", xmin, 0.01))
    one("xmin01", "n002", {"A": good.format("A", 1, 0.3), "B": good.format("B", 2, 0.3), "D": good.format("D", 1, 0.2) * 2, "E": "E,,,False,,skipped_invalid_fit\n"}, good.format("A", 1, 0.4) + good.format("C", 1, 0.9) * 2 + good.format("D", 1, 0.2))
    put(tmp_path, "xmin01/raw_results/plots/summary.csv", HEADER)
    put(tmp_path, "xmin01/other/summary.csv", HEADER + good.format("A", 1, 0.5))
    return tmp_path


def test_sources_are_found_and_reconciled(spark, study):
    found = runs.discovered(spark, str(study))
    assert {(r.xmin_setting, r.concept, r.model) for r in found.collect()} == {(s, c, "lower_bounded_power_law") for s in ("1", "2", "None") for c in ("n1", "variants")} | {("1", "n2", "lower_bounded_power_law")}
    got = {(r.xmin_setting, r.concept, r.log): r for r in runs.reconciled(found).collect()}
    a = got["1", "n1", "A"]
    assert (a.disagrees, a.repeated, a.gof_p, a.n_fitted_types, a.fit_valid) == (False, False, 0.01, 60, True) and "log-results" in a.input_path
    flags = {log: (r.disagrees, r.repeated) for (s, c, log), r in got.items() if (s, c) == ("1", "n2")}
    assert flags == {"A": (True, False), "B": (False, False), "C": (False, True), "D": (True, True), "E": (False, False)}
    assert runs.reconciled(found.limit(0)).count() == 0


def test_reasons_arise_from_files(spark, study):
    """The audit of all settings: what is repeated, disagrees, was run with another xmin, is invalid, or is nowhere."""
    results = runs.reconciled(runs.discovered(spark, str(study))).withColumnRenamed("n_fitted_types", "n_fitted").drop("model")
    logs = spark.createDataFrame([(n,) for n in "ABCDEF"], "log string")
    audit = paired.settings_audit(results, logs, ks=(1, 2), min_types=(50,), gofs=(0.1,))
    rows = {(r.xmin_setting, r.k, r.log): r for r in audit.collect()}
    assert len(rows) == 3 * 2 * 6
    assert {n: rows["1", 2, n].reasons_k for n in "ABCDEF"} == {
        "A": "incompatible_run_configuration", "B": "incompatible_xmin_configuration", "C": "duplicate_results", "D": "duplicate_results;incompatible_run_configuration",
        "E": "invalid_fit;n_fitted_types_missing;gof_p_unavailable", "F": "missing_result"}
    one = rows["None", 1, "A"]
    assert (one.included, one.outcome_k, one.outcome_variants, one.fitted_xmin_k, one.xmin_policy, one.source_experiment) == (True, 0, 1, 5.0, "adaptive", "xmin-adaptive")
    assert rows["1", 2, "A"].gof_p_k is None and rows["2", 1, "B"].source_experiment == "xmin02" and rows["2", 2, "A"].reasons_k == "missing_result"
    grid = {(r.xmin_setting, r.k): r for r in paired.paired_grid(audit, ["xmin_setting"]).collect()}
    assert (grid["2", 1].n01, grid["2", 1].n_logs, grid["2", 1].excluded_k) == (3, 6, "missing_result=3") and grid["None", 2].status == "unavailable"


def test_published_table(spark):
    """Eight statistics in order; an order without pairs is blank but counts in its families."""
    cells = spark.createDataFrame([(k, 1, 5 if k == 1 else 3, 1, 1) if k != 4 else (4, 0, 0, 0, 0) for k in range(1, 21)], "k int, n00 long, n01 long, n10 long, n11 long")
    effects = paired.paired_effects(cells)
    table = paired.paper_table(effects)
    assert table.columns == ["statistic", *(f"k={k}" for k in range(1, 21))]
    rows = table.collect()
    assert [r.statistic for r in rows] == list(paired.PAPER_ROWS)
    by = {r.statistic: r for r in rows}
    raw = {r.k: r.p_value for r in effects.collect()}
    assert by["paired_N"]["k=4"] == 0 and by["difference_pp"]["k=4"] is None and by["difference_pp"]["k=1"] == pytest.approx(50.0)
    assert by["mcnemar_p_holm_k_le_3"]["k=1"] == pytest.approx(min(1, 3 * raw[1])) and by["mcnemar_p_holm_k_le_20"]["k=1"] == pytest.approx(min(1, 20 * raw[1]))
    assert by["mcnemar_p_holm_k_le_3"]["k=4"] is None and by["mcnemar_p_holm_k_le_10"]["k=11"] is None and by["mcnemar_p_holm_k_le_20"]["k=4"] is None
