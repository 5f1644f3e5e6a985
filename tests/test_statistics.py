from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefold.functions import zeta
from tracefold.operators import attributes, decision, paired, powerlaw, sensitivity, xmin_scan

# Newcombe 1998, table III, method 10: both, first, second, neither, lower, upper.
TABLE_III = [
    (36, 12, 2, 0, 0.0569, 0.3404), (20, 12, 2, 16, 0.0562, 0.3292), (18, 12, 2, 18, 0.0562, 0.3290), (36, 14, 0, 0, 0.1528, 0.4167), (35, 14, 0, 1, 0.1461, 0.4175), (18, 14, 0, 18, 0.1441, 0.3963),
    (2, 97, 1, 0, 0.8721, 0.9854), (1, 97, 1, 1, 0.8736, 0.9850), (0, 29, 1, 0, 0.6666, 0.9882), (2, 98, 0, 0, 0.9178, 0.9945), (1, 98, 0, 1, 0.9171, 0.9916), (0, 30, 0, 0, 0.8395, 1.0),
    (54, 0, 0, 0, -0.0664, 0.0664), (53, 0, 0, 1, -0.0729, 0.0729), (30, 0, 0, 24, -0.0358, 0.0358), (29, 0, 0, 25, -0.0354, 0.0354), (28, 0, 0, 26, -0.0352, 0.0352), (27, 0, 0, 27, -0.0351, 0.0351),
]


def test_newcombe(spark):
    df = spark.createDataFrame(TABLE_III, "e int, f int, g int, h int, lo double, hi double")
    low, high = paired.newcombe(F.col("e"), F.col("f"), F.col("g"), F.col("h"))
    for r in df.select(low.alias("a"), high.alias("b"), "lo", "hi").collect():
        assert r.a == pytest.approx(r.lo, abs=1e-4) and r.b == pytest.approx(r.hi, abs=1e-4)


def test_mcnemar_and_effects(spark):
    cells = spark.createDataFrame([(0, 6, 0, 0), (5, 0, 0, 4), (0, 0, 0, 0), (4, 1, 6, 3), (4, 6, 1, 3)], "n00 int, n01 int, n10 int, n11 int")
    got = {(r.n00, r.n01, r.n10, r.n11): r for r in paired.paired_effects(cells).collect()}
    assert got[0, 6, 0, 0].p_value == pytest.approx(0.03125)
    assert (got[5, 0, 0, 4].p_value, got[5, 0, 0, 4].difference, got[5, 0, 0, 4].status) == (1.0, 0.0, "no_discordance")
    assert got[0, 0, 0, 0].p_value is None and got[0, 0, 0, 0].status == "unavailable"
    a, b = got[4, 1, 6, 3], got[4, 6, 1, 3]
    assert a.difference == pytest.approx(-b.difference) and a.lower == pytest.approx(-b.upper) and a.p_value == pytest.approx(b.p_value)


def test_holm_keeps_the_family(spark):
    df = spark.createDataFrame([(0, 1, 0.03125)] + [(0, k, None) for k in range(2, 6)], "f int, k int, p double")
    got = [r.holm_p for r in paired.holm(df, "p", ["f"], "k").orderBy("k").collect()]
    assert got == [pytest.approx(0.15625), None, None, None, None]


def test_preferences(spark):
    rows = [("any", "lognormal", -1.0, 0.05), ("any", "exponential", 5.0, 0.01), ("all", "lognormal", 1.0, 0.05), ("all", "exponential", 2.0, 0.01), ("all", "stretched_exponential", 1.0, 0.02), ("one", "exponential", 2.0, 0.01), ("tpl", "truncated_power_law", -9.0, 0.0), ("tpl", "exponential", 1.0, 0.5)]
    df = spark.createDataFrame(rows, "log string, model_2 string, R double, p double")
    assert {r.log: r.preference for r in decision.preferences(df, ["log"]).collect()} == {"any": "alternative", "all": "power_law", "one": "inconclusive", "tpl": "inconclusive"}
    best = {r.log: (r.best, r.best_R, r.best_p, r.significant) for r in decision.best_distributions(df, ["log"]).collect()}
    assert best == {"any": ("lognormal", -1.0, 0.05, True), "all": ("power_law", None, None, True), "one": ("exponential", 2.0, 0.01, True), "tpl": ("exponential", 1.0, 0.5, False)}
    strict = {r.log: r.significant for r in decision.best_distributions(df, ["log"], 0.02).collect()}
    assert strict["all"] is False


def test_codes(spark):
    rows = [(60, 0.5, True, "alternative", "C"), (60, 0.5, True, "power_law", "D"), (60, 0.5, True, None, "E"), (60, 0.09, True, "power_law", "B"), (49, 0.5, True, "power_law", "A"), (60, None, True, "power_law", "A"), (60, 0.5, False, "power_law", "A")]
    df = spark.createDataFrame(rows, "n int, p double, v boolean, pref string, want string")
    for r in df.select(decision.code(F.col("n"), F.col("p"), F.col("v"), F.coalesce("pref", F.lit("inconclusive"))).alias("got"), "want").collect():
        assert r.got == r.want


def test_endpoint_reasons(spark):
    rows = [("ok", 20, 0.5, True, 1.0, False, False), ("low", 9, 0.5, True, 1.0, False, False), ("bad", 20, 0.5, False, 1.0, False, False), ("nop", 20, None, True, 1.0, False, False), ("out", 20, 1.5, True, 1.0, False, False), ("lock", 20, 0.5, True, 2.0, False, False), ("clash", 20, 0.5, True, 1.0, True, False), ("twice", 20, 0.5, True, 1.0, False, True)]
    df = spark.createDataFrame(rows, "log string, n_fitted int, gof_p double, fit_valid boolean, xmin double, disagrees boolean, repeated boolean").withColumn("concept", F.lit("n1"))
    got = {r.log: (r.reasons, r.outcome) for r in paired.endpoints(df, 10, 0.1, 1.0).collect()}
    assert got["ok"] == ([], 1)
    assert {k: v[0] for k, v in got.items() if k != "ok"} == {"low": ["below_min_fitted_types"], "bad": ["invalid_fit"], "nop": ["gof_p_unavailable"], "out": ["gof_p_out_of_range"], "lock": ["incompatible_xmin_configuration"], "clash": ["incompatible_run_configuration"], "twice": ["duplicate_results"]}


def test_sources_are_reconciled(spark):
    schema = "log string, gof_p double"
    got = {r.log: r for r in decision.reconciled(spark.createDataFrame([("a", 0.1), ("b", 0.2), ("d", 0.1), ("d", 0.1)], schema), spark.createDataFrame([("a", 0.1 + 1e-10), ("b", 0.3), ("c", 0.5)], schema), ["log"], ["gof_p"]).collect()}
    assert not got["a"].disagrees and got["b"].disagrees and not got["c"].disagrees and got["d"].repeated


def test_sensitivity_has_all_settings(spark):
    fits = spark.createDataFrame([("x", c, n, p, True) for c, n, p in (("n1", 60, 0.099), ("variants", 20, 0.5))], "log string, concept string, n_fitted int, gof_p double, fit_valid boolean")
    comps = spark.createDataFrame([("x", "variants", "exponential", 1.0, 0.01)], "log string, concept string, model_2 string, R double, p double")
    got = {r.setting: r for r in sensitivity.category_table(sensitivity.coded(fits, comps)).collect()}
    assert len(got) == 8 and got["baseline"].A == 1 and got["min_types_15"].E == 1 and got["min_types_15"].changed == 1


GOLDEN = (np.array([1, 2, 3, 4, 6, 8.0]), np.array([1155, 10, 2, 1, 1, 1]))


def test_golden_fit():
    alpha, ks = powerlaw.fit_alpha(*GOLDEN, np.array([3.0]), None)
    assert alpha[0] == pytest.approx(2.83121, abs=1e-4) and ks[0] == pytest.approx(0.15789, abs=1e-4)
    full = powerlaw.fit(*GOLDEN, "full_range_power_law")
    assert not full["fit_valid"] and full["ks"] == pytest.approx(1 - 1 / 1170)


def test_recovers_zipf():
    v, n = np.unique(np.random.default_rng(42).zipf(2.0, 1000), return_counts=True)
    for m in powerlaw.MODELS:
        assert abs(powerlaw.fit(v.astype(float), n, m)["alpha"] - 2) < 0.5


def test_power_sums():
    assert powerlaw.power_sum(2.0, 1.0) == pytest.approx(np.pi**2 / 6, abs=1e-10)
    assert powerlaw.power_sum(0.7, 3.0, 500.0) == pytest.approx((np.arange(3, 501.0) ** -0.7).sum(), rel=1e-10)
    assert powerlaw.power_sum(1.0, 2.0, 9.0) == pytest.approx((1 / np.arange(2, 10.0)).sum(), rel=1e-10)


def test_bootstrap_is_independent_of_blocks(spark):
    freqs = spark.createDataFrame([("l", int(f)) for f in np.random.default_rng(1).zipf(2.2, 300)], "log string, freq long")
    fits = xmin_scan.fits(freqs, ["log"], ("lower_bounded_power_law",))
    a, b = (powerlaw.goodness_of_fit(freqs, fits, ["log"], 12, block).first() for block in (3, 12))
    assert (a.gof_p, a.n_success, a.n_failed) == (b.gof_p, b.n_success, b.n_failed)


@pytest.mark.parametrize("bad", [0.0, -1.0, 2.5, float("nan"), float("inf"), None])
def test_bad_frequencies_raise(spark, bad):
    with pytest.raises(Exception, match="positive"):
        powerlaw.histograms(spark.createDataFrame([("l", bad)], "log string, freq double"), ["log"]).collect()


def test_draws_follow_the_law():
    rng = np.random.default_rng(3)
    for alpha, xmin, xmax in ((2.5, 2.0, None), (1.3, 1.0, None), (0.7, 3.0, 50.0)):
        v, c = powerlaw.draw(200_000, alpha, xmin, xmax, rng)
        assert c.sum() == 200_000 and v.min() >= xmin and (xmax is None or v.max() <= xmax)
        z = powerlaw.power_sum(alpha, xmin, xmax)
        for x in (xmin, xmin + 1, xmin + 7):
            assert c[v >= x].sum() / 200_000 == pytest.approx(float(powerlaw.power_sum(alpha, x, xmax) / z), abs=0.005)


def test_fits_together_are_fits_alone():
    rng = np.random.default_rng(9)
    samples = [np.unique(rng.zipf(2.1, size), return_counts=True) for size in (50, 300, 1000)] + [(np.array([1.0]), np.array([1]))]
    for model in powerlaw.MODELS:
        together = powerlaw.fit_many([(v.astype(float), n) for v, n in samples], model)
        assert together[3] is None
        for (v, n), got in zip(samples[:3], together):
            assert got == powerlaw.fit(v.astype(float), n, model)


@pytest.mark.parametrize("args", [{}, {"fixed_xmin": 2}, {"first": 2, "at_once": 1}])
def test_scan_over_tasks_is_the_fit(spark, args):
    """All units at once, over chunks and rounds of pruned candidates, against the kernel that sees a whole unit; one value, one type and two types too."""
    rng, samples = np.random.default_rng(9), {"one": [5] * 9, "single": [7], "pair": [3, 9], "even": [398, 399, 400]}
    for name, (a, size) in {"small": (2.1, 50), "steep": (2.6, 4000), "wide": (1.7, 4000)}.items():
        f = rng.zipf(a, size)
        samples[name] = f[f < 10**9].tolist()
    df = spark.createDataFrame([(u, int(v)) for u, f in samples.items() for v in f], "log string, freq long")
    got = {(r.log, r.model): r.asDict() for r in xmin_scan.fits(df, ["log"], **args).collect()}
    assert len(got) == len(samples) * len(powerlaw.MODELS)
    for (u, m), r in got.items():
        v, n = np.unique(samples[u], return_counts=True)
        want = powerlaw.fit(v.astype(float), n, m, args.get("fixed_xmin")) or {"fit_valid": False, "alpha": None}
        assert {k: r[k] for k in want} == {k: pytest.approx(w, abs=1e-5 if k == "alpha" else 1e-7) if isinstance(w, float) else w for k, w in want.items()}, (u, m)


def test_many_chunks_and_few_pairs(spark):
    """20,000 distinct frequencies in many chunks: the winner is that of all pairs, though most candidates are never measured."""
    x = np.arange(1, 20_001)
    n = np.maximum(1, (3e6 * (x + 3.0) ** -2.3)).astype(int)
    df = spark.createDataFrame([("u", int(a), int(b)) for a, b in zip(x, n, strict=True)], "log string, freq long, n long")
    rows = df.select("log", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(3)))).alias("i"), "freq").drop("i")
    sums = xmin_scan.tail_sums(rows, ["log"])
    found, chunks = xmin_scan.candidates(sums, ["log"], ("lower_bounded_power_law",), None)
    assert chunks.count() == 10
    scanned = xmin_scan.scanned(found, chunks, ["log"])
    best, measured = scanned.agg(F.min("ks")).first()[0], scanned.where("ks is not null").count()
    counts = np.minimum(n, 3)
    alpha, ks = powerlaw.fit_alpha(x[19_000:].astype(float), counts[19_000:], x[19_000:-1].astype(float), None)
    assert 0 < measured < 15_000 and scanned.where(F.col("ks").isNull() & (F.col("bound") < best - 1e-9)).isEmpty() and best <= ks.min() + 1e-9


def test_native_power_sums(spark):
    cases = [(2.0, 1.0, None), (3.7, 5.0, None), (0.7, 3.0, 500.0), (1.0, 2.0, 9.0), (1.0, 2.0, 90.0), (0.0, 4.0, 7.0), (2.5, 6.0, 6.0), (1.2, 40.0, 1e6)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a double, low double, high double")
    got = {r.i: r for r in df.select("i", zeta.power_sum(F.col("a"), F.col("low"), F.col("high")).alias("s"), F.when(F.col("a") > 1, zeta.power_sum(F.col("a"), F.col("low"))).alias("endless")).collect()}
    for i, (a, low, high) in enumerate(cases):
        assert got[i].s == pytest.approx(float(powerlaw.power_sum(a, low, high)), rel=1e-11)
        assert a <= 1 or got[i].endless == pytest.approx(float(powerlaw.power_sum(a, low)), rel=1e-11)


def test_curve_of_a_saved_fit(spark):
    """The largest gap is the fit's distance, with and without an upper bound; a fit without data from its xmin on has no curve."""
    f = np.random.default_rng(4).zipf(2.0, 900)
    df = spark.createDataFrame([("u", int(v)) for v in f if v < 10**8] + [("low", 1), ("low", 2)], "log string, freq long")
    fits = xmin_scan.fits(df.where("log = 'u'"), ["log"])
    saved = fits.select("log", "model", "alpha", "xmin", "xmax").unionByName(spark.createDataFrame([("low", "m", 2.0, 5.0, None), ("low", "none", None, 1.0, None)], "log string, model string, alpha double, xmin double, xmax double"))
    rows = xmin_scan.saved_fit_curve(df, saved, ["log"]).collect()
    assert {r.log for r in rows} == {"u"}
    for fit in fits.where("fit_valid").collect():
        own = [r for r in rows if r.model == fit.model]
        top = [r for r in own if r.largest]
        assert len(top) == 1 and abs(top[0].gap) == pytest.approx(fit.ks, abs=1e-9) == max(abs(r.gap) for r in own)
        assert min(r.x for r in own) >= fit.xmin and (fit.xmax is None or max(r.x for r in own) == fit.xmax)


def test_attribute_types(spark):
    rows = [(str(i), "v", a, v) for i in range(40) for a, v in (("flag", str(i % 2)), ("amount", f"{1000 + i * 7919 % 97 * 3}"), ("price", f"{i // 2 * 10 + 3}.5"), ("half", f"{i % 2}.0"), ("order_id", f"X{i}"), ("day", f"2020-01-{i % 28 + 1:02d}"), ("kind", "abc"[i % 3]), ("none", None), ("same", "x"))]
    df = spark.createDataFrame(rows, "case_id string, variant string, attribute string, value string")
    got = {r.attribute: (r.inferred_type, r.reason_suggested) for r in attributes.recommend(attributes.inventory(df)).collect()}
    assert {k: v[0] for k, v in got.items()} == {"flag": "boolean", "amount": "identifier-like", "price": "continuous", "half": "categorical", "order_id": "identifier-like", "day": "datetime", "kind": "categorical", "none": "unsupported", "same": "categorical"}
    assert got["same"][1] == "constant or near constant" and got["kind"][1] == "categorical case attribute"


def test_attributes_left_out_by_default(spark):
    names = [("org:resource", "case"), ("cost__last", "event"), ("cost__first", "event"), ("cost", "event"), ("kind", "case"), ("variant", "case")]
    rows = [(str(i), "v", a, level, "abcd"[i % 4]) for i in range(40) for a, level in names]
    df = spark.createDataFrame(rows, "case_id string, variant string, attribute string, level string, value string")
    got = {r.attribute: r.reason_suggested for r in attributes.recommend(attributes.inventory(df)).collect()}
    assert got == {
        "org:resource": "resource", "cost__last": "not a first-value aggregate", "cost__first": "categorical aggregate of an event attribute",
        "cost": "event attribute without an aggregate", "kind": "categorical case attribute"}
    assert [r.attribute for r in attributes.candidates(df).collect()] == ["cost", "cost__first", "cost__last", "kind", "org:resource"]


def test_every_planned_order_is_tested(spark):
    fits = spark.createDataFrame([("x", "n1", 60, 0.5, True), ("x", "variants", 60, 0.01, True), ("y", "variants", 5, 0.5, True)], "log string, concept string, n_fitted int, gof_p double, fit_valid boolean")
    audit = paired.paired_audit(fits, min_types=(50,), gofs=(0.1,))
    got = {(r.log, r.k): (r.reasons_k, r.reasons_variants, r.included) for r in audit.collect()}
    assert len(got) == 10 and got["x", 1] == ("", "", True) and got["y", 1] == ("missing_result", "below_min_fitted_types", False)
    grid = {r.k: r for r in paired.paired_grid(audit).collect()}
    assert sorted(grid) == [1, 2, 3, 4, 20] and grid[1].status == "ok" and grid[1].holm_p == 1.0
    assert grid[20].status == "unavailable" and grid[20].p_value is None and grid[20].excluded_k == "missing_result=2" and grid[1].excluded_variants == "below_min_fitted_types=1"


def test_codes_of_labels(spark):
    from tracefold.functions import text

    rows = [(None, "A"), ("", "A"), ("C", "C"), ("?", "?"), ("PL plausible and favored over alternatives", "D"), ("model invalid (x)", "A"), ("(1) < 30 fitted types; plausible", "A"), ("(2) not plausible (p<0.1)", "B"), ("plausible; alternative preferred", "C"), ("plausible; PL preferred", "D"), ("plausible; inconclusive", "E"), ("nonsense", "A")]
    df = spark.createDataFrame(rows, "label string, want string").select(text.code_of_label(F.col("label")).alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())
    errors = spark.createDataFrame([("Cannot fit this",), ("division",), ("",)], "m string").select(text.error_class(F.col("m"), "KeyError").alias("c"))
    assert [r.c for r in errors.collect()] == ["insufficient observations (Cannot fit this)", "error during fitting (division)", "error during fitting (KeyError)"]


def test_published_order_of_outcomes(spark):
    """The published outcomes of variants, A to E: 6, 3, 1, 0 and 14 of 24 logs."""
    wanted = {"A": 6, "B": 3, "C": 1, "D": 0, "E": 14}
    fits = [(f"{c}{i}", "variants", 10 if c == "A" else 60, 0.01 if c == "B" else 0.5, True) for c, n in wanted.items() for i in range(n)]
    comps = [("C0", "variants", "lognormal", -2.0, 0.01)] + [(f"E{i}", "variants", "exponential", 2.0, 0.01) for i in range(14)]
    f = spark.createDataFrame(fits, "log string, concept string, n_fitted int, gof_p double, fit_valid boolean")
    c = spark.createDataFrame(comps, "log string, concept string, model_2 string, R double, p double")
    row = decision.outcome_counts(decision.classified(f, c, min_types=30)).first()
    assert {k: row[k] for k in "ABCDE"} == wanted


def test_bins_are_right_closed(spark):
    rows = spark.createDataFrame([("1", "v", "a", x) for x in ("0", "5", "5.5", "10", "-1", "", "11")], "case_id string, variant string, attribute string, value string")
    cut = spark.createDataFrame([("a", [0.0, 5.0, 10.0])], "attribute string, edges array<double>")
    got = {r.value: r.bin for r in attributes.binned(rows, cut, nonpositive=False).collect()}
    assert got == {"0": "1", "5": "1", "5.5": "2", "10": "2", "-1": "__MISSING__", "": "__MISSING__", "11": "__MISSING__"}


def test_association_extremes(spark):
    rows = [(str(i), "ab"[i % 2], a, v) for i in range(8) for a, v in (("same", "ab"[i % 2]), ("free", "xy"[i // 2 % 2]), ("one", "z"))]
    df = spark.createDataFrame(rows, "case_id string, variant string, attribute string, value string")
    got = {r.attribute: r for r in attributes.associations(df).collect()}
    assert got["same"].ner == pytest.approx(1) and got["free"].er == pytest.approx(0) and got["one"].status == "not_applicable"


def test_permutations(spark):
    rng = np.random.default_rng(4)
    variants = rng.choice(list("abc"), 200)
    rows = [(str(i), v, a, x) for i, v in enumerate(variants) for a, x in (("same", v), ("free", rng.choice(list("xyz"))), ("one", "z"))]
    df = spark.createDataFrame([tuple(map(str, r)) for r in rows], "case_id string, variant string, attribute string, value string")
    got = {r.attribute: r.p_value for r in attributes.permutation_p(df, 99).collect()}
    assert got["same"] == pytest.approx(0.01) and got["free"] > 0.02 and got["one"] == 1.0
    # the drawn tables have the reductions that real shuffles have
    free = np.array([r[3] for r in rows if r[2] == "free"])
    shuffled = []
    for _ in range(300):
        mixed = rng.permutation(variants)
        table = np.array([[((free == x) & (mixed == v)).sum() for v in "abc"] for x in "xyz"], float)
        p = table / table.sum()
        shuffled.append((p * np.log2(np.where(p > 0, p, 1) / (p.sum(1, keepdims=True) * p.sum(0)))).sum())
    a, b = np.unique(free, return_counts=True)[1], np.unique(variants, return_counts=True)[1]
    drawn = [attributes._drawn_reduction(a, b, rng) for _ in range(300)]
    assert np.mean(drawn) == pytest.approx(np.mean(shuffled), rel=0.2)


def test_broken_tables_are_found(spark):
    fits = spark.createDataFrame([(log, c, 60, 0.5 if log == "x" else 0.01, True) for log in "xyz" for c in ("n1", "n2", "variants")], "log string, concept string, n_fitted int, gof_p double, fit_valid boolean")
    audit = paired.paired_audit(fits)
    grid = paired.paired_grid(audit)
    assert paired.violations(grid, audit).count() == 0
    off = {"difference": F.col("difference") + 0.1, "n_eligible_k": F.col("n_eligible_k") + F.when(F.col("min_types") == 50, 1).otherwise(0), "holm_p": F.col("holm_p") / 2}
    rules = lambda g, a: {r.rule for r in paired.violations(g, a).collect()}
    assert rules(grid.withColumn("difference", off["difference"]), audit) == {"difference"}
    assert rules(grid.withColumn("n_eligible_k", off["n_eligible_k"]), audit) == {"more eligible by a higher bound", "audit and summary differ"}
    assert rules(grid.withColumn("holm_p", off["holm_p"]), audit) == {"adjusted p"}
    assert rules(grid, audit.where("log <> 'x' OR k <> 1")) == {"audit and summary differ"}


def test_records_of_a_run(spark):
    from tracefold.operators import records

    rng = np.random.default_rng(2)
    rows = [("good", float(f)) for f in rng.zipf(2.0, 200)] + [("flat", 1.0)] * 30 + [("bad", 2.5), ("bad", 1.0)]
    out = records.run(spark.createDataFrame(rows, "log string, freq double"), ["log"], ("lower_bounded_power_law", "full_range_power_law"), replicates=4)
    summary = {(r.log, r.model): r for r in out["summary"].collect()}
    assert len(summary) == 6
    good, bad = summary["good", "lower_bounded_power_law"], summary["bad", "full_range_power_law"]
    assert good.fit_valid and good.alpha > 1 and good.gof_kind == "refit_all_parameters" and good.n_types == 200 and good.best_other and good.error is None
    assert bad.alpha is None and bad.code == "A" and bad.error.startswith("error during fitting (")
    flat, raw = summary["flat", "full_range_power_law"], {(r.log, r.model): r for r in out["gof"].collect()}["flat", "full_range_power_law"]
    assert not flat.fit_valid and flat.alpha is None and flat.ks is None and flat.gof_kind == "skipped_invalid_fit" and flat.n_singletons == 30
    assert raw.alpha == 4.0 and raw.ks is not None and raw.gof_p is None and raw.n_success == 0  # blank in the summary only
    assert {r.log for r in out["comparisons"].collect()} == {"good"}


def test_inventory_rows(spark):
    rows = spark.createDataFrame([(f"{i:02d}", "v", "kind", "case" if i else "event", "cabd"[i % 4]) for i in range(9)] + [("00", "v", "cost", "event", None)], "case_id string, variant string, attribute string, level string, value string")
    flat = {r.attribute: r for r in attributes.flat_inventory(attributes.inventory(rows.drop("level")), attributes.examples(rows)).collect()}
    assert flat["kind"].example_values == "c|a|b|d" and flat["cost"].example_values is None
    keys = spark.createDataFrame([("org:role",)], "attribute string")
    assert {r.attribute: r.level for r in attributes.source_levels(rows, keys).collect()} == {"kind": "case", "cost": "event", "org:role": "event"}
    whole = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("b", 1.5), ("c", None)], "g string, x double").groupBy("g").agg(attributes.whole_valued(F.col("x")).alias("w"))
    assert {r.g: r.w for r in whole.collect()} == {"a": True, "b": False, "c": False}


def test_extracted_totals_must_agree(spark):
    from tracefold.operators import saturation

    lengths = spark.createDataFrame([("l", 3, 2, 1), ("l", 5, 1, 1)], "log string, length long, cases long, variants long")
    diagnosed = saturation.diagnose(lengths, (1, 2))
    counts = lambda n: spark.createDataFrame([("l", 1, 11), ("l", 2, n)], "log string, k int, extracted long")
    assert saturation.checked_totals(counts(14), diagnosed).where("agrees").count() == 2
    with pytest.raises(Exception, match="disagree"):
        saturation.checked_totals(counts(15), diagnosed).collect()
    broken = diagnosed.withColumn("excess", F.lit(-1))
    assert saturation.violations(broken).count() == 2 and saturation.violations(diagnosed).count() == 0
    table = saturation.order_table(diagnosed.unionByName(diagnosed.withColumn("log", F.lit("m"))), ks=(1, 2))
    assert [r.log for r in saturation.with_median(table, (1, 2)).collect()][-1] == "median"


def test_registered_bootstraps_are_whole(spark, monkeypatch):
    from tracefold.plans import behaviour, core, outcomes

    seen = []
    gof = powerlaw.goodness_of_fit

    def few(freqs, fits, by, replicates=1000, **_):
        seen.append((replicates, sorted(r.log for r in freqs.select("log").distinct().collect())))
        return gof(freqs, fits, by, replicates=2)

    monkeypatch.setattr(powerlaw, "goodness_of_fit", few)
    monkeypatch.setattr(attributes, "permutation_p", lambda rows, replicates=200: seen.append(replicates))
    assert outcomes.powerlaw_gof(spark, "/root/testdata/sf0.001").count() > 0
    outcomes.powerlaw_outcomes(spark, "/root/testdata/sf0.001")
    behaviour.attribute_permutation(spark, "/root/testdata/sf0.001")
    assert seen == [(1000, sorted(core.LOGS))] * 2 + [200]


def test_replicates_measure_few_pairs(monkeypatch):
    """A sample of many distinct values is fitted without looking at all pairs of a candidate and a value, and the fit is that of all pairs."""
    rng = np.random.default_rng(5)
    x, n = np.unique(np.floor(30 * rng.lognormal(2, 1.2, 1500)) + 1, return_counts=True)
    alpha, ks = powerlaw.fit_alpha(x, n, x[:-1], None)
    pairs, whole = [], powerlaw._distances
    monkeypatch.setattr(powerlaw, "_distances", lambda *a: pairs.append(int((a[-1] - a[-2]).sum())) or whole(*a))
    got = powerlaw.fit(x, n, "lower_bounded_power_law")
    i = int(np.argmin(powerlaw.comparable(ks)))
    assert (got["xmin"], got["alpha"], got["ks"]) == (x[i], alpha[i], ks[i])
    assert sum(pairs) < len(x) ** 2 / 8


def test_replicates_are_many_tasks(spark):
    """Blocks of replicates are dealt to tasks of their own, though they are few bytes."""
    freqs = spark.createDataFrame([("l", 1 + i % 40) for i in range(300)], "log string, freq long")
    fitted = spark.createDataFrame([("l", "lower_bounded_power_law", 1.0, None, 1.6, 0.05, 300, True)], "log string, model string, xmin double, xmax double, alpha double, ks double, n_fitted long, fit_valid boolean")
    out = powerlaw.goodness_of_fit(freqs, fitted, ["log"], replicates=40, block=10)
    assert out.collect()[0].n_success + out.collect()[0].n_failed == 40
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()


def test_log_frequencies_are_built_once(spark):
    """Frequencies of several concepts are a table before they are used, so nothing gathers events again; they are those of each concept alone."""
    from tracefold.operators import traces as tr
    from tracefold.plans import outcomes
    from tracefold.plans.core import log_traces

    got = outcomes._log_frequencies(spark, "/root/testdata/sf0.001", logs=("orders",))
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = log_traces(spark, "/root/testdata/sf0.001", "orders")
    want = tr.frequencies(rows, "variants").unionByName(tr.frequencies(rows, "n3"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
