"""Mergeable sketches hold their stated error for any range of days, and days merged in any way give what all at once give."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from tracefold.operators import sketches


def traces(spark, n=6000):
    rng = random.Random(1)
    day = lambda i: datetime.datetime(2024, 1, 1 + i % 20, 12)
    rows = [("l" if i % 3 else "m", str(i), None if i % 50 == 0 else day(i), [f"a{int(rng.paretovariate(1)) % 40}" for _ in range(rng.randrange(9))]) for i in range(n)]
    return spark.createDataFrame(rows, "log string, case_id string, completion timestamp, seq array<string>")


def test_estimates_hold_their_error(spark):
    rows = traces(spark).cache()
    kept = sketches.daily(rows).cache()
    assert kept.count() == 40
    for first, last in ((None, None), ("2024-01-03", "2024-01-09"), (None, "2024-01-01"), ("2024-01-20", None)):
        got = {r.log: r for r in sketches.over_days(kept, first, last).collect()}
        days = F.to_date("completion").between(first or "2000-01-01", last or "2100-01-01")
        own = rows.where((F.size("seq") > 0) & days).collect()
        for log, r in got.items():
            mine = [x.seq for x in own if x.log == log]
            lengths, labels = sorted(map(len, mine)), [a for s in mine for a in s]
            assert (r.n_cases, r.n_events) == (len(mine), len(labels))
            assert abs(r.n_variants - len(set(map(tuple, mine)))) <= max(1, sketches.DISTINCT_ERROR * len(set(map(tuple, mine))))
            assert r.n_activities == len(set(labels)) and r.top_activities[0]["count"] == max(labels.count(a) for a in set(labels))
            for q, x in zip((0.25, 0.5, 0.75), r.length_quantiles, strict=True):
                assert sum(v < x for v in lengths) / len(lengths) <= q + sketches.RANK_ERROR and sum(v <= x for v in lengths) / len(lengths) >= q - sketches.RANK_ERROR
    assert sketches.over_days(kept, "2030-01-01").count() == 0 and sketches.daily(rows.limit(0)).count() == 0
    rows.unpersist(), kept.unpersist()
