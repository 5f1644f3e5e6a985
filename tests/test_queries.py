"""Each query with SQL gives the same rows in DuckDB; the others run."""

from __future__ import annotations

import pytest

from tests.oracle import assert_same
from tracefold.plans.registry import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(n for n in SQL if not n.startswith(("frequency_n1", "rank_curve_n", "tail_counts_n", "xmax_candidates_n"))))
def test_matches_sql(spark, name):
    assert_same(QUERIES[name](spark, FOLDER), SQL[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
