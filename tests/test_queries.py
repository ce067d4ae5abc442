"""Every registered query runs; those with SQL give its rows."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from stroma.plans.base import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None)
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


def rows(table) -> Counter:
    names = sorted(table.column_names)
    return Counter(tuple(plain(v) for v in r) for r in zip(*[table[c].to_pylist() for c in names]))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    have = QUERIES[name](spark, SMALL).toArrow()
    want = duck.execute(SQL[name]).to_arrow_table()
    assert sorted(have.column_names) == sorted(want.column_names)
    assert rows(have) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["conjunction_filter"](spark, SMALL)._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "o_custkey" not in plan.split("ReadSchema")[-1].split("\n")[0]


def test_no_cartesian_products_in_range_joins(spark):
    for name in ("asof_strict", "window_counts", "interval_overlap", "follow_rate", "isolated_share", "matched_controls"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
