"""Every registered query against DuckDB on the smallest data set, and rules for all plans."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from rosterline.runtime import TABLES

SF_DIR = "/root/testdata/sf0.001"
PLANS, CHECKS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def plain(x):
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return bool(x)
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    return float(x) if not isinstance(x, str) else x


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = PLANS[name](spark, SF_DIR).toPandas(), duck.execute(CHECKS[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(PLANS) - set(CHECKS)))
def test_unchecked_query_runs(spark, name):
    assert PLANS[name](spark, SF_DIR).count() > 0


def test_every_check_belongs_to_a_query():
    assert set(CHECKS) <= set(PLANS)


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "text", "lang", "source", "n_chars", "has_opted_in"]


@pytest.mark.parametrize("name", ["detected_flags", "clean_list", "dashboard_summary", "health_score_by_company", "phrase_matches"])
def test_plans_have_no_cross_join_and_no_python(spark, name):
    plan = PLANS[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython"):
        assert banned not in plan
