"""Every query of the catalogue against its SQL counterpart, on the smallest scale factor.

The corpus queries, where they are installed, have tests of their own.

VIEWTIDE_SF picks another directory.
"""

import os

import pytest

import __spark_entry__ as entry
import comparison

SF = os.environ.get("VIEWTIDE_SF", "/root/testdata/sf0.001")
QUERIES, SQL = entry.catalogue.spark_queries(), entry.catalogue.sql_queries()
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
         "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


MODEL_SEARCH = {"fc_model", "fc_backtest_rows", "fc_future_rows", "fc_failure_row", "fc_run", "run_forecasts", "fc_scores",
                "fc_choice", "fc_backtest_fixed", "fc_future_fixed", "fc_run_fixed"}


def check_plan(name, text):
    """No nested loops, and Python in the model search only."""
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert name in MODEL_SEARCH or "Python" not in text


@pytest.fixture(scope="module")
def con():
    return comparison.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    check_plan(name, comparison.plan(df))
    types = comparison.sql_types(con, SQL[name])
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    assert comparison.spark_rows(df) == comparison.sql_rows(con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, name):
    df = QUERIES[name](spark, SF)
    check_plan(name, comparison.plan(df))
    assert df.columns and df.count() >= 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["date", "report_id", "daily_views", "unique_viewers", "views_per_user", "views_7d", "views_28d",
                          "viewers_7d", "viewers_28d", "wow_change_views"]
    assert df.count() > 0
