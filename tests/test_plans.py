"""Shapes of physical plans: exchanges, pruned scans, pushed filters. (What all plans must avoid is checked in
test_queries.)"""

import re

import pytest

import __spark_entry__ as entry
from comparison import plan
from viewtide.operators import performance
from viewtide.catalogue import Data

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()


def exchanges(text):
    return re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", text)


@pytest.mark.parametrize("name, hashed", [
    ("build_report_daily_adoption", 2),        # (date, report, user), (date, report)
    ("add_time_series_usage_features", 3),     # + report; spine, rolling sums and lag share it
    ("win_days_since", 4),                     # the window for first views is not needed here and pruned
    ("build_user_engagement_features", 7), ("fc_daily_series", 2), ("win_seasonal_naive", 2),
    ("agg_sufficiency", 2)])
def test_exchanges(spark, name, hashed):
    assert exchanges(plan(QUERIES[name](spark, SF))).count("hashpartitioning") == hashed


@pytest.mark.parametrize("name, columns", [
    ("agg_adoption_rows", {"ts", "event_type", "user_id"}), ("agg_adoption_sum", {"l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_linestatus", "l_returnflag", "p_partkey", "p_brand"}),
    ("fn_normalize", {"event_id", "ts"})])
def test_scans_read_needed_columns_only(spark, name, columns):
    read = re.findall(r"ReadSchema: struct<(.*?)>\n", plan(QUERIES[name](spark, SF), "formatted") + "\n")
    assert read and all({c.split(":")[0] for c in r.split(",")} <= columns for r in read)


def test_filters_reach_the_scan(spark):
    facts = Data(spark, SF).table("lineitem")
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan(facts.where("l_shipdate >= '2000-01-01'"), "formatted")


def test_one_percentile_path(spark):
    """No size decides the plan: the same operators for a hundred rows and for a million."""
    shapes = set()
    for n in (100, 1_000_000):
        loads = spark.range(n).selectExpr("date'2025-01-01' AS date", "'R' AS report_id", "double(id) AS load_time")
        shapes.add(tuple(re.findall(r"\b(?:HashAggregate|SortMergeJoin|Window|Exchange)\b", plan(
            performance.build_report_performance_features(loads), "simple"))))
    assert len(shapes) == 1


@pytest.mark.parametrize("name", ["fc_daily_series", "win_train_test", "win_naive_last", "win_seasonal_naive", "agg_backtest_errors"])
def test_calendar_days_are_never_sorted(spark, name):
    """One sort, of the days with usage; what is stretched to calendar days is read through."""
    text = plan(QUERIES[name](spark, SF))
    above = text[:text.index("Generate explode(sequence")]
    assert text.count("Sort [") == 1 and "Sort [" not in above and "Window [" not in above


@pytest.mark.parametrize("name, hashed", [
    ("fc_metrics", 2), ("fc_accept", 2), ("union_series", 4), ("fc_history", 4), ("filter_future_rows", 4)])
def test_stand_in_joins_nothing(spark, name, hashed):
    """Forecast and actual come on one row: no join by report and step, no sort but that of the days with usage."""
    text = plan(QUERIES[name](spark, SF))
    assert "Join" not in text.replace("BroadcastHashJoin [l_partkey", "") and exchanges(text).count("hashpartitioning") == hashed


@pytest.mark.parametrize("name", ["fc_realized", "join_unseen_keys", "join_forecast_actuals", "except_existing_keys"])
def test_histories_start_from_days_with_usage(spark, name):
    """The forecasts of a history come from the series step: no numbering or collecting of calendar days."""
    text = plan(QUERIES[name](spark, SF))
    assert "Generate explode(sequence" in text and "row_number" not in text and "collect_list" not in text
