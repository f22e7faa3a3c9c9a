"""Marts against plain-Python brute force on random frames, and on hand-made edge cases."""

import datetime as dt
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from viewtide import (add_time_series_usage_features, build_report_daily_adoption, build_report_performance_features,
                      build_user_engagement_features)
from viewtide.operators import adoption, engagement, performance, quality as Q
from viewtide.plans import marts

DAY0 = dt.date(2025, 1, 1)


def day(i):
    return DAY0 + dt.timedelta(days=i)


@pytest.fixture(scope="module", params=[3, 4])
def events(request):
    """(day, report, user, views): one report has most rows, some rows lack a key, some views are 0."""
    rng = random.Random(request.param)
    rows = []
    for _ in range(3000):
        report = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", "c", None])
        rows.append((day(int(rng.triangular(0, 60, 30))), report, rng.choice([None] + [f"u{i}" for i in range(25)]),
                     rng.choice([0, 0, 1, 2, 3, 8, None])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "date date, report_id string, user_id string, view_count bigint").repartition(5)


def brute_daily(events):
    views, users = defaultdict(int), defaultdict(set)
    for d, r, u, v in events:
        if r is not None:
            views[d, r] += v or 0
            users[d, r] |= {u} - {None}
    return {k: (views[k], len(users[k])) for k in views}


def test_adoption(spark, events):
    got = build_report_daily_adoption(frame(spark, events), views_col="view_count").collect()
    want = brute_daily(events)
    assert {(r.date, r.report_id): (r.daily_views, r.unique_viewers) for r in got} == want
    for r in got:
        assert r.views_per_user == pytest.approx(r.daily_views / r.unique_viewers if r.unique_viewers else 0.0)
    counted = build_report_daily_adoption(frame(spark, events)).agg(F.sum("daily_views")).first()[0]
    assert counted == sum(r is not None for _, r, _, _ in events)


def test_spine_and_rolling(spark, events):
    daily = brute_daily(events)
    last = max(d for d, _ in daily)
    mart = adoption.adoption_mart(frame(spark, events), "date", "report_id", "user_id", "view_count")
    got = {(r.date, r.report_id): r for r in add_time_series_usage_features(mart).collect()}
    want_keys = {(d, rep) for rep in {r for _, r in daily}
                 for d in (min(x for x, y in daily if y == rep) + dt.timedelta(days=i) for i in range(400)) if d <= last}
    assert set(got) == want_keys
    assert sum(r.daily_views for r in got.values()) == sum(v for v, _ in daily.values())
    for (d, rep), r in got.items():
        def value(back, which, d=d, rep=rep):
            return daily.get((d - dt.timedelta(days=back), rep), (0, 0))[which]
        assert (r.daily_views, r.unique_viewers) == (value(0, 0), value(0, 1))
        assert r.views_7d == sum(value(i, 0) for i in range(7)) <= r.views_28d == sum(value(i, 0) for i in range(28))
        assert r.viewers_28d == sum(value(i, 1) for i in range(28))
        ago = d - dt.timedelta(days=7)
        before = value(7, 0) if (ago, rep) in want_keys else None
        assert r.wow_change_views == (pytest.approx((r.daily_views - before) / before) if before else None)
    same = adoption.fill_report_days(build_report_daily_adoption(frame(spark, events), views_col="view_count"))
    assert same.exceptAll(mart).isEmpty() and mart.exceptAll(same).isEmpty()
    assert all(r.passed for r in Q.check_adoption_mart(mart, build_report_daily_adoption(
        frame(spark, events), views_col="view_count")).collect())


def test_engagement(spark, events):
    pages = frame(spark, events).withColumn("page_key", F.lit(1)).withColumnRenamed("view_count", "page_view_count")
    got = {(r.date, r.report_id): r for r in build_user_engagement_features(frame(spark, events), pages).collect()}
    per_user = defaultdict(int)
    for d, r, u, v in events:
        if r is not None and u is not None:
            per_user[d, r, u] += v or 0
    first, per_day = {}, defaultdict(dict)
    for (d, r, u), v in per_user.items():
        first[r, u] = min(d, first.get((r, u), d))
        per_day[d, r][u] = v
    assert set(got) == set(per_day)
    for (d, r), users in per_day.items():
        row, total = got[d, r], sum(users.values())
        size = max(1, math.ceil(len(users) * 0.10))
        assert row.repeat_user_rate == pytest.approx(sum(d > first[r, u] for u in users) / len(users))
        assert row.top_10pct_user_share == pytest.approx(sum(sorted(users.values())[-size:]) / total if total else 0.0)
        active = [x for (x, y), us in per_day.items() if y == r and x < d and sum(us.values()) > 0]
        assert row.days_since_last_use == ((d - max(active)).days if active and total > 0 else 0)
        assert row.avg_pages_per_user == pytest.approx(total / len(users))


def test_engagement_by_fractional_views(spark, events):
    whole = frame(spark, events)
    fractions = whole.withColumn("view_count", F.col("view_count").cast("double"))
    pages = whole.select("date", "report_id", "user_id", F.lit("p").alias("section_id"))
    a, b = (build_user_engagement_features(f, pages) for f in (whole, fractions))
    def keyed(df):
        return sorted((r.date, r.report_id, round(r.repeat_user_rate, 9), round(r.top_10pct_user_share, 9), r.days_since_last_use)
                      for r in df.collect())
    assert keyed(a) == keyed(b)


def test_idle_days_and_page_only_days(spark):
    rows = [(day(0), "R", "u", 0), (day(2), "R", "u", 5), (day(3), "R", "u", 0), (day(4), "R", "u", 0), (day(7), "R", "u", 1)]
    pages = spark.createDataFrame([(day(1), "R", "u", "s"), (day(2), "R", "u", "s"), (day(2), "R", "w", "s"), (day(2), "R", "w", "t")],
                                  "date date, report_id string, user_id string, section_id string")
    got = {r.date: r for r in build_user_engagement_features(frame(spark, rows), pages).collect()}
    assert {d: r.days_since_last_use for d, r in got.items()} == {day(0): 0, day(2): 0, day(3): 0, day(4): 0, day(7): 5}
    assert {d: r.avg_pages_per_user for d, r in got.items()} == {day(0): 0.0, day(2): 1.5, day(3): 0.0, day(4): 0.0, day(7): 0.0}
    # the first row of a user counts as first use even with 0 views
    assert got[day(2)].repeat_user_rate == 1.0 and got[day(0)].top_10pct_user_share == 0.0
    spikes = engagement.idle_spikes(build_user_engagement_features(frame(spark, rows), pages)).collect()
    assert [(r.date, r.days_since_last_use) for r in spikes] == [(day(7), 5)]


def test_repeat_rate_changes(spark):
    mart = spark.createDataFrame([(day(i), "R", x) for i, x in enumerate([0.5, 0.5, 0.2, 0.2])], "date date, report_id string, repeat_user_rate double")
    assert [r.date for r in engagement.repeat_rate_changes(mart).collect()] == [day(2)]


@pytest.mark.parametrize("validate", ["eager", "inline", "off"])
def test_performance(spark, validate):
    rng = random.Random(11)
    loads = defaultdict(list)
    for _ in range(3000):
        key = (day(0), "hot") if rng.random() < 0.4 else (day(rng.randint(0, 30)), rng.choice("abc"))
        loads[key].append(round(rng.lognormvariate(7, 1), 2) if rng.random() < 0.9 else 0.0)
    df = spark.createDataFrame([(d, r, v) for (d, r), vs in loads.items() for v in vs] + [(day(0), None, 1.0)],
                               "date date, report_id string, load_time double").repartition(5)
    got = {(r.date, r.report_id): r for r in build_report_performance_features(df, validate=validate).collect()}
    assert set(got) == set(loads)
    for key, values in loads.items():
        assert got[key].avg_load_time == pytest.approx(np.mean(values))
        assert got[key].p90_load_time == pytest.approx(np.quantile(values, 0.9))
        assert got[key].load_events == len(values)
    for report in "abc":
        days = sorted(d for d, r in loads if r == report)
        means = [np.mean(loads[d, report]) for d in days]
        for i, d in enumerate(days):
            row = got[d, report]
            assert row.avg_load_time_7d == pytest.approx(np.mean(means[max(0, i - 6):i + 1]))
            assert row.load_time_wow_change == (pytest.approx((means[i] - means[i - 7]) / means[i - 7]) if i >= 7 else None)


@pytest.mark.parametrize("validate", ["eager", "inline", "off"])
def test_an_infinite_load_gives_one_answer(spark, validate):
    values = [float(v) for v in range(1, 31)] + [math.inf]
    df = spark.createDataFrame([(day(0), "R", v) for v in values], "date date, report_id string, load_time double")
    row = build_report_performance_features(df, validate=validate).first()
    assert row.p90_load_time == 28.0 and row.avg_load_time == math.inf and row.load_events == 31


def test_zero_and_missing_lag(spark):
    df = spark.createDataFrame([(day(i), "R", 0 if i == 1 else i + 1, 1) for i in range(9)], "date date, report_id string, daily_views int, unique_viewers int")
    got = {r.date: r.wow_change_views for r in add_time_series_usage_features(df).collect()}
    assert got[day(6)] is None and got[day(8)] is None and got[day(7)] == pytest.approx(7.0)


def test_rows_without_report_get_no_features(spark):
    df = spark.createDataFrame([(day(i), None, 1, 1) for i in range(9)], "date date, report_id string, daily_views int, unique_viewers int")
    assert {(r.views_7d, r.wow_change_views) for r in add_time_series_usage_features(df).collect()} == {(None, None)}


def test_empty_input_keeps_the_columns(spark):
    none = spark.createDataFrame([], "date date, report_id string, user_id string, load_time double, section_id string")
    assert build_report_daily_adoption(none).columns == list(adoption.MART)
    assert build_user_engagement_features(none, none).columns == list(engagement.MART)
    assert build_report_performance_features(none).columns == list(performance.MART)
    assert build_report_performance_features(none).count() == 0
    filled = adoption.fill_report_days(build_report_daily_adoption(none))
    assert add_time_series_usage_features(filled).count() == 0


def test_load_time_vs_usage_and_first_reports(spark):
    perf = spark.createDataFrame([(day(0), "a", 1.0, 2.0), (day(0), "b", 3.0, 4.0)], "date date, report_id string, avg_load_time double, p90_load_time double")
    use = spark.createDataFrame([(day(0), "a", 9)], "date date, report_id string, daily_views int")
    assert sorted((r.report_id, r.daily_views) for r in marts.load_time_vs_usage(perf, use).collect()) == [("a", 9), ("b", None)]
    assert [r.report_id for r in marts.first_reports(perf, 1).collect()] == ["a"]


def test_marts_from_facts(spark, events):
    views = frame(spark, events).select(F.date_format("date", "yyyyMMdd").cast("int").alias("date_key"), "report_id",
                                        F.col("user_id").alias("user_key"), "view_count")
    facts = {"fact_report_views": views,
             "fact_page_views": views.withColumnRenamed("view_count", "page_view_count").withColumn("page_key", F.lit(1)),
             "fact_report_loads": views.withColumn("load_time_ms", F.lit(5.0))}
    built = marts.build_marts(facts)
    daily = brute_daily(events)
    assert built["mart_report_performance"].count() == len(daily)
    alone = adoption.adoption_mart(views)
    assert built["mart_report_daily_adoption"].exceptAll(alone).isEmpty() and alone.exceptAll(built["mart_report_daily_adoption"]).isEmpty()
    pages = facts["fact_page_views"]
    alone = build_user_engagement_features(views, pages, "date_key", "report_id", "user_key")
    assert built["mart_user_engagement"].exceptAll(alone).isEmpty() and alone.exceptAll(built["mart_user_engagement"]).isEmpty()
    assert built["mart_report_daily_adoption_ts_features"].count() == built["mart_report_daily_adoption"].count() >= len(daily)
    for name, check in (("mart_user_engagement", Q.check_engagement_mart), ("mart_report_performance", Q.check_performance_mart)):
        assert all(r.passed for r in check(built[name]).collect())
