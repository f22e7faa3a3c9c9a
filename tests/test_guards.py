import datetime as dt

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from viewtide import (add_time_series_usage_features, build_report_daily_adoption, build_report_performance_features,
                      build_user_engagement_features)
from viewtide.functions import columns as C, guards as G
from viewtide.operators import series as S


@pytest.fixture(scope="module")
def views(spark):
    return spark.createDataFrame([("2025-01-01", "R1", "U1", 3, "x")], "date string, report_id string, user_id string, n long, t string")


@pytest.mark.parametrize("call", [
    lambda f: build_report_daily_adoption([1]), lambda f: add_time_series_usage_features("x"),
    lambda f: build_user_engagement_features(None, f), lambda f: build_user_engagement_features(f, None),
    lambda f: build_report_performance_features({}), lambda f: S.daily_totals(3)])
def test_only_dataframes(views, call):
    with pytest.raises(TypeError, match="must be a Spark DataFrame"):
        call(views)


def test_missing_columns_are_named_in_order(views):
    with pytest.raises(ValueError, match="^Missing required columns: a, z$"):
        build_report_daily_adoption(views, date_col="z", user_col="a")
    with pytest.raises(ValueError, match="Missing required columns: load_time"):
        build_report_performance_features(views)
    with pytest.raises(ValueError, match="Missing required columns: daily_views, unique_viewers"):
        add_time_series_usage_features(views)


def test_measure_must_be_numeric(views):
    with pytest.raises(TypeError, match="'t' must be numeric when provided."):
        build_report_daily_adoption(views, views_col="t")
    with pytest.raises(TypeError, match="'view_count' must be numeric"):
        build_user_engagement_features(views.withColumnRenamed("t", "view_count"), views.withColumn("page_key", F.lit(1)))
    with pytest.raises(TypeError, match="'daily_views' must be numeric."):
        add_time_series_usage_features(views.withColumnRenamed("t", "daily_views").withColumnRenamed("n", "unique_viewers"))


def test_pages_need_an_identity(views):
    with pytest.raises(ValueError, match="either 'section_id' or 'page_key'"):
        build_user_engagement_features(views, views)


def test_measure_missing_in_usage(views):
    with pytest.raises(KeyError, match="Expected column 'Occurrences' is missing"):
        S.daily_totals(views)


@pytest.fixture(scope="module")
def spoilt(views):
    return views.unionByName(views.withColumn("date", F.lit("no day")))


def test_bad_dates_eager(spoilt):
    with pytest.raises(ValueError, match="Unable to parse all values in 'date' into valid datetimes."):
        build_report_daily_adoption(spoilt, validate="eager")
    with pytest.raises(ValueError, match="Unable to parse all values in 'date' from fact_report_views."):
        build_user_engagement_features(spoilt, spoilt.withColumn("page_key", F.lit(1)), validate="eager")
    with pytest.raises(ValueError, match="valid datetimes"):
        add_time_series_usage_features(spoilt.select("*", F.lit(1).alias("daily_views"), F.lit(1).alias("unique_viewers")), validate="eager")


def test_bad_dates_inline_fail_the_job_not_the_call(spoilt):
    lazy = build_report_daily_adoption(spoilt, validate="inline")
    with pytest.raises((PySparkException, Py4JJavaError), match="Unable to parse all values in 'date'"):
        lazy.collect()
    assert build_report_daily_adoption(spoilt, validate="off").count() == 1


def test_unknown_mode(views):
    with pytest.raises(ValueError, match="validate must be one of"):
        build_report_daily_adoption(views, validate="sometimes")


@pytest.mark.parametrize("value, message", [("fast", "Unable to convert"), ("NaN", "Unable to convert"), (None, "Unable to convert"),
                                            ("-1.5", "must not contain negative values")])
@pytest.mark.parametrize("mode", ["eager", "inline"])
def test_load_times(spark, value, message, mode):
    loads = spark.createDataFrame([("2025-01-01", "R", "7.5"), ("2025-01-01", "R", value)],
                                  "date string, report_id string, load_time string")
    with pytest.raises((ValueError, PySparkException, Py4JJavaError), match=message):
        build_report_performance_features(loads, validate=mode).collect()


def test_every_spelling_of_a_day(spark):
    day = dt.date(2025, 1, 31)
    df = spark.createDataFrame(
        [(20250131, 20250131.0, day, dt.datetime(2025, 1, 31, 23, 59), "2025-01-31", "2025-01-31 23:59:59", "20250131",
          "2025-01-31T08:00:00", " 2025-01-31 ", "1/31/2025")],
        "i int, f double, d date, t timestamp_ntz, a string, b string, c string, e string, g string, h string")
    assert set(df.select(*[C.to_day(df, c).alias(c) for c in df.columns]).first()) == {day}
    bad = spark.createDataFrame([(20259901, 20250131.5, "later", "20259901", None, "")],
                                "i int, f double, a string, b string, c string, d string")
    assert set(bad.select(*[C.to_day(bad, c).alias(c) for c in bad.columns]).first()) == {None}


def test_time_is_kept_where_days_are_not_asked_for(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 1, 1, 5), "R", 1, 1)], "date timestamp_ntz, report_id string, daily_views int, unique_viewers int")
    assert add_time_series_usage_features(df).first()["date"] == dt.datetime(2025, 1, 1, 5)


def test_numbers(spark):
    df = spark.createDataFrame([("1.5", float("nan"), 2), ("x", 1.0, None), (None, None, 3)], "s string, f double, i int")
    got = df.select(C.to_number(df, "s"), C.to_number(df, "f"), C.to_number(df, "i"), C.to_number_or_zero(df, "s")).collect()
    assert [tuple(r) for r in got] == [(1.5, None, 2.0, 1.5), (None, 1.0, None, 0.0), (None, None, 3.0, 0.0)]


def test_ratios_and_changes(spark):
    df = spark.createDataFrame([(4.0, 2.0), (4.0, 0.0), (None, 2.0), (float("inf"), 2.0)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    got = [tuple(r) for r in df.select(C.ratio_or_zero(a, b), C.relative_change(a, b), C.improvement(a, b),
                                       C.floor_at_zero(b - 1), C.finite(a)).collect()]
    assert got[0] == (2.0, 1.0, -1.0, 1.0, 4.0)
    assert got[1] == (0.0, None, None, 0.0, 4.0)
    assert got[2] == (0.0, None, None, 1.0, None)
    assert got[3][1] is None and got[3][4] is None


@pytest.mark.parametrize("users, size", [(1, 1), (9, 1), (10, 1), (11, 2), (21, 3), (100, 10), (101, 11)])
def test_top_decile(spark, users, size):
    assert spark.range(1).select(C.top_decile_size(F.lit(users))).first()[0] == size


def test_preflight_reports_the_first_broken_rule(spark):
    df = spark.range(3)
    G.preflight(df, {"none": F.col("id") > 5})
    with pytest.raises(ValueError, match="second"):
        G.preflight(df, {"first": F.col("id") > 5, "second": F.col("id") > 1, "third": F.col("id") > 0})
