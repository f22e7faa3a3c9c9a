import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from viewtide import schemas
from viewtide.operators import quality as Q, star_schema as M
from viewtide.plans import validation
from viewtide.sources import calendar, files

DAY = dt.date(2025, 1, 4)


def test_calendar(spark):
    rows = calendar.calendar(spark, "2025-01-04", "2025-03-01").orderBy("date").collect()
    assert len(rows) == 57
    for r in rows:
        assert r.day_of_week == r.date.strftime("%A") and r.month == r.date.strftime("%Y-%m")
        assert r.week_start_date == r.date - dt.timedelta(days=r.date.weekday()) and r.is_weekend == (r.date.weekday() >= 5)
    empty = spark.createDataFrame([], "d date")
    assert calendar.calendar_of(empty, F.col("d")).count() == 0


def test_first_row_per_key_whatever_the_order(spark):
    rows = [("k", 2, "b"), ("k", 1, "z"), ("k", 1, "a"), (None, 5, "n"), (None, 4, "m"), ("x", None, "q"), ("x", 3, "r")] * 50
    for df in (spark.createDataFrame(rows, "user_key string, a int, b string"),
               spark.createDataFrame(rows[::-1], "user_key string, a int, b string").repartition(7)):
        got = sorted((tuple(r) for r in M.build_dim_user(df).collect()), key=str)
        assert got == sorted([("k", 1, "a"), (None, 4, "m"), ("x", None, "q")], key=str)


def test_page_keys_are_dense_and_ordered(spark):
    pages = [(f"R_{r:03d}", f"R_{r:03d}_P{p}", f"Page {p}") for r in range(150) for p in range(1, 4 + r % 5)]
    df = spark.createDataFrame(pages * 3, "report_id string, section_id string, section_name string").repartition(9)
    got = M.build_dim_page(df).collect()
    assert [tuple(r)[1:] for r in sorted(got)] == sorted(pages)
    assert sorted(r.page_key for r in got) == list(range(1, len(pages) + 1))


def test_dim_date_drops_whole_duplicates_only(spark):
    dates = calendar.calendar(spark, "2025-01-01", "2025-01-03")
    assert M.build_dim_date(dates.unionByName(dates)).count() == 3
    other = dates.withColumn("month", F.lit("?"))
    assert M.build_dim_date(dates.unionByName(other)).count() == 6


@pytest.fixture(scope="module")
def raw(spark):
    """Two reports, three users, one orphan of each kind."""
    return {
        "reports": spark.createDataFrame([("R1", "one", "W", "Report", False), ("R2", "two", "W", "Paginated", True)], schemas.RAW["reports"]),
        "users": spark.createDataFrame([("U1", "a", "A"), ("U2", "b", "B"), ("U2", "b", "C")], schemas.RAW["users"]),
        "report_pages": spark.createDataFrame([("R1", "R1_P1", "Page 1"), ("R1", "R1_P2", "Page 2")], schemas.RAW["report_pages"]),
        "dates": calendar.calendar(spark, "2025-01-01", "2025-01-31"),
        "report_views": spark.createDataFrame(
            [(DAY, "R1", "U1", "a", "c", "d", "x", 3), (DAY, "R9", "U1", "a", "c", "d", "x", 1), (dt.date(2026, 1, 1), "R2", None, None, "c", "d", "x", None)],
            schemas.RAW["report_views"]),
        "report_page_views": spark.createDataFrame(
            [(dt.datetime(2025, 1, 4, 9), DAY, "R1", "R1_P2", "U1", "c", "s", 2), (dt.datetime(2025, 1, 4, 9), DAY, "R1", "R9_P1", "U9", "c", "s", 1)],
            schemas.RAW["report_page_views"]),
        "report_load_times": spark.createDataFrame([(dt.datetime(2025, 1, 4, 9), DAY, "R1", "U1", "a", "b", "c", "ZA", 12.5)], schemas.RAW["report_load_times"]),
    }


def test_facts_keep_every_row(spark, raw):
    t = M.build_semantic_model(raw)
    for name, df in t.items():
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in schemas.PROCESSED[name]]
    views = {r.report_id: r for r in t["fact_report_views"].collect()}
    assert views["R1"].date_key == 20250104 and views["R2"].date_key is None and len(views) == 3
    assert sorted((r.page_key or 0) for r in t["fact_page_views"].collect()) == [0, 2]
    both = M.build_fact_page_views(raw["report_page_views"].withColumn("report_id", F.lit("R2")), t["dim_date"], t["dim_page"],
                                   page_on=("report_id", "section_id"))
    assert {r.page_key for r in both.collect()} == {None}


def test_validation_counts_the_faults(spark, raw):
    model = M.build_semantic_model(raw)
    r = validation.validate_semantic_model(model, raw)
    bad = {(x.table_name, x.expectation_name, x.details): x for x in r["gx_validation_results"].collect() if not x.success}
    assert {(k[0], k[2]) for k in bad} == {("fact_report_views", "{'column': 'date_key'}"), ("fact_report_views", "{'column': 'user_key'}"),
                                           ("fact_report_views", "{'column': 'view_count'}"), ("fact_page_views", "{'column': 'page_key'}")}
    null_key = bad["fact_page_views", "ExpectColumnValuesToNotBeNull", "{'column': 'page_key'}"]
    assert (null_key.unexpected_count, null_key.unexpected_percent, null_key.element_count, null_key.missing_count) == (1, 50.0, 2, None)
    ri = {x.check_name: (x.invalid_count, x.total_rows) for x in r["referential_integrity_checks"].collect() if not x.success}
    assert ri == {"fact_report_views.report_id -> dim_report.report_id": (1, 3), "fact_report_views.user_key -> dim_user.user_key": (1, 3),
                  "fact_report_views.date_key -> dim_date.date_key": (1, 3), "fact_page_views.page_key -> dim_page.page_key": (1, 2),
                  "fact_page_views.user_key -> dim_user.user_key": (1, 2)}
    pairs = {x.raw_table: (x.raw_row_count, x.processed_row_count, x.row_count_difference, x.exact_match)
             for x in r["row_count_reconciliation"].collect()}
    assert pairs["users"] == (3, 2, -1, False) and pairs["dates"] == (31, 31, 0, True) and len(pairs) == 7
    summary = {x.check_group: (x.checks_run, x.checks_passed, x.checks_failed) for x in r["validation_summary"].collect()}
    assert summary == {"uniqueness": (4, 4, 0), "nulls": (19, 15, 4), "row_count": (7, 7, 0), "referential_integrity": (10, 5, 5),
                       "row_count_reconciliation": (7, 6, 1)}
    light = {x.check_name: (x.success, x.value) for x in Q.run_lightweight_checks(model).collect()}
    assert light["fact_report_views.user_key in dim_user"] == (False, 1) and light["dim_user.user_key"] == (True, 0)
    assert light["fact_page_views.page_key"] == (False, 1) and len(light) == 4 + 7 + 10
    keys = {x.check_name: x.invalid_count for x in Q.run_raw_key_checks(raw).collect()}
    assert keys == {"report_views.report_id in reports": 1, "report_views.user_key in users": 1,
                    "report_page_views.section_id in report_pages": 1, "report_load_times.report_id in reports": 0}


def test_uniqueness_and_missing(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,)], "k string")
    r = Q.run_expectations(df, "t", [Q.Expectation("unique", "k"), Q.Expectation("row_count", min_value=6)]).collect()
    assert (r[0].unexpected_count, r[0].missing_count, r[0].element_count, r[0].success) == (2, 2, 5, False)
    assert r[0].unexpected_percent == pytest.approx(200 / 3) and r[0].missing_percent == 40.0
    assert r[1].success is False and r[1].element_count is None
    empty = Q.run_expectations(df.where("false"), "t", [Q.Expectation("unique", "k"), Q.Expectation("not_null", "k"),
                                                        Q.Expectation("row_count", min_value=1)]).collect()
    assert [x.success for x in empty] == [True, True, False] and empty[0].unexpected_percent is None


@pytest.mark.parametrize("dim, invalid", [(["a", None], 1), (["a", "a"], 3), ([], 5)])
def test_membership_of_null(spark, dim, invalid):
    fact = spark.createDataFrame([("a",), ("a",), ("z",), (None,), (None,)], "k string")
    known = spark.createDataFrame([(d,) for d in dim], "k string")
    assert tuple(Q.membership(fact, "k", known, "k").first()) == (5, invalid)


def test_describe_ignores_missing(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 5), (None, 5), (4.0, 6)], "a double, b int")
    got = {r.column: r for r in Q.describe(df, ["a", "b"]).collect()}
    assert got["a"]["count"] == 3 and got["a"].p50 == 2.0 and got["a"].p25 == 1.5 and got["b"].p75 == 5.25 and got["b"].std == 0.5


def test_profile(spark):
    rows = [(DAY, "R", "n", "u", 1), (DAY, "R", "n", "u", 1), (DAY, "R", "n", "u", 1), (None, "R", None, "u", -2)]
    df = spark.createDataFrame(rows, "`Date` date, `Report Guid` string, `Report Name` string, `User Id` string, `Occurrences` int")
    got = {r.check: (r.value, r.status) for r in Q.run_data_quality_checks(df).collect()}
    assert got == {"row_count": ("4", "ok"), "nulls_Date": ("1", "warn"), "nulls_Report Guid": ("0", "ok"), "nulls_Report Name": ("1", "warn"),
                   "nulls_User Id": ("0", "ok"), "nulls_Occurrences": ("0", "ok"), "exact_duplicate_rows": ("2", "warn"),
                   "min_date": ("2025-01-04", "ok"), "max_date": ("2025-01-04", "ok"), "negative_occurrences": ("1", "fail")}
    assert {r.check: r.status for r in Q.run_data_quality_checks(df.where("false")).collect()}["row_count"] == "fail"


def test_mart_checks_find_faults(spark):
    d = [dt.date(2025, 1, i) for i in range(1, 4)]
    daily = spark.createDataFrame([(d[1], "R"), (d[2], "R"), (d[1], "S")], "date date, report_id string")
    mart = spark.createDataFrame([(d[0], "R", 0, 1.0), (d[1], "R", 1, 1.0), (d[2], "R", 1, 1.0), (d[1], "S", 0, 0.0), (d[1], "S", 0, 0.0)],
                                 "date date, report_id string, unique_viewers int, views_per_user double")
    assert {r.check: r.passed for r in Q.check_adoption_mart(mart, daily).collect()} == {
        "one_row_per_date_report": False, "no_prelaunch_rows": False, "all_reports_end_at_global_max": False, "zero_viewers_zero_ratio": False}
    perf = spark.createDataFrame([(d[0], "R", -1.0, 5.0, 1.0, float("inf"), 2), (d[1], "R", 9.0, 5.0, None, None, 2)],
                                 "date date, report_id string, avg_load_time double, p90_load_time double, avg_load_time_7d double, load_time_wow_change double, load_events int")
    got = {r.check: r.passed for r in Q.check_performance_mart(perf).collect()}
    assert got == {"one_row_per_date_report": True, "keys_not_null": True, "avg_not_negative": False, "p90_not_negative": True,
                   "rolling_avg_not_negative": False, "no_infinite_change": False, "p90_at_least_avg": False}
    ts = mart.select("*", *[F.lit(None if c == "views_7d" else 1.0).cast("double").alias(c) for c in
                            ("views_7d", "views_28d", "viewers_7d", "viewers_28d", "wow_change_views")])
    got = {r.check: r.passed for r in Q.check_time_series_mart(ts, mart.limit(2)).collect()}
    assert got == {"row_count_unchanged": False, "one_row_per_date_report": False, "rolling_columns_populated": False, "no_infinite_change": True}


# Files ----------------------------------------------------------------------------------------------

@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_tables_survive_files(spark, raw, tmp_path, fmt):
    files.save_tables(raw, str(tmp_path), fmt)
    files.save_tables({"users": raw["users"].limit(1)}, str(tmp_path), fmt)
    back = files.load_raw_tables(spark, str(tmp_path), fmt)
    assert back["users"].count() == 1
    for name in ("dates", "report_views", "report_page_views", "report_load_times"):
        assert back[name].schema == schemas.RAW[name]
        assert back[name].exceptAll(raw[name]).isEmpty() and raw[name].exceptAll(back[name]).isEmpty()
    model = M.build_semantic_model(raw)
    files.save_tables(model, str(tmp_path), fmt)
    stored = files.load_processed_tables(spark, str(tmp_path), fmt)
    assert {n: d.count() for n, d in stored.items()} == {n: d.count() for n, d in model.items()}


def test_missing_table_raises(spark, tmp_path):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        files.load_raw_tables(spark, str(tmp_path))


def test_history_may_be_missing_but_not_broken(spark, tmp_path):
    empty = files.read_history(spark, str(tmp_path / "none"), schemas.FORECAST_HISTORY)
    assert empty.schema == schemas.FORECAST_HISTORY and empty.isEmpty()


def test_marts_are_stored_in_order(spark, tmp_path):
    rows = [(dt.date(2025, 1, 1 + i % 28), f"R{i % 13}") for i in range(500)]
    files.save_tables({"mart_user_engagement": spark.createDataFrame(rows, "date date, report_id string")}, str(tmp_path))
    parts = (spark.read.parquet(str(tmp_path / "mart_user_engagement.parquet")).withColumn("f", F.input_file_name())
             .groupBy("f").agg(F.min("report_id").alias("a"), F.max("report_id").alias("b")).orderBy("a").collect())
    assert all(x.b <= y.a for x, y in zip(parts, parts[1:]))
