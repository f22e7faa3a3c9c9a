import datetime as dt

import pytest
from pyspark.sql import functions as F

from viewtide import schemas
from viewtide.plans import forecasting as Fc
from viewtide.sources import files, histories

DAY0 = dt.date(2024, 1, 1)
NOW = dt.datetime(2025, 1, 1)
ACTUALS = "report_id string, report_name string, date date, actual_views double"


def add_run(spark, paths, start, reports=("a", "b"), days=40):
    """A run whose forecasts are the day's number, from ``start`` days after DAY0 on."""
    run_id = f"run_{start:03}"
    at = dt.datetime.combine(DAY0 + dt.timedelta(days=start - 1), dt.time(6))
    rows = [(run_id, at, r, r, DAY0 + dt.timedelta(days=i), i - start + 1, float(i), 0.0, 1.0, "m")
            for r in reports for i in range(start, start + days)]
    files.replace_run(spark.createDataFrame(rows, schemas.FORECAST_HISTORY), paths.forecasts_history, run_id)


def actuals(spark, days, reports=("a", "b"), without=()):
    return spark.createDataFrame([(r, r, DAY0 + dt.timedelta(days=i), 2.0 * i) for r in reports for i in range(days)
                                  if (r, i) not in without], ACTUALS)


def backfill(spark, paths, *args, **kwargs):
    new = Fc.append_realized_errors(actuals(spark, *args, **kwargs), paths, NOW)
    return sorted((r.run_id, r.report_id, (r.target_date - DAY0).days) for r in new.collect())


def stored(spark, paths):
    rows = files.read_history(spark, paths.realized_errors_history, schemas.REALIZED_ERRORS).collect()
    assert all(r.error == r.actual_views - r.forecast_views == float((r.target_date - DAY0).days) for r in rows)
    return sorted((r.run_id, r.report_id, (r.target_date - DAY0).days) for r in rows)


def expected(starts, days, without=()):
    return sorted((f"run_{s:03}", r, i) for s in starts for r in "ab" for i in range(s, min(s + 40, days)) if (r, i) not in without)


@pytest.fixture
def paths(tmp_path):
    return Fc.ForecastPaths(str(tmp_path))


def files_read(spark, paths, days):
    """Files of the forecast history that a backfill's plan opens."""
    before = histories.stored_marks(spark, paths.realized_errors_marks)
    marks = histories.current_marks(actuals(spark, days), paths.forecasts_history, schemas.FORECAST_HISTORY)
    parts = [p for p, m in marks.items() if before.get(p) != m]
    # the month goes with a filter on partition columns: other files are not in the scan
    rows = files.read_months(spark, paths.forecasts_history, schemas.FORECAST_HISTORY).where(histories.part().isin(parts))
    assert "PartitionFilters: [" in rows._jdf.queryExecution().toString()
    read = {r[0] for r in rows.select("_metadata.file_path").distinct().collect()}
    everything = len(files.read_months(spark, paths.forecasts_history, schemas.FORECAST_HISTORY).inputFiles())
    return len(read), everything


def test_files_read_do_not_grow_with_the_number_of_runs(spark, paths):
    starts, read = [], []
    for k in range(6):
        starts.append(31 * k)
        add_run(spark, paths, 31 * k)
        days = 31 * k + 20
        if k:
            read.append(files_read(spark, paths, days))
        assert backfill(spark, paths, days)
        assert stored(spark, paths) == expected(starts, days)
    some, everything = zip(*read)
    assert max(some) <= everything[0] < everything[-1] / 2, read      # those of two runs, however many there are


def test_late_days_repeated_calls_and_replaced_runs(spark, paths):
    add_run(spark, paths, 0)
    add_run(spark, paths, 35)
    late = {("b", 3), ("b", 36)}
    assert backfill(spark, paths, 60, without=late) == expected([0, 35], 60, late)
    assert backfill(spark, paths, 60, without=late) == []
    assert backfill(spark, paths, 60) == [("run_000", "b", 3), ("run_000", "b", 36), ("run_035", "b", 36)]
    add_run(spark, paths, 0, reports=("a", "b", "c"))      # the run is replaced, with one more report
    assert {r for _, r, _ in backfill(spark, paths, 60, reports=("a", "b", "c"))} == {"c"}
    assert len(stored(spark, paths)) == len(expected([0, 35], 60)) + 40


def test_a_call_that_dies_after_its_rows_adds_nothing_twice(spark, paths, monkeypatch):
    add_run(spark, paths, 0)

    def dies(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(histories, "store_marks", dies)
        with pytest.raises(RuntimeError, match="lost"):
            backfill(spark, paths, 30)
    assert backfill(spark, paths, 30) == []
    assert stored(spark, paths) == expected([0], 30)


def test_nothing_to_do(spark, paths):
    assert backfill(spark, paths, 30) == []      # no history
    add_run(spark, paths, 200)
    assert backfill(spark, paths, 30) == []      # no day has come
    empty = spark.createDataFrame([], ACTUALS)
    assert Fc.append_realized_errors(empty, paths, NOW).isEmpty()
    assert files.read_months(spark, paths.forecasts_history, schemas.FORECAST_HISTORY).where(
        F.col(files.MONTH) != files.month_of("target_date")).isEmpty()
