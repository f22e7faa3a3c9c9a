"""Silver and gold that follow a growing bronze table."""

import datetime as dt
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import comparison
from viewtide import schemas
from viewtide.operators import publish as P
from viewtide.plans import forecasting as Fc
from viewtide.sources import periods, publication

DAY0 = dt.date(2024, 1, 1)
RUN = P.Run("run_1", dt.datetime(2025, 1, 1, 6))


def events(spark, rows):
    return spark.createDataFrame([(r, n, None if d is None else DAY0 + dt.timedelta(days=d), float(v)) for r, n, d, v in rows],
                                 schemas.BRONZE)


def some(days, seed=0):
    draw = random.Random(seed)
    return [(draw.choice("abc"), draw.choice(["x", "y", None]), d, draw.randint(0, 9)) for d in days for _ in range(draw.randint(1, 6))]


def sums(rows):
    found = Counter()
    for r, n, d, v in rows:
        found[r, n, None if d is None else DAY0 + dt.timedelta(days=d)] += v
    return found


def silver(spark, root):
    rows = periods.read(spark, Fc.ForecastPaths(root).silver_report_daily_views, schemas.SILVER).collect()
    assert len(rows) == len({(r.report_id, r.report_name, r.date) for r in rows})
    return {(r.report_id, r.report_name, r.date): r.actual_views for r in rows}


def files_of(path):
    return {os.path.join(at, name) for at, _, names in os.walk(path) for name in names if name.endswith(".parquet")}


def day(i):
    return str(DAY0 + dt.timedelta(days=i))


def test_only_new_days_are_read_and_written(spark, tmp_path):
    root, paths = str(tmp_path), Fc.ForecastPaths(str(tmp_path))
    first = some(range(6))
    Fc.add_bronze(events(spark, first), root)
    assert Fc.refresh_silver(spark, root) == [day(i) for i in range(6)]
    before = files_of(paths.silver_report_daily_views)
    for name in files_of(paths.bronze_report_usage):  # what is not read may be anything
        with open(name, "wb") as out:
            out.write(b"no parquet")
    more = some([6], 1)
    Fc.add_bronze(events(spark, more), root)
    assert Fc.refresh_silver(spark, root) == [day(6)]
    after = files_of(paths.silver_report_daily_views)
    assert before < after and all(f"period={day(6)}/" in name for name in after - before)
    assert silver(spark, root) == sums(first + more)
    assert Fc.refresh_silver(spark, root) == [] and files_of(paths.silver_report_daily_views) == after


def test_plan_prunes_parts(spark, tmp_path):
    root = str(tmp_path)
    Fc.add_bronze(events(spark, some(range(4))), root)
    rows = periods.read(spark, Fc.ForecastPaths(root).bronze_report_usage, schemas.BRONZE, [day(2)])
    text = comparison.plan(rows, "formatted")
    assert "PartitionFilters: [" in text and "period" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert {r.period for r in rows.select("period").distinct().collect()} == {DAY0 + dt.timedelta(days=2)}


@pytest.mark.parametrize("unit", ["day", "month"])
def test_late_missing_and_repeated_days(spark, tmp_path, unit):
    """Late events of an old day, events without a day, the same events twice (they count twice), nulls in every column."""
    root, seen = str(tmp_path), []
    steps = [some(range(0, 80, 7)), some([7, None], 2), some([7, None], 2), [(None, None, None, 1), ("a", None, 40, 2)]]
    for rows in steps:
        seen += rows
        Fc.add_bronze(events(spark, rows), root, unit)
        made = Fc.refresh_silver(spark, root)
        assert set(made) == {periods.NO_PERIOD if d is None else day(d) if unit == "day" else day(d)[:8] + "01" for _, _, d, _ in rows}
        assert silver(spark, root) == sums(seen)


def test_removed_days_leave_silver(spark, tmp_path):
    root, paths = str(tmp_path), Fc.ForecastPaths(str(tmp_path))
    Fc.add_bronze(events(spark, some(range(3))), root)
    Fc.refresh_silver(spark, root)
    publication.Folder(spark, root).remove(f"{paths.bronze_report_usage}/period={day(1)}")
    assert Fc.refresh_silver(spark, root) == [day(1)]
    assert {d for _, _, d in silver(spark, root)} == {DAY0, DAY0 + dt.timedelta(days=2)}


@pytest.mark.parametrize("renames", range(4))
def test_interrupted_refresh_is_repeated(spark, tmp_path, monkeypatch, renames):
    """The job dies after some renames, in the middle of a swap as well; the next one ends with the right rows."""
    root, paths = str(tmp_path), Fc.ForecastPaths(str(tmp_path))
    rows = some(range(4))
    Fc.add_bronze(events(spark, rows), root)
    Fc.refresh_silver(spark, root)
    late = some([1, 2, 5], 3)
    Fc.add_bronze(events(spark, late), root)
    whole, left = publication.Folder.rename, [renames]

    def dies(self, source, target):
        if not left[0]:
            raise OSError("killed")
        left[0] -= 1
        whole(self, source, target)

    with monkeypatch.context() as patch:
        patch.setattr(publication.Folder, "rename", dies)
        with pytest.raises(OSError, match="killed"):
            Fc.refresh_silver(spark, root)
    assert Fc.refresh_silver(spark, root) == [day(i) for i in (1, 2, 5)]
    assert silver(spark, root) == sums(rows + late)
    names = os.listdir(paths.silver_report_daily_views) + os.listdir(root)
    assert not [n for n in names if n.startswith((publication.NEW, publication.OLD, periods.PARTS))]


def test_lost_marks_rebuild_everything(spark, tmp_path):
    root, paths = str(tmp_path), Fc.ForecastPaths(str(tmp_path))
    rows = some(range(3))
    Fc.add_bronze(events(spark, rows), root)
    Fc.refresh_silver(spark, root)
    publication.Folder(spark, root).remove(paths.silver_marks)
    assert len(Fc.refresh_silver(spark, root)) == 3 and silver(spark, root) == sums(rows)


def test_empty_bronze(spark, tmp_path):
    root = str(tmp_path)
    assert Fc.refresh_silver(spark, root) == [] and silver(spark, root) == {}
    Fc.add_bronze(events(spark, []), root)
    assert Fc.refresh_silver(spark, root) == [] and silver(spark, root) == {}
    Fc.add_bronze(events(spark, [("a", "x", 1, 1)]), root)
    assert Fc.refresh_silver(spark, root) == [day(1)] and len(silver(spark, root)) == 1


def test_unknown_unit(spark, tmp_path):
    with pytest.raises(ValueError, match="fortnight"):
        Fc.add_bronze(events(spark, some([1])), str(tmp_path), "fortnight")


def test_layers_in_steps_are_the_layers_at_once(spark, tmp_path):
    rows = [("r", "R", i, 20 + (i % 7) * 5) for i in range(150)]
    for part in (rows[:100], rows[100:]):
        tables = Fc.update_layers(events(spark, part), str(tmp_path / "a"), RUN, "month")
    whole = Fc.refresh_layers(events(spark, rows), str(tmp_path / "b"), RUN)
    assert sorted(map(tuple, tables.forecasts.collect())) == sorted(map(tuple, whole.forecasts.collect()))
    kept = spark.read.parquet(Fc.ForecastPaths(str(tmp_path / "a")).gold_report_forecasts_latest)
    assert kept.count() == tables.forecasts.count() == 60
    assert kept.where(F.col("IsForecast") == 1).count() == whole.forecasts.where(F.col("IsForecast") == 1).count()
