"""The stages as a user runs them, on the test tables through CSV and Parquet files."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from viewtide import jobs, session
from viewtide.sources import files
from viewtide.sources.telemetry import Telemetry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_stages(spark, tmp_path, fmt):
    data = Telemetry(spark, SF)
    raw, processed, out = (str(tmp_path / d) for d in ("raw", "processed", "out"))
    files.save_tables(data.raw(), raw, fmt)
    jobs.main(["model", "--raw", raw, "--processed", processed, "--format", fmt])
    jobs.main(["validate", "--raw", raw, "--processed", processed, "--out", out, "--format", fmt])
    jobs.main(["marts", "--processed", processed, "--out", out, "--format", fmt])
    suffix = ".csv" if fmt == "csv" else ".parquet"
    def read(name):
        return files.read_table(spark, f"{out}/{name}{suffix}", None, fmt)
    groups = {r["check_group"]: int(r["checks_failed"]) for r in read("validation_summary").collect()}
    assert groups == {"uniqueness": 0, "nulls": 0, "row_count": 0, "referential_integrity": 0, "row_count_reconciliation": 2}
    lines = data.table("lineitem").count()
    assert read("mart_report_performance").agg(F.sum("load_events")).first()[0] == lines
    assert read("mart_report_daily_adoption_ts_features").count() == read("mart_report_daily_adoption").count()
    assert read("mart_user_engagement").count() <= lines


def test_forecast_stage(spark, tmp_path):
    usage, out = str(tmp_path / "usage"), str(tmp_path / "out")
    Telemetry(spark, "/root/testdata/sf0.01").usage_c().write.parquet(usage)
    for _ in range(2):
        jobs.main(["forecast", "--usage", usage, "--out", out, "--run-id", "r1", "--run-time", "2001-11-05T06:00:00"])
    latest = spark.read.parquet(out + "/forecasts_latest")
    history = spark.read.parquet(out + "/forecasts_history")
    assert history.count() == latest.where("IsForecast = 1").count() > 0
    assert spark.read.parquet(out + "/metrics_history").count() == spark.read.parquet(out + "/metrics_latest").count()


def test_staged_tables_go_with_the_job(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "scratch_root", lambda spark: str(tmp_path / "app"))
    assert session.staged(spark.range(3), "some").count() == 3 and list(tmp_path.rglob("*.parquet"))
    session.clear_scratch(spark)
    assert not list(tmp_path.rglob("*.parquet"))


@pytest.mark.parametrize("master, fails", [("local", False), ("local[8]", False), ("local-cluster[2,1,1024]", True), ("yarn", True)])
def test_shared_folder_where_none_is_named(master, fails):
    """On one machine a temporary folder is set on the context; on a cluster the setting is needed."""
    folder = {}
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: folder.get("dir"),
                              setCheckpointDir=lambda path: folder.update(dir=path))
    lone = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default: default))
    if fails:
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.shared_dir(lone)
    else:
        assert session.shared_dir(lone) == session.shared_dir(lone) == folder["dir"]


def test_forecast_stage_with_other_columns(spark, tmp_path):
    usage, out = str(tmp_path / "usage"), str(tmp_path / "out")
    (Telemetry(spark, "/root/testdata/sf0.001").usage_c().withColumnsRenamed({"Date": "d", "Occurrences": "n"})
     .write.option("header", True).csv(usage))
    jobs.main(["forecast", "--usage", usage, "--out", out, "--run-id", "r1", "--run-time", "2001-11-05T06:00:00", "--format", "csv",
               "--date-col", "d", "--views-col", "n", "--horizon", "5"])
    assert spark.read.parquet(out + "/metrics_latest").count() > 0


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_layers_stage(spark, tmp_path, fmt):
    """Two deliveries of events through the command line."""
    out = str(tmp_path / "out")
    rows = Telemetry(spark, SF).usage_c().select(F.col("Report Guid").alias("report_id"), F.col("Report Name").alias("report_name"),
                                                 F.col("Date").alias("date"), F.col("Occurrences").alias("occurrences"))
    early = F.year("date") < 1996
    for i, some in enumerate((early, ~early)):
        events = str(tmp_path / f"events{i}")
        rows.where(some).write.format(fmt).option("header", True).save(events)
        jobs.main(["layers", "--events", events, "--out", out, "--run-id", f"r{i}", "--run-time", "2001-11-05T06:00:00",
                   "--format", fmt, "--unit", "year", "--horizon", "5"])
    silver = spark.read.parquet(out + "/silver_report_daily_views")
    assert silver.agg(F.sum("actual_views")).first()[0] == rows.agg(F.sum("occurrences")).first()[0]
    assert silver.count() == rows.select("report_id", "report_name", "date").distinct().count()
    assert spark.read.parquet(out + "/gold_report_metrics_latest").count() > 0
