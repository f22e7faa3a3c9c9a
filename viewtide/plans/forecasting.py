"""The forecasting run: usage rows to forecasts, metrics and diagnostics, and their tables."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from viewtide import schemas
from viewtide.operators import ar_search as A, publish as P, series as S
from viewtide.session import staged
from viewtide.sources import files, histories, periods, publication


@dataclass(frozen=True)
class ForecastTables:
    forecasts: DataFrame
    metrics: DataFrame
    diagnostics: DataFrame
    actuals: DataFrame | None = None


@dataclass(frozen=True)
class ForecastPaths:
    """Where a run keeps its tables, below one root."""

    root: str

    def __getattr__(self, name: str) -> str:
        if name.startswith("_"):
            raise AttributeError(name)
        return f"{self.root.rstrip('/')}/{name}"


def candidate_series(totals: DataFrame, rule: S.Sufficiency = S.Sufficiency(), names: Collection[str] = ()) -> DataFrame:
    """Numbered gap-free series of the reports worth modelling.

    The verdict is taken on the totals, so series that fail are never stretched to daily rows.
    """
    worth = S.with_sufficiency(totals, rule).where("passes_data_criteria")
    return S.numbered_series(S.allowed_names(worth.select("report_id", "report_name", "date", "views"), names))


def backtest_metrics(numbered: DataFrame, orders=A.ORDERS, differencings=A.DIFFERENCINGS, choice: str = "tests") -> DataFrame:
    """Search a model for every backtestable series and measure it on the test days, beside both baselines.

    Only stationary and invertible models take part, as an exploding one has no errors worth a comparison.
    """
    split = staged(numbered, "series")
    models = A.fit_models(split, orders, differencings, choice, check_roots=True)
    path = staged(A.backtest_path(models, "n_obs", "n_train", "n_test", *P.ORDER_COLUMNS), "path")
    return P.backtest_metrics(P.paired_days(path, S.with_baselines(split.where(F.col("error").isNull()))))


def run_forecasts_for_reports(usage: DataFrame, run: P.Run, horizon: int = P.HORIZON,
                              rule: S.Sufficiency = S.Sufficiency(), acceptance: P.Acceptance = P.Acceptance(),
                              names: Collection[str] = (), orders=A.ORDERS, differencings=A.DIFFERENCINGS,
                              choice: str = "tests", **columns) -> ForecastTables:
    """Backtest and forecast every report with enough data; publish the accepted ones only.

    What several branches read - the sums per report, name and day, the numbered series, the fitted models, the published
    rows - is staged once: the usage is scanned a single time, and a forecast is computed a single time.
    """
    named = staged(S.named_totals(usage, **columns), "named-totals")
    totals = S.totals_of(named)
    diagnostics = S.sufficiency(totals, rule)
    split = staged(candidate_series(totals, rule, names), "series")
    models = staged(A.fit_models(split, orders, differencings, choice), "models")
    tested = S.with_baselines(split.where(F.col("error").isNull()))
    backtest = staged(P.backtest_rows(A.backtest_path(models), tested), "backtest")
    fitted = P.metrics_rows(models, backtest, acceptance)
    metrics = staged(P.with_diagnostics(
        fitted.unionByName(P.failure_rows(split, fitted, A.DIVERGED), allowMissingColumns=True), diagnostics), "metrics")
    accepted = metrics.where("passes_model_criteria").select("report_id")
    published = P.combine(backtest, P.future_rows(A.future_path(models, horizon))).join(accepted, "report_id", "left_semi")
    forecasts = staged(P.forecast_rows(published, run), "forecasts")
    return ForecastTables(forecasts, metrics, diagnostics, S.actuals_of(named))


def save_latest_outputs(tables: ForecastTables, run: P.Run, paths: ForecastPaths) -> None:
    """Replace the latest forecasts (placeholder row if none) and metrics; a run that dies leaves the tables before or after."""
    publication.publish(P.with_placeholder(tables.forecasts, run), paths.forecasts_latest)
    publication.publish(tables.metrics, paths.metrics_latest)


def append_forecasts_history(forecasts: DataFrame, run: P.Run, path: str) -> None:
    files.replace_run(P.history_rows(forecasts), path, run.run_id)


def append_metrics_history(metrics: DataFrame, run: P.Run, path: str) -> None:
    files.replace_run(P.stamp(metrics, run), path, run.run_id)


def update_realized_errors(usage: DataFrame, paths: ForecastPaths, realized_at: datetime, **columns) -> DataFrame:
    """Append the errors of forecasts whose day has come since the last call; returns the new rows."""
    return append_realized_errors(staged(S.daily_actuals(usage, **columns), "actuals"), paths, realized_at)


def append_realized_errors(actuals: DataFrame, paths: ForecastPaths, realized_at: datetime) -> DataFrame:
    """The same from stored daily actuals.

    Only the parts of both histories (run and month) that changed since the last call are read; forecasts realised before
    and days that have not come are left out before anything is joined. The new rows are staged before they are appended:
    the plan reads the table it appends to. Marks follow the rows: a call that dies in between is repeated by the next one,
    which adds nothing twice.
    """
    spark = actuals.sparkSession
    written = publication.Folder(spark, paths.realized_errors_history).exists()
    before = histories.stored_marks(spark, paths.realized_errors_marks) if written else {}
    marks = histories.current_marks(actuals, paths.forecasts_history, schemas.FORECAST_HISTORY)
    parts = [name for name, mark in marks.items() if before.get(name) != mark]
    if not parts:
        return spark.createDataFrame([], schemas.REALIZED_ERRORS)
    history = histories.read_parts(spark, paths.forecasts_history, schemas.FORECAST_HISTORY, parts)
    existing = histories.read_parts(spark, paths.realized_errors_history, schemas.REALIZED_ERRORS, parts)
    until = actuals.agg(F.max("date")).scalar()
    new = staged(P.realized_errors(history.where(F.col("target_date") <= until), actuals, existing, realized_at), "realized")
    files.append_rows(new, paths.realized_errors_history)
    histories.store_marks(spark, before | marks, paths.realized_errors_marks)
    return new


def run_forecasts(usage: DataFrame, run: P.Run, root: str, realized_at: datetime | None = None, **options) -> ForecastTables:
    """A whole run: forecast, overwrite the latest tables, extend the histories, backfill errors.

    ``options`` are those of ``run_forecasts_for_reports``, the names of the usage's columns among them. A missing column
    raises before anything is written.
    """
    paths = ForecastPaths(root)
    tables = run_forecasts_for_reports(usage, run, **options)
    save_latest_outputs(tables, run, paths)
    append_forecasts_history(tables.forecasts, run, paths.forecasts_history)
    append_metrics_history(tables.metrics, run, paths.metrics_history)
    append_realized_errors(tables.actuals, paths, realized_at or run.run_timestamp)
    return tables


def silver_daily_views(bronze: DataFrame, *also: str) -> DataFrame:
    """Raw usage events (report_id, report_name, date, occurrences) to daily views; ``also`` are columns that follow from the date."""
    return bronze.groupBy("report_id", "report_name", "date", *also).agg(F.sum("occurrences").alias("actual_views"))


def add_bronze(events: DataFrame, root: str, unit: str = "day") -> None:
    """Append raw usage events to the bronze table, which is stored by ``unit`` of the event's day. Days may come late."""
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.BRONZE]
    periods.append(events.select(*columns), ForecastPaths(root).bronze_report_usage, "date", "report_id", unit)


def refresh_silver(spark: SparkSession, root: str) -> list[str]:
    """Bring the silver table up to date with the bronze one; returns the periods made anew.

    Only the bronze files of periods that have changed since the last call are read, and only their parts are written.
    """
    paths = ForecastPaths(root)
    return periods.refresh(spark, paths.bronze_report_usage, schemas.BRONZE, paths.silver_report_daily_views, paths.silver_marks,
                           lambda rows: silver_daily_views(rows, periods.PERIOD), "report_id")


def refresh_gold(silver: DataFrame, root: str, run: P.Run, **options) -> ForecastTables:
    """Silver daily views to the gold tables, each replaced as a whole."""
    paths = ForecastPaths(root)
    tables = run_forecasts_for_reports(silver, run, report_id_col="report_id", name_col="report_name",
                                       date_col="date", views_col="actual_views", **options)
    publication.publish(tables.forecasts, paths.gold_report_forecasts_latest)
    publication.publish(tables.metrics, paths.gold_report_metrics_latest)
    return tables


def update_layers(events: DataFrame, root: str, run: P.Run, unit: str = "day", **options) -> ForecastTables:
    """New events to bronze, their periods to silver, gold anew: the work below gold grows with the new events' periods.

    A call that dies after the events were appended is not repeated with the same events; ``refresh_silver`` goes on from there.
    """
    spark = events.sparkSession
    add_bronze(events, root, unit)
    refresh_silver(spark, root)
    silver = periods.read(spark, ForecastPaths(root).silver_report_daily_views, schemas.SILVER)
    return refresh_gold(silver.drop(periods.PERIOD), root, run, **options)


def refresh_layers(bronze: DataFrame, root: str, run: P.Run, **options) -> ForecastTables:
    """Bronze events to the silver table to the gold tables, each replaced as a whole; all of it on executors.

    For events that are not kept as the bronze table of ``update_layers``; the two are not mixed below one root.
    """
    paths = ForecastPaths(root)
    publication.publish(silver_daily_views(bronze), paths.silver_report_daily_views)
    return refresh_gold(bronze.sparkSession.read.parquet(paths.silver_report_daily_views), root, run, **options)
