"""From fitted models to published rows: error columns, metrics, acceptance, history, realised errors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from viewtide import schemas
from viewtide.functions import columns as C
from viewtide.operators import series as S

MODEL_NAME = "SeasonalARIMA_m7_daily_report_views"
HORIZON = 30
ORDER_COLUMNS = ("p", "d", "q", "seasonal_p", "seasonal_d", "seasonal_q", "m")
SIZES = ("report_name", "n_obs", "n_train", "n_test")


@dataclass(frozen=True)
class Run:
    """Identity of one forecasting run; arguments, so a repeated run gives the same rows."""

    run_id: str
    run_timestamp: datetime
    model_name: str = MODEL_NAME

    @property
    def timestamp(self) -> Column:
        return F.lit(self.run_timestamp.isoformat(sep=" ")).cast("timestamp_ntz")


@dataclass(frozen=True)
class Acceptance:
    """When a model may be published (fixed default values)."""

    max_mae_ratio_to_mean: float = 0.6
    min_improvement_vs_naive: float = 0.10
    min_improvement_vs_seasonal_naive: float = 0.10


def backtest_rows(path: DataFrame, tested: DataFrame) -> DataFrame:
    """Forecast, interval, actual and errors per test day."""
    days = tested.select("report_id", "step", "date", F.col("views").alias("actual"), "naive", "seasonal_naive")
    return with_errors(path.select("report_id", "report_name", "step", "forecast", "lower_ci", "upper_ci")
                       .join(days, ["report_id", "step"]))


def paired_days(path: DataFrame, tested: DataFrame) -> DataFrame:
    """Sizes, order, forecast, actual and both baselines per test day of the fitted reports.

    Both sides carry the sizes and have a day once, so one aggregate brings them together: nothing is joined or sorted.
    """
    key = ("report_id", *SIZES, F.col("step").cast("int").alias("step"))
    days = tested.select(*key, F.col("views").alias("actual"), "naive", "seasonal_naive")
    both = path.select(*key, *ORDER_COLUMNS, "forecast").unionByName(days, allowMissingColumns=True)
    values = (*ORDER_COLUMNS, "forecast", "actual", "naive", "seasonal_naive")
    return both.groupBy("report_id", *SIZES, "step").agg(*[F.max(c).alias(c) for c in values]).where(
        F.col("m").isNotNull() & F.col("actual").isNotNull())


def with_errors(rows: DataFrame) -> DataFrame:
    """Errors of rows that have forecast and actual side by side."""
    error = F.col("actual") - F.col("forecast")
    return (rows.withColumn("error", error).withColumn("abs_error", F.abs("error"))
            .withColumn("pct_error", C.percent_error(F.col("error"), F.col("actual"))))


def future_rows(path: DataFrame) -> DataFrame:
    """Forecast rows after the last day; nothing to compare with yet."""
    nothing = F.lit(None).cast("double")
    return path.select("report_id", "report_name", "date", "forecast", "lower_ci", "upper_ci",
                       *[nothing.alias(c) for c in ("actual", "error", "abs_error", "pct_error")])


def combine(backtest: DataFrame, future: DataFrame) -> DataFrame:
    """Backtest rows followed by future rows."""
    return backtest.select(*future.columns).unionByName(future)


def model_errors(backtest: DataFrame, *also: str) -> DataFrame:
    """Errors of the model and both baselines per report; ``also`` are columns that are the same on all rows of a report.

    Names of figures, here and below, are fixed values.
    """
    actual = F.col("actual")
    return backtest.groupBy("report_id", *also).agg(
        *S.error_figures(actual, F.col("forecast"), "arima"), *S.error_figures(actual, F.col("naive"), "naive"),
        *S.error_figures(actual, F.col("seasonal_naive"), "seasonal_naive"), F.avg(actual).alias("avg_level_test"),
        F.count_if(~(F.abs("forecast") < float("inf")) | F.isnan("forecast")).alias("_broken"))


def backtest_metrics(days: DataFrame) -> DataFrame:
    """One row per fitted report, from its paired_days: sizes, errors of the model and both baselines, improvements, order."""
    errors = model_errors(days, *SIZES, *ORDER_COLUMNS).where(F.col("_broken") == 0).drop("_broken")
    return with_improvements(errors).withColumn("model_str", C.model_label(*[F.col(c) for c in ORDER_COLUMNS]))


def with_improvements(metrics: DataFrame) -> DataFrame:
    return (metrics
            .withColumn("mae_improvement_vs_naive", C.improvement(F.col("mae_arima"), F.col("mae_naive")))
            .withColumn("mae_improvement_vs_seasonal_naive",
                        C.improvement(F.col("mae_arima"), F.col("mae_seasonal_naive"))))


def apply_model_criteria(metrics: DataFrame, rule: Acceptance = Acceptance()) -> DataFrame:
    """Small error against the mean level, and better than at least one baseline.

    A base that is missing or 0 cannot be failed.
    """
    mae = F.col("mae_arima")

    def at_most(base: str, factor: float) -> Column:
        no_base = F.col(base).isNull() | (F.col(base) == 0)
        return no_base | F.coalesce(mae <= F.col(base) * factor, F.lit(False))

    return (metrics
            .withColumn("passes_mae_ratio", at_most("avg_level_test", rule.max_mae_ratio_to_mean))
            .withColumn("passes_improvement_vs_naive", at_most("mae_naive", 1 - rule.min_improvement_vs_naive))
            .withColumn("passes_improvement_vs_seasonal_naive",
                        at_most("mae_seasonal_naive", 1 - rule.min_improvement_vs_seasonal_naive))
            .withColumn("passes_model_criteria", F.col("passes_mae_ratio") & (
                F.col("passes_improvement_vs_naive") | F.col("passes_improvement_vs_seasonal_naive"))))


def metrics_rows(models: DataFrame, backtest: DataFrame, rule: Acceptance = Acceptance()) -> DataFrame:
    """One row per fitted report: sizes, errors, improvements, order, verdict."""
    sizes = models.select("report_id", "report_name", "n_obs", "n_train", "n_test", *ORDER_COLUMNS, "model_str")
    errors = model_errors(backtest).where(F.col("_broken") == 0).drop("_broken")
    return apply_model_criteria(with_improvements(sizes.join(errors, "report_id")), rule).withColumn(
        "error", F.lit(None).cast("string"))


def failure_rows(split: DataFrame, fitted: DataFrame, reason: str) -> DataFrame:
    """One row per report that has no metrics: size, verdict false, reason; all else NULL."""
    reports = split.groupBy("report_id").agg(
        F.min("report_name").alias("report_name"), F.max("n_obs").alias("n_obs"), F.max("error").alias("_short"))
    return reports.join(fitted.select("report_id"), "report_id", "left_anti").select(
        "report_id", "report_name", "n_obs", F.lit(False).alias("passes_model_criteria"),
        F.coalesce("_short", F.lit(reason)).alias("error"))


def with_diagnostics(metrics: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Metrics next to the data-sufficiency figures of the same report."""
    return metrics.join(diagnostics, "report_id", "left")


def stamp(df: DataFrame, run: Run) -> DataFrame:
    return df.withColumn("run_id", F.lit(run.run_id)).withColumn("run_timestamp", run.timestamp)


def forecast_rows(rows: DataFrame, run: Run) -> DataFrame:
    """Rows in the published layout; a row without an actual is a forecast."""
    return ensure_forecast_schema(stamp(rows.select(
        F.col("date").alias("Date"), "forecast", "lower_ci", "upper_ci", "actual", "error", "abs_error", "pct_error",
        F.col("report_id").alias("ReportId"), F.col("report_name").alias("ReportName"),
        F.col("actual").isNull().cast("int").alias("IsForecast"), run.timestamp.alias("ModelRunTimestamp"),
        F.lit(run.model_name).alias("ModelName"), F.lit(0).alias("IsPlaceholderRow")), run))


def ensure_forecast_schema(df: DataFrame) -> DataFrame:
    """The 16 published columns in order; missing flags become 0, other missing columns NULL."""
    flags = ("IsForecast", "IsPlaceholderRow")
    present = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in present else F.lit(0 if f.name in flags else None)).cast(f.dataType).alias(f.name)
        for f in schemas.FORECAST.fields])


def placeholder(spark: SparkSession, run: Run) -> DataFrame:
    """The single row that stands for "nothing published"."""
    row = stamp(spark.range(1).select(
        F.lit("1900-01-01").alias("Date"), F.lit("NO_FORECAST").alias("ReportName"), F.lit(1).alias("IsForecast"),
        run.timestamp.alias("ModelRunTimestamp"), F.lit(run.model_name).alias("ModelName"),
        F.lit(1).alias("IsPlaceholderRow")), run)
    return ensure_forecast_schema(row)


def with_placeholder(forecasts: DataFrame, run: Run) -> DataFrame:
    """The forecasts, or the placeholder row if there are none; decided inside the plan."""
    any_row = forecasts.limit(1).agg(F.count("*")).scalar()
    instead = placeholder(forecasts.sparkSession, run).where(any_row == 0)
    return forecasts.unionByName(instead)


def future_only(forecasts: DataFrame) -> DataFrame:
    return forecasts.where(F.col("IsForecast") == 1)


def history_rows(forecasts: DataFrame) -> DataFrame:
    """Forecast rows in history layout; the horizon counts from the day of the run."""
    return future_only(forecasts).select(
        "run_id", "run_timestamp", F.col("ReportId").alias("report_id"), F.col("ReportName").alias("report_name"),
        F.col("Date").alias("target_date"),
        F.datediff(F.col("Date"), F.to_date("ModelRunTimestamp")).alias("horizon_days"),
        F.col("forecast").alias("forecast_views"), "lower_ci", "upper_ci", F.col("ModelName").alias("model_name"))


def matched_actuals(history: DataFrame, actuals: DataFrame) -> DataFrame:
    """History rows whose target day has actual usage by now."""
    return history.join(actuals.select("report_id", F.col("date").alias("target_date"), "actual_views"),
                        ["report_id", "target_date"])


REALIZED_KEY: Sequence[str] = ("run_id", "report_id", "target_date")


def unseen(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows whose key was not realised before."""
    return rows.join(existing.select(*REALIZED_KEY), list(REALIZED_KEY), "left_anti")


def realized_errors(history: DataFrame, actuals: DataFrame, existing: DataFrame, realized_at: datetime) -> DataFrame:
    """Errors of forecasts whose day has come, each reported once."""
    error = F.col("actual_views") - F.col("forecast_views")
    return (matched_actuals(unseen(history, existing), actuals)
            .withColumn("error", error).withColumn("abs_error", F.abs("error"))
            .withColumn("pct_error", C.percent_error(F.col("error"), F.col("actual_views")))
            .withColumn("realized_at", F.lit(realized_at.isoformat(sep=" ")).cast("timestamp_ntz"))
            .select(*schemas.REALIZED_ERRORS.fieldNames()))


def acceptance_view(metrics: DataFrame, rows: int = 15) -> DataFrame:
    """Accepted reports first, then by error: the top of the list. The columns are fixed values."""
    return (metrics.select(
        "report_name", "passes_data_criteria", "passes_model_criteria", "mae_arima", "mae_naive", "mae_seasonal_naive",
        "mae_improvement_vs_naive", "mae_improvement_vs_seasonal_naive", "wape_arima", "model_str")
        .orderBy(F.col("passes_model_criteria").desc(), F.col("mae_arima").asc_nulls_last(), "report_name").limit(rows))
