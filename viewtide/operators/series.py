"""Daily series per report: totals, sufficiency, split, baselines.

A report's series has one row per calendar day, so every window here holds a few thousand rows at
most, however many views the report has. All windows are partitioned by report: after the daily
totals there is one exchange, and everything up to the baselines runs on it.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from viewtide.functions import columns as C, guards as G

# Season, share of training days, text of the failure.
SEASON = 7
TRAIN_SHARE = 0.8
TOO_SHORT = "Series too short for robust backtest split"
NOT_FINITE = "Series holds values that are not finite"


@dataclass(frozen=True)
class Sufficiency:
    """Least data a series must have to be modelled (fixed default values)."""

    min_days: int = 90
    min_nonzero_days: int = 35
    min_nonzero_ratio: float = 0.25
    min_total_views: int = 120


def named_totals(usage: DataFrame, report_id_col: str = "Report Guid", date_col: str = "Date",
                 name_col: str = "Report Name", views_col: str = "Occurrences", validate: str = "inline") -> DataFrame:
    """Views per report, name and day: report_id, _name, date, views. Totals and actuals both follow from it."""
    G.require_dataframe(usage, "usage")
    G.require_measure(usage, views_col)
    G.require_columns(usage, [report_id_col, date_col, name_col])
    # a date that is missing drops out, a date that is there but unreadable is an error
    rows = usage.select(C.quoted(report_id_col).alias("report_id"), C.quoted(name_col).alias("_name"),
                        C.to_day(usage, date_col).alias("date"), C.quoted(date_col).isNotNull().alias("_dated"),
                        C.to_number_or_zero(usage, views_col).alias("views"))
    rows = G.enforce(rows, {f"Unable to parse all values in '{date_col}' into valid datetimes.":
                            ("date", F.col("_dated") & F.col("date").isNull())}, validate)
    return C.filled(rows, ["report_id", "date"]).groupBy("report_id", "_name", "date").agg(F.sum("views").alias("views"))


def daily_totals(usage: DataFrame, **columns) -> DataFrame:
    """Views per report and day with usage: report_id, report_name, date, views. ``columns`` as in named_totals."""
    return totals_of(named_totals(usage, **columns))


def totals_of(named: DataFrame) -> DataFrame:
    """Daily totals from sums per name. A report has one name; if its rows disagree the smallest is taken.

    The rows are sorted once, by report, day (last one first) and name. All windows here and in what makes series of the totals
    go along that order, so a task holds its sums a single time.
    """
    by_report = Window.partitionBy("report_id").orderBy(F.desc("date"), "_name")
    by_day = _backwards()
    whole = by_report.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = named.withColumn("report_name", F.min("_name").over(whole)).withColumn("_later", F.lag("date").over(by_report))
    summed = ranked.withColumn("views", F.sum("views").over(by_day.rangeBetween(Window.currentRow, Window.currentRow)))
    first = F.col("_later").isNull() | (F.col("_later") > F.col("date"))
    return summed.where(first).select("report_id", "report_name", "date", "views")


def _sufficiency_columns(over: Window | None, rule: Sufficiency) -> dict[str, Column]:
    def whole(aggregate: Column) -> Column:
        return aggregate if over is None else aggregate.over(over)

    return {
        # first to last day, so gaps need not be filled in first
        "total_days": (F.datediff(whole(F.max("date")), whole(F.min("date"))) + 1).cast("bigint"),
        "nonzero_days": whole(F.count_if(F.col("views") > 0)),
        # infinite sums pass and are reported as an error of their report later, they do not stop the others
        "total_views": F.least(whole(F.sum("views")), F.lit(float(1 << 62))).try_cast("bigint"),
    }


def _passes(rule: Sufficiency) -> Column:
    return ((F.col("total_days") >= rule.min_days) & (F.col("nonzero_days") >= rule.min_nonzero_days)
            & (F.col("nonzero_ratio") >= rule.min_nonzero_ratio) & (F.col("total_views") >= rule.min_total_views))


def sufficiency(daily: DataFrame, rule: Sufficiency = Sufficiency()) -> DataFrame:
    """One row per report with the figures and the verdict; takes totals or gap-free series."""
    figures = _sufficiency_columns(None, rule)
    return (daily.groupBy("report_id").agg(*[c.alias(n) for n, c in figures.items()])
            .withColumn("nonzero_ratio", F.col("nonzero_days") / F.col("total_days"))
            .withColumn("passes_data_criteria", _passes(rule))
            .select("report_id", "total_days", "nonzero_days", "nonzero_ratio", "total_views", "passes_data_criteria"))


def with_sufficiency(daily: DataFrame, rule: Sufficiency = Sufficiency()) -> DataFrame:
    """The same figures on every row, for filtering without a join."""
    by_report = Window.partitionBy("report_id")
    return (daily.select("*", *[c.alias(n) for n, c in _sufficiency_columns(by_report, rule).items()])
            .withColumn("nonzero_ratio", F.col("nonzero_days") / F.col("total_days"))
            .withColumn("passes_data_criteria", _passes(rule)))


def allowed_names(series: DataFrame, names: Collection[str] = ()) -> DataFrame:
    """Keep reports of these names; no names means all."""
    return series.where(F.col("report_name").isin(list(names))) if names else series


def _backwards() -> Window:
    """A report's days from the last to the first."""
    return Window.partitionBy("report_id").orderBy(F.desc("date"))


def _with_until(daily: DataFrame) -> DataFrame:
    """_until: the day before the report's next day with usage, or the day itself if it is the last."""
    return daily.withColumn("_until", F.coalesce(F.date_sub(F.lag("date").over(_backwards()), 1), F.col("date")))


def _stretched(daily: DataFrame, *added: Column) -> DataFrame:
    """A row per day from date to _until, the last day first, zero views on added days; ``added`` may use _day, the new date."""
    views = F.when(F.col("_day") == F.col("date"), F.col("views")).otherwise(F.lit(0).cast(daily.schema["views"].dataType))
    days = F.explode(F.sequence("_until", "date", F.expr("INTERVAL -1 DAY")))
    kept = [c for c in daily.columns if c not in ("date", "report_id", "views", "_until")]
    return daily.withColumn("_day", days).select(F.col("_day").alias("date"), "report_id", views.alias("views"), *kept, *added)


def fill_series(daily: DataFrame) -> DataFrame:
    """Gap-free from the report's own first to its own last day, zero on added days."""
    return _stretched(_with_until(daily))


def daily_series(usage: DataFrame, **columns) -> DataFrame:
    """Gap-free series of all reports: date, report_id, views, report_name."""
    return fill_series(daily_totals(usage, **columns))


def split_series(series: DataFrame, train_share: float = TRAIN_SHARE) -> DataFrame:
    """Number the days of each series and mark the first share as training.

    Adds pos (1..n), n_obs, n_train, n_test, step (1.. in the test part, else NULL) and error (why the
    series cannot be backtested, else NULL).
    """
    by_report = Window.partitionBy("report_id")
    finite = F.min(_is_finite()).over(by_report)
    return _split_columns(series.withColumn("pos", F.row_number().over(by_report.orderBy("date")).cast("bigint"))
                          .withColumn("n_obs", F.count("*").over(by_report)).withColumn("_finite", finite), train_share).drop("_finite")


def _is_finite() -> Column:
    views = F.col("views").cast("double")
    return ~F.isnan(views) & (F.abs(views) < float("inf"))


def _training_days(train_share: float) -> Column:
    return F.floor(F.col("n_obs") * F.lit(float(train_share)))


def _split_columns(numbered: DataFrame, train_share: float) -> DataFrame:
    """n_train, n_test, step and error of rows with pos, n_obs and _finite."""
    return (numbered.withColumn("n_train", _training_days(train_share)).withColumn("n_test", F.col("n_obs") - F.col("n_train"))
            .withColumn("step", F.when(F.col("pos") > F.col("n_train"), F.col("pos") - F.col("n_train")))
            .withColumn("error", F.when((F.col("n_train") < 30) | (F.col("n_test") < 7), F.lit(TOO_SHORT))
                        .when(~F.col("_finite"), F.lit(NOT_FINITE))))


def numbered_series(daily: DataFrame, train_share: float = TRAIN_SHARE) -> DataFrame:
    """The gap-free series of daily totals, split, and the last training season of each: split_series of fill_series, and _season.

    Everything is worked out on the days with usage. They are stretched to calendar days last, and no sort or map holds
    calendar days: one report in many has usage on one day in five.
    """
    by_report = Window.partitionBy("report_id")
    # the ordered window comes first: its order also serves those without one
    daily = _with_until(daily)
    daily = daily.select("*", F.min("date").over(by_report).alias("_first"), F.max("date").over(by_report).alias("_last"),
                         F.min(_is_finite()).over(by_report).alias("_finite"))
    daily = (daily.withColumn("n_obs", F.datediff("_last", "_first").cast("bigint") + 1)
             .withColumn("_end", F.date_add("_first", (_training_days(train_share) - 1).cast("int"))))
    zero = F.lit(0).cast(daily.schema["views"].dataType)
    season = [F.coalesce(F.max(F.when(F.col("date") == F.date_sub("_end", back), F.col("views"))).over(by_report), zero)
              for back in reversed(range(SEASON))]
    kept = F.least(_training_days(train_share), F.lit(SEASON)).cast("int")
    daily = daily.withColumn("_season", F.slice(F.array(*season), SEASON + 1 - kept, kept))
    pos = F.datediff("_day", "_first").cast("bigint") + 1
    return _split_columns(_stretched(daily, pos.alias("pos")), train_share).drop("_first", "_last", "_end", "_finite")


def with_baselines(split: DataFrame) -> DataFrame:
    """Test days with the two baselines: last training value, last training season repeated.

    The last season travels as an array of at most seven values; rows of numbered_series have it already.
    """
    tested = F.col("step").isNotNull() & (F.size("_season") > 0)
    return with_naive(with_season(split).where(tested)).drop("_season")


def with_season(split: DataFrame) -> DataFrame:
    """The last training season as _season, if it is not there."""
    if "_season" in split.columns:
        return split
    whole = (Window.partitionBy("report_id").orderBy("date")
             .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    in_season = (F.col("pos") <= F.col("n_train")) & (F.col("pos") > F.col("n_train") - SEASON)
    return split.withColumn("_season", F.collect_list(F.when(in_season, F.col("views"))).over(whole))


def with_naive(tested: DataFrame) -> DataFrame:
    """Both baselines from the season."""
    naive = F.element_at("_season", -1)
    repeated = F.get("_season", ((F.col("step") - 1) % SEASON).cast("int"))
    return tested.withColumn("naive", naive).withColumn(
        "seasonal_naive", F.when(F.size("_season") < SEASON, naive).otherwise(repeated))


def error_figures(actual: Column, forecast: Column, suffix: str) -> list[Column]:
    """MAE, RMSE and WAPE as aggregates named ``<figure>_<suffix>``; WAPE is NULL without volume."""
    error = actual - forecast
    return [F.avg(F.abs(error)).alias(f"mae_{suffix}"), F.sqrt(F.avg(error * error)).alias(f"rmse_{suffix}"),
            C.ratio(F.sum(F.abs(error)), F.sum(F.abs(actual))).alias(f"wape_{suffix}")]


def baseline_errors(tested: DataFrame) -> DataFrame:
    """Errors of both baselines and the mean level, per report."""
    return tested.groupBy("report_id").agg(
        *error_figures(F.col("views"), F.col("naive"), "naive"),
        *error_figures(F.col("views"), F.col("seasonal_naive"), "seasonal_naive"),
        F.avg("views").alias("avg_level_test"))


def daily_actuals(usage: DataFrame, **columns) -> DataFrame:
    """Views per report id, report name and day (a renamed report has a row per name). ``columns`` as in named_totals."""
    return actuals_of(named_totals(usage, **columns))


def actuals_of(named: DataFrame) -> DataFrame:
    """Daily actuals from sums per name; rows without a name take no part."""
    return C.filled(named, ["_name"]).select("report_id", F.col("_name").alias("report_name"), "date",
                                             F.col("views").alias("actual_views"))


def usage_summary(usage: DataFrame, name_col: str = "Report Name", views_col: str = "Occurrences") -> DataFrame:
    """Per report: total views, rows, mean per row; largest first."""
    return (usage.where(C.quoted(name_col).isNotNull()).groupBy(C.quoted(name_col).alias("report_name"))
            .agg(C.total(C.quoted(views_col)).alias("total_views"), F.count(C.quoted(views_col)).alias("rows"),
                 F.avg(C.quoted(views_col)).alias("avg_occurrence_per_row"))
            .orderBy(F.col("total_views").desc(), "report_name"))
