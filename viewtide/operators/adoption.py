"""Daily adoption mart: report-day totals, gap-free calendar, rolling features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from viewtide.functions import columns as C, guards as G

MART = ("date", "report_id", "daily_views", "unique_viewers", "views_per_user")


def build_report_daily_adoption(fact_report_views: DataFrame, date_col: str = "date", report_col: str = "report_id",
                                user_col: str = "user_id", views_col: str | None = None,
                                validate: str = "inline") -> DataFrame:
    """Views, distinct viewers and views per viewer for each (date, report_id).

    ``daily_views`` sums ``views_col`` if named, else counts rows. Spark plans the distinct count over
    (date, report, user) first, so a report holding a third of the rows is spread by user before its
    few report-day rows meet.
    """
    G.require_dataframe(fact_report_views, "fact_report_views")
    G.require_columns(fact_report_views, [date_col, report_col, user_col] + ([views_col] if views_col else []))
    if views_col is not None:
        G.require_numeric(fact_report_views, views_col)
    rows = fact_report_views.select(
        C.to_day(fact_report_views, date_col).alias("date"), C.quoted(report_col).alias("report_id"),
        C.quoted(user_col).alias("_user"), *([C.quoted(views_col).alias("_views")] if views_col else []))
    rows = G.enforce(rows, {f"Unable to parse all values in '{date_col}' into valid datetimes.":
                            ("date", F.col("date").isNull())}, validate)
    views = C.total(F.col("_views")) if views_col else F.count("*")
    return (rows.where(F.col("date").isNotNull() & F.col("report_id").isNotNull())
            .groupBy("date", "report_id")
            .agg(views.alias("daily_views"), F.count_distinct("_user").alias("unique_viewers"))
            .withColumn("views_per_user", C.ratio_or_zero(F.col("daily_views"), F.col("unique_viewers"))))


def adoption_from_user_days(user_days: DataFrame) -> DataFrame:
    """The same mart from views already summed per (date, report_id, user_id) as ``user_views``.

    Rows without a user are kept by that sum: they count as views, not as a viewer.
    """
    return (user_days.where(F.col("date").isNotNull() & F.col("report_id").isNotNull())
            .groupBy("date", "report_id")
            .agg(F.sum("user_views").alias("daily_views"), F.count("user_id").alias("unique_viewers"))
            .withColumn("views_per_user", C.ratio_or_zero(F.col("daily_views"), F.col("unique_viewers"))))


def fill_days(daily: DataFrame, key: str, measures: list[str], last: Column | None = None) -> DataFrame:
    """Make each key's days gap-free, zero on added days.

    From the key's first day to ``last`` (same for all keys), or to its own last day if ``last`` is
    None. A row is stretched up to the day before the key's next row, which needs one window and no
    join with a date spine.
    """
    by_key = Window.partitionBy(key).orderBy("date")
    until = F.coalesce(F.date_sub(F.lead("date").over(by_key), 1), F.col("date") if last is None else last)
    stretched = (daily.withColumn("_until", until)
                 .select("*", F.posexplode(F.sequence("date", "_until")).alias("_step", "_day")))
    # cast of the zero: Catalyst needs both branches to have the measure's own type
    filled = [F.when(F.col("_step") == 0, F.col(m)).otherwise(F.lit(0).cast(daily.schema[m].dataType)).alias(m)
              for m in measures]
    kept = [c for c in daily.columns if c not in measures and c not in (key, "date")]
    return stretched.select(F.col("_day").alias("date"), key, *filled, *kept)


def last_day(daily: DataFrame) -> Column:
    """The last day over all reports, as a scalar subquery."""
    return daily.agg(F.max("date")).scalar()


def fill_report_days(daily: DataFrame, until: Column | None = None) -> DataFrame:
    """Adoption rows for every day from a report's first day to the last day of the whole table.

    ``until`` spares the second evaluation of ``daily`` when the caller knows the last day from a
    cheaper place (a one-column scan of the fact).
    """
    filled = fill_days(daily.select("date", "report_id", "daily_views", "unique_viewers"), "report_id",
                       ["daily_views", "unique_viewers"], last_day(daily) if until is None else until)
    return filled.withColumn("views_per_user", C.ratio_or_zero(F.col("daily_views"), F.col("unique_viewers")))


def add_time_series_usage_features(df: DataFrame, date_col: str = "date", report_col: str = "report_id",
                                   validate: str = "inline") -> DataFrame:
    """Rolling 7/28-row sums and week-over-week change per report; input columns are kept.

    All frames and the lag share one partitioning and order, hence one Window operator. Frames count
    rows, so the input should be gap-free.
    """
    G.require_dataframe(df, "df")
    G.require_columns(df, [date_col, report_col, "daily_views", "unique_viewers"])
    for measure in ("daily_views", "unique_viewers"):
        G.require_numeric(df, measure, "'{}' must be numeric.")
    df = df.withColumn(date_col, C.to_moment(df, date_col))
    df = G.enforce(df, {f"Unable to parse all values in '{date_col}' into valid datetimes.":
                        (date_col, C.quoted(date_col).isNull())}, validate)
    known = C.quoted(report_col).isNotNull()
    # rows without a report get no features; dealt by their content they do not meet in one task
    apart = F.when(~known, F.hash(date_col, "daily_views", "unique_viewers"))
    by_report = Window.partitionBy(report_col, apart).orderBy(date_col)

    def rolling(measure: str, days: int) -> Column:
        return F.when(known, F.sum(measure).over(by_report.rowsBetween(1 - days, 0))).cast("double")

    week_ago = F.lag("daily_views", 7).over(by_report)
    return df.select(
        "*", rolling("daily_views", 7).alias("views_7d"), rolling("daily_views", 28).alias("views_28d"),
        rolling("unique_viewers", 7).alias("viewers_7d"), rolling("unique_viewers", 28).alias("viewers_28d"),
        F.when(known, C.relative_change(F.col("daily_views"), week_ago)).alias("wow_change_views"))


def adoption_mart(fact_report_views: DataFrame, date_col: str = "date_key", report_col: str = "report_id",
                  user_col: str = "user_key", views_col: str | None = "view_count",
                  validate: str = "inline") -> DataFrame:
    """Gap-free adoption mart straight from the fact: two hash exchanges, one scalar subquery."""
    daily = build_report_daily_adoption(fact_report_views, date_col, report_col, user_col, views_col, validate)
    named = fact_report_views.where(C.quoted(report_col).isNotNull())
    until = named.agg(F.max(C.to_day(fact_report_views, date_col))).scalar()
    return fill_report_days(daily, until)


def present(mart: DataFrame) -> DataFrame:
    """Presentation order of every mart."""
    return mart.orderBy("report_id", "date")
