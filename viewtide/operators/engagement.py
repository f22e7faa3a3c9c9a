"""Behavioural mart: repeat use, concentration, idle gaps, page depth.

One chain for the views: user-days -> histogram of views per report-day -> report-day. Each exchange
carries fewer rows than the one before, and no step gathers the users of a report-day in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from viewtide.functions import columns as C, guards as G
from viewtide.functions.order_stats import top_share

DAY = ["date", "report_id"]
USER_DAY = ["date", "report_id", "user_id"]
MART = ("date", "report_id", "repeat_user_rate", "top_10pct_user_share", "days_since_last_use", "avg_pages_per_user")


def pick_measure(df: DataFrame, candidates: tuple[str, ...]) -> str | None:
    """The first of the candidate columns the table has; None means rows are counted."""
    name = next((c for c in candidates if c in df.columns), None)
    if name is not None:
        G.require_numeric(df, name)
    return name


def canonical_rows(df: DataFrame, date_col: str, report_col: str, user_col: str, measure: str | None,
                   label: str, validate: str) -> DataFrame:
    """The caller's columns under the names date, report_id, user_id (and _amount)."""
    rows = df.select(C.to_day(df, date_col).alias("date"), C.quoted(report_col).alias("report_id"),
                     C.quoted(user_col).alias("user_id"), *([C.quoted(measure).alias("_amount")] if measure else []))
    return G.enforce(rows, {f"Unable to parse all values in '{date_col}' from {label}.":
                            ("date", F.col("date").isNull())}, validate)


def per_user_day(rows: DataFrame, name: str) -> DataFrame:
    """Sum of the measure, or row count, per (date, report, user)."""
    amount = C.total(F.col("_amount")) if "_amount" in rows.columns else F.count("*")
    return rows.groupBy(*USER_DAY).agg(amount.alias(name))


def known_users(user_days: DataFrame) -> DataFrame:
    """Behaviour is a matter of users: rows without one, or without report or day, drop out."""
    return C.filled(user_days, USER_DAY)


def with_first_view(user_days: DataFrame) -> DataFrame:
    """Add the user's first day on the report; the window holds at most one row per calendar day."""
    history = Window.partitionBy("report_id", "user_id")
    return (user_days.withColumn("first_view_date", F.min("date").over(history))
            .withColumn("is_repeat_user", F.col("date") > F.col("first_view_date")))


def view_histogram(user_days: DataFrame) -> DataFrame:
    """Per report-day: how many users (and returning users) had each number of views."""
    return user_days.groupBy(*DAY, "user_views").agg(
        F.count("*").alias("users"), F.count_if("is_repeat_user").alias("repeats"))


def report_day_behaviour(user_days: DataFrame) -> DataFrame:
    """repeat_user_rate, top_10pct_user_share and the totals they come from, per report-day."""
    marked = user_days if "is_repeat_user" in user_days.columns else with_first_view(user_days)
    integral = isinstance(user_days.schema["user_views"].dataType, T.IntegralType)
    daily = top_share(view_histogram(marked), DAY, "user_views", "users", C.top_decile_size, integral, also=[
        F.sum("users").alias("unique_viewers"), F.sum("repeats").alias("repeat_users"),
        F.sum(F.col("users") * F.col("user_views")).alias("total_views")])
    return daily.select(
        *DAY, "unique_viewers", "repeat_users", "total_views",
        C.ratio_or_zero(F.col("repeat_users"), F.col("unique_viewers")).alias("repeat_user_rate"),
        C.ratio_or_zero(F.col("_top"), F.col("total_views")).alias("top_10pct_user_share"))


def previous_active_day(views: Column) -> Column:
    """Latest earlier day of the report with views."""
    earlier = (Window.partitionBy("report_id").orderBy("date")
               .rowsBetween(Window.unboundedPreceding, -1))
    return F.last(F.when(views > 0, F.col("date")), ignorenulls=True).over(earlier)


def with_idle_days(daily: DataFrame, views: str = "total_views") -> DataFrame:
    """Days since the report was last used; 0 on inactive days and on the first active one."""
    gap = F.when(F.col(views) > 0, F.datediff("date", "previous_active_date"))
    return (daily.withColumn("previous_active_date", previous_active_day(F.col(views)))
            .withColumn("days_since_last_use", F.coalesce(gap, F.lit(0)).cast("bigint")))


def page_depth(user_pages: DataFrame) -> DataFrame:
    return user_pages.groupBy(*DAY).agg(F.avg("page_views").alias("avg_pages_per_user"))


def build_user_engagement_features(fact_report_views: DataFrame, fact_page_views: DataFrame, date_col: str = "date",
                                   report_col: str = "report_id", user_col: str = "user_id",
                                   validate: str = "inline") -> DataFrame:
    """One row per (date, report_id) that has views, with the four behavioural features."""
    G.require_dataframe(fact_report_views, "fact_report_views")
    G.require_dataframe(fact_page_views, "fact_page_views")
    for fact in (fact_report_views, fact_page_views):
        G.require_columns(fact, [date_col, report_col, user_col])
    G.require_page_identity(fact_page_views)
    views = canonical_rows(fact_report_views, date_col, report_col, user_col,
                           pick_measure(fact_report_views, ("view_count", "views")), "fact_report_views", validate)
    pages = canonical_rows(fact_page_views, date_col, report_col, user_col,
                           pick_measure(fact_page_views, ("page_view_count",)), "fact_page_views", validate)
    return engagement_from_user_days(per_user_day(views, "user_views"), per_user_day(pages, "page_views"))


def engagement_from_user_days(user_days: DataFrame, user_pages: DataFrame) -> DataFrame:
    """The same mart from views and page views already summed per (date, report_id, user_id)."""
    behaviour = report_day_behaviour(known_users(user_days))
    depth = page_depth(known_users(user_pages))
    # the join comes first: both sides are already partitioned by (date, report_id) here
    joined = behaviour.join(depth, DAY, "left")
    return with_idle_days(joined).select(
        *DAY, "repeat_user_rate", "top_10pct_user_share", "days_since_last_use",
        F.coalesce("avg_pages_per_user", F.lit(0.0)).alias("avg_pages_per_user"))


def repeat_rate_changes(mart: DataFrame) -> DataFrame:
    """Rows whose repeat rate differs from the report's previous row; a first row is no change."""
    step = F.col("repeat_user_rate") - F.lag("repeat_user_rate").over(Window.partitionBy("report_id").orderBy("date"))
    return (mart.withColumn("_step", F.coalesce(step, F.lit(0.0))).where(F.col("_step") != 0)
            .select(*DAY, "repeat_user_rate"))


def high_concentration(mart: DataFrame, share: float = 0.5) -> DataFrame:
    return (mart.where(F.col("top_10pct_user_share") >= share)
            .select(*DAY, "top_10pct_user_share", "repeat_user_rate"))


def idle_spikes(mart: DataFrame, days: int = 2) -> DataFrame:
    return mart.where(F.col("days_since_last_use") >= days).select(*DAY, "days_since_last_use", "repeat_user_rate")
