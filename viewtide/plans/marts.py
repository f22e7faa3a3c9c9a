"""The three daily marts from the facts of the star schema."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from viewtide.operators import adoption, engagement, performance
from viewtide.session import staged


def user_day_views(fact: DataFrame, measure: tuple[str, ...], name: str, validate: str) -> DataFrame:
    """A fact summed per (date, report_id, user_id)."""
    rows = engagement.canonical_rows(fact, "date_key", "report_id", "user_key",
                                     engagement.pick_measure(fact, measure), "the fact table", validate)
    return engagement.per_user_day(rows, name)


def build_marts(tables: Mapping[str, DataFrame], validate: str = "inline") -> dict[str, DataFrame]:
    """Adoption (plain and with rolling features), engagement and performance.

    Adoption and engagement both start from views per user-day. That sum is the one large shuffle of
    the view fact, so it is done once and staged. ``validate`` holds for every fact.
    """
    user_days = staged(user_day_views(tables["fact_report_views"], ("view_count", "views"), "user_views", validate), "user-days")
    user_pages = user_day_views(tables["fact_page_views"], ("page_view_count",), "page_views", validate)
    last = user_days.where(F.col("report_id").isNotNull()).agg(F.max("date")).scalar()
    mart = adoption.fill_report_days(adoption.adoption_from_user_days(user_days), last)
    return {
        "mart_report_daily_adoption": mart,
        "mart_report_daily_adoption_ts_features": adoption.add_time_series_usage_features(mart, validate="off"),
        "mart_user_engagement": engagement.engagement_from_user_days(user_days, user_pages),
        "mart_report_performance": performance.build_report_performance_features(
            tables["fact_report_loads"], "date_key", "report_id", "load_time_ms", validate),
    }


def first_reports(mart: DataFrame, n: int) -> DataFrame:
    """Rows of the first n reports by id."""
    few = mart.select("report_id").distinct().orderBy("report_id").limit(n)
    return mart.join(few, "report_id", "left_semi")


def load_time_vs_usage(performance_mart: DataFrame, adoption_mart: DataFrame) -> DataFrame:
    """Load times next to the views of the same report-day."""
    views = adoption_mart.select("date", "report_id", "daily_views")
    return (performance_mart.join(views, ["date", "report_id"], "left")
            .select("date", "report_id", "avg_load_time", "p90_load_time", "daily_views"))


def wow_missing(ts: DataFrame) -> DataFrame:
    return ts.where(F.col("wow_change_views").isNull()).select(
        "date", "report_id", "daily_views", "views_7d", "views_28d", "wow_change_views")
