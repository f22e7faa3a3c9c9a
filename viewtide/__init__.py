"""Report-usage analytics on Spark: star schema, checks, daily marts, forecasts."""

from viewtide.operators.adoption import add_time_series_usage_features, build_report_daily_adoption
from viewtide.operators.engagement import build_user_engagement_features
from viewtide.operators.performance import build_report_performance_features
from viewtide.operators.star_schema import build_semantic_model
from viewtide.plans.forecasting import run_forecasts, run_forecasts_for_reports
from viewtide.plans.marts import build_marts
from viewtide.plans.validation import validate_semantic_model

__all__ = [
    "add_time_series_usage_features", "build_marts", "build_report_daily_adoption", "build_report_performance_features",
    "build_semantic_model", "build_user_engagement_features", "run_forecasts", "run_forecasts_for_reports",
    "validate_semantic_model",
]
