"""Column types of the stored tables.

Event times and run times are ``TIMESTAMP_NTZ``: wall-clock values that no session zone shifts.
"""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"string": T.StringType, "date": T.DateType, "boolean": T.BooleanType, "int": T.IntegerType,
          "bigint": T.LongType, "double": T.DoubleType, "timestamp_ntz": T.TimestampNTZType,
          "double[]": lambda: T.ArrayType(T.DoubleType())}


def schema(columns: str) -> T.StructType:
    """Schema from "name type, ..." (``StructType.fromDDL`` would need a running session)."""
    fields = [part.split() for part in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]()) for name, kind in fields])


RAW = {
    "reports": schema("report_id string, report_name string, workspace_id string, report_type string, "
                       "is_usage_metrics_report boolean"),
    "users": schema("user_key string, user_id string, unique_user string"),
    "report_pages": schema("report_id string, section_id string, section_name string"),
    "dates": schema("date date, day_of_week string, week_start_date date, month string, is_weekend boolean"),
    "report_views": schema("date date, report_id string, user_key string, user_id string, consumption_method string, "
                            "distribution_method string, user_agent string, view_count bigint"),
    "report_page_views": schema("timestamp timestamp_ntz, date date, report_id string, section_id string, "
                                 "user_key string, client string, session_source string, page_view_count bigint"),
    "report_load_times": schema("timestamp timestamp_ntz, date date, report_id string, user_key string, "
                                 "user_id string, browser string, client string, country string, load_time_ms double"),
}

PROCESSED = {
    "dim_date": schema("date_key int, date date, day_of_week string, week_start_date date, month string, "
                        "is_weekend boolean"),
    "dim_user": RAW["users"],
    "dim_report": RAW["reports"],
    "dim_page": schema("page_key bigint, report_id string, section_id string, section_name string"),
    "fact_report_views": schema("date_key int, report_id string, user_key string, consumption_method string, "
                                 "distribution_method string, view_count bigint"),
    "fact_page_views": schema("date_key int, report_id string, page_key bigint, user_key string, client string, "
                               "session_source string, page_view_count bigint"),
    "fact_report_loads": schema("date_key int, report_id string, user_key string, browser string, client string, "
                                 "country string, load_time_ms double"),
}

FORECAST = schema(
    "Date date, forecast double, lower_ci double, upper_ci double, actual double, error double, abs_error double, "
    "pct_error double, ReportId string, ReportName string, IsForecast int, ModelRunTimestamp timestamp_ntz, "
    "ModelName string, run_id string, run_timestamp timestamp_ntz, IsPlaceholderRow int")

FORECAST_HISTORY = schema(
    "run_id string, run_timestamp timestamp_ntz, report_id string, report_name string, target_date date, "
    "horizon_days int, forecast_views double, lower_ci double, upper_ci double, model_name string")

REALIZED_ERRORS = schema(
    "run_id string, report_id string, report_name string, target_date date, horizon_days int, forecast_views double, "
    "actual_views double, error double, abs_error double, pct_error double, run_timestamp timestamp_ntz, "
    "realized_at timestamp_ntz, model_name string")

#: Raw usage events and the daily views made of them.
BRONZE = schema("report_id string, report_name string, date date, occurrences double")
SILVER = schema("report_id string, report_name string, date date, actual_views double")
