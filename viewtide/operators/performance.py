"""Load-time mart: mean, exact 90th percentile, rolling mean, week-over-week change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from viewtide.functions import columns as C, guards as G
from viewtide.functions.order_stats import exact_percentiles

DAY = ["date", "report_id"]
MART = ("date", "report_id", "avg_load_time", "p90_load_time", "avg_load_time_7d", "load_time_wow_change", "load_events")


def load_rows(loads: DataFrame, date_col: str, report_col: str, load_time_col: str) -> DataFrame:
    return loads.select(C.to_day(loads, date_col).alias("date"), C.quoted(report_col).alias("report_id"),
                        C.to_number(loads, load_time_col).alias("load_time"))


def load_rules(date_col: str, load_time_col: str) -> dict:
    """Value rules; the messages are fixed values."""
    return {
        f"Unable to parse all values in '{date_col}' into valid datetimes.": ("date", F.col("date").isNull()),
        f"Unable to convert all values in '{load_time_col}' to numeric load times.":
            ("load_time", F.col("load_time").isNull()),
        f"'{load_time_col}' must not contain negative values.": ("load_time", F.col("load_time") < 0),
    }


def aggregate_loads(rows: DataFrame) -> DataFrame:
    """Mean, p90 and count per report-day, of any size."""
    means = rows.groupBy(*DAY).agg(F.avg("load_time").alias("avg_load_time"), F.count("*").alias("load_events"))
    p90 = exact_percentiles(rows, DAY, "load_time", {"p90_load_time": 0.9})
    return means.join(p90, DAY, "left").select(*DAY, "avg_load_time", "p90_load_time", "load_events")


def add_load_trends(daily: DataFrame) -> DataFrame:
    """Mean over the last 7 active days and change against 7 active days before."""
    by_report = Window.partitionBy("report_id").orderBy("date")
    return daily.select(
        *DAY, "avg_load_time", "p90_load_time",
        F.avg("avg_load_time").over(by_report.rowsBetween(-6, 0)).alias("avg_load_time_7d"),
        C.relative_change(F.col("avg_load_time"), F.lag("avg_load_time", 7).over(by_report))
        .alias("load_time_wow_change"),
        "load_events")


def build_report_performance_features(fact_report_loads: DataFrame, date_col: str = "date",
                                      report_col: str = "report_id", load_time_col: str = "load_time",
                                      validate: str = "inline") -> DataFrame:
    """Daily load-time features per report."""
    G.require_dataframe(fact_report_loads, "fact_report_loads")
    G.require_columns(fact_report_loads, [date_col, report_col, load_time_col])
    rows, rules = load_rows(fact_report_loads, date_col, report_col, load_time_col), load_rules(date_col, load_time_col)
    return add_load_trends(aggregate_loads(C.filled(G.enforce(rows, rules, validate), DAY)))
