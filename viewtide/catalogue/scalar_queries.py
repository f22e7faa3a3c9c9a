"""Scalar functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from viewtide.catalogue.base import Data, query
from viewtide.functions import columns as C


@query("fn_date_format", uses="dates", sql="""
    SELECT date, CAST(strftime(date, '%Y%m%d') AS INTEGER) AS date_key, dayname(date) AS day_of_week,
           strftime(date, '%Y-%m') AS month FROM dates""")
def fn_date_format(data: Data) -> DataFrame:
    return data.dates().select("date", C.date_key(F.col("date")).alias("date_key"), "day_of_week", "month")


@query("fn_week_start", uses="dates", sql="SELECT date, date - CAST(isodow(date) - 1 AS INTEGER) AS week_start FROM dates")
def fn_week_start(data: Data) -> DataFrame:
    return data.dates().select("date", C.week_start(F.col("date")).alias("week_start"))


@query("fn_weekend", uses="dates", sql="SELECT date, isodow(date) IN (6, 7) AS weekend FROM dates")
def fn_weekend(data: Data) -> DataFrame:
    return data.dates().select("date", C.is_weekend(F.col("date")).alias("weekend"))


@query("fn_normalize", sql="SELECT event_id, CAST(ts AS DATE) AS date FROM events")
def fn_normalize(data: Data) -> DataFrame:
    events = data.table("events")
    return events.select("event_id", C.to_day(events, "ts").alias("date"))


@query("fn_day_diff", uses="daily_b", sql="""
    SELECT date, report_id, date - lag(date) OVER (PARTITION BY report_id ORDER BY date) AS gap FROM daily_b""")
def fn_day_diff(data: Data) -> DataFrame:
    before = F.lag("date").over(Window.partitionBy("report_id").orderBy("date"))
    return data.daily_b().select("date", "report_id", F.datediff("date", before).cast("bigint").alias("gap"))


@query("fn_date_add", uses="daily_b", sql="""
    SELECT report_id, CAST(unnest(generate_series(max(date) + INTERVAL 1 DAY, max(date) + INTERVAL 30 DAY, INTERVAL 1 DAY)) AS DATE)
           AS date FROM daily_b GROUP BY report_id""")
def fn_date_add(data: Data) -> DataFrame:
    last = data.daily_b().groupBy("report_id").agg(F.max("date").alias("last"))
    return last.select("report_id", F.explode(F.sequence(F.date_add("last", 1), F.date_add("last", 30))).alias("date"))


@query("fn_abs_pct_error", uses="daily_b", doubles="pct_error", sql="""
    SELECT date, report_id, daily_views - unique_viewers AS error, abs(daily_views - unique_viewers) AS abs_error,
           abs(daily_views - unique_viewers) / CAST(nullif(daily_views, 0) AS DOUBLE) * 100 AS pct_error FROM daily_b""")
def fn_abs_pct_error(data: Data) -> DataFrame:
    error = F.col("daily_views") - F.col("unique_viewers")
    return data.daily_b().select("date", "report_id", error.alias("error"), F.abs(error).alias("abs_error"),
                                 C.percent_error(error, F.col("daily_views")).alias("pct_error"))


@query("fn_clip", uses="daily_b", doubles="clipped", sql="""
    SELECT date, report_id, CAST(greatest(daily_views - 20, 0) AS DOUBLE) AS clipped FROM daily_b""")
def fn_clip(data: Data) -> DataFrame:
    return data.daily_b().select("date", "report_id",
                                 C.floor_at_zero(F.col("daily_views").cast("double") - 20).alias("clipped"))


@query("fn_null_zero", uses="mart_b", doubles="per_view", sql="""
    SELECT date, report_id, unique_viewers / CAST(nullif(daily_views, 0) AS DOUBLE) AS per_view FROM mart_b""")
def fn_null_zero(data: Data) -> DataFrame:
    return data.mart_b().select("date", "report_id",
                                C.ratio(F.col("unique_viewers"), F.col("daily_views")).alias("per_view"))


@query("fn_inf_to_null", sql="""
    SELECT event_id, CASE WHEN user_id % 3 = 0 THEN value END AS value FROM events""", doubles="value")
def fn_inf_to_null(data: Data) -> DataFrame:
    """Values spoilt for two thirds of the users: infinite for one, not a number for the other."""
    spoilt = (F.when(F.col("user_id") % 3 == 1, F.lit(float("inf"))).when(F.col("user_id") % 3 == 2, F.lit(float("nan")))
              .otherwise(F.col("value")))
    return data.table("events").select("event_id", C.finite(spoilt).alias("value"))


@query("fn_fill", uses="ts_b", doubles="wow", sql="SELECT date, report_id, coalesce(wow_change_views, 0.0) AS wow FROM ts_b")
def fn_fill(data: Data) -> DataFrame:
    return data.ts_b().select("date", "report_id", F.coalesce("wow_change_views", F.lit(0.0)).alias("wow"))


@query("fn_between", uses="ts_b", sql="""
    SELECT date, report_id, coalesce(wow_change_views BETWEEN 0 AND 1, false) AS in_range FROM ts_b""")
def fn_between(data: Data) -> DataFrame:
    return data.ts_b().select("date", "report_id", F.coalesce(F.col("wow_change_views").between(0, 1), F.lit(False))
                              .alias("in_range"))


@query("fn_ceil_max", uses="daily_a", sql="""
    SELECT date, report_id, CAST(greatest(1, ceil(unique_viewers * 0.1::DOUBLE)) AS BIGINT) AS top_n FROM daily_a""")
def fn_ceil_max(data: Data) -> DataFrame:
    return data.daily_a().select("date", "report_id", C.top_decile_size(F.col("unique_viewers")).alias("top_n"))


@query("fn_concat_id", sql="""
    SELECT l_linenumber % 4 AS p, 'ARIMA(' || l_linenumber % 4 || ',' || l_linenumber % 2 || ',0)x(' || l_linenumber % 3
           || ',0,0,7)' AS model_str, count(*) AS rows FROM lineitem GROUP BY l_linenumber""")
def fn_concat_id(data: Data) -> DataFrame:
    """Model labels of orders made from line numbers."""
    n, zero = F.col("l_linenumber"), F.lit(0)
    counted = data.table("lineitem").groupBy("l_linenumber").agg(F.count("*").alias("rows"))
    return counted.select((n % 4).alias("p"), C.model_label(n % 4, n % 2, zero, n % 3, zero, zero, F.lit(7))
                          .alias("model_str"), "rows")


@query("fn_improvement", uses="daily_b", doubles="gain", sql="""
    SELECT date, report_id, CASE WHEN daily_views > 0 THEN 1 - unique_viewers / CAST(daily_views AS DOUBLE) END AS gain
    FROM daily_b""")
def fn_improvement(data: Data) -> DataFrame:
    return data.daily_b().select("date", "report_id", C.improvement(
        F.col("unique_viewers").cast("double"), F.col("daily_views").cast("double")).alias("gain"))
