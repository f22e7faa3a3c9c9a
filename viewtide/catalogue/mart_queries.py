"""Aggregations, windows and composites of the three marts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from viewtide.catalogue.base import Data, query
from viewtide.functions import columns as C
from viewtide.operators import adoption, engagement, performance, quality, series
from viewtide.plans import marts
from viewtide.session import staged

ADOPTION = "views_per_user"
ROLLING = "views_per_user views_7d views_28d viewers_7d viewers_28d wow_change_views"
ENGAGEMENT = "repeat_user_rate top_10pct_user_share avg_pages_per_user"
PERFORMANCE = "avg_load_time p90_load_time avg_load_time_7d load_time_wow_change"

# Adoption -------------------------------------------------------------------------------------------


@query("agg_adoption_rows", uses="daily_a", sql="SELECT date, report_id, daily_views, unique_viewers FROM daily_a")
def agg_adoption_rows(data: Data) -> DataFrame:
    return data.daily_a().drop("views_per_user")


@query("agg_adoption_sum", uses="daily_b", sql="SELECT date, report_id, daily_views, unique_viewers FROM daily_b")
def agg_adoption_sum(data: Data) -> DataFrame:
    return data.daily_b().drop("views_per_user")


@query("agg_views_per_user", uses="daily_b", doubles=ADOPTION, sql="SELECT date, report_id, views_per_user FROM daily_b")
def agg_views_per_user(data: Data) -> DataFrame:
    return data.daily_b().select("date", "report_id", "views_per_user")


@query("build_report_daily_adoption", uses="daily_b", doubles=ADOPTION, sql="SELECT * FROM daily_b")
def build_report_daily_adoption(data: Data) -> DataFrame:
    return data.daily_b()


@query("agg_start_date", uses="launches_b", sql="SELECT * FROM launches_b")
def agg_start_date(data: Data) -> DataFrame:
    return data.daily_b().groupBy("report_id").agg(F.min("date").alias("start_date"))


@query("agg_global_max_date", uses="daily_b", sql="SELECT max(date) AS global_max_date FROM daily_b")
def agg_global_max_date(data: Data) -> DataFrame:
    return data.daily_b().agg(F.max("date").alias("global_max_date"))


@query("agg_end_date", uses="mart_b", sql="""
    SELECT report_id, max(date) AS end_date, max(date) = (SELECT max(date) FROM mart_b) AS at_global_max
    FROM mart_b GROUP BY report_id""")
def agg_end_date(data: Data) -> DataFrame:
    last = data.report_views().agg(F.max("date")).scalar()
    return (data.mart_b().groupBy("report_id").agg(F.max("date").alias("end_date"))
            .withColumn("at_global_max", F.col("end_date") == last))


@query("join_spine", uses="mart_b", sql="SELECT date, report_id, daily_views, unique_viewers FROM mart_b")
def join_spine(data: Data) -> DataFrame:
    return adoption.fill_report_days(data.daily_b()).drop("views_per_user")


@query("mart_report_daily_adoption", uses="mart_b", doubles=ADOPTION, sql="SELECT * FROM mart_b")
def mart_report_daily_adoption(data: Data) -> DataFrame:
    return data.mart_b()


@query("join_start_dates", uses="mart_b launches_b", sql="""
    SELECT m.date, m.report_id, start_date, m.date < start_date AS before_launch
    FROM mart_b m JOIN launches_b l ON m.report_id = l.report_id""")
def join_start_dates(data: Data) -> DataFrame:
    start = F.min("date").over(Window.partitionBy("report_id"))
    return (data.mart_b().select("date", "report_id", start.alias("start_date"))
            .withColumn("before_launch", F.col("date") < F.col("start_date")))


def _rolling(name: str):
    @query(name, uses="ts_b", doubles=name.removeprefix("win_"),
           sql=f"SELECT date, report_id, {name.removeprefix('win_')} FROM ts_b")
    def run(data: Data) -> DataFrame:
        return data.ts_b().select("date", "report_id", name.removeprefix("win_"))


for _name in ("win_views_7d", "win_views_28d", "win_viewers_7d", "win_viewers_28d"):
    _rolling(_name)


@query("win_wow_views", uses="ts_b", doubles="wow_change_views", sql="SELECT date, report_id, wow_change_views FROM ts_b")
def win_wow_views(data: Data) -> DataFrame:
    return data.ts_b().select("date", "report_id", "wow_change_views")


@query("add_time_series_usage_features", uses="ts_b", doubles=ROLLING, sql="SELECT * FROM ts_b")
def add_time_series_usage_features(data: Data) -> DataFrame:
    return data.ts_b()


@query("sort_mart", uses="mart_b", doubles=ADOPTION, sql="SELECT * FROM mart_b ORDER BY report_id, date")
def sort_mart(data: Data) -> DataFrame:
    return adoption.present(data.mart_b())


# Engagement -----------------------------------------------------------------------------------------

@query("agg_user_daily_views", uses="user_days_b", sql="SELECT * FROM user_days_b")
def agg_user_daily_views(data: Data) -> DataFrame:
    return data.user_days()


@query("agg_first_view", uses="first_view_b", sql="SELECT * FROM first_view_b")
def agg_first_view(data: Data) -> DataFrame:
    return data.user_days().groupBy("report_id", "user_id").agg(F.min("date").alias("first_view_date"))


@query("join_first_seen", uses="marked_b", sql="""
    SELECT date, report_id, user_id, user_views, first_view_date, is_repeat_user FROM marked_b""")
def join_first_seen(data: Data) -> DataFrame:
    return engagement.with_first_view(data.user_days())


@query("agg_repeat_rate", uses="behaviour_a", doubles="repeat_user_rate", sql="""
    SELECT date, report_id, unique_viewers, repeat_users, total_views, repeat_user_rate FROM behaviour_a""")
def agg_repeat_rate(data: Data) -> DataFrame:
    return engagement.report_day_behaviour(data.user_days(dense=True)).drop("top_10pct_user_share")


@query("agg_daily_usage", uses="behaviour_b", sql="SELECT date, report_id, total_views AS daily_views FROM behaviour_b")
def agg_daily_usage(data: Data) -> DataFrame:
    return data.user_days().groupBy("date", "report_id").agg(F.sum("user_views").alias("daily_views"))


@query("win_top10_share", uses="behaviour_a", doubles="top_10pct_user_share", sql="""
    SELECT date, report_id, top_10pct_user_share FROM behaviour_a""")
def win_top10_share(data: Data) -> DataFrame:
    return engagement.report_day_behaviour(data.user_days(dense=True)).select("date", "report_id", "top_10pct_user_share")


@query("topk_users", uses="marked_b", doubles="top_views", sql="""
    SELECT date, report_id, max(users) AS users,
           CAST(sum(user_views) FILTER (WHERE place <= greatest(1, ceil(users * 0.1::DOUBLE))) AS DOUBLE) AS top_views
    FROM marked_b GROUP BY date, report_id""")
def topk_users(data: Data) -> DataFrame:
    """Views of the top tenth of the users per report-day, fractional measure."""
    days = data.user_days().withColumn("user_views", F.col("user_views").cast("double"))
    cells = days.groupBy("date", "report_id", "user_views").agg(F.count("*").alias("n"))
    return engagement.top_share(cells, ["date", "report_id"], "user_views", "n", C.top_decile_size, False,
                                also=[F.sum("n").alias("users")]).withColumnRenamed("_top", "top_views")


@query("join_prev_active", uses="behaviour_b active_b", sql="""
    SELECT b.date, b.report_id, total_views, previous_active_date
    FROM behaviour_b b LEFT JOIN active_b a ON b.date = a.date AND b.report_id = a.report_id""")
def join_prev_active(data: Data) -> DataFrame:
    """The previous active day, seen by active days only."""
    idle = engagement.with_idle_days(engagement.report_day_behaviour(data.user_days()))
    return idle.select("date", "report_id", "total_views",
                       F.when(F.col("total_views") > 0, F.col("previous_active_date")).alias("previous_active_date"))


@query("win_prev_active", uses="active_b", sql="SELECT * FROM active_b")
def win_prev_active(data: Data) -> DataFrame:
    active = engagement.report_day_behaviour(data.user_days()).where(F.col("total_views") > 0)
    return active.select("date", "report_id",
                         engagement.previous_active_day(F.col("total_views")).alias("previous_active_date"))


@query("win_days_since", uses="engagement_b", sql="SELECT date, report_id, days_since_last_use FROM engagement_b")
def win_days_since(data: Data) -> DataFrame:
    return engagement.with_idle_days(engagement.report_day_behaviour(data.user_days())).select(
        "date", "report_id", "days_since_last_use")


@query("agg_user_daily_pages", uses="user_pages_b", sql="SELECT * FROM user_pages_b")
def agg_user_daily_pages(data: Data) -> DataFrame:
    return data.user_pages()


@query("agg_avg_pages", uses="depth_b", doubles="avg_pages_per_user", sql="SELECT * FROM depth_b")
def agg_avg_pages(data: Data) -> DataFrame:
    return engagement.page_depth(data.user_pages())


@query("join_engagement_assemble", uses="engagement_a", doubles=ENGAGEMENT, sql="SELECT * FROM engagement_a")
def join_engagement_assemble(data: Data) -> DataFrame:
    return data.engagement_a()


@query("build_user_engagement_features", uses="engagement_b", doubles=ENGAGEMENT, sql="SELECT * FROM engagement_b")
def build_user_engagement_features(data: Data) -> DataFrame:
    return data.engagement_b()


@query("win_repeat_change", uses="engagement_b", doubles="repeat_user_rate", sql="""
    SELECT date, report_id, repeat_user_rate FROM (
        SELECT *, repeat_user_rate - lag(repeat_user_rate) OVER (PARTITION BY report_id ORDER BY date) AS step
        FROM engagement_b) WHERE coalesce(step, 0) <> 0""")
def win_repeat_change(data: Data) -> DataFrame:
    return engagement.repeat_rate_changes(data.engagement_b())


@query("limit_examples", uses="engagement_b", doubles="value repeat_user_rate", sql="""
    SELECT * FROM (SELECT 'high_concentration' AS list, date, report_id, top_10pct_user_share AS value, repeat_user_rate
        FROM engagement_b WHERE top_10pct_user_share >= 0.5 ORDER BY report_id, date LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'repeat_change', date, report_id, repeat_user_rate, repeat_user_rate FROM (
        SELECT *, repeat_user_rate - lag(repeat_user_rate) OVER (PARTITION BY report_id ORDER BY date) AS step
        FROM engagement_b) WHERE coalesce(step, 0) <> 0 ORDER BY report_id, date LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'idle_spike', date, report_id, CAST(days_since_last_use AS DOUBLE), repeat_user_rate
        FROM engagement_b WHERE days_since_last_use >= 2 ORDER BY report_id, date LIMIT 10)""")
def limit_examples(data: Data) -> DataFrame:
    """The first ten rows of the three example lists."""
    mart = data.engagement_b()
    lists = {"high_concentration": (engagement.high_concentration(mart), "top_10pct_user_share"),
             "repeat_change": (engagement.repeat_rate_changes(mart), "repeat_user_rate"),
             "idle_spike": (engagement.idle_spikes(mart), "days_since_last_use")}
    parts = [adoption.present(rows).limit(10).select(F.lit(name).alias("list"), "date", "report_id",
                                                     F.col(value).cast("double").alias("value"), "repeat_user_rate")
             for name, (rows, value) in lists.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Performance ----------------------------------------------------------------------------------------

@query("agg_performance", uses="loads_daily_a", doubles="avg_load_time p90_load_time", sql="SELECT * FROM loads_daily_a")
def agg_performance(data: Data) -> DataFrame:
    """The form for report-days of any size."""
    loads = data.loads_a()
    return performance.aggregate_loads(performance.load_rows(loads, "date", "report_id", "load_time"))


@query("win_avg_load_7d", uses="performance_a", doubles="avg_load_time_7d", sql="""
    SELECT date, report_id, avg_load_time_7d FROM performance_a""")
def win_avg_load_7d(data: Data) -> DataFrame:
    return data.performance_a().select("date", "report_id", "avg_load_time_7d")


@query("win_load_wow", uses="performance_a", doubles="load_time_wow_change", sql="""
    SELECT date, report_id, load_time_wow_change FROM performance_a""")
def win_load_wow(data: Data) -> DataFrame:
    return data.performance_a().select("date", "report_id", "load_time_wow_change")


@query("build_report_performance_features", uses="performance_b", doubles=PERFORMANCE, sql="SELECT * FROM performance_b")
def build_report_performance_features(data: Data) -> DataFrame:
    return data.performance_b()


@query("join_load_vs_usage", uses="performance_b mart_b", doubles="avg_load_time p90_load_time", sql="""
    SELECT p.date, p.report_id, avg_load_time, p90_load_time, daily_views
    FROM performance_b p LEFT JOIN mart_b m ON p.date = m.date AND p.report_id = m.report_id""")
def join_load_vs_usage(data: Data) -> DataFrame:
    return marts.load_time_vs_usage(data.performance_b(), data.mart_b())


# Looking at tables ----------------------------------------------------------------------------------

def _describe(table: str, columns: list[str]) -> str:
    return "\nUNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std,
        CAST(min({c}) AS DOUBLE) AS min, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50,
        quantile_cont({c}, 0.75) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM {table}""" for c in columns)


DESCRIBED = ["daily_views", "unique_viewers", "views_per_user", "views_7d", "views_28d", "wow_change_views"]


@query("agg_describe", uses="ts_b", doubles="mean std min p25 p50 p75 max", sql=_describe("ts_b", DESCRIBED))
def agg_describe(data: Data) -> DataFrame:
    """The mart is kept as a reliable checkpoint first: describing reads its input three times."""
    return quality.describe(staged(data.ts_b().select(*DESCRIBED), "described"), DESCRIBED)


@query("agg_null_counts", uses="ts_b", sql="""
    SELECT 'date' AS "column", count(*) FILTER (WHERE date IS NULL) AS null_count FROM ts_b
    UNION ALL SELECT 'views_28d', count(*) FILTER (WHERE views_28d IS NULL) FROM ts_b
    UNION ALL SELECT 'wow_change_views', count(*) FILTER (WHERE wow_change_views IS NULL) FROM ts_b""")
def agg_null_counts(data: Data) -> DataFrame:
    return quality.null_counts(data.ts_b(), ["date", "views_28d", "wow_change_views"])


@query("agg_duplicate_rows", uses="usage_c", sql="""
    SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM usage_c
        GROUP BY "Date", "Report Guid", "Report Name", "User Id", "Occurrences")""")
def agg_duplicate_rows(data: Data) -> DataFrame:
    usage = data.usage_c()
    return quality.duplicate_rows(usage, usage.columns)


SUMMARY = """
    SELECT "Report Name" AS report_name, CAST(sum("Occurrences") AS BIGINT) AS total_views, count(*) AS rows,
           avg("Occurrences") AS avg_occurrence_per_row FROM usage_c GROUP BY "Report Name" """


@query("agg_eda_summary", uses="usage_c", doubles="avg_occurrence_per_row", sql=SUMMARY)
def agg_eda_summary(data: Data) -> DataFrame:
    return series.usage_summary(data.usage_c())


@query("topk_eda", uses="usage_c", doubles="avg_occurrence_per_row",
       sql=SUMMARY + "ORDER BY total_views DESC, report_name LIMIT 10")
def topk_eda(data: Data) -> DataFrame:
    return series.usage_summary(data.usage_c()).limit(10)
