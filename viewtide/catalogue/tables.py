"""Sources, sinks, projections, filters, joins and the star schema."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from viewtide import schemas
from viewtide.catalogue.base import Data, query
from viewtide.functions import columns as C, guards
from viewtide.operators import adoption, engagement, performance, quality, series, star_schema
from viewtide.plans import forecasting, marts
from viewtide.session import scratch_path
from viewtide.sources import files, periods
from viewtide.sources.calendar import calendar_of

# Sources and sinks ----------------------------------------------------------------------------------


@query("src_raw_tables", uses="reports users report_pages dates report_views report_page_views report_load_times", sql="""
    SELECT 'reports' AS table_name, count(*) AS row_count, count(DISTINCT report_id) AS keys, CAST(NULL AS DATE) AS first_date
    FROM reports
    UNION ALL SELECT 'users', count(*), count(DISTINCT user_key), NULL FROM users
    UNION ALL SELECT 'report_pages', count(*), count(DISTINCT section_id), NULL FROM report_pages
    UNION ALL SELECT 'dates', count(*), count(DISTINCT month), min(date) FROM dates
    UNION ALL SELECT 'report_views', count(*), count(DISTINCT user_key), min(date) FROM report_views
    UNION ALL SELECT 'report_page_views', count(*), count(DISTINCT section_id), min(date) FROM report_page_views
    UNION ALL SELECT 'report_load_times', count(*), count(DISTINCT load_time_ms), min(date) FROM report_load_times""")
def src_raw_tables(data: Data) -> DataFrame:
    """Raw tables through CSV files and back, with typed columns."""
    root = scratch_path(data.spark, "raw")
    files.save_tables(data.raw(), root, "csv")
    tables = files.load_raw_tables(data.spark, root, "csv")
    keys = {"reports": "report_id", "users": "user_key", "report_pages": "section_id", "dates": "month",
            "report_views": "user_key", "report_page_views": "section_id", "report_load_times": "load_time_ms"}
    return quality.union(tables[t].agg(
        F.lit(t).alias("table_name"), F.count("*").alias("row_count"), F.count_distinct(k).alias("keys"),
        (F.min("date") if "date" in tables[t].columns else F.lit(None).cast("date")).alias("first_date"))
        for t, k in keys.items())


@query("src_processed_tables", uses="dim_date dim_page fact_report_views fact_page_views", sql="""
    SELECT f.report_id, month, count(*) AS views, CAST(sum(page_view_count) AS BIGINT) AS pages,
           count(DISTINCT section_name) AS sections
    FROM fact_page_views f JOIN dim_date d ON f.date_key = d.date_key JOIN dim_page p ON f.page_key = p.page_key
    GROUP BY f.report_id, month""")
def src_processed_tables(data: Data) -> DataFrame:
    """Star schema stored as Parquet, loaded and read across fact and dimensions."""
    root = scratch_path(data.spark, "processed")
    files.save_tables(data.model(), root)
    t = files.load_processed_tables(data.spark, root)
    return (t["fact_page_views"].join(t["dim_date"].select("date_key", "month"), "date_key")
            .join(t["dim_page"].select("page_key", "section_name"), "page_key").groupBy("report_id", "month")
            .agg(F.count("*").alias("views"), F.sum("page_view_count").alias("pages"),
                 F.count_distinct("section_name").alias("sections")))


@query("gen_calendar", uses="dates", sql="SELECT * FROM dates")
def gen_calendar(data: Data) -> DataFrame:
    return calendar_of(data.table("lineitem"), F.to_date("l_shipdate"))


@query("layers_bronze_silver_gold", uses="usage_c", sql="""
    SELECT "Report Guid" AS report_id, "Report Name" AS report_name, "Date" AS date,
           CAST(sum("Occurrences") AS BIGINT) AS actual_views FROM usage_c GROUP BY ALL""")
def layers_bronze_silver_gold(data: Data) -> DataFrame:
    """Bronze events to the stored silver table (the gold step is query fc_run)."""
    bronze = data.usage_c().select(F.col("Report Guid").alias("report_id"), F.col("Report Name").alias("report_name"),
                                   F.col("Date").alias("date"), F.col("Occurrences").alias("occurrences"))
    path = scratch_path(data.spark, "silver")
    forecasting.silver_daily_views(bronze).write.mode("overwrite").parquet(path)
    return data.spark.read.parquet(path)


@query("layers_incremental", uses="usage_c", sql="""
    SELECT "Report Guid" AS report_id, "Report Name" AS report_name, "Date" AS date, sum("Occurrences")::DOUBLE AS actual_views,
           date_trunc('quarter', "Date")::DATE AS period, date_trunc('quarter', "Date") >= DATE '1998-01-01' OR date_trunc('quarter', "Date") = DATE '1995-04-01' AS made_anew
    FROM usage_c GROUP BY ALL""")
def layers_incremental(data: Data) -> DataFrame:
    """Silver by quarter in two refreshes: the second one gets the days since 1998 and the late ones of a day of 1995, and
    makes these quarters anew and no other."""
    events = data.usage_c().select(F.col("Report Guid").alias("report_id"), F.col("Report Name").alias("report_name"),
                                   F.col("Date").alias("date"), F.col("Occurrences").alias("occurrences"))
    later = (F.col("date") >= F.lit(date(1998, 1, 1))) | (F.col("date") == F.lit(date(1995, 5, 17)))
    root, made = scratch_path(data.spark, "layers"), []
    for some in (~later, later):
        forecasting.add_bronze(events.where(some), root, "quarter")
        made = forecasting.refresh_silver(data.spark, root)
    silver = periods.read(data.spark, forecasting.ForecastPaths(root).silver_report_daily_views, schemas.SILVER)
    return silver.withColumn("made_anew", periods.part().isin(made))


@query("snk_tables", uses="mart_b", doubles="views_per_user", sql="SELECT * FROM mart_b")
def snk_tables(data: Data) -> DataFrame:
    """A mart stored twice (the second time over the first) and read back."""
    root = scratch_path(data.spark, "marts")
    for _ in range(2):
        files.save_tables({"mart_report_daily_adoption": data.mart_b()}, root)
    return data.spark.read.parquet(root + "/mart_report_daily_adoption.parquet")


@query("src_history", uses="history_c", doubles="forecast_views lower_ci upper_ci", sql="SELECT * FROM history_c")
def src_history(data: Data) -> DataFrame:
    """A stored history, and one that was never written and reads as empty."""
    path = scratch_path(data.spark, "history")
    files.append_rows(data.history_c(), path)
    never = files.read_history(data.spark, scratch_path(data.spark, "never"), schemas.FORECAST_HISTORY)
    return files.read_history(data.spark, path, schemas.FORECAST_HISTORY).unionByName(never)


# Projections and filters ----------------------------------------------------------------------------

@query("guard_dates_parse", uses="report_views", sql="SELECT date, count(*) AS rows FROM report_views GROUP BY date")
def guard_dates_parse(data: Data) -> DataFrame:
    """Days kept as text, each checked while it is read."""
    text = data.report_views().withColumn("date", F.col("date").cast("string"))
    rows = engagement.canonical_rows(text, "date", "report_id", "user_key", None, "report_views", "inline")
    return rows.groupBy("date").agg(F.count("*").alias("rows"))


def _checked_loads(data: Data) -> DataFrame:
    """Load times kept as text, each checked while it is read."""
    text = data.report_load_times().withColumn("load_time_ms", F.col("load_time_ms").cast("string"))
    rows = performance.load_rows(text, "date", "report_id", "load_time_ms")
    return guards.enforce(rows, performance.load_rules("date", "load_time_ms"), "inline")


@query("num_strict", uses="report_load_times", doubles="total", sql="""
    SELECT report_id, sum(load_time_ms) AS total FROM report_load_times GROUP BY report_id""")
def num_strict(data: Data) -> DataFrame:
    return _checked_loads(data).groupBy("report_id").agg(F.sum("load_time").alias("total"))


@query("guard_non_negative", uses="report_load_times", doubles="least", sql="""
    SELECT date, min(load_time_ms) AS least FROM report_load_times GROUP BY date""")
def guard_non_negative(data: Data) -> DataFrame:
    return _checked_loads(data).groupBy("date").agg(F.min("load_time").alias("least"))


@query("to_day", uses="dates", sql="""
    SELECT date, date AS from_number, date AS from_text, date AS from_compact, date AS from_moment,
           CAST(NULL AS DATE) AS from_junk, CAST(NULL AS DATE) AS from_no_date FROM dates""")
def to_day(data: Data) -> DataFrame:
    """Every accepted spelling of a day, and two that are none."""
    day = F.col("date")
    spelled = data.dates().select(
        "date", C.date_key(day).alias("from_number"), day.cast("string").alias("from_text"),
        F.date_format(day, "yyyyMMdd").alias("from_compact"),
        F.concat(day.cast("string"), F.lit(" 23:59:00")).alias("from_moment"),
        F.concat(F.lit("day "), day.cast("string")).alias("from_junk"),
        (C.date_key(day) + (13 - F.month(day)) * 100).alias("from_no_date"))
    return spelled.select(*[C.to_day(spelled, c).alias(c) for c in spelled.columns])


@query("num_lenient", sql="""
    SELECT event_type AS report_id, sum(CASE WHEN event_type = 'error' THEN 0.0 ELSE value END) AS total
    FROM events GROUP BY event_type""", doubles="total")
def num_lenient(data: Data) -> DataFrame:
    """Numbers kept as text; what is no number counts as 0."""
    text = data.table("events").select(
        F.col("event_type").alias("report_id"),
        F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.col("value").cast("string")).alias("v"))
    return text.groupBy("report_id").agg(F.sum(C.to_number_or_zero(text, "v")).alias("total"))


@query("empty_input", uses="daily_a", sql="SELECT * FROM daily_a WHERE date < DATE '1900-01-01'", doubles="views_per_user")
def empty_input(data: Data) -> DataFrame:
    nothing = data.views_a().where(F.col("date") < F.lit(date(1900, 1, 1)))
    return adoption.build_report_daily_adoption(nothing, user_col="user_key")


@query("alias_canonical", sql="""
    SELECT CAST(ts AS DATE) AS date, event_type AS report_id, user_id, count(*) AS rows FROM events GROUP BY ALL""")
def alias_canonical(data: Data) -> DataFrame:
    """The caller's own column names mapped on the canonical ones."""
    rows = engagement.canonical_rows(data.table("events"), "ts", "event_type", "user_id", None, "events", "off")
    return rows.groupBy("date", "report_id", "user_id").agg(F.count("*").alias("rows"))


@query("pick_measure", uses="report_views", sql="""
    SELECT report_id, CAST(sum(view_count) AS BIGINT) AS by_view_count, CAST(sum(view_count) AS BIGINT) AS by_views,
           count(*) AS by_rows FROM report_views GROUP BY report_id""")
def pick_measure(data: Data) -> DataFrame:
    """view_count, else views, else the number of rows."""
    def total(views: DataFrame, name: str) -> DataFrame:
        measure = engagement.pick_measure(views, ("view_count", "views"))
        rows = engagement.canonical_rows(views, "date", "report_id", "user_key", measure, "views", "off")
        return engagement.per_user_day(rows, "n").groupBy("report_id").agg(F.sum("n").alias(name))

    views = data.report_views()
    return (total(views, "by_view_count")
            .join(total(views.withColumnRenamed("view_count", "views"), "by_views"), "report_id")
            .join(total(views.drop("view_count"), "by_rows"), "report_id"))


@query("date_key", uses="dim_date", sql="SELECT date, date_key FROM dim_date")
def date_key(data: Data) -> DataFrame:
    return data.dates().select("date", C.date_key(F.col("date")).alias("date_key"))


@query("project_fact", uses="fact_report_loads", sql="SELECT * FROM fact_report_loads", doubles="load_time_ms")
def project_fact(data: Data) -> DataFrame:
    return star_schema.build_fact_report_loads(data.report_load_times(), data.dim_date()).select(*star_schema.FACT_LOADS)


@query("filter_allowed_names", uses="totals_c", sql="""
    SELECT * FROM totals_c WHERE report_name IN ('Report F_A', 'Report Brand#7')""", doubles="views")
def filter_allowed_names(data: Data) -> DataFrame:
    return series.allowed_names(data.totals_c(), {"Report F_A", "Report Brand#7"})


@query("filter_first_n_reports", uses="mart_b", sql="""
    SELECT * FROM mart_b WHERE report_id IN (SELECT DISTINCT report_id FROM mart_b ORDER BY report_id LIMIT 3)""",
       doubles="views_per_user")
def filter_first_n_reports(data: Data) -> DataFrame:
    return marts.first_reports(data.mart_b(), 3)


@query("filter_active_days", uses="daily_b", sql="SELECT date, report_id, daily_views FROM daily_b WHERE daily_views > 0")
def filter_active_days(data: Data) -> DataFrame:
    return data.daily_b().where(F.col("daily_views") > 0).select("date", "report_id", "daily_views")


@query("filter_high_concentration", uses="engagement_b", doubles="top_10pct_user_share repeat_user_rate", sql="""
    SELECT date, report_id, top_10pct_user_share, repeat_user_rate FROM engagement_b WHERE top_10pct_user_share >= 0.5""")
def filter_high_concentration(data: Data) -> DataFrame:
    return engagement.high_concentration(data.engagement_b())


@query("filter_idle_spike", uses="engagement_b", doubles="repeat_user_rate", sql="""
    SELECT date, report_id, days_since_last_use, repeat_user_rate FROM engagement_b WHERE days_since_last_use >= 2""")
def filter_idle_spike(data: Data) -> DataFrame:
    return engagement.idle_spikes(data.engagement_b())


@query("filter_wow_missing", uses="ts_b", doubles="views_7d views_28d wow_change_views", sql="""
    SELECT date, report_id, daily_views, views_7d, views_28d, wow_change_views FROM ts_b WHERE wow_change_views IS NULL""")
def filter_wow_missing(data: Data) -> DataFrame:
    return marts.wow_missing(data.ts_b())


@query("filter_page_capable", uses="reports", sql="SELECT * FROM reports WHERE report_type IN ('Report', 'Dashboard')")
def filter_page_capable(data: Data) -> DataFrame:
    return star_schema.page_capable(data.reports())


# Joins and star schema ------------------------------------------------------------------------------

@query("join_fact_report_views", uses="fact_report_views", sql="SELECT * FROM fact_report_views")
def join_fact_report_views(data: Data) -> DataFrame:
    return star_schema.build_fact_report_views(data.report_views(), data.dim_date())


@query("join_fact_page_views", uses="fact_page_views", sql="SELECT * FROM fact_page_views")
def join_fact_page_views(data: Data) -> DataFrame:
    return star_schema.build_fact_page_views(data.report_page_views(), data.dim_date(), data.dim_page())


@query("join_fact_report_loads", uses="report_load_times dim_date", doubles="load_time_ms", sql="""
    SELECT d.date_key, report_id, user_key, browser, client, country, load_time_ms
    FROM report_load_times v LEFT JOIN (SELECT * FROM dim_date WHERE NOT is_weekend) d ON v.date = d.date""")
def join_fact_report_loads(data: Data) -> DataFrame:
    """Against a calendar without weekends: loads on other days keep a NULL key."""
    return star_schema.build_fact_report_loads(data.report_load_times(), data.dim_date().where(~F.col("is_weekend")))


@query("join_pages_reports", uses="report_pages dim_report", sql="""
    SELECT p.report_id, section_id, section_name, report_type FROM report_pages p
    LEFT JOIN dim_report r ON p.report_id = r.report_id""")
def join_pages_reports(data: Data) -> DataFrame:
    return star_schema.page_report_types(data.report_pages(), star_schema.build_dim_report(data.reports()))


@query("join_ri_membership", uses="report_page_views dim_report", sql="""
    SELECT count(*) AS total_rows, count(*) FILTER (WHERE report_id NOT IN (
        SELECT report_id FROM dim_report WHERE report_type IN ('Report', 'Dashboard'))) AS invalid_count
    FROM report_page_views""")
def join_ri_membership(data: Data) -> DataFrame:
    """Page views of reports that cannot have pages are orphans."""
    return quality.membership(data.report_page_views(), "report_id",
                              star_schema.page_capable(data.reports()), "report_id")


@query("distinct_dim_date", uses="dim_date", sql="SELECT * FROM dim_date")
def distinct_dim_date(data: Data) -> DataFrame:
    calendar = data.dates()
    return star_schema.build_dim_date(calendar.unionByName(calendar))


@query("distinct_dim_user", uses="users dim_user", sql="SELECT * FROM dim_user")
def distinct_dim_user(data: Data) -> DataFrame:
    """Every user comes twice, the second time under a later name."""
    users = data.users()
    return star_schema.build_dim_user(users.unionByName(users.withColumn("unique_user", F.concat("unique_user", F.lit(" 2")))))


@query("distinct_dim_report", uses="dim_report", sql="SELECT * FROM dim_report")
def distinct_dim_report(data: Data) -> DataFrame:
    return star_schema.build_dim_report(data.reports())


@query("distinct_dim_page", uses="dim_page", sql="SELECT report_id, section_id, section_name FROM dim_page")
def distinct_dim_page(data: Data) -> DataFrame:
    return star_schema.first_per_key(data.report_pages(), ["report_id", "section_id"])


@query("win_page_key", uses="dim_page", sql="SELECT * FROM dim_page")
def win_page_key(data: Data) -> DataFrame:
    return data.dim_page()


@query("distinct_reports", uses="report_views", sql="SELECT DISTINCT report_id FROM report_views")
def distinct_reports(data: Data) -> DataFrame:
    return data.report_views().select("report_id").distinct()


@query("sort_calendar", uses="dim_date", sql="SELECT * FROM dim_date ORDER BY date")
def sort_calendar(data: Data) -> DataFrame:
    return data.dim_date().orderBy("date")


@query("agg_page_types", uses="report_pages dim_report", sql="""
    SELECT report_type, count(*) AS count FROM report_pages p JOIN dim_report r ON p.report_id = r.report_id
    GROUP BY report_type""")
def agg_page_types(data: Data) -> DataFrame:
    return star_schema.count_page_types(data.report_pages(), star_schema.build_dim_report(data.reports()))


@query("build_semantic_model", uses="dim_date dim_user dim_report dim_page fact_report_views fact_page_views fact_report_loads",
       doubles="load_time", sql="""
    SELECT d.month, r.report_name, u.unique_user, count(*) AS views, CAST(sum(f.view_count) AS BIGINT) AS view_count,
           CAST(sum(g.pages) AS BIGINT) AS pages, sum(l.load_time) AS load_time
    FROM (SELECT date_key, report_id, user_key, CAST(sum(view_count) AS BIGINT) AS view_count
          FROM fact_report_views GROUP BY ALL) f
    JOIN (SELECT date_key, v.report_id, user_key, sum(page_view_count) AS pages
          FROM fact_page_views v JOIN dim_page p ON v.page_key = p.page_key GROUP BY ALL) g
      ON f.date_key = g.date_key AND f.report_id = g.report_id AND f.user_key = g.user_key
    JOIN (SELECT date_key, report_id, user_key, sum(load_time_ms) AS load_time FROM fact_report_loads GROUP BY ALL) l
      ON f.date_key = l.date_key AND f.report_id = l.report_id AND f.user_key = l.user_key
    JOIN dim_date d ON f.date_key = d.date_key JOIN dim_user u ON f.user_key = u.user_key
    JOIN dim_report r ON f.report_id = r.report_id GROUP BY ALL""")
def build_semantic_model(data: Data) -> DataFrame:
    """All seven tables, read together: facts rolled up to user-days before they meet."""
    t = data.model()
    day = ["date_key", "report_id", "user_key"]
    views = t["fact_report_views"].groupBy(*day).agg(F.sum("view_count").alias("view_count"))
    pages = (t["fact_page_views"].join(t["dim_page"].select("page_key"), "page_key")
             .groupBy(*day).agg(F.sum("page_view_count").alias("pages")))
    loads = t["fact_report_loads"].groupBy(*day).agg(F.sum("load_time_ms").alias("load_time"))
    return (views.join(pages, day).join(loads, day).join(t["dim_date"], "date_key").join(t["dim_user"], "user_key")
            .join(t["dim_report"], "report_id").groupBy("month", "report_name", "unique_user")
            .agg(F.count("*").alias("views"), F.sum("view_count").alias("view_count"), F.sum("pages").alias("pages"),
                 F.sum("load_time").alias("load_time")))
