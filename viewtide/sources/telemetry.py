"""The test Parquet seen as report telemetry (see FIXTURES.md section 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from viewtide.sources.calendar import calendar_of


class Telemetry:
    """Lazy telemetry tables over one scale-factor directory."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """Reader of one file; kept, as opening it costs a look at its footer."""
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return self._tables[name]

    # usage_a: dense, many users per report-day ------------------------------------------------
    def views_a(self) -> DataFrame:
        return self.table("events").select(
            F.to_date("ts").alias("date"), F.col("event_type").alias("report_id"), F.col("user_id").alias("user_key"))

    def pages_a(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("bigint")
        return self.table("events").select(
            F.to_date("ts").alias("date"), F.col("event_type").alias("report_id"), F.col("user_id").alias("user_key"),
            F.concat("event_type", F.lit("_P"), (k % 8 + 1).cast("string")).alias("section_id"))

    def loads_a(self) -> DataFrame:
        return self.table("events").select(
            F.to_date("ts").alias("date"), F.col("event_type").alias("report_id"), F.col("value").alias("load_time"))

    # usage_b: sparse, seven years, zero-view days ---------------------------------------------
    def lines_b(self) -> DataFrame:
        part = self.table("part").select("p_partkey", "p_brand", "p_type")
        return self.table("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))

    def report_views(self) -> DataFrame:
        idle = (F.col("l_linestatus") == "O") & (F.col("l_returnflag") != "R")
        return self.lines_b().select(
            F.to_date("l_shipdate").alias("date"), F.col("p_brand").alias("report_id"),
            F.col("l_suppkey").alias("user_key"), F.col("l_suppkey").cast("string").alias("user_id"),
            F.col("l_linestatus").alias("consumption_method"), F.col("l_returnflag").alias("distribution_method"),
            F.lit(None).cast("string").alias("user_agent"),
            F.when(idle, F.lit(0)).otherwise(F.col("l_quantity")).cast("bigint").alias("view_count"))

    def report_page_views(self) -> DataFrame:
        return self.lines_b().select(
            F.col("l_shipdate").alias("timestamp"), F.to_date("l_shipdate").alias("date"),
            F.col("p_brand").alias("report_id"), F.concat_ws("_", "p_brand", "p_type").alias("section_id"),
            F.col("l_suppkey").alias("user_key"), F.col("l_linestatus").alias("client"),
            F.col("l_returnflag").alias("session_source"), F.col("l_linenumber").cast("bigint").alias("page_view_count"))

    def report_load_times(self) -> DataFrame:
        return self.lines_b().select(
            F.col("l_shipdate").alias("timestamp"), F.to_date("l_shipdate").alias("date"),
            F.col("p_brand").alias("report_id"), F.col("l_suppkey").alias("user_key"),
            F.col("l_suppkey").cast("string").alias("user_id"), F.col("l_returnflag").alias("browser"),
            F.col("l_linestatus").alias("client"), F.col("p_type").alias("country"),
            F.col("l_extendedprice").alias("load_time_ms"))

    def reports(self) -> DataFrame:
        """One row per part, so each report comes many times with differing names."""
        return self.table("part").select(
            F.col("p_brand").alias("report_id"), F.concat(F.lit("Report "), "p_name").alias("report_name"),
            F.concat(F.lit("WS_"), F.substring("p_brand", 7, 1)).alias("workspace_id"),
            F.when(F.col("p_brand").endswith("3"), "Paginated").when(F.col("p_brand").endswith("5"), "Dashboard")
            .otherwise("Report").alias("report_type"),
            F.col("p_brand").endswith("7").alias("is_usage_metrics_report"))

    def report_pages(self) -> DataFrame:
        """One row per part, so each page comes many times with differing names."""
        return self.table("part").select(
            F.col("p_brand").alias("report_id"), F.concat_ws("_", "p_brand", "p_type").alias("section_id"),
            F.concat(F.lit("Page "), "p_name").alias("section_name"))

    def users(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_suppkey").alias("user_key"), F.col("s_name").alias("user_id"),
            F.concat(F.lit("User "), "s_name").alias("unique_user"))

    def dates(self) -> DataFrame:
        return calendar_of(self.table("lineitem"), F.to_date("l_shipdate"))

    def raw(self) -> dict[str, DataFrame]:
        return {"reports": self.reports(), "users": self.users(), "report_pages": self.report_pages(),
                "dates": self.dates(), "report_views": self.report_views(),
                "report_page_views": self.report_page_views(), "report_load_times": self.report_load_times()}

    # usage_c: forecasting ---------------------------------------------------------------------
    def usage_c(self) -> DataFrame:
        """User-level rows: 3 busy series (F_), 25 middling ones (Brand#) and one per supplier (S_)."""
        line = self.lines_b()
        guids = F.array(F.concat(F.lit("F_"), "l_returnflag"), F.col("p_brand"),
                        F.concat(F.lit("S_"), F.col("l_suppkey").cast("string")))
        return (line.select(F.to_date("l_shipdate").alias("Date"), F.explode(guids).alias("Report Guid"),
                            F.col("l_suppkey").alias("User Id"), F.col("l_quantity").cast("bigint").alias("Occurrences"))
                .withColumn("Report Name", F.concat(F.lit("Report "), F.col("Report Guid"))))
