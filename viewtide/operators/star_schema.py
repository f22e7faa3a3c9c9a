"""Star schema: raw telemetry to four dimensions and three facts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from viewtide.functions import columns as C
from viewtide.session import staged

DIM_DATE = ["date_key", "date", "day_of_week", "week_start_date", "month", "is_weekend"]
DIM_PAGE = ["page_key", "report_id", "section_id", "section_name"]
FACT_VIEWS = ["date_key", "report_id", "user_key", "consumption_method", "distribution_method", "view_count"]
FACT_PAGES = ["date_key", "report_id", "page_key", "user_key", "client", "session_source", "page_view_count"]
FACT_LOADS = ["date_key", "report_id", "user_key", "browser", "client", "country", "load_time_ms"]


def build_dim_date(dates: DataFrame) -> DataFrame:
    day = C.to_day(dates, "date")
    return dates.withColumn("date", day).withColumn("date_key", C.date_key(F.col("date"))).select(*DIM_DATE).distinct()


def first_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key. A DataFrame has no first row, so the smallest by the other columns is taken.

    ``min`` of a struct is combined before the shuffle; a key with very many copies costs one row per
    task there, where a row_number window would sort all its copies in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    return (df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row"))
            .select(*keys, "_row.*").select(*df.columns))


def build_dim_user(users: DataFrame) -> DataFrame:
    return first_per_key(users, ["user_key"])


def build_dim_report(reports: DataFrame) -> DataFrame:
    return first_per_key(reports, ["report_id"])


def number_rows(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Dense 1..n in the given (unique) order, without sorting all rows in one task.

    Rows are range-partitioned and numbered inside their partition; the partitions' offsets are a
    running sum over one row per partition. The ranges come from a sample, so the rows are staged
    before two branches read them.
    """
    inside = 33  # monotonically_increasing_id keeps the partition above 33 bits of row number
    placed = (staged(df.repartitionByRange(*order).sortWithinPartitions(*order)
                     .withColumn("_id", F.monotonically_increasing_id()), "numbered")
              .withColumn("_part", F.shiftright("_id", inside))
              .withColumn("_row", F.col("_id").bitwiseAND(F.lit((1 << inside) - 1))))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("_part").agg(F.count("*").alias("_n"))
               .select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")))
    # one row per partition: as many as the session's shuffle partitions, so safe to broadcast
    return (placed.join(F.broadcast(offsets), "_part")
            .withColumn(name, (F.col("_offset") + F.col("_row") + 1).cast("bigint"))
            .drop("_part", "_row", "_offset", "_id"))


def build_dim_page(report_pages: DataFrame) -> DataFrame:
    """Pages with a dense surrogate key in (report_id, section_id) order."""
    pages = first_per_key(report_pages.select("report_id", "section_id", "section_name"), ["report_id", "section_id"])
    return number_rows(pages, ["report_id", "section_id"], "page_key").select(*DIM_PAGE)


def _keyed_by_day(events: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Left lookup of date_key. No hint: Spark broadcasts the calendar while it is below the session's
    size threshold and otherwise joins by shuffle with adaptive skew handling."""
    day = C.to_day(events, "date")
    return events.withColumn("date", day).join(dim_date.select("date", "date_key"), "date", "left")


def build_fact_report_views(report_views: DataFrame, dim_date: DataFrame) -> DataFrame:
    return _keyed_by_day(report_views, dim_date).select(*FACT_VIEWS)


def build_fact_page_views(report_page_views: DataFrame, dim_date: DataFrame, dim_page: DataFrame,
                          page_on: Sequence[str] = ("section_id",)) -> DataFrame:
    """Page views with date and page keys. Section ids embed the report, so they alone identify the
    page; pass ``page_on=("report_id", "section_id")`` where they do not."""
    keyed = _keyed_by_day(report_page_views, dim_date)
    return keyed.join(dim_page.select("page_key", *page_on), list(page_on), "left").select(*FACT_PAGES)


def build_fact_report_loads(report_load_times: DataFrame, dim_date: DataFrame) -> DataFrame:
    return _keyed_by_day(report_load_times, dim_date).select(*FACT_LOADS)


def build_semantic_model(raw: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Seven raw tables to four dimensions and three facts."""
    dim_date, dim_page = build_dim_date(raw["dates"]), build_dim_page(raw["report_pages"])
    return {
        "dim_date": dim_date,
        "dim_user": build_dim_user(raw["users"]),
        "dim_report": build_dim_report(raw["reports"]),
        "dim_page": dim_page,
        "fact_report_views": build_fact_report_views(raw["report_views"], dim_date),
        "fact_page_views": build_fact_page_views(raw["report_page_views"], dim_date, dim_page),
        "fact_report_loads": build_fact_report_loads(raw["report_load_times"], dim_date),
    }


def page_report_types(pages: DataFrame, reports: DataFrame) -> DataFrame:
    """Pages with the type of their report."""
    return pages.join(reports.select("report_id", "report_type"), "report_id", "left")


def count_page_types(pages: DataFrame, reports: DataFrame) -> DataFrame:
    return page_report_types(pages, reports).where(F.col("report_type").isNotNull()).groupBy("report_type").count()


def page_capable(reports: DataFrame) -> DataFrame:
    """Only these kinds of report have pages."""
    return reports.where(F.col("report_type").isin("Report", "Dashboard"))
