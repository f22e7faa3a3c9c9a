"""Registry of runnable queries, each with the SQL that gives the same rows where SQL can.

``data`` wraps the test tables; the derived tables below are plans, built anew for each query.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, functions as F, types as T

from viewtide import schemas
from viewtide.catalogue import reference_sql
from viewtide.operators import adoption, engagement, performance, publish, series, star_schema
from viewtide.session import scratch_path
from viewtide.sources import files
from viewtide.sources.telemetry import Telemetry

DIGITS = 6
RUN = publish.Run("run_001", datetime(2001, 10, 1, 6, 30))
REALIZED_AT = datetime(2002, 1, 1)


class Data(Telemetry):
    """Telemetry plus the tables derived from it."""

    def daily_a(self) -> DataFrame:
        return adoption.build_report_daily_adoption(self.views_a(), user_col="user_key", validate="inline")

    def daily_b(self) -> DataFrame:
        return adoption.build_report_daily_adoption(self.report_views(), user_col="user_key", views_col="view_count",
                                                    validate="inline")

    def mart_b(self) -> DataFrame:
        return adoption.adoption_mart(self.report_views(), date_col="date")

    def ts_b(self) -> DataFrame:
        return adoption.add_time_series_usage_features(self.mart_b(), validate="off")

    def engagement_a(self) -> DataFrame:
        return engagement.build_user_engagement_features(self.views_a(), self.pages_a(), user_col="user_key",
                                                         validate="inline")

    def engagement_b(self) -> DataFrame:
        return engagement.build_user_engagement_features(self.report_views(), self.report_page_views(),
                                                         user_col="user_key", validate="inline")

    def user_days(self, dense: bool = False) -> DataFrame:
        views = self.views_a() if dense else self.report_views()
        rows = engagement.canonical_rows(views, "date", "report_id", "user_key",
                                         engagement.pick_measure(views, ("view_count", "views")), "views", "inline")
        return engagement.known_users(engagement.per_user_day(rows, "user_views"))

    def user_pages(self) -> DataFrame:
        pages = self.report_page_views()
        rows = engagement.canonical_rows(pages, "date", "report_id", "user_key", "page_view_count", "pages", "inline")
        return engagement.known_users(engagement.per_user_day(rows, "page_views"))

    def performance_a(self) -> DataFrame:
        return performance.build_report_performance_features(self.loads_a())

    def performance_b(self) -> DataFrame:
        return performance.build_report_performance_features(self.report_load_times(), load_time_col="load_time_ms")

    def dim_date(self) -> DataFrame:
        return star_schema.build_dim_date(self.dates())

    def dim_page(self) -> DataFrame:
        return star_schema.build_dim_page(self.report_pages())

    def model(self) -> dict[str, DataFrame]:
        return star_schema.build_semantic_model(self.raw())

    def stored_model(self) -> dict[str, DataFrame]:
        """The star schema written out and read back: for queries that check every table many times."""
        root = scratch_path(self.spark, "model")
        files.save_tables(self.model(), root)
        return files.load_processed_tables(self.spark, root)

    def totals_c(self) -> DataFrame:
        return series.daily_totals(self.usage_c())

    def split_c(self) -> DataFrame:
        return series.numbered_series(self.totals_c())

    def tested_c(self) -> DataFrame:
        return series.with_baselines(self.split_c().where(F.col("error").isNull()))

    def history_c(self) -> DataFrame:
        """Seasonal-naive forecasts of each series' test part, as if made by a run long ago."""
        day = F.lit(RUN.run_timestamp.date().isoformat()).cast("date")
        return self.tested_c().where(F.col("date") > day).select(
            F.lit(RUN.run_id).alias("run_id"), RUN.timestamp.alias("run_timestamp"), "report_id", "report_name",
            F.col("date").alias("target_date"), F.datediff("date", day).alias("horizon_days"),
            F.col("seasonal_naive").alias("forecast_views"), F.lit(0.0).alias("lower_ci"),
            (F.col("seasonal_naive") * 2).alias("upper_ci"), F.lit("seasonal naive").alias("model_name"))

    def realized_c(self) -> DataFrame:
        """Errors realised before: those of the first ten days after the run."""
        return publish.realized_errors(self.history_c().where(F.col("horizon_days") <= 10),
                                       series.daily_actuals(self.usage_c()), self.no_errors(), REALIZED_AT)

    def no_errors(self) -> DataFrame:
        return self.spark.createDataFrame([], schemas.REALIZED_ERRORS)


@dataclass(frozen=True)
class Query:
    run: Callable[[Data], DataFrame]
    sql: str | None
    doubles: tuple[str, ...]


REGISTRY: dict[str, Query] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits: sums depend on the order of their terms in the last ones."""
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), DIGITS).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
        for f in df.schema.fields])


def query(name: str, sql: str | None = None, uses: str = "", doubles: str = ""):
    """Register a query. ``uses`` names the shared SQL tables, ``doubles`` the columns to round."""
    def register(run: Callable[[Data], DataFrame]):
        columns = tuple(doubles.split())
        text = None
        if sql is not None:
            body = sql.strip()
            if columns:
                keep = ", ".join(f'round("{c}", {DIGITS}) AS "{c}"' for c in columns)
                body = f"SELECT * REPLACE ({keep}) FROM ({body}) AS result"
            text = reference_sql.with_tables(uses.split(), body)
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(run, text, columns)
        return run
    return register


def spark_queries() -> dict[str, Callable]:
    def bind(q: Query) -> Callable:
        return lambda spark, sf_dir: rounded(q.run(Data(spark, sf_dir)))
    return {name: bind(q) for name, q in REGISTRY.items()}


def sql_queries() -> dict[str, str]:
    return {name: q.sql for name, q in REGISTRY.items() if q.sql is not None}
