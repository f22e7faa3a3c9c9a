"""Calendar rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from viewtide.functions import columns as C


def _rows(days: DataFrame) -> DataFrame:
    day = F.col("date")
    return days.select(
        "date", F.date_format(day, "EEEE").alias("day_of_week"), C.week_start(day).alias("week_start_date"),
        F.date_format(day, "yyyy-MM").alias("month"), C.is_weekend(day).alias("is_weekend"))


def calendar(spark: SparkSession, first: str, last: str) -> DataFrame:
    """One row per day from ``first`` to ``last``, both included."""
    span = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return _rows(spark.range(1).select(F.explode(span).alias("date")))


def calendar_of(df: DataFrame, day: Column) -> DataFrame:
    """Calendar from the first to the last day found in ``df``."""
    ends = df.agg(F.min(day).alias("first"), F.max(day).alias("last")).where(F.col("first").isNotNull())
    return _rows(ends.select(F.explode(F.sequence("first", "last")).alias("date")))
