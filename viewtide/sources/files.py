"""Reading and writing named tables: Parquet by default, CSV with a header for interchange."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from viewtide import schemas
from viewtide.sources import publication

TABLE_ORDER = {
    "dim_date": ["date"],
    "mart_report_daily_adoption": ["report_id", "date"],
    "mart_report_daily_adoption_ts_features": ["report_id", "date"],
    "mart_user_engagement": ["report_id", "date"],
    "mart_report_performance": ["report_id", "date"],
}

#: Partition column of histories: the month of the target day.
MONTH = "target_month"


def read_table(spark: SparkSession, path: str, schema: T.StructType | None, fmt: str = "parquet") -> DataFrame:
    """Read one table. A missing path raises Spark's own PATH_NOT_FOUND."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def load_tables(spark: SparkSession, root: str, catalog: Mapping[str, T.StructType],
                fmt: str = "parquet") -> dict[str, DataFrame]:
    """Every table of the catalog. CSV is read by the catalog's types, Parquet by its own (keys may be
    numbers there)."""
    suffix = ".csv" if fmt == "csv" else ".parquet"
    return {name: read_table(spark, f"{root.rstrip('/')}/{name}{suffix}", schema if fmt == "csv" else None, fmt)
            for name, schema in catalog.items()}


def load_raw_tables(spark: SparkSession, root: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """The seven raw telemetry tables."""
    return load_tables(spark, root, schemas.RAW, fmt)


def load_processed_tables(spark: SparkSession, root: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """Four dimensions and three facts."""
    return load_tables(spark, root, schemas.PROCESSED, fmt)


def read_history(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """History table, or an empty one of the same type if nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def month_of(day: str) -> Column:
    """Year and month of a day as a number: 202601."""
    return F.year(day) * 100 + F.month(day)


def read_months(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """History partitioned by run and month of the target day, with the month as a last column."""
    return read_history(spark, path, T.StructType([*schema.fields, T.StructField(MONTH, T.IntegerType())]))


def clustered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Range-partition and sort inside partitions: files sorted overall without one task seeing all."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def save_tables(tables: Mapping[str, DataFrame], root: str, fmt: str = "parquet") -> None:
    """Overwrite each named table; marts and the calendar are laid out in their presentation order."""
    for name, df in tables.items():
        if name in TABLE_ORDER:
            df = clustered(df, TABLE_ORDER[name])
        writer = df.write.mode("overwrite").format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.save(f"{root.rstrip('/')}/{name}" + (".csv" if fmt == "csv" else ".parquet"))


def replace_run(df: DataFrame, path: str, run_id: str) -> None:
    """Append the rows of one run to a history table partitioned by run, and by month of the target day if it has one.

    A repeated run replaces its own partition and no other, also if it has no rows this time.
    """
    if not re.fullmatch(r"[\w.-]+", run_id):
        raise ValueError(f"run id {run_id!r} may hold letters, digits, '_', '.' and '-' only")
    rows, by = df.drop("run_id"), []
    if "target_date" in rows.columns:
        rows, by = rows.withColumn(MONTH, month_of("target_date")), [MONTH]
    publication.publish(rows, f"{path.rstrip('/')}/run_id={run_id}", by)


def append_rows(df: DataFrame, path: str) -> None:
    """Append rows with a target day to a history partitioned by run and month: few files a part, and a large part in several."""
    by_part = df.withColumn(MONTH, month_of("target_date")).repartitionByRange("run_id", MONTH, "report_id")
    by_part.write.mode("append").partitionBy("run_id", MONTH).parquet(path)
