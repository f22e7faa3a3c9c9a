"""Forecast histories by run and month of the target day, and the marks that tell which parts have changed.

A backfill needs a part of the history only if the part's files, or the report-days with actual usage in its month, are
not those of the last backfill. A part's mark holds both; the marks of the last backfill are a small table of one row per
part. Late usage of an old day changes the mark of its month, so it is found as well.

The driver sees the names of files, which Spark's listing holds anyway, and one row per part and month; never rows of data.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from viewtide.sources import files, publication

MARKS = T.StructType().add("part", "string").add("mark", "string")


def part() -> Column:
    """Name of a row's part; of partition columns alone, so that Spark leaves out the files of other parts."""
    return F.concat_ws("/", "run_id", F.col(files.MONTH).cast("string"))


def read_parts(spark: SparkSession, path: str, schema: T.StructType, parts: Iterable[str]) -> DataFrame:
    """The rows of some parts of a history."""
    return files.read_months(spark, path, schema).where(part().isin(list(parts))).select(*schema.fieldNames())


def file_marks(spark: SparkSession, path: str, schema: T.StructType) -> dict[str, tuple[int, str]]:
    """Month and a digest of the file names of every part."""
    names = defaultdict(list)
    for name in files.read_months(spark, path, schema).inputFiles():
        found = re.search(rf"/run_id=([^/]+)/{files.MONTH}=(\d+)/([^/]+)$", name)
        if found:  # rows without a target day cannot be realised
            names[unquote(found[1]), int(found[2])].append(found[3])
    return {f"{run}/{month}": (month, hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest())
            for (run, month), found in names.items()}


def usage_marks(actuals: DataFrame) -> dict[int, str]:
    """Number and digest of the report-days with usage, by month. Values are left out: an error is reported once."""
    key = F.xxhash64("report_id", "date").cast("decimal(20,0)")
    rows = actuals.groupBy(files.month_of("date").alias("month")).agg(F.count("*").alias("n"), F.sum(key).alias("keys")).collect()
    return {r["month"]: f"{r['n']}:{r['keys']}" for r in rows}


def current_marks(actuals: DataFrame, path: str, schema: T.StructType) -> dict[str, str]:
    """Mark of every part whose month has usage."""
    usage = usage_marks(actuals)
    found = file_marks(actuals.sparkSession, path, schema)
    return {name: f"{digest}:{usage[month]}" for name, (month, digest) in found.items() if month in usage}


def stored_marks(spark: SparkSession, path: str) -> dict[str, str]:
    publication.recover(spark, path)
    return {r["part"]: r["mark"] for r in files.read_history(spark, path, MARKS).collect()}


def store_marks(spark: SparkSession, marks: dict[str, str], path: str) -> None:
    publication.publish(spark.createDataFrame(sorted(marks.items()), MARKS).coalesce(1), path)
