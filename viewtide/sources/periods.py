"""Tables stored in parts by day or month, of which only those are made anew whose source has changed.

A part's mark is a digest of the names of its source files; Spark never writes two files of one name, so files that were added, removed or
replaced all change it. The marks of the last refresh are a small table of one row per part, stored after the parts. A
refresh that dies is repeated by the next one: parts are functions of their source alone, so nothing is counted twice.

The driver sees the names of files, which Spark's listing holds anyway, and never rows of data.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from viewtide.sources import files, histories, publication

PERIOD = "period"

#: Name of parts that are aside, whole tables that are aside have others.
PARTS = ".parts-"
UNITS = ("day", "week", "month", "quarter", "year")

#: Fixed value: the folder Spark gives to rows without a period.
NO_PERIOD = "__HIVE_DEFAULT_PARTITION__"


def period_of(day: str, unit: str = "day") -> Column:
    """First day of a day's period."""
    if unit not in UNITS:
        raise ValueError(f"unit {unit!r} is none of {', '.join(UNITS)}")
    return F.date_trunc(unit, F.col(day)).cast("date")


def part() -> Column:
    """Name of a row's part; of the partition column alone, so that Spark leaves out the files of other parts."""
    return F.coalesce(F.col(PERIOD).cast("string"), F.lit(NO_PERIOD))


def with_period(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(PERIOD, T.DateType())])


def read(spark: SparkSession, path: str, schema: T.StructType, parts: Iterable[str] | None = None) -> DataFrame:
    """The rows of a table with their period, or of some of its parts only."""
    rows = files.read_history(spark, path, with_period(schema))
    return rows if parts is None else rows.where(part().isin(list(parts)))


def laid_out(df: DataFrame, near: str) -> DataFrame:
    """Rows so dealt that a part has few files, and a large part several."""
    return df.repartitionByRange(PERIOD, near)


def append(df: DataFrame, path: str, day: str, near: str, unit: str = "day") -> None:
    """Add rows to a table; ``near`` names the column by which a large part is cut into files."""
    laid_out(df.withColumn(PERIOD, period_of(day, unit)), near).write.mode("append").partitionBy(PERIOD).parquet(path)


def file_marks(spark: SparkSession, path: str, schema: T.StructType) -> dict[str, str]:
    """Digest of the file names of every part."""
    names = defaultdict(list)
    for name in read(spark, path, schema).inputFiles():
        found = re.search(rf"/{PERIOD}=([^/]+)/([^/]+)$", name)
        if found is None:
            raise ValueError(f"{name} lies outside the parts of {path}")
        names[unquote(found[1])].append(found[2])
    return {period: hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest() for period, found in names.items()}


def replace_parts(df: DataFrame, path: str, parts: Iterable[str]) -> None:
    """Replace some parts of a table by ``df``, which has rows of these parts only; parts without rows are removed.

    All of them are written aside by one job, then each is swapped by renames; readers see a part as it was or as it is, or for the
    moment between two renames not at all. Rows must not come from the parts replaced.
    """
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    whole = publication.Folder(spark, path)
    for left in whole.left(PARTS):
        whole.remove(left)
    aside = publication.Folder(spark, f"{whole.aside(PARTS)}-{mark}")
    df.write.partitionBy(PERIOD).parquet(aside.path)
    for name in parts:
        folder = publication.Folder(spark, f"{whole.path}/{PERIOD}={name}")
        new, old = f"{aside.path}/{PERIOD}={name}", f"{folder.aside(publication.OLD)}-{mark}"
        for left in folder.left(publication.OLD):  # of a refresh that died; its part is made anew now
            folder.remove(left)
        if whole.exists(new):
            publication.swap(folder, new, old)
        elif folder.exists():
            folder.remove(folder.path)
    aside.remove(aside.path)


def refresh(spark: SparkSession, source: str, source_schema: T.StructType, target: str, marks: str,
            make: Callable[[DataFrame], DataFrame], near: str) -> list[str]:
    """Bring the table at ``target`` up to date with the one at ``source``; returns the parts that were made anew or removed.

    ``make`` turns rows of some periods into the target's rows of the same periods and keeps the column ``period``. Only
    source files of changed parts are read. Without marks or without a target, all of it is made and swapped in at once. One writer at a time.
    """
    publication.recover(spark, target)
    written = publication.Folder(spark, target).exists()
    before = histories.stored_marks(spark, marks) if written else {}
    now = file_marks(spark, source, source_schema)
    gone = before.keys() - now.keys()
    changed = sorted({name for name, mark in now.items() if before.get(name) != mark} | gone)
    if not changed and written:
        return []
    rows = laid_out(make(read(spark, source, source_schema, changed)), near)
    if before:
        replace_parts(rows, target, changed)
    else:
        publication.publish(rows, target, [PERIOD])
    histories.store_marks(spark, now, marks)
    return changed
