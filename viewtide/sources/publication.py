"""Tables that are replaced as a whole: readers see the old table or the new one, whatever dies in between.

A new table is written aside and becomes complete there. The swap is two renames; one that was interrupted between them is
finished, or undone if the new table is incomplete, by whoever publishes or opens the table next.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

#: Names of what is aside. Spark's readers pass over names that begin with a dot, so a partition's swap shows no half table.
NEW, OLD = ".new-", ".old-"


class Folder:
    """A path in the file system Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self.at = self.jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = self.at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def other(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str | None = None) -> bool:
        return self.fs.exists(self.at if path is None else self.other(path))

    def aside(self, mark: str) -> str:
        """The path beside this one that begins with ``mark``."""
        return f"{self.at.getParent().toString()}/{mark}{self.at.getName()}"

    def left(self, mark: str) -> list[str]:
        """Paths beside this one that a swap left, the newest last."""
        parent = self.at.getParent()
        if not self.fs.exists(parent):
            return []
        mine = re.compile(re.escape(f"{mark}{self.at.getName()}-") + "[0-9a-f]{32}")
        found = [x for x in self.fs.listStatus(parent) if mine.fullmatch(x.getPath().getName())]
        return [x.getPath().toString() for x in sorted(found, key=lambda x: x.getModificationTime())]

    def rename(self, source: str, target: str) -> None:
        if not self.fs.rename(self.other(source), self.other(target)):
            raise OSError(f"cannot rename {source} to {target}")

    def remove(self, path: str) -> None:
        self.fs.delete(self.other(path), True)


def recover(spark: SparkSession, path: str) -> None:
    """Finish or undo a swap that was interrupted."""
    folder = Folder(spark, path)
    if not folder.exists():
        complete = [p for p in folder.left(NEW) if folder.exists(f"{p}/_SUCCESS")]
        instead = complete[-1:] or folder.left(OLD)[-1:]
        if instead:
            folder.rename(instead[0], folder.path)
    for left in (*folder.left(NEW), *folder.left(OLD)):
        folder.remove(left)


def publish(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Replace the table at ``path`` by ``df``, which may read the table it replaces. One writer at a time.

    ``by`` names partition columns below the path."""
    spark = df.sparkSession
    recover(spark, path)
    folder, mark = Folder(spark, path), uuid.uuid4().hex
    new, old = f"{folder.aside(NEW)}-{mark}", f"{folder.aside(OLD)}-{mark}"
    df.write.partitionBy(*by).parquet(new)
    swap(folder, new, old)


def swap(folder: Folder, new: str, old: str) -> None:
    if folder.exists():
        folder.rename(folder.path, old)
    folder.rename(new, folder.path)
    folder.remove(old)


def open_table(spark: SparkSession, path: str) -> DataFrame:
    """The published table; an interrupted swap is settled first."""
    recover(spark, path)
    return spark.read.parquet(path)
