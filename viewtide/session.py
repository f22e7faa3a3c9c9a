"""Session helpers: a local session for tests and benches, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", partitions: int = 8, app: str = "viewtide") -> SparkSession:
    """Session for one machine. On a cluster the submitter sets master, memory and partitions."""
    return (SparkSession.builder.master(f"local[{cores}]").appName(app)
            .config("spark.sql.shuffle.partitions", str(partitions))
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.driver.memory", "16g")
            .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
            .getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``, or the checkpoint folder set on the context.

    Only a session on one machine that names none gets a temporary folder; on a cluster the setting is needed, since a
    folder of one machine would be lost with that machine.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None and (context.master == "local" or context.master.startswith("local[")):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="viewtide-"))
        named = context.getCheckpointDir()
    if named is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return named


def scratch_root(spark: SparkSession) -> str:
    """This application's folder for staged tables."""
    return f"{shared_dir(spark).rstrip('/')}/viewtide/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends, columns can be pruned, sizes are known."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Remove all staged tables of this application; for the end of a job, when its results are stored."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
