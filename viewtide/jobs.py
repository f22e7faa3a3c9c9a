"""Command line: one job per stage, each reading and writing named tables below a root folder.

    spark-submit viewtide/jobs.py model    --raw RAW --processed OUT [--format csv]
    spark-submit viewtide/jobs.py validate --raw RAW --processed OUT --out DIR
    spark-submit viewtide/jobs.py marts    --processed OUT --out DIR
    spark-submit viewtide/jobs.py forecast --usage TABLE --out DIR --run-id ID --run-time 2026-01-31T06:00:00
        [--format csv] [--horizon 30] [--names A B] [--report-id-col C] [--name-col C] [--date-col C] [--views-col C]
    spark-submit viewtide/jobs.py layers   --events TABLE --out DIR --run-id ID --run-time 2026-01-31T06:00:00
        [--format csv] [--unit day] [--horizon 30] [--names A B]
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from datetime import datetime
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from viewtide import schemas  # noqa: E402
from viewtide.operators import publish, star_schema  # noqa: E402
from viewtide.plans import forecasting, marts, validation  # noqa: E402
from viewtide.session import clear_scratch  # noqa: E402
from viewtide.sources import files, periods  # noqa: E402


def model_job(spark: SparkSession, raw: str, processed: str, fmt: str = "parquet") -> None:
    files.save_tables(star_schema.build_semantic_model(files.load_raw_tables(spark, raw, fmt)), processed, fmt)


def validate_job(spark: SparkSession, raw: str, processed: str, out: str, fmt: str = "parquet") -> None:
    files.save_tables(validation.validate_semantic_model(files.load_processed_tables(spark, processed, fmt),
                                                         files.load_raw_tables(spark, raw, fmt)), out, fmt)


def marts_job(spark: SparkSession, processed: str, out: str, fmt: str = "parquet") -> None:
    files.save_tables(marts.build_marts(files.load_processed_tables(spark, processed, fmt)), out, fmt)


def forecast_job(spark: SparkSession, usage: str, out: str, run_id: str, run_time: str, fmt: str = "parquet",
                 horizon: int = publish.HORIZON, names: Sequence[str] = (), **columns) -> None:
    run = publish.Run(run_id, datetime.fromisoformat(run_time))
    rows = spark.read.parquet(usage) if fmt == "parquet" else spark.read.csv(usage, header=True)
    forecasting.run_forecasts(rows, run, out, horizon=horizon, names=names, **columns)


def layers_job(spark: SparkSession, events: str, out: str, run_id: str, run_time: str, fmt: str = "parquet", unit: str = "day",
               horizon: int = publish.HORIZON, names: Sequence[str] = ()) -> None:
    """New events (report_id, report_name, date, occurrences) into the layers below ``out``."""
    run = publish.Run(run_id, datetime.fromisoformat(run_time))
    rows = files.read_table(spark, events, schemas.BRONZE if fmt == "csv" else None, fmt)
    forecasting.update_layers(rows, out, run, unit, horizon=horizon, names=names)


JOBS = {"model": model_job, "validate": validate_job, "marts": marts_job, "forecast": forecast_job, "layers": layers_job}
ARGUMENTS = {"model": ("raw", "processed"), "validate": ("raw", "processed", "out"), "marts": ("processed", "out"),
             "forecast": ("usage", "out", "run_id", "run_time"), "layers": ("events", "out", "run_id", "run_time")}

#: Names of the usage table's columns that a forecast job may be told.
COLUMNS = ("report_id_col", "name_col", "date_col", "views_col")


def main(argv: Sequence[str] | None = None, clear: bool = False) -> None:
    """Run one job; ``clear`` removes the application's staged tables when it is over."""
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    stages = parser.add_subparsers(dest="stage", required=True)
    for stage, names in ARGUMENTS.items():
        sub = stages.add_parser(stage)
        for name in names:
            sub.add_argument("--" + name.replace("_", "-"), required=True)
        sub.add_argument("--format", dest="fmt", choices=["parquet", "csv"], default="parquet")
        if stage in ("forecast", "layers"):
            sub.add_argument("--horizon", type=int, default=publish.HORIZON)
            sub.add_argument("--names", nargs="*", default=[])
        if stage == "layers":
            sub.add_argument("--unit", choices=periods.UNITS, default="day")
        if stage == "forecast":
            for name in COLUMNS:
                sub.add_argument("--" + name.replace("_", "-"), default=argparse.SUPPRESS)
    options = vars(parser.parse_args(argv))
    spark = SparkSession.builder.appName("viewtide").getOrCreate()
    try:
        JOBS[options.pop("stage")](spark, **options)
    finally:
        if clear:
            clear_scratch(spark)


if __name__ == "__main__":
    main(clear=True)
