"""How often a series is to be differenced, by tests of stationarity; all reports at once, no Python.

The level statistic (KPSS) of n values is the sum of their squared partial sums of deviations from the mean, over n squared times
the long-run variance, which weighs the autocovariances of the first lags down linearly. Above ``CRITICAL`` the level wanders.
For the season the statistic is taken for every weekday alone, of the deviations from the centred mean of seven
days (which take trend and level away), and averaged: a weekly pattern that wanders asks for a seasonal difference.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

SEASON = 7
#: 5 % point of the level statistic (fixed value).
CRITICAL = 0.463


def lags_used(n: Column) -> Column:
    """How many lags the long-run variance of n values takes."""
    return F.floor(4 * F.pow(n / 100, 0.25)).cast("int")


def longest(rows: DataFrame, n: str) -> int:
    """Lags that the longest series of the rows takes: 8 for seven years of days."""
    return rows.agg(F.max(lags_used(F.col(n))).alias("lags")).first()["lags"] or 0


def level_statistic(rows: DataFrame, keys: Sequence[str], value: str, order: str, lags: int) -> DataFrame:
    """keys, n and ``statistic``: NULL for a constant series and for fewer than three values.

    ``lags`` is at least what the longest series takes.
    """
    lags, mine = max(lags, 1), ", ".join(keys)
    over = f"over (partition by {mine} order by {order})"
    deviations = rows.selectExpr(*keys, order, f"{value} - avg({value}) over (partition by {mine}) as _e").where("_e is not null")
    summed = deviations.selectExpr(*keys, "_e", f"sum(_e) {over} as _s", *[f"lag(_e, {k}) {over} as _e{k}" for k in range(1, lags + 1)])
    cross = ", ".join(f"coalesce(sum(_e * _e{k}), 0D)" for k in range(1, lags + 1))
    sums = summed.groupBy(*keys).agg(*[F.expr(x) for x in (
        "count(*) as n", "sum(_s * _s) as _partial", "sum(_e * _e) as _own", f"array({cross}) as _cross")])
    used = lags_used(F.col("n"))
    weighted = F.transform("_cross", lambda c, i: F.when(i < used, c * (1 - (i + 1) / (used + 1))).otherwise(0.0))
    long_run = F.col("_own") + 2 * F.aggregate(weighted, F.lit(0.0), lambda a, c: a + c)
    return sums.select(*keys, "n", F.when((F.col("n") >= 3) & (long_run > 1e-9 * F.col("_own")),
                                          F.col("_partial") / (F.col("n") * long_run)).alias("statistic"))


def training_lags(split: DataFrame) -> int:
    return longest(split.where(F.col("error").isNull()), "n_train")


def level_statistics(split: DataFrame, lags: int | None = None) -> DataFrame:
    """report_id, sd, n, statistic of the training days as they are (sd 0) and after a seasonal difference (sd 1)."""
    by_report = Window.partitionBy("report_id").orderBy("date")
    before = F.lag("views", SEASON).over(by_report)
    rows = (split.where(F.col("error").isNull() & F.col("step").isNull()).select("report_id", "pos", "views", before.alias("_before"))
            .select("report_id", "pos", F.inline(F.array(
                F.struct(F.lit(0).alias("sd"), F.col("views").alias("value")),
                F.struct(F.lit(1).alias("sd"), (F.col("views") - F.col("_before")).alias("value"))))))
    return level_statistic(rows, ["report_id", "sd"], "value", "pos", training_lags(split) if lags is None else lags)


def seasonal_statistics(split: DataFrame, lags: int | None = None) -> DataFrame:
    """report_id and the mean over weekdays of the level statistic of the deviations from the centred weekly mean."""
    centred = Window.partitionBy("report_id").orderBy("date").rowsBetween(-(SEASON // 2), SEASON // 2)
    rows = (split.where(F.col("error").isNull() & F.col("step").isNull())
            .select("report_id", "pos", (F.col("pos") % SEASON).alias("phase"), (F.col("views") - F.avg("views").over(centred)).alias("value"),
                    F.count("*").over(centred).alias("_days")).where(F.col("_days") == SEASON))
    return (level_statistic(rows, ["report_id", "phase"], "value", "pos", training_lags(split) if lags is None else lags)
            .groupBy("report_id").agg(F.avg("statistic").alias("seasonal_statistic")))


def choose_differencing(split: DataFrame) -> DataFrame:
    """report_id, d, sd: the seasonal difference first, then the ordinary one of what the seasonal one leaves."""
    lags = training_lags(split)
    level = level_statistics(split, lags).groupBy("report_id").agg(
        *[F.max(F.when(F.col("sd") == k, F.col("statistic"))).alias(f"level_{k}") for k in (0, 1)])
    sd = F.coalesce((F.col("seasonal_statistic") > CRITICAL).cast("int"), F.lit(0))
    found = level.join(seasonal_statistics(split, lags), "report_id", "left").withColumn("sd", sd)
    left = F.when(F.col("sd") == 1, F.col("level_1")).otherwise(F.col("level_0"))
    return found.select("report_id", F.coalesce((left > CRITICAL).cast("int"), F.lit(0)).alias("d"), "sd")
