"""Column expressions shared by the operators.

Everything here builds a ``Column`` from the schema alone, so nothing runs until the caller acts.
Casts go through ``try_*`` because Spark 4 is ANSI by default: a bad value becomes NULL and is
judged by a guard, it does not kill the task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def quoted(name: str) -> Column:
    """Column of exactly this name, also when it holds spaces or dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def filled(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows with all these columns filled.

    Written as the conditions a join would add itself, so that a plan used on both sides of a join stays
    the same on both and Spark runs its exchange once (``dropna`` is opaque to that).
    """
    for name in names:
        df = df.where(quoted(name).isNotNull())
    return df


def _dated(text: Column, pattern: str) -> Column:
    return F.try_to_timestamp(text, F.lit(pattern)).cast("date")


def to_moment(df: DataFrame, name: str) -> Column:
    """Date-like column as DATE or TIMESTAMP; unreadable values become NULL.

    Dates and timestamps are kept, numbers are read as ``YYYYMMDD`` and text as ISO date,
    ISO timestamp, ``YYYYMMDD`` or month/day/year.
    """
    kind, raw = df.schema[name].dataType, quoted(name)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return raw
    if isinstance(kind, T.IntegralType):
        return _dated(raw.cast("string"), "yyyyMMdd")
    if isinstance(kind, T.NumericType):
        whole = raw.try_cast("bigint")
        return _dated(F.when(whole == raw, whole).cast("string"), "yyyyMMdd")
    text = F.trim(raw.cast("string"))
    return F.coalesce(text.try_cast("timestamp_ntz"), _dated(text, "yyyyMMdd").cast("timestamp_ntz"),
                      _dated(text, "M/d/yyyy").cast("timestamp_ntz"))


def to_day(df: DataFrame, name: str) -> Column:
    """Date-like column cut to the day."""
    return to_moment(df, name).cast("date")


def to_number(df: DataFrame, name: str) -> Column:
    """Column as DOUBLE; text that is no number and NaN become NULL."""
    kind, raw = df.schema[name].dataType, quoted(name)
    number = raw.cast("double") if isinstance(kind, T.NumericType) else raw.cast("string").try_cast("double")
    if isinstance(kind, (T.IntegralType, T.DecimalType)):
        return number
    return F.when(~F.isnan(number), number)


def to_number_or_zero(df: DataFrame, name: str) -> Column:
    return F.coalesce(to_number(df, name), F.lit(0.0))


def date_key(day: Column) -> Column:
    """``YYYYMMDD`` as INT."""
    return F.date_format(day, "yyyyMMdd").cast("int")


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as DOUBLE, NULL where ``whole`` is 0 or NULL."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def ratio_or_zero(part: Column, whole: Column) -> Column:
    return F.coalesce(ratio(part, whole), F.lit(0.0))


def finite(value: Column) -> Column:
    """NULL instead of NaN and the infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def relative_change(now: Column, before: Column) -> Column:
    """``(now - before) / before``; NULL if ``before`` is missing or 0."""
    return finite(ratio(now.cast("double") - before, before))


def percent_error(error: Column, actual: Column) -> Column:
    """Absolute error in percent of the actual value, NULL where that is 0."""
    return ratio(F.abs(error), actual) * 100


def floor_at_zero(value: Column) -> Column:
    """Counts cannot be negative; NULL stays NULL (``greatest`` would skip it)."""
    return F.when(value < 0, F.lit(0.0)).otherwise(value)


def improvement(mae: Column, base: Column) -> Column:
    """Share of the baseline's error that is saved; NULL without a positive baseline."""
    return F.when(base > 0, 1 - mae / base)


def top_decile_size(users: Column) -> Column:
    """How many users make up the top 10 percent: at least one, rounded up."""
    return F.greatest(F.lit(1), F.ceil(users * F.lit(0.10))).cast("bigint")


def model_label(p: Column, d: Column, q: Column, sp: Column, sd: Column, sq: Column, m: Column) -> Column:
    return F.format_string("ARIMA(%d,%d,%d)x(%d,%d,%d,%d)", p, d, q, sp, sd, sq, m)


def week_start(day: Column) -> Column:
    """Monday of the week of ``day``."""
    return F.date_trunc("week", day).cast("date")


def is_weekend(day: Column) -> Column:
    return F.weekday(day) >= 5


def total(value: Column) -> Column:
    """Sum that is 0, not NULL, when every value is missing."""
    return F.coalesce(F.sum(value), F.lit(0))
