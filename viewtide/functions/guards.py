"""Input guards.

Schema guards look at ``df.schema`` and cost nothing. Value guards come in two forms:

* ``eager``   - one aggregate over the needed columns before the plan is built, ``ValueError`` at once;
* ``inline``  - the check sits inside the plan (``raise_error``): no extra pass over the input, a bad
  value fails the job that reads it. Meant for large inputs.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

MODES = ("eager", "inline", "off")


# The error texts below are fixed values.

def require_dataframe(value: object, label: str) -> None:
    if not isinstance(value, DataFrame):
        raise TypeError(f"{label} must be a Spark DataFrame.")


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    absent = sorted(set(names).difference(df.columns))
    if absent:
        raise ValueError("Missing required columns: " + ", ".join(absent))


def require_numeric(df: DataFrame, name: str, message: str = "'{}' must be numeric when provided.") -> None:
    if not isinstance(df.schema[name].dataType, T.NumericType):
        raise TypeError(message.format(name))


def require_page_identity(pages: DataFrame) -> None:
    if not {"section_id", "page_key"}.intersection(pages.columns):
        raise ValueError("fact_page_views must include either 'section_id' or 'page_key'.")


def require_measure(df: DataFrame, name: str) -> None:
    if name not in df.columns:
        raise KeyError(f"Expected column '{name}' is missing")


def require_mode(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"validate must be one of {', '.join(MODES)}")


def preflight(df: DataFrame, rules: Mapping[str, Column]) -> None:
    """Count the rows breaking each rule in one pass; raise the first broken rule's message."""
    if not rules:
        return
    messages = list(rules)
    broken = df.agg(*[F.count_if(rules[m]).alias(f"r{i}") for i, m in enumerate(messages)]).first()
    for i, message in enumerate(messages):
        if broken[i]:
            raise ValueError(message)


def enforce(df: DataFrame, rules: Mapping[str, tuple[str, Column]], mode: str) -> DataFrame:
    """Apply value rules ``{message: (column guarded, condition that must not hold)}``."""
    require_mode(mode)
    if mode == "eager":
        preflight(df, {message: bad for message, (_, bad) in rules.items()})
    if mode == "inline":
        for message, (name, bad) in rules.items():
            df = df.withColumn(name, F.when(bad, F.raise_error(F.lit(message))).otherwise(F.col(name)))
    return df
