"""Data-quality checks as result tables.

Rules are data (lists of specs); each table is read once for all its null and row-count rules.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from viewtide.functions import columns as C
from viewtide.functions.order_stats import column_percentiles


@dataclass(frozen=True)
class Expectation:
    """A rule on one table. ``kind`` is a key of ``NAMES``."""

    kind: str
    column: str | None = None
    min_value: int | None = None

    @property
    def details(self) -> str:
        return str({"column": self.column} if self.column else {"min_value": self.min_value})


NAMES = {"unique": "ExpectColumnValuesToBeUnique", "not_null": "ExpectColumnValuesToNotBeNull",
         "row_count": "ExpectTableRowCountToBeBetween"}
GROUPS = {"unique": "uniqueness", "not_null": "nulls", "row_count": "row_count"}

# The rules of the star schema.
UNIQUE_KEYS = {"dim_date": "date_key", "dim_user": "user_key", "dim_report": "report_id", "dim_page": "page_key"}
REQUIRED = {
    "dim_date": ["date_key"],
    "dim_user": ["user_key"],
    "dim_report": ["report_id"],
    "dim_page": ["page_key", "report_id", "section_id"],
    "fact_report_views": ["date_key", "report_id", "user_key", "view_count"],
    "fact_page_views": ["date_key", "report_id", "page_key", "user_key", "page_view_count"],
    "fact_report_loads": ["date_key", "report_id", "user_key", "load_time_ms"],
}
REFERENCES = [
    ("fact_report_views", "report_id", "dim_report"),
    ("fact_report_views", "user_key", "dim_user"),
    ("fact_report_views", "date_key", "dim_date"),
    ("fact_page_views", "report_id", "dim_report"),
    ("fact_page_views", "page_key", "dim_page"),
    ("fact_page_views", "user_key", "dim_user"),
    ("fact_page_views", "date_key", "dim_date"),
    ("fact_report_loads", "report_id", "dim_report"),
    ("fact_report_loads", "user_key", "dim_user"),
    ("fact_report_loads", "date_key", "dim_date"),
]
PAIRS = [
    ("reports", "dim_report"), ("users", "dim_user"), ("report_pages", "dim_page"), ("dates", "dim_date"),
    ("report_views", "fact_report_views"), ("report_page_views", "fact_page_views"),
    ("report_load_times", "fact_report_loads"),
]
RAW_REFERENCES = [
    ("report_views", "report_id", "reports"), ("report_views", "user_key", "users"),
    ("report_page_views", "section_id", "report_pages"), ("report_load_times", "report_id", "reports"),
]


def union(frames: Iterable[DataFrame]) -> DataFrame:
    """All rows of the frames by column name; columns a frame lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _result(table: str, rule: Expectation, success: Column, unexpected: Column | None = None,
            unexpected_percent: Column | None = None, missing: Column | None = None,
            missing_percent: Column | None = None, elements: Column | None = None) -> Column:
    """One flat result record; figures a rule does not have are NULL."""
    def figure(value: Column | None, kind: str) -> Column:
        return (F.lit(None) if value is None else value).cast(kind)

    return F.struct(
        F.lit(table).alias("table_name"), F.lit(GROUPS[rule.kind]).alias("check_group"),
        F.lit(NAMES[rule.kind]).alias("expectation_name"), success.alias("success"),
        figure(unexpected, "bigint").alias("unexpected_count"),
        figure(unexpected_percent, "double").alias("unexpected_percent"),
        figure(missing, "bigint").alias("missing_count"), figure(missing_percent, "double").alias("missing_percent"),
        figure(elements, "bigint").alias("element_count"), F.lit(rule.details).alias("details"))


def _unroll(one_row: DataFrame, records: Sequence[Column]) -> DataFrame:
    return one_row.select(F.inline(F.array(*records)))


def _figures(df: DataFrame, rules: Sequence[Expectation]) -> DataFrame:
    """One row with the counts that all rules of a table need, from one scan.

    Without uniqueness rules that is one aggregate. With one, rows are counted per key first and the counts of
    nulls ride along. With several, the keys of all rules are stacked, each row giving one entry per rule.
    """
    needed = list(dict.fromkeys(r.column for r in rules if r.kind == "not_null"))
    keys = [r.column for r in rules if r.kind == "unique"]
    nulls = [F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in needed]
    if not keys:
        return df.agg(F.count("*").alias("_rows"), *nulls)
    if len(keys) == 1:
        # the rule's column is counted as the key: a null key is one group
        copies = df.groupBy(F.col(keys[0]).alias("_key")).agg(F.count("*").alias("_n"), *nulls).withColumn("_rule", F.lit(0))
    else:
        entry = [F.struct(F.lit(i).alias("_rule"), *_typed(df, c), *[(F.col(n).isNull() if i == 0 else F.lit(False)).alias(f"_is_{n}")
                                                                       for n in needed]) for i, c in enumerate(keys)]
        stacked = df.select(F.inline(F.array(*entry)))
        copies = stacked.groupBy("_rule", "_long", "_text").agg(
            F.count("*").alias("_n"), *[F.count_if(f"_is_{n}").alias(f"_null_{n}") for n in needed])
        copies = copies.withColumn("_key", F.coalesce(F.col("_long").cast("string"), F.col("_text")))
    null = F.col("_key").isNull()
    mine = [F.col("_rule") == i for i in range(len(keys))]
    return copies.agg(
        C.total(F.when(mine[0], F.col("_n"))).alias("_rows"), *[C.total(F.col(f"_null_{c}")).alias(f"_null_{c}") for c in needed],
        *[C.total(F.when(m & null, F.col("_n"))).alias(f"_empty{i}") for i, m in enumerate(mine)],
        *[C.total(F.when(m & ~null & (F.col("_n") > 1), F.col("_n"))).alias(f"_twice{i}") for i, m in enumerate(mine)])


def _typed(df: DataFrame, column: str, kind: str | None = None) -> list[Column]:
    """A key as (_long, _text): whole numbers stay numbers, so keys of different types fit into one column pair."""
    kind = kind or df.schema[column].dataType.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return [F.col(column).cast("bigint").alias("_long"), F.lit(None).cast("string").alias("_text")]
    return [F.lit(None).cast("bigint").alias("_long"), F.col(column).cast(kind).cast("string").alias("_text")]


def run_expectations(df: DataFrame, table: str, rules: Sequence[Expectation]) -> DataFrame:
    """Result rows of all rules on one table, from one scan of it."""
    rows, records, unique = F.col("_rows"), [], 0
    for rule in rules:
        if rule.kind == "unique":
            twice, empty = F.col(f"_twice{unique}"), F.col(f"_empty{unique}")
            records.append(_result(table, rule, twice == 0, twice, C.ratio(twice * 100, rows - empty), empty,
                                   C.ratio(empty * 100, rows), rows))
            unique += 1
        elif rule.kind == "not_null":
            nulls = F.col(f"_null_{rule.column}")
            records.append(_result(table, rule, nulls == 0, nulls, C.ratio(nulls * 100, rows), elements=rows))
        else:
            records.append(_result(table, rule, rows >= rule.min_value))
    return _unroll(_figures(df, rules), records)


def model_expectations(groups: Iterable[str] = ("unique", "not_null", "row_count")) -> dict[str, list[Expectation]]:
    """The star schema's rules per table."""
    rules: dict[str, list[Expectation]] = {}
    for table, columns in REQUIRED.items():
        mine = []
        if "unique" in groups and table in UNIQUE_KEYS:
            mine.append(Expectation("unique", UNIQUE_KEYS[table]))
        if "not_null" in groups:
            mine += [Expectation("not_null", c) for c in columns]
        if "row_count" in groups:
            mine.append(Expectation("row_count", min_value=1))
        if mine:
            rules[table] = mine
    return rules


def run_model_expectations(tables: Mapping[str, DataFrame], groups=("unique", "not_null", "row_count")) -> DataFrame:
    return union(run_expectations(tables[t], t, rules) for t, rules in model_expectations(groups).items())


@dataclass(frozen=True)
class Reference:
    """Key ``key`` of table ``fact`` must be among the values of ``dim_key`` in ``dim``."""

    fact: str
    key: str
    dim: str
    dim_key: str


def _key_type(tables: Mapping[str, DataFrame], r: Reference) -> str:
    """Type in which the two sides of a reference are compared."""
    kinds = [tables[t].schema[c].dataType.simpleString() for t, c in ((r.fact, r.key), (r.dim, r.dim_key))]
    whole = ("tinyint", "smallint", "int", "bigint")
    if kinds[0] == kinds[1]:
        return kinds[0]
    if all(k in whole for k in kinds):
        return "bigint"
    return "double" if all(k in (*whole, "float", "double") for k in kinds) else "string"


def memberships(tables: Mapping[str, DataFrame], references: Sequence[Reference]) -> DataFrame:
    """(check, total_rows, invalid_count) of all references, ``check`` being the place in the list.

    Every table is scanned once: a row gives one entry per key of it, entries are counted per (check, key) before the only
    shuffle, and the dimension's keys meet them there as entries without a count. So nothing is joined, and a hot key is
    one row per task. NULL counts as a key like any other: invalid unless the dimension holds NULL too.
    """
    kinds = [_key_type(tables, r) for r in references]
    entries: dict[str, list[Column]] = {}
    for i, (r, kind) in enumerate(zip(references, kinds)):
        for table, column, n in ((r.fact, r.key, 1), (r.dim, r.dim_key, 0)):
            entries.setdefault(table, []).append(F.struct(
                F.lit(i).alias("check"), F.lit(n).cast("bigint").alias("_n"), *_typed(tables[table], column, kind)))
    stacked = union(tables[t].select(F.inline(F.array(*mine))) for t, mine in entries.items())
    counted = stacked.groupBy("check", "_long", "_text").agg(F.sum("_n").alias("_n"), F.min("_n").alias("_least"))
    # an entry of the dimension counts 0, so the smallest count tells whether the dimension has the key
    return counted.groupBy("check").agg(F.sum("_n").alias("total_rows"),
                                        C.total(F.when(F.col("_least") > 0, F.col("_n"))).alias("invalid_count"))


def checked(tables: Mapping[str, DataFrame], references: Sequence[Reference], describe_one) -> DataFrame:
    """One row per reference; ``describe_one`` names it. References between empty tables have no rows and no fault."""
    spark = next(iter(tables.values())).sparkSession
    named = [describe_one(r) for r in references]
    names = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("check"), *[F.lit(v).alias(k) for k, v in one.items()]) for i, one in enumerate(named)])))
    found = memberships(tables, references)
    return names.join(found, "check", "left").drop("check").withColumns(
        {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("total_rows", "invalid_count")})


def run_referential_integrity_checks(tables: Mapping[str, DataFrame], references=tuple(REFERENCES)) -> DataFrame:
    """One row per foreign key; dimension keys carry the fact key's name."""
    rows = checked(tables, [Reference(fact, key, dim, key) for fact, key, dim in references], lambda r: {
        "check_name": f"{r.fact}.{r.key} -> {r.dim}.{r.key}", "fact_key": r.key, "dimension_key": r.key})
    return rows.select("check_name", "fact_key", "dimension_key", "invalid_count", "total_rows",
                       (F.col("invalid_count") == 0).alias("success"))


def membership(fact: DataFrame, fact_key: str, dim: DataFrame, dim_key: str) -> DataFrame:
    """Rows of the fact and rows whose key the dimension lacks: (total_rows, invalid_count)."""
    return checked({"fact": fact, "dim": dim}, [Reference("fact", fact_key, "dim", dim_key)],
                   lambda r: {"name": ""}).select("total_rows", "invalid_count")


def run_row_count_reconciliation(raw: Mapping[str, DataFrame], processed: Mapping[str, DataFrame]) -> DataFrame:
    """Row counts of each raw table and the table built from it."""
    def count(df: DataFrame, pair: tuple[str, str], side: str) -> DataFrame:
        return df.agg(F.count("*").alias(side)).select(
            F.lit(pair[0]).alias("raw_table"), F.lit(pair[1]).alias("processed_table"), side)

    counts = union(frame for pair in PAIRS for frame in (
        count(raw[pair[0]], pair, "raw_row_count"), count(processed[pair[1]], pair, "processed_row_count")))
    return (counts.groupBy("raw_table", "processed_table")
            .agg(F.max("raw_row_count").alias("raw_row_count"), F.max("processed_row_count").alias("processed_row_count"))
            .withColumn("row_count_difference", F.col("processed_row_count") - F.col("raw_row_count"))
            .withColumn("exact_match", F.col("row_count_difference") == 0))


def tally(checks: DataFrame, flag: str, group: Column) -> DataFrame:
    """Checks run, passed and failed per group."""
    return (checks.groupBy(group.alias("check_group"))
            .agg(F.count(flag).alias("checks_run"), F.count_if(flag).alias("checks_passed"))
            .withColumn("checks_failed", F.col("checks_run") - F.col("checks_passed")))


def build_validation_summary(expectations: DataFrame, integrity: DataFrame, reconciliation: DataFrame) -> DataFrame:
    """Checks run, passed and failed per check group."""
    return union([tally(expectations, "success", F.col("check_group")),
                  tally(integrity, "success", F.lit("referential_integrity")),
                  tally(reconciliation, "exact_match", F.lit("row_count_reconciliation"))])


def _flag(df: DataFrame, group: str, name: str, passed: Column, value: Column) -> DataFrame:
    return df.select(F.lit(group).alias("check_group"), F.lit(name).alias("check_name"), passed.alias("success"),
                     value.cast("bigint").alias("value"))


def run_lightweight_checks(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Build-time checks: key uniqueness, foreign keys other than dates, NULLs in fact keys.

    ``value`` is the number of offending rows.
    """
    parts = []
    for dim, key in UNIQUE_KEYS.items():
        copies = tables[dim].groupBy(key).agg(F.count("*").alias("_n"))
        extra = copies.agg(C.total(F.col("_n") - 1).alias("_extra"))
        parts.append(_flag(extra, "uniqueness", f"{dim}.{key}", F.col("_extra") == 0, F.col("_extra")))
    keys = [Reference(fact, key, dim, key) for fact, key, dim in REFERENCES if key != "date_key"]
    integrity = checked(tables, keys, lambda r: {"check_name": f"{r.fact}.{r.key} in {r.dim}"})
    parts.append(integrity.select(F.lit("referential_integrity").alias("check_group"), "check_name",
                                  (F.col("invalid_count") == 0).alias("success"), F.col("invalid_count").alias("value")))
    for fact in ("fact_report_views", "fact_page_views", "fact_report_loads"):
        keys = [c for c in REQUIRED[fact] if c.endswith(("_key", "_id"))]
        nulls = null_counts(tables[fact], keys)
        parts.append(nulls.select(F.lit("nulls").alias("check_group"),
                                  F.concat(F.lit(fact + "."), "column").alias("check_name"),
                                  (F.col("null_count") == 0).alias("success"), F.col("null_count").alias("value")))
    return union(parts)


def run_raw_key_checks(raw: Mapping[str, DataFrame]) -> DataFrame:
    """Whether the keys of the raw event tables exist in the raw master tables."""
    rows = checked(raw, [Reference(t, key, master, key) for t, key, master in RAW_REFERENCES],
                   lambda r: {"check_name": f"{r.fact}.{r.key} in {r.dim}"})
    return rows.select("check_name", (F.col("invalid_count") == 0).alias("success"), "invalid_count")


def null_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column, null_count), one pass."""
    counted = df.agg(*[F.count_if(C.quoted(c).isNull()).alias(f"n{i}") for i, c in enumerate(names)])
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("null_count")) for i, c in enumerate(names)])))


def duplicate_rows(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Number of rows that repeat an earlier identical row."""
    copies = df.groupBy(*[C.quoted(c) for c in names]).agg(F.count("*").alias("_n"))
    return copies.agg(C.total(F.col("_n") - 1).alias("duplicate_rows"))


def describe(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles, max per column; quartiles exact and gathered nowhere. Reads ``df`` several times."""
    figures = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    quartiles, found = column_percentiles(df, names, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, {
        c: [figure(C.quoted(c).cast("double")) for figure in figures.values()] for c in names})
    rows = [(c, *found[c][:-1], *[quartiles.get(c, {}).get(p) for p in ("p25", "p50", "p75")], found[c][-1]) for c in names]
    return df.sparkSession.createDataFrame(rows, "column string, count bigint, mean double, std double, min double, p25 double, "
                                                 "p50 double, p75 double, max double")


def run_data_quality_checks(df: DataFrame, date_col: str = "Date", id_col: str = "Report Guid",
                            name_col: str = "Report Name", user_col: str = "User Id",
                            views_col: str = "Occurrences") -> DataFrame:
    """Profile of the forecasting input: (check, value, status).

    Equal rows are counted once, then every figure is read off the counted rows: a single pass.
    """
    names = [date_col, id_col, name_col, user_col, views_col]
    copies = df.groupBy(*[C.quoted(c) for c in names]).agg(F.count("*").alias("_n"))
    n, day = F.col("_n"), C.to_day(df, date_col)
    figures = copies.agg(
        C.total(n).alias("rows"), *[C.total(F.when(C.quoted(c).isNull(), n)).alias(f"null{i}") for i, c in enumerate(names)],
        C.total(n - 1).alias("extra"), F.min(day).alias("first"), F.max(day).alias("last"),
        C.total(F.when(C.quoted(views_col) < 0, n)).alias("negative"))

    def record(check: str, value: Column, status: Column) -> Column:
        return F.struct(F.lit(check).alias("check"), value.cast("string").alias("value"), status.alias("status"))

    def zero_or(bad: str, value: Column) -> Column:
        return F.when(value == 0, "ok").otherwise(bad)

    rows = F.col("rows")
    return _unroll(figures, [
        record("row_count", rows, F.when(rows > 0, "ok").otherwise("fail")),
        *[record(f"nulls_{c}", F.col(f"null{i}"), zero_or("warn", F.col(f"null{i}"))) for i, c in enumerate(names)],
        record("exact_duplicate_rows", F.col("extra"), zero_or("warn", F.col("extra"))),
        record("min_date", F.col("first"), F.lit("ok")), record("max_date", F.col("last"), F.lit("ok")),
        record("negative_occurrences", F.col("negative"), zero_or("fail", F.col("negative")))])


# Mart invariants ------------------------------------------------------------------------------------

def _verdicts(figures: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    return figures.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("check"), F.coalesce(ok, F.lit(True)).alias("passed")) for name, ok in checks.items()])))


def _broken_rows(mart: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows breaking each rule, and surplus rows per (date, report_id): one aggregate over the mart."""
    by_day = mart.groupBy("date", "report_id").agg(
        F.count("*").alias("_n"), *[F.count_if(bad).alias(name) for name, bad in rules.items()])
    return by_day.agg(C.total(F.col("_n")).alias("rows"), C.total(F.col("_n") - 1).alias("extra"),
                      *[C.total(F.col(name)).alias(name) for name in rules])


def _outside(name: str, low: float, high: float) -> Column:
    """Not between the bounds; NULL lies outside, as in the check's pandas form."""
    return ~F.coalesce(F.col(name).between(low, high), F.lit(False))


def _negative(name: str) -> Column:
    return ~F.coalesce(F.col(name) >= 0, F.lit(False))


def _infinite(name: str) -> Column:
    return F.coalesce(F.abs(F.col(name)) == float("inf"), F.lit(False))


def check_adoption_mart(mart: DataFrame, daily: DataFrame) -> DataFrame:
    """Grain, no row before launch, common last day, zero viewers give zero views per user."""
    launches = daily.groupBy("report_id").agg(F.min("date").alias("start_date"))
    last = daily.agg(F.max("date")).scalar()
    per_report = (mart.groupBy("report_id", "date").agg(
        F.count("*").alias("_n"),
        F.count_if((F.col("unique_viewers") == 0) & ~F.coalesce(F.col("views_per_user") == 0, F.lit(False))).alias("_zero"))
        .groupBy("report_id").agg(F.min("date").alias("_first"), F.max("date").alias("_last"),
                                  F.sum(F.col("_n") - 1).alias("_extra"), F.sum("_zero").alias("_zero")))
    figures = per_report.join(launches, "report_id", "left").withColumn("_end", last).agg(
        C.total(F.col("_extra")).alias("extra"), F.count_if(F.col("_first") < F.col("start_date")).alias("early"),
        F.count_if(F.col("_last") != F.col("_end")).alias("short"), C.total(F.col("_zero")).alias("zero"))
    return _verdicts(figures, {
        "one_row_per_date_report": F.col("extra") == 0, "no_prelaunch_rows": F.col("early") == 0,
        "all_reports_end_at_global_max": F.col("short") == 0, "zero_viewers_zero_ratio": F.col("zero") == 0})


def check_time_series_mart(ts: DataFrame, mart: DataFrame) -> DataFrame:
    """Row count kept, grain, rolling columns filled, no infinite change."""
    rolling = ["views_7d", "views_28d", "viewers_7d", "viewers_28d"]
    empty = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in rolling])
    figures = _broken_rows(ts, {"empty": empty, "infinite": _infinite("wow_change_views")})
    before = mart.agg(F.count("*")).scalar()
    return _verdicts(figures.withColumn("before", before), {
        "row_count_unchanged": F.col("rows") == F.col("before"), "one_row_per_date_report": F.col("extra") == 0,
        "rolling_columns_populated": F.col("empty") == 0, "no_infinite_change": F.col("infinite") == 0})


def check_engagement_mart(mart: DataFrame) -> DataFrame:
    """Grain, keys filled, shares in [0, 1], idle days and page depth not negative."""
    figures = _broken_rows(mart, {
        "key": F.col("date").isNull() | F.col("report_id").isNull(),
        "repeat": _outside("repeat_user_rate", 0, 1), "top": _outside("top_10pct_user_share", 0, 1),
        "idle": _negative("days_since_last_use"), "depth": _negative("avg_pages_per_user")})
    return _verdicts(figures, {
        "one_row_per_date_report": F.col("extra") == 0, "keys_not_null": F.col("key") == 0,
        "repeat_user_rate_in_range": F.col("repeat") == 0, "top_share_in_range": F.col("top") == 0,
        "idle_days_not_negative": F.col("idle") == 0, "page_depth_not_negative": F.col("depth") == 0})


def check_performance_mart(mart: DataFrame) -> DataFrame:
    """Grain, keys, signs, infinities, and p90 >= mean where several events exist.

    The last one is information, not an invariant: one extreme outlier among many loads breaks it.
    """
    late = (F.col("load_events") > 1) & ~F.coalesce(F.col("p90_load_time") >= F.col("avg_load_time"), F.lit(False))
    figures = _broken_rows(mart, {
        "key": F.col("date").isNull() | F.col("report_id").isNull(), "mean": _negative("avg_load_time"),
        "p90": _negative("p90_load_time"), "week": _negative("avg_load_time_7d"),
        "infinite": _infinite("load_time_wow_change"), "late": late})
    return _verdicts(figures, {
        "one_row_per_date_report": F.col("extra") == 0, "keys_not_null": F.col("key") == 0,
        "avg_not_negative": F.col("mean") == 0, "p90_not_negative": F.col("p90") == 0,
        "rolling_avg_not_negative": F.col("week") == 0, "no_infinite_change": F.col("infinite") == 0,
        "p90_at_least_avg": F.col("late") == 0})
