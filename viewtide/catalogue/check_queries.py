"""Data-quality queries. Some run on tables with known faults, so that checks fail with exact counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from viewtide.catalogue.base import Data, query
from viewtide.operators import quality as Q, star_schema
from viewtide.plans import validation

RESULT_DOUBLES = "unexpected_percent missing_percent"
MODEL = "dim_date dim_user dim_report dim_page fact_report_views fact_page_views fact_report_loads"
RAW = "reports users report_pages dates report_views report_page_views report_load_times"


def _details(rule: Q.Expectation) -> str:
    return rule.details.replace("'", "''")


def unique_sql(table: str, column: str, source: str | None = None) -> str:
    rule = Q.Expectation("unique", column)
    return f"""
    SELECT '{table}' AS table_name, 'uniqueness' AS check_group, '{Q.NAMES["unique"]}' AS expectation_name,
           u = 0 AS success, u AS unexpected_count, u * 100.0::DOUBLE / nullif(n - m, 0) AS unexpected_percent,
           m AS missing_count, m * 100.0::DOUBLE / nullif(n, 0) AS missing_percent, n AS element_count,
           '{_details(rule)}' AS details
    FROM (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS n, CAST(coalesce(sum(c) FILTER (WHERE k IS NULL), 0) AS BIGINT) AS m,
                 CAST(coalesce(sum(c) FILTER (WHERE k IS NOT NULL AND c > 1), 0) AS BIGINT) AS u
          FROM (SELECT {column} AS k, count(*) AS c FROM {source or table} GROUP BY {column}))"""


def not_null_sql(table: str, column: str, source: str | None = None) -> str:
    rule = Q.Expectation("not_null", column)
    return f"""
    SELECT '{table}' AS table_name, 'nulls' AS check_group, '{Q.NAMES["not_null"]}' AS expectation_name, u = 0 AS success,
           u AS unexpected_count, u * 100.0::DOUBLE / nullif(n, 0) AS unexpected_percent,
           CAST(NULL AS BIGINT) AS missing_count, CAST(NULL AS DOUBLE) AS missing_percent, n AS element_count,
           '{_details(rule)}' AS details
    FROM (SELECT count(*) AS n, count(*) FILTER (WHERE {column} IS NULL) AS u FROM {source or table})"""


def row_count_sql(table: str) -> str:
    rule = Q.Expectation("row_count", min_value=1)
    return f"""
    SELECT '{table}' AS table_name, 'row_count' AS check_group, '{Q.NAMES["row_count"]}' AS expectation_name,
           count(*) >= 1 AS success, CAST(NULL AS BIGINT) AS unexpected_count, CAST(NULL AS DOUBLE) AS unexpected_percent,
           CAST(NULL AS BIGINT) AS missing_count, CAST(NULL AS DOUBLE) AS missing_percent,
           CAST(NULL AS BIGINT) AS element_count, '{_details(rule)}' AS details FROM {table}"""


def union_sql(parts: list[str]) -> str:
    return " UNION ALL ".join(f"({p.strip()})" for p in parts)


UNIQUE_SQL = [unique_sql(t, c) for t, c in Q.UNIQUE_KEYS.items()]
NOT_NULL_SQL = [not_null_sql(t, c) for t, cs in Q.REQUIRED.items() for c in cs]
ROW_COUNT_SQL = [row_count_sql(t) for t in Q.REQUIRED]


def integrity_sql(fact: str, key: str, dim: str) -> str:
    return f"""
    SELECT '{fact}.{key} -> {dim}.{key}' AS check_name, '{key}' AS fact_key, '{key}' AS dimension_key,
           count(*) FILTER (WHERE k IS NULL) AS invalid_count, count(*) AS total_rows,
           count(*) FILTER (WHERE k IS NULL) = 0 AS success
    FROM {fact} f LEFT JOIN (SELECT DISTINCT {key} AS k FROM {dim}) d ON f.{key} = d.k"""


def pair_sql(raw: str, processed: str) -> str:
    return f"""
    SELECT '{raw}' AS raw_table, '{processed}' AS processed_table, a AS raw_row_count, b AS processed_row_count,
           b - a AS row_count_difference, a = b AS exact_match
    FROM (SELECT (SELECT count(*) FROM {raw}) AS a, (SELECT count(*) FROM {processed}) AS b)"""


@query("dq_unique", uses="dim_date dim_user dim_report dim_page reports", doubles=RESULT_DOUBLES,
       sql=union_sql([*UNIQUE_SQL, unique_sql("reports", "report_id")]))
def dq_unique(data: Data) -> DataFrame:
    """Dimension keys, and the raw reports, where every id comes many times."""
    return Q.union([Q.run_model_expectations(data.model(), ("unique",)),
                    Q.run_expectations(data.reports(), "reports", [Q.Expectation("unique", "report_id")])])


def _weekday_model(data: Data) -> dict[str, DataFrame]:
    """A model whose facts were keyed by a calendar without weekends."""
    model = data.stored_model()
    return model | {"fact_report_views": star_schema.build_fact_report_views(
        data.report_views(), model["dim_date"].where(~F.col("is_weekend")))}


WEEKDAY_VIEWS = ("(SELECT d.date_key, report_id, user_key, view_count FROM report_views v LEFT JOIN "
                 "(SELECT * FROM dim_date WHERE NOT is_weekend) d ON v.date = d.date)")


@query("dq_not_null", uses=MODEL + " report_views", doubles=RESULT_DOUBLES, sql=union_sql(
    [not_null_sql(t, c, WEEKDAY_VIEWS if t == "fact_report_views" else None) for t, cs in Q.REQUIRED.items() for c in cs]))
def dq_not_null(data: Data) -> DataFrame:
    """19 columns; views on weekends lack their date key."""
    return Q.run_model_expectations(_weekday_model(data), ("not_null",))


@query("dq_row_count", uses=MODEL, doubles=RESULT_DOUBLES, sql=union_sql(ROW_COUNT_SQL))
def dq_row_count(data: Data) -> DataFrame:
    return Q.run_model_expectations(data.model(), ("row_count",))


@query("dq_result_row", uses="report_pages", doubles=RESULT_DOUBLES, sql=union_sql(
    [unique_sql("report_pages", "section_id"), not_null_sql("report_pages", "section_name"), row_count_sql("report_pages")]))
def dq_result_row(data: Data) -> DataFrame:
    """One flat row per rule and kind of rule."""
    return Q.run_expectations(data.report_pages(), "report_pages", [
        Q.Expectation("unique", "section_id"), Q.Expectation("not_null", "section_name"),
        Q.Expectation("row_count", min_value=1)])


@query("dq_run_expectations", uses=MODEL, doubles=RESULT_DOUBLES, sql=union_sql(UNIQUE_SQL + NOT_NULL_SQL + ROW_COUNT_SQL))
def dq_run_expectations(data: Data) -> DataFrame:
    return Q.run_model_expectations(data.model())


@query("union_check_results", uses=MODEL, doubles=RESULT_DOUBLES, sql=union_sql(
    [unique_sql("dim_page", "page_key"), row_count_sql("fact_page_views")]))
def union_check_results(data: Data) -> DataFrame:
    model = data.model()
    return Q.union([Q.run_expectations(model["dim_page"], "dim_page", [Q.Expectation("unique", "page_key")]),
                    Q.run_expectations(model["fact_page_views"], "fact_page_views",
                                       [Q.Expectation("row_count", min_value=1)])])


@query("dq_referential_integrity", uses=MODEL, sql=union_sql([integrity_sql(*r) for r in Q.REFERENCES]))
def dq_referential_integrity(data: Data) -> DataFrame:
    return Q.run_referential_integrity_checks(data.model())


@query("dq_row_reconciliation", uses=MODEL + " " + RAW, sql=union_sql([pair_sql(*p) for p in Q.PAIRS]))
def dq_row_reconciliation(data: Data) -> DataFrame:
    return Q.run_row_count_reconciliation(data.raw(), data.stored_model())


def summary_sql() -> str:
    checks = union_sql([f"SELECT check_group, success FROM ({p})" for p in UNIQUE_SQL + NOT_NULL_SQL + ROW_COUNT_SQL]
                       + [f"SELECT 'referential_integrity', success FROM ({integrity_sql(*r)})" for r in Q.REFERENCES]
                       + [f"SELECT 'row_count_reconciliation', exact_match FROM ({pair_sql(*p)})" for p in Q.PAIRS])
    return f"""
    SELECT check_group, count(success) AS checks_run, count(*) FILTER (WHERE success) AS checks_passed,
           count(success) - count(*) FILTER (WHERE success) AS checks_failed FROM ({checks}) GROUP BY check_group"""


@query("dq_summary", uses=MODEL + " " + RAW, sql=summary_sql())
def dq_summary(data: Data) -> DataFrame:
    return validation.validate_semantic_model(data.stored_model(), data.raw())["validation_summary"]


@query("agg_check_summary", uses=MODEL, sql=f"""
    SELECT check_group, count(success) AS checks_run, count(*) FILTER (WHERE success) AS checks_passed,
           count(*) FILTER (WHERE NOT success) AS checks_failed
    FROM ({union_sql([f"SELECT 'referential_integrity' AS check_group, success FROM ({integrity_sql(*r)})" for r in Q.REFERENCES])})
    GROUP BY check_group""")
def agg_check_summary(data: Data) -> DataFrame:
    integrity = Q.run_referential_integrity_checks(data.model())
    return Q.tally(integrity, "success", F.lit("referential_integrity"))


@query("validate_semantic_model", uses=MODEL + " " + RAW, sql=f"""
    SELECT 'expectation' AS kind, table_name || '/' || expectation_name || '/' || details AS name, success,
           unexpected_count AS faults FROM ({union_sql(UNIQUE_SQL + NOT_NULL_SQL + ROW_COUNT_SQL)})
    UNION ALL SELECT 'integrity', check_name, success, invalid_count FROM ({union_sql([integrity_sql(*r) for r in Q.REFERENCES])})
    UNION ALL SELECT 'reconciliation', raw_table || '/' || processed_table, exact_match, row_count_difference
    FROM ({union_sql([pair_sql(*p) for p in Q.PAIRS])})
    UNION ALL SELECT 'summary', check_group, checks_failed = 0, checks_failed FROM ({summary_sql()})""")
def validate_semantic_model(data: Data) -> DataFrame:
    """The four result tables in one: what was checked, whether it held, how many faults."""
    r = validation.validate_semantic_model(data.stored_model(), data.raw())
    return Q.union([
        r["gx_validation_results"].select(
            F.lit("expectation").alias("kind"), F.concat_ws("/", "table_name", "expectation_name", "details").alias("name"),
            "success", F.col("unexpected_count").alias("faults")),
        r["referential_integrity_checks"].select(
            F.lit("integrity").alias("kind"), F.col("check_name").alias("name"), "success",
            F.col("invalid_count").alias("faults")),
        r["row_count_reconciliation"].select(
            F.lit("reconciliation").alias("kind"), F.concat_ws("/", "raw_table", "processed_table").alias("name"),
            F.col("exact_match").alias("success"), F.col("row_count_difference").alias("faults")),
        r["validation_summary"].select(
            F.lit("summary").alias("kind"), F.col("check_group").alias("name"),
            (F.col("checks_failed") == 0).alias("success"), F.col("checks_failed").alias("faults"))])


def light_sql() -> str:
    parts = [f"""SELECT 'uniqueness' AS check_group, '{t}.{c}' AS check_name, count(*) = count(DISTINCT {c}) AS success,
             count(*) - count(DISTINCT {c}) AS value FROM {t}""" for t, c in Q.UNIQUE_KEYS.items()]
    parts += [f"""SELECT 'referential_integrity', '{f}.{k} in {d}', success, invalid_count FROM ({integrity_sql(f, k, d)})"""
              for f, k, d in Q.REFERENCES if k != "date_key"]
    parts += [f"""SELECT 'nulls', '{t}.{c}', count(*) = count({c}), count(*) - count({c}) FROM {t}"""
              for t, cs in Q.REQUIRED.items() if t.startswith("fact") for c in cs if c.endswith(("_key", "_id"))]
    return union_sql(parts)


@query("dq_model_light", uses=MODEL, sql=light_sql())
def dq_model_light(data: Data) -> DataFrame:
    return Q.run_lightweight_checks(data.stored_model())


@query("dq_raw_keys", uses=RAW, sql=union_sql([f"""
    SELECT '{t}.{k} in {m}' AS check_name, count(*) FILTER (WHERE known IS NULL) = 0 AS success,
           count(*) FILTER (WHERE known IS NULL) AS invalid_count
    FROM {t} LEFT JOIN (SELECT DISTINCT {k} AS known FROM {m}) ON {k} = known""" for t, k, m in Q.RAW_REFERENCES]))
def dq_raw_keys(data: Data) -> DataFrame:
    return Q.run_raw_key_checks(data.raw())


def _null_sql(column: str) -> str:
    return f"""SELECT 'nulls_{column}', CAST(count(*) FILTER (WHERE "{column}" IS NULL) AS VARCHAR),
               CASE WHEN count(*) = count("{column}") THEN 'ok' ELSE 'warn' END FROM usage_c"""


@query("dq_profile", uses="usage_c", sql=f"""
    SELECT 'row_count' AS "check", CAST(count(*) AS VARCHAR) AS value, CASE WHEN count(*) > 0 THEN 'ok' ELSE 'fail' END AS status
    FROM usage_c
    UNION ALL {" UNION ALL ".join(_null_sql(c) for c in ("Date", "Report Guid", "Report Name", "User Id", "Occurrences"))}
    UNION ALL SELECT 'exact_duplicate_rows', CAST(n AS VARCHAR), CASE WHEN n = 0 THEN 'ok' ELSE 'warn' END
    FROM (SELECT CAST(sum(c - 1) AS BIGINT) AS n FROM (SELECT count(*) AS c FROM usage_c
          GROUP BY "Date", "Report Guid", "Report Name", "User Id", "Occurrences"))
    UNION ALL SELECT 'min_date', CAST(min("Date") AS VARCHAR), 'ok' FROM usage_c
    UNION ALL SELECT 'max_date', CAST(max("Date") AS VARCHAR), 'ok' FROM usage_c
    UNION ALL SELECT 'negative_occurrences', CAST(count(*) FILTER (WHERE "Occurrences" < 0) AS VARCHAR),
                     CASE WHEN count(*) FILTER (WHERE "Occurrences" < 0) = 0 THEN 'ok' ELSE 'fail' END FROM usage_c""")
def dq_profile(data: Data) -> DataFrame:
    return Q.run_data_quality_checks(data.usage_c())


GRAIN = "count(*) = count(DISTINCT (date, report_id))"


@query("dq_adoption_mart", uses="mart_b launches_b", sql=f"""
    SELECT 'one_row_per_date_report' AS "check", {GRAIN} AS passed FROM mart_b
    UNION ALL SELECT 'no_prelaunch_rows', count(*) FILTER (WHERE m.date < start_date) = 0
    FROM mart_b m JOIN launches_b l ON m.report_id = l.report_id
    UNION ALL SELECT 'all_reports_end_at_global_max', bool_and(last = (SELECT max(date) FROM daily_b))
    FROM (SELECT max(date) AS last FROM mart_b GROUP BY report_id)
    UNION ALL SELECT 'zero_viewers_zero_ratio', count(*) FILTER (WHERE unique_viewers = 0 AND views_per_user <> 0) = 0 FROM mart_b""")
def dq_adoption_mart(data: Data) -> DataFrame:
    return Q.check_adoption_mart(data.mart_b(), data.daily_b())


@query("dq_ts_mart", uses="ts_b", sql=f"""
    SELECT 'row_count_unchanged' AS "check", count(*) = (SELECT count(*) FROM mart_b) AS passed FROM ts_b
    UNION ALL SELECT 'one_row_per_date_report', {GRAIN} FROM ts_b
    UNION ALL SELECT 'rolling_columns_populated',
        count(*) FILTER (WHERE views_7d IS NULL OR views_28d IS NULL OR viewers_7d IS NULL OR viewers_28d IS NULL) = 0 FROM ts_b
    UNION ALL SELECT 'no_infinite_change', count(*) FILTER (WHERE isinf(wow_change_views)) = 0 FROM ts_b""")
def dq_ts_mart(data: Data) -> DataFrame:
    return Q.check_time_series_mart(data.ts_b(), data.mart_b())


@query("dq_engagement_mart", uses="engagement_b", sql=f"""
    SELECT 'one_row_per_date_report' AS "check", {GRAIN} AS passed FROM engagement_b
    UNION ALL SELECT 'keys_not_null', count(*) FILTER (WHERE date IS NULL OR report_id IS NULL) = 0 FROM engagement_b
    UNION ALL SELECT 'repeat_user_rate_in_range', bool_and(repeat_user_rate BETWEEN 0 AND 1) FROM engagement_b
    UNION ALL SELECT 'top_share_in_range', bool_and(top_10pct_user_share BETWEEN 0 AND 1) FROM engagement_b
    UNION ALL SELECT 'idle_days_not_negative', bool_and(days_since_last_use >= 0) FROM engagement_b
    UNION ALL SELECT 'page_depth_not_negative', bool_and(avg_pages_per_user >= 0) FROM engagement_b""")
def dq_engagement_mart(data: Data) -> DataFrame:
    return Q.check_engagement_mart(data.engagement_b())


@query("dq_performance_mart", uses="performance_b", sql=f"""
    SELECT 'one_row_per_date_report' AS "check", {GRAIN} AS passed FROM performance_b
    UNION ALL SELECT 'keys_not_null', count(*) FILTER (WHERE date IS NULL OR report_id IS NULL) = 0 FROM performance_b
    UNION ALL SELECT 'avg_not_negative', bool_and(avg_load_time >= 0) FROM performance_b
    UNION ALL SELECT 'p90_not_negative', bool_and(p90_load_time >= 0) FROM performance_b
    UNION ALL SELECT 'rolling_avg_not_negative', bool_and(avg_load_time_7d >= 0) FROM performance_b
    UNION ALL SELECT 'no_infinite_change', count(*) FILTER (WHERE isinf(load_time_wow_change)) = 0 FROM performance_b
    UNION ALL SELECT 'p90_at_least_avg', count(*) FILTER (WHERE load_events > 1 AND p90_load_time < avg_load_time) = 0 FROM performance_b""")
def dq_performance_mart(data: Data) -> DataFrame:
    return Q.check_performance_mart(data.performance_b())
