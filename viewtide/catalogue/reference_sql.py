"""Shared SQL tables (CTEs) of the comparison queries: name -> (tables it reads, text)."""

from __future__ import annotations

TABLES: dict[str, tuple[str, str]] = {
    # usage_a ------------------------------------------------------------------------------------
    "views_a": ("", """
        SELECT CAST(ts AS DATE) AS date, event_type AS report_id, user_id AS user_key FROM events"""),
    "pages_a": ("", """
        SELECT CAST(ts AS DATE) AS date, event_type AS report_id, user_id AS user_key,
               event_type || '_P' || (CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) % 8 + 1) AS section_id
        FROM events"""),
    "loads_a": ("", "SELECT CAST(ts AS DATE) AS date, event_type AS report_id, value AS load_time FROM events"),
    # usage_b ------------------------------------------------------------------------------------
    "lines_b": ("", "SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey"),
    "report_views": ("lines_b", """
        SELECT CAST(l_shipdate AS DATE) AS date, p_brand AS report_id, l_suppkey AS user_key,
               CAST(l_suppkey AS VARCHAR) AS user_id, l_linestatus AS consumption_method,
               l_returnflag AS distribution_method, CAST(NULL AS VARCHAR) AS user_agent,
               CAST(CASE WHEN l_linestatus = 'O' AND l_returnflag <> 'R' THEN 0 ELSE l_quantity END AS BIGINT) AS view_count
        FROM lines_b"""),
    "report_page_views": ("lines_b", """
        SELECT l_shipdate AS timestamp, CAST(l_shipdate AS DATE) AS date, p_brand AS report_id,
               p_brand || '_' || p_type AS section_id, l_suppkey AS user_key, l_linestatus AS client,
               l_returnflag AS session_source, CAST(l_linenumber AS BIGINT) AS page_view_count FROM lines_b"""),
    "report_load_times": ("lines_b", """
        SELECT l_shipdate AS timestamp, CAST(l_shipdate AS DATE) AS date, p_brand AS report_id, l_suppkey AS user_key,
               CAST(l_suppkey AS VARCHAR) AS user_id, l_returnflag AS browser, l_linestatus AS client,
               p_type AS country, l_extendedprice AS load_time_ms FROM lines_b"""),
    "reports": ("", """
        SELECT p_brand AS report_id, 'Report ' || p_name AS report_name, 'WS_' || substr(p_brand, 7, 1) AS workspace_id,
               CASE WHEN p_brand LIKE '%3' THEN 'Paginated' WHEN p_brand LIKE '%5' THEN 'Dashboard' ELSE 'Report' END
                 AS report_type, p_brand LIKE '%7' AS is_usage_metrics_report FROM part"""),
    "report_pages": ("", """
        SELECT p_brand AS report_id, p_brand || '_' || p_type AS section_id, 'Page ' || p_name AS section_name FROM part"""),
    "users": ("", "SELECT s_suppkey AS user_key, s_name AS user_id, 'User ' || s_name AS unique_user FROM supplier"),
    "dates": ("", """
        SELECT date, dayname(date) AS day_of_week, CAST(date_trunc('week', date) AS DATE) AS week_start_date,
               strftime(date, '%Y-%m') AS month, isodow(date) >= 6 AS is_weekend
        FROM (SELECT CAST(unnest(generate_series(first, last, INTERVAL 1 DAY)) AS DATE) AS date
              FROM (SELECT CAST(min(l_shipdate) AS DATE) AS first, CAST(max(l_shipdate) AS DATE) AS last FROM lineitem))"""),
    # star schema --------------------------------------------------------------------------------
    "dim_date": ("dates", """
        SELECT DISTINCT CAST(strftime(date, '%Y%m%d') AS INTEGER) AS date_key, date, day_of_week, week_start_date, month,
               is_weekend FROM dates"""),
    "dim_user": ("users", """
        SELECT user_key, user_id, unique_user FROM (SELECT *, row_number() OVER (
            PARTITION BY user_key ORDER BY user_id, unique_user) AS rn FROM users) WHERE rn = 1"""),
    "dim_report": ("reports", """
        SELECT report_id, report_name, workspace_id, report_type, is_usage_metrics_report
        FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY report_name, workspace_id, report_type,
                                           is_usage_metrics_report) AS rn FROM reports) WHERE rn = 1"""),
    "dim_page": ("report_pages", """
        SELECT row_number() OVER (ORDER BY report_id, section_id) AS page_key, report_id, section_id, section_name
        FROM (SELECT *, row_number() OVER (PARTITION BY report_id, section_id ORDER BY section_name) AS rn
              FROM report_pages) WHERE rn = 1"""),
    "fact_report_views": ("report_views dim_date", """
        SELECT date_key, report_id, user_key, consumption_method, distribution_method, view_count
        FROM report_views v LEFT JOIN dim_date d ON v.date = d.date"""),
    "fact_page_views": ("report_page_views dim_date dim_page", """
        SELECT date_key, v.report_id, page_key, user_key, client, session_source, page_view_count
        FROM report_page_views v LEFT JOIN dim_date d ON v.date = d.date LEFT JOIN dim_page p ON v.section_id = p.section_id"""),
    "fact_report_loads": ("report_load_times dim_date", """
        SELECT date_key, report_id, user_key, browser, client, country, load_time_ms
        FROM report_load_times v LEFT JOIN dim_date d ON v.date = d.date"""),
    # adoption -----------------------------------------------------------------------------------
    "daily_a": ("views_a", """
        SELECT date, report_id, count(*) AS daily_views, count(DISTINCT user_key) AS unique_viewers,
               count(*) / CAST(count(DISTINCT user_key) AS DOUBLE) AS views_per_user
        FROM views_a GROUP BY date, report_id"""),
    "daily_b": ("report_views", """
        SELECT date, report_id, CAST(sum(view_count) AS BIGINT) AS daily_views, count(DISTINCT user_key) AS unique_viewers,
               sum(view_count) / CAST(count(DISTINCT user_key) AS DOUBLE) AS views_per_user
        FROM report_views GROUP BY date, report_id"""),
    "launches_b": ("daily_b", "SELECT report_id, min(date) AS start_date FROM daily_b GROUP BY report_id"),
    "spine_b": ("daily_b launches_b", """
        SELECT report_id, CAST(unnest(generate_series(start_date, (SELECT max(date) FROM daily_b), INTERVAL 1 DAY)) AS DATE)
               AS date FROM launches_b"""),
    "mart_b": ("spine_b daily_b", """
        SELECT s.date, s.report_id, coalesce(daily_views, 0) AS daily_views, coalesce(unique_viewers, 0) AS unique_viewers,
               coalesce(daily_views / CAST(nullif(unique_viewers, 0) AS DOUBLE), 0.0) AS views_per_user
        FROM spine_b s LEFT JOIN daily_b d ON s.date = d.date AND s.report_id = d.report_id"""),
    "ts_b": ("mart_b", """
        SELECT *, CAST(sum(daily_views) OVER (w ROWS 6 PRECEDING) AS DOUBLE) AS views_7d,
               CAST(sum(daily_views) OVER (w ROWS 27 PRECEDING) AS DOUBLE) AS views_28d,
               CAST(sum(unique_viewers) OVER (w ROWS 6 PRECEDING) AS DOUBLE) AS viewers_7d,
               CAST(sum(unique_viewers) OVER (w ROWS 27 PRECEDING) AS DOUBLE) AS viewers_28d,
               CAST(daily_views - lag(daily_views, 7) OVER w AS DOUBLE) / nullif(lag(daily_views, 7) OVER w, 0)
                 AS wow_change_views
        FROM mart_b WINDOW w AS (PARTITION BY report_id ORDER BY date)"""),
    # engagement ---------------------------------------------------------------------------------
    "user_days_a": ("views_a", """
        SELECT date, report_id, user_key AS user_id, count(*) AS user_views FROM views_a GROUP BY ALL"""),
    "user_days_b": ("report_views", """
        SELECT date, report_id, user_key AS user_id, CAST(sum(view_count) AS BIGINT) AS user_views
        FROM report_views GROUP BY date, report_id, user_key"""),
    "user_pages_a": ("pages_a", """
        SELECT date, report_id, user_key AS user_id, count(*) AS page_views FROM pages_a GROUP BY ALL"""),
    "user_pages_b": ("report_page_views", """
        SELECT date, report_id, user_key AS user_id, CAST(sum(page_view_count) AS BIGINT) AS page_views
        FROM report_page_views GROUP BY date, report_id, user_key"""),
}


def _engagement(suffix: str) -> None:
    """Engagement tables, the same text over usage_a and usage_b."""
    TABLES[f"first_view_{suffix}"] = (f"user_days_{suffix}", f"""
        SELECT report_id, user_id, min(date) AS first_view_date FROM user_days_{suffix} GROUP BY report_id, user_id""")
    TABLES[f"marked_{suffix}"] = (f"user_days_{suffix} first_view_{suffix}", f"""
        SELECT u.*, first_view_date, u.date > first_view_date AS is_repeat_user,
               row_number() OVER (PARTITION BY u.date, u.report_id ORDER BY user_views DESC) AS place,
               count(*) OVER (PARTITION BY u.date, u.report_id) AS users
        FROM user_days_{suffix} u JOIN first_view_{suffix} f ON u.report_id = f.report_id AND u.user_id = f.user_id""")
    TABLES[f"behaviour_{suffix}"] = (f"marked_{suffix}", f"""
        SELECT date, report_id, count(*) AS unique_viewers, count(*) FILTER (WHERE is_repeat_user) AS repeat_users,
               CAST(sum(user_views) AS BIGINT) AS total_views,
               count(*) FILTER (WHERE is_repeat_user) / CAST(count(*) AS DOUBLE) AS repeat_user_rate,
               coalesce(sum(user_views) FILTER (WHERE place <= greatest(1, ceil(users * 0.1::DOUBLE)))
                        / CAST(nullif(sum(user_views), 0) AS DOUBLE), 0.0) AS top_10pct_user_share
        FROM marked_{suffix} GROUP BY date, report_id""")
    TABLES[f"active_{suffix}"] = (f"behaviour_{suffix}", f"""
        SELECT date, report_id, lag(date) OVER (PARTITION BY report_id ORDER BY date) AS previous_active_date
        FROM behaviour_{suffix} WHERE total_views > 0""")
    TABLES[f"depth_{suffix}"] = (f"user_pages_{suffix}", f"""
        SELECT date, report_id, avg(page_views) AS avg_pages_per_user FROM user_pages_{suffix} GROUP BY date, report_id""")
    TABLES[f"engagement_{suffix}"] = (f"behaviour_{suffix} active_{suffix} depth_{suffix}", f"""
        SELECT b.date, b.report_id, repeat_user_rate, top_10pct_user_share,
               CAST(coalesce(b.date - previous_active_date, 0) AS BIGINT) AS days_since_last_use,
               coalesce(avg_pages_per_user, 0.0) AS avg_pages_per_user
        FROM behaviour_{suffix} b
        LEFT JOIN active_{suffix} a ON b.date = a.date AND b.report_id = a.report_id
        LEFT JOIN depth_{suffix} d ON b.date = d.date AND b.report_id = d.report_id""")


def _performance(suffix: str, source: str, measure: str) -> None:
    TABLES[f"loads_daily_{suffix}"] = (source, f"""
        SELECT date, report_id, avg({measure}) AS avg_load_time, quantile_cont({measure}, 0.9) AS p90_load_time,
               count(*) AS load_events FROM {source} GROUP BY date, report_id""")
    TABLES[f"performance_{suffix}"] = (f"loads_daily_{suffix}", f"""
        SELECT date, report_id, avg_load_time, p90_load_time,
               avg(avg_load_time) OVER (w ROWS 6 PRECEDING) AS avg_load_time_7d,
               (avg_load_time - lag(avg_load_time, 7) OVER w) / nullif(lag(avg_load_time, 7) OVER w, 0)
                 AS load_time_wow_change, load_events
        FROM loads_daily_{suffix} WINDOW w AS (PARTITION BY report_id ORDER BY date)""")


_engagement("a")
_engagement("b")
_performance("a", "loads_a", "load_time")
_performance("b", "report_load_times", "load_time_ms")

TABLES |= {
    # forecasting --------------------------------------------------------------------------------
    "usage_c": ("lines_b", """
        SELECT CAST(l_shipdate AS DATE) AS "Date", guid AS "Report Guid", l_suppkey AS "User Id",
               CAST(l_quantity AS BIGINT) AS "Occurrences", 'Report ' || guid AS "Report Name"
        FROM (SELECT *, unnest(['F_' || l_returnflag, p_brand, 'S_' || l_suppkey]) AS guid FROM lines_b)"""),
    "totals_c": ("usage_c", """
        SELECT "Report Guid" AS report_id, min("Report Name") AS report_name, "Date" AS date,
               CAST(sum("Occurrences") AS DOUBLE) AS views FROM usage_c GROUP BY "Report Guid", "Date" """),
    "series_c": ("totals_c", """
        SELECT s.report_id, s.report_name, s.date, coalesce(t.views, 0.0) AS views
        FROM (SELECT report_id, min(report_name) AS report_name,
                     CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
              FROM totals_c GROUP BY report_id) s
        LEFT JOIN totals_c t ON s.report_id = t.report_id AND s.date = t.date"""),
    "sufficiency_c": ("series_c", """
        SELECT *, total_days >= 90 AND nonzero_days >= 35 AND nonzero_ratio >= 0.25 AND total_views >= 120
                 AS passes_data_criteria
        FROM (SELECT report_id, count(*) AS total_days, count(*) FILTER (WHERE views > 0) AS nonzero_days,
                     count(*) FILTER (WHERE views > 0) / CAST(count(*) AS DOUBLE) AS nonzero_ratio,
                     CAST(sum(views) AS BIGINT) AS total_views FROM series_c GROUP BY report_id)"""),
    "numbered_c": ("series_c", """
        SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY date) AS pos,
               count(*) OVER (PARTITION BY report_id) AS n_obs,
               CAST(floor(count(*) OVER (PARTITION BY report_id) * 0.8::DOUBLE) AS BIGINT) AS n_train FROM series_c"""),
    "split_c": ("numbered_c", """
        SELECT *, n_obs - n_train AS n_test, CASE WHEN pos > n_train THEN pos - n_train END AS step,
               CASE WHEN n_train < 30 OR n_obs - n_train < 7 THEN 'Series too short for robust backtest split' END AS error
        FROM numbered_c"""),
    "tested_c": ("split_c", """
        SELECT * EXCLUDE (l0, l1, l2, l3, l4, l5, l6), l6 AS naive,
               CASE (step - 1) % 7 WHEN 0 THEN l0 WHEN 1 THEN l1 WHEN 2 THEN l2 WHEN 3 THEN l3 WHEN 4 THEN l4 WHEN 5 THEN l5 ELSE l6 END
                 AS seasonal_naive
        FROM (SELECT *, """ + ", ".join(f"max(views) FILTER (WHERE pos = n_train - {6 - k}) OVER (PARTITION BY report_id) AS l{k}"
                                        for k in range(7)) + """
              FROM split_c)
        WHERE step IS NOT NULL AND error IS NULL"""),
    "actuals_c": ("usage_c", """
        SELECT "Report Guid" AS report_id, "Report Name" AS report_name, "Date" AS date,
               CAST(sum("Occurrences") AS DOUBLE) AS actual_views FROM usage_c GROUP BY ALL"""),
    "history_c": ("tested_c", """
        SELECT 'run_001' AS run_id, TIMESTAMP '2001-10-01 06:30:00' AS run_timestamp, report_id, report_name,
               date AS target_date, CAST(date - DATE '2001-10-01' AS INTEGER) AS horizon_days,
               seasonal_naive AS forecast_views, 0.0::DOUBLE AS lower_ci, seasonal_naive * 2 AS upper_ci,
               'seasonal naive' AS model_name FROM tested_c WHERE date > DATE '2001-10-01'"""),
    "matched_c": ("history_c actuals_c", """
        SELECT h.*, actual_views, actual_views - forecast_views AS error, abs(actual_views - forecast_views) AS abs_error,
               abs(actual_views - forecast_views) / nullif(actual_views, 0) * 100 AS pct_error,
               TIMESTAMP '2002-01-01' AS realized_at
        FROM history_c h JOIN actuals_c a ON h.report_id = a.report_id AND h.target_date = a.date"""),
}

# the model search with a single order (one lag and a constant), solved in closed form ---------------------
_STEP = "{c1} * {x}[1] + {c2} * {x}[2] + sd * {x}[7] - sd * {c1} * {x}[8] - sd * {c2} * {x}[9]"


def _next(x: str) -> str:
    return _STEP.format(c1="(b1 + d)", c2="(-d * b1)", x=x)


def _path(name: str, choice: str, last: str, steps: str) -> str:
    """Recursion over the days after ``last``: the latest nine values and the response to one shock as lists."""
    return f"""
        SELECT report_id, 0 AS step, centre, d, sd, b0{name} AS b0, b1{name} AS b1, sigma{name} AS sigma, {steps} AS steps,
               0.0::DOUBLE AS forecast, 0.0::DOUBLE AS variance, {last} AS past, [1.0::DOUBLE, 0, 0, 0, 0, 0, 0, 0, 0] AS echo
        FROM {choice}
        UNION ALL
        SELECT report_id, step + 1, centre, d, sd, b0, b1, sigma, steps, value, variance + echo[1] * echo[1],
               list_prepend(value, past[1:8]), list_prepend({_next("echo")}, echo[1:8])
        FROM (SELECT *, b0 + {_next("past")} AS value FROM path{name}_c WHERE step < steps)"""


def statistic_sql(values: str, keys: str) -> str:
    """Level statistic per ``keys`` of the (keys, pos, value) rows of ``values``."""
    return f"""
        WITH _dev AS MATERIALIZED (
            SELECT *, sum(e) OVER (PARTITION BY {keys} ORDER BY pos) AS s, row_number() OVER (PARTITION BY {keys} ORDER BY pos) AS i,
                   count(*) OVER (PARTITION BY {keys}) AS n
            FROM (SELECT {keys}, pos, value - avg(value) OVER (PARTITION BY {keys}) AS e FROM ({values}) WHERE value IS NOT NULL)),
        _cross AS (
            SELECT {keys}, sum((1 - (a.i - b.i) / (floor(4 * pow(a.n / 100, 0.25)) + 1)) * a.e * b.e) AS weighted
            FROM _dev a JOIN _dev b USING ({keys})
            WHERE a.i - b.i BETWEEN 1 AND floor(4 * pow(a.n / 100, 0.25)) GROUP BY {keys}),
        _whole AS (SELECT {keys}, count(*) AS n, sum(s * s) AS partial, sum(e * e) AS own FROM _dev GROUP BY {keys})
        SELECT {keys}, n, CASE WHEN n >= 3 AND own + 2 * coalesce(weighted, 0) > 1e-9 * own
                               THEN partial / (n * (own + 2 * coalesce(weighted, 0))) END AS statistic
        FROM _whole LEFT JOIN _cross USING ({keys})"""


TABLES |= {
    "level_c": ("centred_c", statistic_sql("""
        SELECT report_id, 0 AS sd, pos, views AS value FROM centred_c WHERE step IS NULL
        UNION ALL SELECT report_id, 1, pos, views - lag(views, 7) OVER (PARTITION BY report_id ORDER BY date)
        FROM centred_c WHERE step IS NULL""", "report_id, sd")),
    "weekday_c": ("centred_c", statistic_sql("""
        SELECT report_id, pos % 7 AS phase, pos, views - mean AS value
        FROM (SELECT *, avg(views) OVER w AS mean, count(*) OVER w AS days FROM centred_c WHERE step IS NULL
              WINDOW w AS (PARTITION BY report_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) WHERE days = 7""",
        "report_id, phase")),
    "centred_c": ("split_c sufficiency_c", """
        SELECT *, views - centre AS y0 FROM (
            SELECT s.*, avg(s.views) FILTER (WHERE s.step IS NULL) OVER (PARTITION BY s.report_id) AS centre
            FROM split_c s JOIN sufficiency_c q ON s.report_id = q.report_id WHERE passes_data_criteria AND error IS NULL)"""),
    "variants_c": ("centred_c", """
        SELECT report_id, d, sd, CASE WHEN d + sd <= 1 THEN 1.0 ELSE 0.0 END AS level,
               CASE WHEN pos <= floor(n_train * 0.8::DOUBLE) THEN 'fit' WHEN pos <= n_train THEN 'hold' ELSE 'test' END AS part,
               pos, y0 - d * y1 - sd * (y7 - d * y8) AS w, y1 - d * y2 - sd * (y8 - d * y9) AS w1
        FROM (SELECT *, lag(y0, 1) OVER w AS y1, lag(y0, 2) OVER w AS y2, lag(y0, 7) OVER w AS y7, lag(y0, 8) OVER w AS y8,
                     lag(y0, 9) OVER w AS y9 FROM centred_c WINDOW w AS (PARTITION BY report_id ORDER BY date)),
             (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS v(d, sd)
        WHERE pos > 15"""),
    "moments_c": ("variants_c", """
        SELECT v.report_id, v.d, v.sd, v.level, scope, CAST(count(*) AS DOUBLE) AS n, sum(v.level * w1) AS sx, sum(v.level * w) AS sy,
               sum(w1 * w1) AS sxx, sum(w1 * w) AS sxy, sum(w * w) AS syy
        FROM variants_c v JOIN (VALUES ('fit', 'early'), ('hold', 'hold'), ('fit', 'train'), ('hold', 'train'), ('fit', 'full'),
                                       ('hold', 'full'), ('test', 'full')) AS s(part, scope) ON v.part = s.part
        GROUP BY ALL"""),
    "fits_c": ("moments_c", """
        SELECT *, CASE WHEN level = 1 THEN (sy - b1 * sx) / n ELSE 0.0 END AS b0 FROM (
            SELECT *, CASE WHEN level = 1 THEN (n * sxy - sx * sy) / (n * sxx - sx * sx) ELSE sxy / sxx END AS b1 FROM moments_c)"""),
    "scores_c": ("fits_c", """
        SELECT t.report_id, t.d, t.sd, rss_hold / n_hold AS hold_mse, n * ln(greatest(rss / n, 1e-12)) + 6 AS aic, b0, b1,
               sqrt(rss / greatest(n - 3, 1)) AS sigma, b0_full, b1_full, sqrt(rss_full / greatest(n_full - 3, 1)) AS sigma_full
        FROM (SELECT *, syy - 2 * b0 * sy - 2 * b1 * sxy + level * b0 * b0 * n + 2 * b0 * b1 * sx + b1 * b1 * sxx AS rss
              FROM fits_c WHERE scope = 'train') t
        JOIN (SELECT report_id, d, sd, b0 AS b0_full, b1 AS b1_full, n AS n_full,
                     syy - 2 * b0 * sy - 2 * b1 * sxy + level * b0 * b0 * n + 2 * b0 * b1 * sx + b1 * b1 * sxx AS rss_full
              FROM fits_c WHERE scope = 'full') f ON t.report_id = f.report_id AND t.d = f.d AND t.sd = f.sd
        JOIN (SELECT h.report_id, h.d, h.sd, h.n AS n_hold, h.syy - 2 * e.b0 * h.sy - 2 * e.b1 * h.sxy
                     + h.level * e.b0 * e.b0 * h.n + 2 * e.b0 * e.b1 * h.sx + e.b1 * e.b1 * h.sxx AS rss_hold
              FROM fits_c h JOIN fits_c e ON h.report_id = e.report_id AND h.d = e.d AND h.sd = e.sd
              WHERE h.scope = 'hold' AND e.scope = 'early') h
          ON t.report_id = h.report_id AND t.d = h.d AND t.sd = h.sd"""),
    "chosen_c": ("scores_c centred_c", """
        SELECT s.*, e.* EXCLUDE (report_id) FROM scores_c s JOIN (
            SELECT report_id, max(n_obs) AS n_obs, max(n_train) AS n_train, max(n_test) AS n_test, max(date) AS last_date,
                   max(centre) AS centre, min(report_name) AS report_name,
                   list(y0 ORDER BY pos DESC) FILTER (WHERE pos <= n_train AND pos > n_train - 9) AS train_tail,
                   list(y0 ORDER BY pos DESC) FILTER (WHERE pos > n_obs - 9) AS full_tail
            FROM centred_c GROUP BY report_id) e ON s.report_id = e.report_id
        QUALIFY row_number() OVER (PARTITION BY s.report_id ORDER BY hold_mse, d + sd, d) = 1"""),
    "path_c": ("chosen_c", _path("", "chosen_c", "train_tail", "n_test")),
    "path_full_c": ("chosen_c", _path("_full", "chosen_c", "full_tail", "30")),
    "backtest_one_c": ("path_c tested_c", """
        SELECT report_id, report_name, date, step, forecast, lower_ci, upper_ci, actual, actual - forecast AS error,
               abs(actual - forecast) AS abs_error, abs(actual - forecast) / nullif(actual, 0) * 100 AS pct_error,
               naive, seasonal_naive
        FROM (SELECT t.report_id, t.report_name, t.date, t.step, t.views AS actual, naive, seasonal_naive,
                     greatest(centre + forecast, 0) AS forecast,
                     greatest(centre + forecast - 1.959963984540054 * sigma * sqrt(variance), 0) AS lower_ci,
                     greatest(centre + forecast + 1.959963984540054 * sigma * sqrt(variance), 0) AS upper_ci
              FROM path_c p JOIN tested_c t ON p.report_id = t.report_id AND p.step = t.step)"""),
    "future_one_c": ("path_full_c chosen_c", """
        SELECT p.report_id, c.report_name, CAST(c.last_date + INTERVAL 1 DAY * p.step AS DATE) AS date,
               greatest(p.centre + forecast, 0) AS forecast,
               greatest(p.centre + forecast - 1.959963984540054 * p.sigma * sqrt(variance), 0) AS lower_ci,
               greatest(p.centre + forecast + 1.959963984540054 * p.sigma * sqrt(variance), 0) AS upper_ci
        FROM path_full_c p JOIN chosen_c c ON p.report_id = c.report_id WHERE p.step > 0"""),
    "accepted_one_c": ("backtest_one_c", """
        SELECT report_id FROM backtest_one_c GROUP BY report_id
        HAVING avg(abs_error) <= 0.6 * avg(actual) AND (avg(abs_error) <= 0.9 * avg(abs(actual - naive))
               OR avg(abs_error) <= 0.9 * avg(abs(actual - seasonal_naive)))"""),
}

# the search over all 32 orders: normal equations by the sweep operator, roots by the step-down recursion ----------------
_AR = ["one", "w1", "w2", "w3", "w7"]
_ARMA = [*_AR, "e1", "e7"]


def _sums(source: str, terms: list[str]) -> str:
    """Sums of products of the terms and w over the training days, as a matrix in one list, and its diagonal."""
    names, n = [*terms, "w"], len(terms) + 1
    each = ", ".join(f"sum({names[i]} * {names[j]}) AS s{i}_{j}" for i in range(n) for j in range(i, n))
    flat = ", ".join(f"s{min(i, j)}_{max(i, j)}" for i in range(n) for j in range(n))
    return f"""
        SELECT report_id, n, [{flat}] AS a, [{", ".join(f"s{i}_{i}" for i in range(n))}] AS own
        FROM (SELECT report_id, count(*) AS n, {each} FROM {source} WHERE pos <= n_train GROUP BY report_id)"""


def _sweep(name: str, start: str, terms: list[str]) -> str:
    """Rows (report_id, model, n, used, own, a): one term after the other is swept out of the matrix, if it is used."""
    n = len(terms) + 1
    pivot, row, column = f"a[k * {n + 1} + 1]", f"(x // {n})", f"(x % {n})"
    return f"""
        SELECT report_id, model, n, used, own, 0 AS k, a FROM ({start})
        UNION ALL
        SELECT report_id, model, n, used, own, k + 1, CASE WHEN used[k + 1] = 0 OR {pivot} <= 1e-10 * own[k + 1] THEN a
            ELSE list_transform(range({n * n}), lambda x: CASE WHEN {row} = k AND {column} = k THEN -1 / {pivot}
                WHEN {row} = k OR {column} = k THEN a[x + 1] / {pivot}
                ELSE a[x + 1] - a[{row} * {n} + k + 1] * a[k * {n} + {column} + 1] / {pivot} END) END
        FROM {name} WHERE k < {n - 1}"""


def _swept(name: str, terms: list[str]) -> str:
    """Coefficients b_<term> and the residual sum of squares once all terms are done."""
    n = len(terms) + 1
    betas = ", ".join(f"CASE WHEN used[{i}] > 0 AND a[{(i - 1) * n + i}] < 0 THEN a[{i * n}] ELSE 0 END AS b_{t}" for i, t in enumerate(terms, 1))
    return f"SELECT report_id, model, n, greatest(a[{n * n}], 0) AS rss, {betas} FROM {name} WHERE k = {n - 1}"


def _by_lags(table: str) -> str:
    """A statistic's text over all backtestable series, with the pairs of each lag joined by place: 8 a day, not all of a series."""
    return (TABLES[table][1].replace("centred_c", "search_c")
            .replace("FROM _dev a JOIN", "FROM (SELECT *, unnest(generate_series(1, CAST(floor(4 * pow(n / 100, 0.25)) AS BIGINT))) AS back FROM _dev) a JOIN")
            .replace("WHERE a.i - b.i BETWEEN 1 AND floor(4 * pow(a.n / 100, 0.25))", "WHERE b.i = a.i - a.back"))


def _variant(k: int) -> str:
    return f"y{k} - d * y{k + 1} - sd * (y{k + 7} - d * y{k + 8})"


def _past(k: int) -> str:
    return f"(past[{k}] - d * past[{k + 1}] - sd * (past[{k + 7}] - d * past[{k + 8}]))"


TABLES |= {
    "search_c": ("split_c", """
        SELECT *, views - centre AS y0 FROM (
            SELECT *, avg(views) FILTER (WHERE step IS NULL) OVER (PARTITION BY report_id) AS centre FROM split_c WHERE error IS NULL)"""),
    "search_level_c": ("search_c", _by_lags("level_c")),
    "search_weekday_c": ("search_c", _by_lags("weekday_c")),
    "search_differencing_c": ("search_level_c search_weekday_c", """
        SELECT report_id, sd, CAST(coalesce(CASE WHEN sd = 1 THEN level_1 ELSE level_0 END > 0.463, false) AS INTEGER) AS d
        FROM (SELECT report_id, CAST(coalesce(s > 0.463, false) AS INTEGER) AS sd, level_0, level_1
              FROM (SELECT report_id, max(statistic) FILTER (WHERE sd = 0) AS level_0, max(statistic) FILTER (WHERE sd = 1) AS level_1
                    FROM search_level_c GROUP BY report_id)
              LEFT JOIN (SELECT report_id, avg(statistic) AS s FROM search_weekday_c GROUP BY report_id) USING (report_id))"""),
    "search_rows_c": ("search_c search_differencing_c", f"""
        SELECT report_id, pos, n_train, CASE WHEN d + sd <= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS one,
               {", ".join(f"{_variant(k)} AS w{k or ''}" for k in (0, 1, 2, 3, 7))}
        FROM (SELECT *, {", ".join(f"lag(y0, {k}) OVER w AS y{k}" for k in range(1, 16))}
              FROM search_c WINDOW w AS (PARTITION BY report_id ORDER BY date)) JOIN search_differencing_c USING (report_id)
        WHERE pos > 15"""),
    "search_long_sums_c": ("search_rows_c", _sums("search_rows_c", _AR)),
    "search_long_sweep_c": ("search_long_sums_c", _sweep(
        "search_long_sweep_c", "SELECT *, 0 AS model, [1, 1, 1, 1, 1] AS used FROM search_long_sums_c", _AR)),
    "search_shocks_c": ("search_rows_c search_long_sweep_c", f"""
        SELECT *, coalesce(lag(e, 1) OVER w, 0) AS e1, coalesce(lag(e, 7) OVER w, 0) AS e7
        FROM (SELECT r.*, w - ({" + ".join(f"b_{t} * {t}" for t in _AR)}) AS e
              FROM search_rows_c r JOIN ({_swept("search_long_sweep_c", _AR)}) b ON r.report_id = b.report_id)
        WINDOW w AS (PARTITION BY report_id ORDER BY pos)"""),
    "search_sums_c": ("search_shocks_c", _sums("search_shocks_c", _ARMA)),
    "search_sweep_c": ("search_sums_c", _sweep("search_sweep_c", """
        SELECT *, p * 8 + q * 4 + sp * 2 + sq AS model, [1, CAST(p >= 1 AS INTEGER), CAST(p >= 2 AS INTEGER), CAST(p >= 3 AS INTEGER), sp, q, sq] AS used
        FROM search_sums_c, (VALUES (0), (1), (2), (3)) AS p(p), (VALUES (0), (1)) AS q(q), (VALUES (0), (1)) AS sp(sp),
             (VALUES (0), (1)) AS sq(sq)""", _ARMA)),
    "search_fits_c": ("search_sweep_c", f"""
        SELECT *, n * ln(greatest(rss / n, 1e-12)) + 2 * (2 + p + q + sp + sq) AS aic
        FROM (SELECT *, model // 8 AS p, model // 4 % 2 AS q, model // 2 % 2 AS sp, model % 2 AS sq FROM ({_swept("search_sweep_c", _ARMA)}))"""),
    "search_roots_c": ("search_fits_c", """
        SELECT report_id, model, unnest(['ar', 'ma']) AS side, 7 AS k,
               unnest([[-b_w1, -b_w2, -b_w3, 0, 0, 0, -b_w7], [b_e1, 0, 0, 0, 0, 0, b_e7]]) AS a FROM search_fits_c
        UNION ALL
        SELECT report_id, model, side, k - 1, list_transform(range(k - 1), lambda x: (a[x + 1] - a[k] * a[k - 1 - x]) / (1 - a[k] * a[k]))
        FROM search_roots_c WHERE k > 0 AND abs(a[k]) < 1"""),
    "search_best_c": ("search_fits_c search_roots_c search_differencing_c", """
        SELECT f.*, d, sd FROM search_fits_c f JOIN search_differencing_c USING (report_id)
        LEFT JOIN (SELECT report_id, model, count(*) = 2 AS admissible FROM search_roots_c WHERE k = 0 GROUP BY report_id, model)
            USING (report_id, model)
        QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY coalesce(admissible, false) DESC, aic, p + q + sp + sq, p, q, sp) = 1"""),
    "search_path_c": ("search_best_c search_c search_shocks_c", f"""
        SELECT b.*, 0 AS step, n_test, centre, 0.0::DOUBLE AS forecast, past, known
        FROM search_best_c b
        JOIN (SELECT report_id, max(n_test) AS n_test, max(centre) AS centre, list(y0 ORDER BY pos DESC) AS past
              FROM search_c WHERE pos <= n_train AND pos > n_train - 15 GROUP BY report_id) USING (report_id)
        JOIN (SELECT report_id, list(e ORDER BY pos DESC) AS known
              FROM search_shocks_c WHERE pos <= n_train AND pos > n_train - 7 GROUP BY report_id) USING (report_id)
        UNION ALL
        SELECT * EXCLUDE (value) REPLACE (step + 1 AS step, value AS forecast, list_prepend(value, past[1:14]) AS past)
        FROM (SELECT *, b_one + {" + ".join(f"b_w{k} * {_past(k)}" for k in (1, 2, 3, 7))} + d * past[1] + sd * (past[7] - d * past[8])
                        + CASE WHEN step < 1 THEN b_e1 * known[1] ELSE 0 END + CASE WHEN step < 7 THEN b_e7 * known[7 - step] ELSE 0 END AS value
              FROM search_path_c WHERE step < n_test)"""),
}

#: Tables that refer to themselves.
RECURSIVE = {"path_c", "path_full_c", "search_long_sweep_c", "search_sweep_c", "search_roots_c", "search_path_c"}
#: Tables that are worth computing once, as others read them several times.
MATERIALIZED = {"usage_c", "split_c", "centred_c", "chosen_c", "backtest_one_c", "search_c", "search_differencing_c", "search_rows_c",
                "search_shocks_c", "search_fits_c", "search_best_c"}


def with_tables(names: list[str], body: str) -> str:
    """The body preceded by the shared tables it needs, each after those it reads."""
    ordered: dict[str, None] = {}

    def add(name: str) -> None:
        if name not in ordered:
            for needed in TABLES[name][0].split():
                add(needed)
            ordered[name] = None

    for name in names:
        add(name)
    kept = lambda n: "MATERIALIZED " if n in MATERIALIZED else ""
    head = ",\n".join(f"{n} AS {kept(n)}({TABLES[n][1].strip()})" for n in ordered)
    return f"WITH {'RECURSIVE ' if RECURSIVE & set(ordered) else ''}{head}\n{body}" if head else body
