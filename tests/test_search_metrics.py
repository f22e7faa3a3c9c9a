"""fc_metrics measures the searched model, not a stand-in for it."""

import datetime as dt
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import comparison
from test_forecasting import usage, weekly
from viewtide.operators import ar_search as A, publish as P, series as S
from viewtide.plans import forecasting as Fc

DAY0 = dt.datetime(1999, 3, 1)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Lines of four suppliers, each with a brand and flag of its own: weekly, wandering, sparse, and too short to be split."""
    rng, level = random.Random(5), 60.0
    series = {1: weekly(200, seed=1), 2: [], 3: [rng.randrange(5, 40) if i % 6 in (0, rng.randrange(6)) else None for i in range(260)], 4: [9.0] * 30}
    for _ in range(220):
        level = max(level + rng.gauss(0, 3), 5)
        series[2].append(level)
    root = tmp_path_factory.mktemp("tables")
    lines = [(DAY0 + dt.timedelta(days=i), k, k, float(round(v)), "ANRX"[k - 1], "O") for k, vs in series.items() for i, v in enumerate(vs) if v is not None]
    spark.createDataFrame(lines, "l_shipdate timestamp_ntz, l_partkey bigint, l_suppkey bigint, l_quantity double, l_returnflag string, l_linestatus string"
                          ).coalesce(1).write.parquet(f"{root}/lineitem.parquet")
    spark.createDataFrame([(k, f"Brand#{k}", "T") for k in series], "p_partkey bigint, p_brand string, p_type string").coalesce(1).write.parquet(
        f"{root}/part.parquet")
    return str(root), series


def test_metrics_are_those_of_the_searched_model(spark, tables):
    root, series = tables
    got = {r.report_id: r for r in entry.queries()["fc_metrics"](spark, root).collect()}
    assert set(got) == {f"{kind}{k}" for k in (1, 2, 3) for kind in ("S_", "Brand#")} | {"F_A", "F_N", "F_R"}
    y = [float(round(v)) for v in series[1]]
    week_mean = sum(y[153:160]) / 7
    row = got["S_1"]
    assert row.mae_arima < 0.5 * sum(abs(v - week_mean) for v in y[160:]) / 40
    split = S.split_series(S.daily_series(usage(spark, {"S_1": y})))
    path = A.backtest_path(A.fit_models(split, check_roots=True)).orderBy("step").collect()
    errors = [a - r.forecast for a, r in zip(y[160:], path, strict=True)]
    assert row.mae_arima == pytest.approx(sum(map(abs, errors)) / 40, abs=1e-5)
    assert row.rmse_arima == pytest.approx(math.sqrt(sum(e * e for e in errors) / 40), abs=1e-5)
    assert row.wape_arima == pytest.approx(sum(map(abs, errors)) / sum(y[160:]), abs=1e-5)
    assert row.mae_improvement_vs_naive == pytest.approx(1 - row.mae_arima / row.mae_naive, abs=1e-5)
    assert row.p + row.seasonal_p + row.seasonal_d > 0 and row.m == 7
    for r in got.values():
        assert r.model_str == f"ARIMA({r.p},{r.d},{r.q})x({r.seasonal_p},{r.seasonal_d},{r.seasonal_q},7)"


def test_the_sql_makes_the_same_search(spark, tables):
    root, _ = tables
    con = duckdb.connect()
    for name in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet/*.parquet'")
    assert comparison.spark_rows(entry.queries()["fc_metrics"](spark, root)) == comparison.sql_rows(con, entry.oracle_sql()["fc_metrics"])


def test_pairs_are_those_of_the_join(spark):
    split = S.split_series(S.daily_series(usage(spark, {"a": weekly(120), "b": weekly(90, seed=4), "young": [3.0] * 20}, {"b": None})))
    tested = S.with_baselines(split.where(F.col("error").isNull()))
    path = A.backtest_path(A.fit_models(split.where("report_id <> 'b'").unionByName(split.where("report_id = 'b'"))), "n_obs", "n_train", "n_test", *P.ORDER_COLUMNS)
    columns = ["report_id", "step", "forecast", "actual", "naive", "seasonal_naive"]
    want = P.backtest_rows(path, tested).select(*columns)
    assert comparison.spark_rows(P.paired_days(path, tested).select(*columns)) == comparison.spark_rows(want) and want.count() == 24 + 18
    # a report without a model has no metrics, one without test days neither
    assert P.paired_days(path.where("report_id = 'a'"), tested.where("report_id = 'b'")).isEmpty()


def test_roots():
    rng = np.random.default_rng(2)
    polynomials = rng.normal(size=(400, 7)) * rng.choice([0.05, 0.2, 0.5], size=(400, 1)) * (rng.random((400, 7)) < 0.6)
    want = [np.abs(np.roots([1.0, *p])).max(initial=0.0) < 1 for p in polynomials]
    assert list(A._fades(polynomials)) == want and 50 < sum(want) < 350
    assert list(A._fades(np.array([[np.nan, 0.0], [np.inf, 0.0], [0.0, 0.0], [-1.01, 0.0], [-0.99, 0.0]]))) == [False, False, True, False, True]


def test_exploding_orders_are_passed_over(spark):
    """Terms that cancel each other fit best by AIC; their forecasts explode."""
    beta = {"explodes": [0.1, 5.9, 0.0, -0.2, 0.0, -5.9, 0.0], "echoes": [0.1, 0.2, 0.0, 0.0, 0.0, 1.4, 0.0], "plain": [0.1, 0.3, 0.0, 0.0, 0.2, 0.0, 0.0]}
    rows = [(r, 0, 0, p, 1, 0, 0, aic, beta[name], None) for r, p, aic, name in [
        ("r", 3, 1.0, "explodes"), ("r", 1, 2.0, "echoes"), ("r", 2, 3.0, "plain"), ("all", 3, 1.0, "explodes"), ("all", 1, 2.0, "echoes")]]
    scored = spark.createDataFrame(rows, "report_id string, d int, sd int, p int, q int, sp int, sq int, aic double, beta array<double>, error string")
    chosen = lambda **how: {r.report_id: r.p for r in A.best_order(scored, **how).collect()}
    assert chosen() == {"r": 3, "all": 3} and chosen(check_roots=True) == {"r": 2, "all": 3}
    assert A.best_order(scored).columns == A.best_order(scored, check_roots=True).columns == scored.columns
