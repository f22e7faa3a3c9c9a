"""Moving-average terms, differencing by tests, and reports that cannot be modelled."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from test_forecasting import RUN, usage, weekly
from viewtide.operators import ar_search as A, series as S, stationarity as N
from viewtide.plans import forecasting as Fc


def split_of(spark, data):
    return S.split_series(S.daily_series(usage(spark, data)))


def moving_average(n, theta, seasonal, seed):
    rng = np.random.default_rng(seed)
    e = rng.normal(size=n + 7) * 3
    return 100 + e[7:] + theta * e[6:-1] + seasonal * e[:-7]


@pytest.mark.parametrize("theta, seasonal", [(0.6, 0.0), (-0.5, 0.0), (0.0, 0.6), (0.4, 0.4)])
def test_moving_averages_are_recovered(spark, theta, seasonal):
    y = moving_average(3000, theta, seasonal, 4)
    orders = [(0, q, 0, sq) for q in (0, 1) for sq in (0, 1)]
    model = A.fit_models(split_of(spark, {"r": y}), orders, ((0, 0),)).first()
    # the innovations come from a short autoregression, so the estimates are somewhat small
    assert model.beta[5:] == pytest.approx([theta, seasonal], abs=0.12)
    assert (model.q if theta else model.seasonal_q) == 1
    assert model.sigma == pytest.approx(3.0, abs=0.35)
    assert model.model_str == f"ARIMA(0,0,{model.q})x(0,0,{model.seasonal_q},7)"


def test_full_search_fills_all_orders(spark):
    model = A.fit_models(split_of(spark, {"r": moving_average(2500, 0.8, 0.6, 8)})).first()
    assert (model.d, model.seasonal_d) == (0, 0) and model.q + model.seasonal_q >= 1
    assert len(A.ORDERS) == 32 and len(model.beta) == 7 and len(model.full_shocks) == 7


def test_shocked_path_follows_the_recursion():
    beta, y, e = np.array([0.3, 0.4, 0, 0, 0.2, 0.5, -0.3]), [float(x) for x in range(15, 0, -1)], [1.0, -2, 3, 0.5, -1, 2, 4]
    one = lambda x: pd.Series([x])
    got = A.shocked_path.func(one(beta), one(0), one(0), one(2.0), one(y), one(10), one(e))[0]
    values, known, want = y[::-1], e[::-1], []
    for h in range(10):
        shock = lambda k: known[len(known) - k] if 0 <= len(known) - k < 7 else 0.0
        w = 0.3 + 0.4 * values[-1] + 0.2 * values[-7] + 0.5 * shock(1) - 0.3 * shock(7)
        values.append(w)
        known = known + [0.0]
        want.append(w)
    assert [g["forecast"] for g in got] == pytest.approx(want)
    psi = [1.0]
    for h in range(1, 10):
        psi.append(0.4 * psi[h - 1] + (0.2 * psi[h - 7] if h >= 7 else 0) + (0.5 if h == 1 else 0) + (-0.3 if h == 7 else 0))
    assert [g["half_width"] for g in got] == pytest.approx(list(A.Z95 * 2 * np.sqrt(np.cumsum(np.square(psi)))))


def test_known_innovations_improve_the_first_day(spark):
    y = moving_average(600, 0.9, 0.0, 1)
    split = split_of(spark, {"r": y})
    orders = [(0, 1, 0, 0)]
    model = A.fit_models(split, orders, ((0, 0),))
    first = A.backtest_path(model).where("step = 1").first().forecast
    e = model.first().train_shocks[0]
    assert first == pytest.approx(model.first().centre + model.first().beta[0] + model.first().beta[5] * e)


# Differencing -----------------------------------------------------------------------------------------

def kpss(x):
    x = np.asarray(x, float) - np.mean(x)
    n = len(x)
    used = int(4 * (n / 100) ** 0.25)
    own = (x ** 2).sum() + 2 * sum((1 - k / (used + 1)) * (x[k:] * x[:-k]).sum() for k in range(1, used + 1))
    return (np.cumsum(x) ** 2).sum() / (n * own)


def test_level_statistic(spark):
    rng = np.random.default_rng(0)
    for x in (rng.normal(size=200), rng.normal(size=333).cumsum(), np.arange(40.0)):
        rows = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(x)], "report_id string, pos int, value double")
        got = N.level_statistic(rows, ["report_id"], "value", "pos", 9).first()
        assert got.n == len(x) and got.statistic == pytest.approx(kpss(x), rel=1e-9)
    flat = rows.withColumn("value", F.lit(3.0))
    assert N.level_statistic(flat, ["report_id"], "value", "pos", 9).first().statistic is None
    assert N.level_statistic(rows.limit(2), ["report_id"], "value", "pos", 9).first().statistic is None


def test_choice_of_differencing(spark):
    rng = random.Random(6)
    walk = [500.0]
    for _ in range(399):
        walk.append(max(walk[-1] + rng.gauss(0, 10), 0))
    # a weekly pattern that is another one every few weeks
    drifting, shape = [], [rng.gauss(0, 20) for _ in range(7)]
    for i in range(400):
        shape[i % 7] += rng.gauss(0, 12)
        drifting.append(500 + shape[i % 7] + rng.gauss(0, 2))
    noise = [100 + rng.gauss(0, 5) for _ in range(400)]
    data = {"walk": walk, "drifting": drifting, "noise": noise, "weekly": weekly(400), "flat": [5.0] * 100, "young": weekly(20)}
    got = {r.report_id: (r.d, r.sd) for r in N.choose_differencing(split_of(spark, data)).collect()}
    assert got["walk"][0] == 1 and got["drifting"][1] == 1
    assert got["noise"] == got["weekly"] == got["flat"] == (0, 0) and "young" not in got


# Failures ---------------------------------------------------------------------------------------------

BAD = {"infinite": float("inf"), "nan": float("nan"), "minus": float("-inf")}


def test_one_bad_series_fails_alone(spark, tmp_path):
    good = {"weekly": weekly(200), "other": weekly(150, seed=3)}
    broken = {k: weekly(160, seed=i)[:80] + [v] + weekly(79, seed=i) for i, (k, v) in enumerate(BAD.items())}
    broken["huge"] = [1e160 + i * 1e158 for i in range(120)]
    rule = S.Sufficiency(min_nonzero_ratio=0.1)
    tables = Fc.run_forecasts(usage(spark, good | broken), RUN, str(tmp_path / "a"), rule=rule)
    alone = Fc.run_forecasts(usage(spark, good), RUN, str(tmp_path / "b"), rule=rule)
    rows = {r.report_id: r for r in tables.metrics.collect()}
    assert rows["infinite"].error == S.NOT_FINITE and not rows["infinite"].passes_model_criteria
    assert rows["huge"].error == A.DIVERGED and not rows["huge"].passes_model_criteria
    assert rows["nan"].error is None      # not a number counts as no views
    for name in good:
        assert rows[name].error is None and rows[name].passes_model_criteria
    mine = lambda t: sorted(map(tuple, t.forecasts.where(F.col("ReportId").isin(*good)).collect()))
    assert mine(tables) == mine(alone)


def test_kernel_masks_bad_rows():
    size = 1 + len(A._PAIRS)
    good = np.zeros(size)
    good[0] = 50
    for at, (i, j) in enumerate(A._PAIRS, start=1):
        good[at] = 50.0 if i == j else 1.0
    for value in (float("inf"), float("nan"), 1e200):
        bad = good.copy()
        bad[3] = value
        score = A.score_orders(A.AR_ORDERS).func
        alone = score(pd.Series([good]), pd.Series([good]), pd.Series([None]))
        both = score(pd.Series([bad, good]), pd.Series([good, good]), pd.Series([None, None]))
        assert both[1] == alone[0] and len(both[1]) == len(A.AR_ORDERS)
        assert [r["error"] for r in both[0]] == [A.UNSOLVED] and both[0][0]["aic"] is None
        assert all(math.isfinite(r["aic"]) for r in both[1])


def test_all_series_bad(spark):
    data = {"infinite": weekly(100) + [float("inf")], "day": [dt.date.max.year]}
    tables = Fc.run_forecasts_for_reports(usage(spark, data), RUN)
    assert tables.forecasts.isEmpty() and tables.metrics.first().error == S.NOT_FINITE
