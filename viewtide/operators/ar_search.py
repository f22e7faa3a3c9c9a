"""Choice and fit of a seasonal ARIMA model per report.

All candidate models of a report are least-squares fits on subsets of the same few columns, so one aggregate over the
series - the sums of products of these columns - holds all that is needed to fit and score every one of them. Spark does the
lags and the sums; Python gets one small row per (report, differencing) and solves 6x6 or 8x8 systems, whole Arrow batches at a time.

Moving-average terms come from a second round (two-step regression): the residuals of the longest autoregression stand for the
innovations, and their lags 1 and 7 join the columns. Innovations from before the sample count as 0.

Candidates: order p in 0..3, q in 0..1, seasonal orders P and Q in 0..1 (lag 7; the terms add up, they are not multiplied out).
The differencing d and D in 0..1 is chosen by tests of stationarity, or by the error of held-out training days. Column names
ignore case in Spark, so the seasonal order is called seasonal_p, seasonal_d, seasonal_q.

A report that cannot be solved - its sums are not finite - has an error instead of a model and touches no other.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from viewtide.functions import columns as C
from viewtide.operators import stationarity
from viewtide.schemas import schema
from viewtide.session import staged

# ship the functions below with the job, so that executors need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEASON = 7
MAX_LAG = 15                 # 7 seasonal + 7 differenced season + 1 difference
LAGS = (1, 2, 3, SEASON)     # lags a candidate may use
SHOCKS = (1, SEASON)         # lags of the innovations a candidate may use
#: Autoregressive orders (p, P), and the full search: orders (p, q, P, Q) and differencings (d, D).
AR_ORDERS = tuple((p, sp) for p in range(4) for sp in range(2))
ORDERS = tuple((p, q, sp, sq) for p, sp in AR_ORDERS for q in range(2) for sq in range(2))
DIFFERENCINGS = tuple((d, sd) for d in (0, 1) for sd in (0, 1))
Z95 = 1.959963984540054      # 97.5 % point of the normal distribution
HOLDOUT_SHARE = 0.2          # part of the training days used to choose the differencing
DIVERGED = "Model forecast is not finite"
UNSOLVED = "Sums of the series are not finite"
LARGEST = 1e100              # sums beyond this lose their meaning in double precision when they are multiplied


def full_order(order) -> tuple[int, int, int, int]:
    """(p, q, P, Q) of an order that may be given as (p, P)."""
    return tuple(order) if len(order) == 4 else (order[0], 0, order[1], 0)


def has_shocks(orders) -> bool:
    return any(q or sq for _, q, _, sq in map(full_order, orders))


def _pairs(width: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(width) for j in range(i, width)]


_TERMS = ["one", *[f"w{k}" for k in LAGS], "w"]
_SHOCK_TERMS = [*_TERMS[:-1], *[f"e{k}" for k in SHOCKS], "w"]
_PAIRS = _pairs(len(_TERMS))


def _differenced(k: int, d: int | str, sd: int | str) -> str:
    """SQL of the value k days back after d ordinary and sd seasonal differences."""
    if (d, sd) == (0, 0):
        return f"y{k}"
    once = lambda i: f"(y{i} - {d} * y{i + 1})" if d != 0 else f"y{i}"
    return f"{once(k)} - {sd} * {once(k + SEASON)}" if sd != 0 else once(k)


# The many columns below are SQL text: building each as a Column object costs the driver a round trip per operation.

def with_lags(split: DataFrame) -> DataFrame:
    """Centre each backtestable series on its training mean and add y0..y15 (days back)."""
    centred = split.where("error is null").selectExpr(
        "*", "avg(case when step is null then views end) over (partition by report_id) as centre").selectExpr(
        "*", "views - centre as y0")
    return centred.selectExpr("*", *[f"lag(y0, {k}) over (partition by report_id order by date) as y{k}" for k in range(1, MAX_LAG + 1)])


_PART = (f"case when pos <= floor(n_train * {1 - HOLDOUT_SHARE}D) then 'fit' when pos <= n_train then 'hold' else 'test' end as part")


def _variant_rows(lagged: DataFrame, differencings) -> DataFrame:
    """report_id, part and, per differencing, the columns of the regression.

    Only days that have all 15 lags count, so all candidates see the same sample.
    """
    def variant(d: int, sd: int) -> str:
        lags = "".join(f"{_differenced(k, d, sd)} as w{k}, " for k in LAGS)
        return f"struct({d} as d, {sd} as sd, {1.0 if d + sd <= 1 else 0.0}D as one, {lags}{_differenced(0, d, sd)} as w)"

    return lagged.where(F.col("pos") > MAX_LAG).selectExpr(
        "report_id", _PART, f"inline(array({', '.join(variant(d, sd) for d, sd in differencings)}))")


def _sums_of(rows: DataFrame, terms: list[str]) -> DataFrame:
    pairs = _pairs(len(terms))
    sums = rows.groupBy("report_id", "d", "sd", "part").agg(
        F.expr("cast(count(*) as double) as n"), *[F.expr(f"sum({terms[i]} * {terms[j]}) as s{i}_{j}") for i, j in pairs])
    packed = f"array(n, {', '.join(f's{i}_{j}' for i, j in pairs)})"
    return sums.groupBy("report_id", "d", "sd").agg(
        *[F.expr(f"max(case when part = '{p}' then {packed} end) as {p}") for p in ("fit", "hold", "test")])


def product_sums(lagged: DataFrame, differencings=DIFFERENCINGS) -> DataFrame:
    """Sums of products per report, differencing and part of the series (fit, hold, test)."""
    return _sums_of(_variant_rows(lagged, differencings), _TERMS)


def innovations(lagged: DataFrame, long: DataFrame) -> DataFrame:
    """The regression's rows with ``e``, the residual of the autoregressions ``long`` (report_id, d, sd, beta), and its lags.

    ``long`` holds a row per differencing wanted, usually one per report.
    """
    rows = lagged.where(F.col("pos") > MAX_LAG).join(long.select("report_id", "d", "sd", "beta"), "report_id").selectExpr(
        "report_id", "d", "sd", "pos", "n_train", "n_obs", _PART, "beta", "case when d + sd <= 1 then 1.0D else 0.0D end as one",
        *[f"{_differenced(k, 'd', 'sd')} as w{k}" for k in LAGS], f"{_differenced(0, 'd', 'sd')} as w")
    fitted = " + ".join(f"beta[{i}] * {t}" for i, t in enumerate(_TERMS[:-1]))
    order = "over (partition by report_id, d, sd order by pos)"
    return (rows.selectExpr("*", f"w - ({fitted}) as e")
            .selectExpr("*", *[f"coalesce(lag(e, {k}) {order}, 0D) as e{k}" for k in range(1, SEASON + 1)]).drop("beta"))


def shock_sums(rows: DataFrame) -> DataFrame:
    """Sums of products that take the innovations in."""
    return _sums_of(rows, _SHOCK_TERMS)


def last_shocks(rows: DataFrame) -> DataFrame:
    """report_id, d, sd and the last seven innovations of the training days and of the whole series, latest first."""
    tail = f"array(e, {', '.join(f'e{k}' for k in range(1, SEASON))})"
    return rows.groupBy("report_id", "d", "sd").agg(
        F.expr(f"max(case when pos = n_train then {tail} end) as train_shocks"),
        F.expr(f"max(case when pos = n_obs then {tail} end) as full_shocks"))


def _square(packed: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Counts and symmetric matrices from packed sums; a missing part counts as no days."""
    size = max((len(v) for v in packed if v is not None), default=1 + len(_PAIRS))
    width = int(np.sqrt(2 * size))                  # size = 1 + width * (width + 1) / 2
    flat = np.stack([np.zeros(size) if v is None else np.asarray(v, dtype=float) for v in packed])
    full = np.zeros((len(flat), width, width))
    for at, (i, j) in enumerate(_pairs(width), start=1):
        full[:, i, j] = full[:, j, i] = flat[:, at]
    return flat[:, 0], full


def _same_width(parts: list) -> list:
    """All parts as wide as the widest: a batch may lack a part altogether."""
    width = max(full.shape[1] for _, full in parts)
    return [(n, full if full.shape[1] == width else np.zeros((len(full), width, width))) for n, full in parts]


def _solvable(*parts: np.ndarray) -> np.ndarray:
    """Which rows have finite sums in all parts."""
    with np.errstate(invalid="ignore"):
        return np.all([(np.abs(full) < LARGEST).all(axis=(1, 2)) for full in parts], axis=0)


def _solve(sums: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Least-squares coefficients of the used terms, 0 for the others; least norm if singular."""
    x = sums[:, :-1, :-1] * used[:, None] * used[None, :]
    xy = sums[:, :-1, -1] * used
    scale = np.sqrt(np.maximum(np.einsum("bii->bi", x), 1e-300))
    scale[scale < 1e-100] = 1.0
    inverse = np.linalg.pinv(x / scale[:, :, None] / scale[:, None, :], rcond=1e-10, hermitian=True)
    return np.einsum("bij,bj->bi", inverse, xy / scale) / scale


def _squares(sums: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Residual sum of squares of given coefficients."""
    v = np.concatenate([-beta, np.ones((len(beta), 1))], axis=1)
    return np.maximum(np.einsum("bi,bij,bj->b", v, sums, v), 0.0)


_SCORE = T.ArrayType(schema("p int, q int, sp int, sq int, hold_mse double, aic double, beta double[], sigma double, "
                            "beta_full double[], sigma_full double, error string"))
_PATH = T.ArrayType(schema("step int, forecast double, half_width double"))


def score_orders(orders):
    """Function that fits and scores all orders for each row of product sums; a row that cannot be solved has one error."""
    def score(fit: pd.Series, hold: pd.Series, test: pd.Series) -> pd.Series:
        if not len(fit):
            return pd.Series([], dtype=object)
        (n_fit, s_fit), (n_hold, s_hold), (n_test, s_test) = _same_width([_square(fit), _square(hold), _square(test)])
        good = _solvable(s_fit, s_hold, s_test)
        for part in (s_fit, s_hold, s_test):
            part[~good] = 0.0
        n_train, s_train, n_full, s_full = n_fit + n_hold, s_fit + s_hold, n_fit + n_hold + n_test, s_fit + s_hold + s_test
        blank = dict.fromkeys(_SCORE.elementType.fieldNames())
        scores: list[list[dict]] = [[] if g else [blank | {"error": UNSOLVED}] for g in good]
        for p, q, sp, sq in map(full_order, orders):
            used = np.array([1.0, *[float(k <= p) for k in LAGS[:-1]], float(sp), float(q), float(sq)])[:s_fit.shape[1] - 1]
            terms = used.sum() + 1
            early, beta, beta_full = _solve(s_fit, used), _solve(s_train, used), _solve(s_full, used)
            hold_mse = _squares(s_hold, early) / np.maximum(n_hold, 1)
            rss = _squares(s_train, beta)
            aic = n_train * np.log(np.maximum(rss / np.maximum(n_train, 1), 1e-12)) + 2 * terms
            sigma = np.sqrt(rss / np.maximum(n_train - terms, 1))
            sigma_full = np.sqrt(_squares(s_full, beta_full) / np.maximum(n_full - terms, 1))
            for i in np.flatnonzero(good):
                scores[i].append({"p": p, "q": q, "sp": sp, "sq": sq, "hold_mse": hold_mse[i], "aic": aic[i],
                                  "beta": beta[i].tolist(), "sigma": sigma[i], "beta_full": beta_full[i].tolist(),
                                  "sigma_full": sigma_full[i], "error": None})
        return pd.Series(scores)

    return F.pandas_udf(score, _SCORE)


def score_candidates(sums: DataFrame, orders=AR_ORDERS) -> DataFrame:
    """One row per report and candidate model; a report that cannot be solved has ``error`` instead."""
    return sums.select("report_id", "d", "sd", F.inline(score_orders(orders)("fit", "hold", "test")))


def choose_differencing(candidates: DataFrame, orders=AR_ORDERS) -> DataFrame:
    """Differencing by one-step error of the fullest order on the held-out training days: the candidates with it."""
    by_report = Window.partitionBy("report_id")
    p, _, sp, _ = max(map(full_order, orders), key=lambda order: (sum(order), order[0]))
    fullest = (F.col("p") == p) & (F.col("sp") == sp)
    best = F.min(F.when(fullest, F.struct("hold_mse", (F.col("d") + F.col("sd")).alias("k"), "d", "sd"))).over(by_report)
    return (candidates.where("error is null").withColumn("_best", best)
            .where((F.col("d") == F.col("_best.d")) & (F.col("sd") == F.col("_best.sd"))).drop("_best"))


def _fades(polynomials: np.ndarray) -> np.ndarray:
    """Which rows a1..ak, read as 1 + a1 L + .. + ak L^k, have all roots outside the unit circle.

    The degree is stepped down; each step's last coefficient must stay below 1 (Schur and Cohn).
    """
    within = np.isfinite(polynomials).all(axis=1)
    a = np.where(within[:, None], polynomials, 0.0)
    for k in range(a.shape[1], 0, -1):
        within &= np.abs(a[:, k - 1]) < 1
        last = np.where(within, a[:, k - 1], 0.0)[:, None]
        a = (a[:, :k - 1] - last * a[:, :k - 1][:, ::-1]) / (1 - last ** 2)
    return within


@F.pandas_udf(T.BooleanType())
def admissible(beta: pd.Series) -> pd.Series:
    """Whether the fitted terms are stationary and invertible; others only explode or cancel each other."""
    if not len(beta):
        return pd.Series([], dtype=bool)
    fitted = np.stack([np.asarray(b, dtype=float) for b in beta])
    ar, ma = np.zeros((len(fitted), SEASON)), np.zeros((len(fitted), SEASON))
    ar[:, [k - 1 for k in LAGS]] = -fitted[:, 1:1 + len(LAGS)]
    if fitted.shape[1] > 1 + len(LAGS):
        ma[:, [k - 1 for k in SHOCKS]] = fitted[:, 1 + len(LAGS):]
    return pd.Series(_fades(ar) & _fades(ma))


def best_order(candidates: DataFrame, check_roots: bool = False) -> DataFrame:
    """The order by AIC, which compares only models of the same differencing; with ``check_roots`` admissible models come first."""
    size = F.col("p") + F.col("sp") + F.col("q") + F.col("sq")
    candidates = candidates.where("error is null")
    first = []
    if check_roots:
        candidates, first = candidates.withColumn("_outside", ~admissible("beta")), ["_outside"]
    rank = F.row_number().over(Window.partitionBy("report_id").orderBy(*first, "aic", size, "p", "q", "sp"))
    return candidates.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank", *first)


def choose_model(candidates: DataFrame, orders=AR_ORDERS) -> DataFrame:
    """Differencing by held-out days, then the order by AIC."""
    return best_order(choose_differencing(candidates, orders))


def series_ends(lagged: DataFrame) -> DataFrame:
    """Per report: what forecasting starts from. Latest value first in the two tails."""
    tail = f"array({', '.join(f'y{k}' for k in range(MAX_LAG))})"
    return lagged.groupBy("report_id").agg(*[F.expr(f"{how}({c}) as {name}") for how, c, name in (
        ("min", "report_name", "report_name"), ("max", "n_obs", "n_obs"), ("max", "n_train", "n_train"), ("max", "n_test", "n_test"),
        ("max", "date", "last_date"), ("max", "centre", "centre"), ("max", f"case when pos = n_train then {tail} end", "train_tail"),
        ("max", f"case when pos = n_obs then {tail} end", "full_tail"))])


def _level_weights(beta: np.ndarray, d: int, sd: int) -> np.ndarray:
    """Weights of y(t-1)..y(t-15) once the differences are multiplied out."""
    ar = np.zeros(SEASON + 1)
    ar[0] = 1.0
    for k, b in zip(LAGS, beta[1:]):
        ar[k] -= b
    if d:
        ar = np.convolve(ar, [1.0, -1.0])
    if sd:
        ar = np.convolve(ar, [1.0] + [0.0] * (SEASON - 1) + [-1.0])
    weights = np.zeros(MAX_LAG)
    weights[:len(ar) - 1] = -ar[1:]
    return weights


def _walk(beta, d, sd, sigma, tail, steps, shocks=None) -> pd.Series:
    """Iterate each row's recursion ``steps`` days on; the rows of a batch advance together.

    ``shocks`` are the last seven innovations, latest first; those to come are 0.
    """
    rows, horizon = len(beta), int(steps.max()) if len(steps) else 0
    if not rows:
        return pd.Series([], dtype=object)
    coefficients = np.stack([np.asarray(b, float) for b in beta])
    ar = coefficients[:, :1 + len(LAGS)]
    ma = coefficients[:, 1 + len(LAGS):] if coefficients.shape[1] > 1 + len(LAGS) else np.zeros((rows, len(SHOCKS)))
    known = np.zeros((rows, SEASON)) if shocks is None else np.stack([np.asarray(e, dtype=float) for e in shocks])
    weights = np.stack([_level_weights(b, int(i), int(j)) for b, i, j in zip(ar, d, sd)])
    level = np.array([float(b[0]) if i + j <= 1 else 0.0 for b, i, j in zip(ar, d, sd)])
    past = np.stack([np.asarray(t, dtype=float) for t in tail])
    echo = np.zeros((rows, MAX_LAG))      # response to one shock, latest day first
    echo[:, 0] = 1.0
    forecast, spread = np.zeros((rows, horizon)), np.zeros((rows, horizon))
    variance = np.zeros(rows)
    with np.errstate(over="ignore", invalid="ignore"):
        for h in range(horizon):
            variance = variance + echo[:, 0] ** 2
            spread[:, h] = np.sqrt(variance)
            moved = level + (weights * past).sum(axis=1)
            answer = (weights * echo).sum(axis=1)
            for k, theta in zip(SHOCKS, ma.T):
                if h < k:                 # innovation k days before this one is known
                    moved = moved + theta * known[:, k - 1 - h]
                if h + 1 == k:
                    answer = answer + theta
            forecast[:, h] = moved
            past = np.concatenate([forecast[:, h:h + 1], past[:, :-1]], axis=1)
            echo = np.concatenate([answer[:, None], echo[:, :-1]], axis=1)
        spread *= Z95 * np.asarray(sigma, dtype=float)[:, None]
    return pd.Series([[{"step": h + 1, "forecast": forecast[i, h], "half_width": spread[i, h]} for h in range(int(n))]
                      for i, n in enumerate(steps)])


@F.pandas_udf(_PATH)
def forecast_path(beta: pd.Series, d: pd.Series, sd: pd.Series, sigma: pd.Series, tail: pd.Series,
                  steps: pd.Series) -> pd.Series:
    """Forecasts of autoregressions."""
    return _walk(beta, d, sd, sigma, tail, steps)


@F.pandas_udf(_PATH)
def shocked_path(beta: pd.Series, d: pd.Series, sd: pd.Series, sigma: pd.Series, tail: pd.Series,
                 steps: pd.Series, shocks: pd.Series) -> pd.Series:
    """Forecasts of models that may have moving-average terms."""
    return _walk(beta, d, sd, sigma, tail, steps, shocks)


def _models(split: DataFrame, lagged: DataFrame, orders, differencings, choice: str, check_roots: bool) -> DataFrame:
    """The chosen candidate per report, with its last innovations."""
    if choice not in ("tests", "holdout"):
        raise ValueError("choice is 'tests' or 'holdout'")
    long = AR_ORDERS if has_shocks(orders) else orders
    candidates = score_candidates(product_sums(lagged, differencings), long)
    if choice == "holdout" or len(differencings) == 1:
        candidates = choose_differencing(candidates, long)
    else:
        # a row a report, stored: the sorts of the tests end before those of the innovations begin
        wanted = staged(stationarity.choose_differencing(split), "differencing")
        candidates = candidates.where("error is null").join(wanted, ["report_id", "d", "sd"])
    if not has_shocks(orders):
        none = F.array_repeat(F.lit(0.0), SEASON)
        return best_order(candidates, check_roots).withColumns({"train_shocks": none, "full_shocks": none})
    p, _, sp, _ = max(map(full_order, long), key=lambda order: (sum(order), order[0]))
    fullest = staged(candidates.where((F.col("p") == p) & (F.col("sp") == sp)).select("report_id", "d", "sd", "beta"), "autoregressions")
    rows = staged(innovations(lagged, fullest), "innovations")
    return best_order(score_candidates(shock_sums(rows), orders), check_roots).join(last_shocks(rows), ["report_id", "d", "sd"])


def fit_models(split: DataFrame, orders=ORDERS, differencings=DIFFERENCINGS, choice: str = "tests",
               check_roots: bool = False) -> DataFrame:
    """Chosen model per backtestable report that can be solved, with everything needed to forecast from it.

    ``choice`` of the differencing: "tests" of stationarity, or "holdout", the error on held-out training days.
    ``check_roots`` passes over orders whose fit is not stationary and invertible.
    """
    lagged = with_lags(split)
    chosen = _models(split, lagged, orders, differencings, choice, check_roots)
    # days before the sixteenth lack lags; the ends carry none of these, as training has 30 days
    return chosen.join(series_ends(lagged), "report_id").select(
        "report_id", "report_name", "n_obs", "n_train", "n_test", "last_date", "centre", "p", "d", "q",
        F.col("sp").alias("seasonal_p"), F.col("sd").alias("seasonal_d"), F.col("sq").alias("seasonal_q"),
        F.lit(SEASON).alias("m"), "aic", "hold_mse", "beta", "sigma", "beta_full",
        "sigma_full", "train_tail", "full_tail", "train_shocks", "full_shocks",
    ).withColumn("model_str", C.model_label(*[F.col(c) for c in (
        "p", "d", "q", "seasonal_p", "seasonal_d", "seasonal_q", "m")]))


def _path(models: DataFrame, beta: str, sigma: str, tail: str, steps: Column, *also: str) -> DataFrame:
    path = shocked_path(beta, "d", "seasonal_d", sigma, tail, steps.cast("int"), tail.replace("tail", "shocks"))
    centred = models.select("report_id", "report_name", "last_date", "centre", *also, F.inline(path))
    level = F.col("centre") + F.col("forecast")
    return centred.select(
        "report_id", "report_name", *also, "step", "last_date", level.alias("_raw"),
        C.floor_at_zero(level).alias("forecast"), C.floor_at_zero(level - F.col("half_width")).alias("lower_ci"),
        C.floor_at_zero(level + F.col("half_width")).alias("upper_ci"))


def backtest_path(models: DataFrame, *also: str) -> DataFrame:
    """Forecasts of the test days from the training fit; ``also`` are columns of the models that go along."""
    return _path(models, "beta", "sigma", "train_tail", F.col("n_test"), *also)


def future_path(models: DataFrame, horizon: int) -> DataFrame:
    """Forecasts after the last day from the refit on the whole series."""
    return (_path(models, "beta_full", "sigma_full", "full_tail", F.lit(horizon))
            .withColumn("date", F.date_add("last_date", F.col("step"))))
