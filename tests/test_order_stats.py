"""Order statistics against brute force, with a group that holds a third and more of all rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from viewtide.functions import columns as C
from viewtide.functions import order_stats
from viewtide.functions.order_stats import exact_percentiles, in_order, top_share


def groups(seed):
    rng = random.Random(seed)
    data = {
        "hot": [rng.lognormvariate(8, 2) for _ in range(4000)],
        "point": [30000.0] * 1500 + [1.0],
        "signs": [rng.uniform(-5, 5) for _ in range(301)] + [0.0] * 20,
        "wide": [rng.choice([1e-300, 1e300, 5.0, -1e300, 0.0]) for _ in range(50)],
        "close": [1000 + i * 1e-9 for i in range(700)],
        "one": [42.0], "two": [1.0, 2.0],
    }
    for i in range(40):
        data[f"g{i}"] = [float(rng.randint(0, 9)) for _ in range(rng.randint(1, 25))]
    return data


@pytest.mark.parametrize("seed", [1, 2])
def test_percentiles(spark, seed):
    data = groups(seed)
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs] + [("one", None)], "k string, v double")
    probs = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    got = {r["k"]: r for r in exact_percentiles(df.repartition(6), ["k"], "v", probs).collect()}
    assert set(got) == set(data)
    for key, values in data.items():
        for name, q in probs.items():
            assert got[key][name] == pytest.approx(np.quantile(values, q), rel=1e-12, abs=1e-300), (key, name)


def test_partitions_stay_even(spark):
    """Close values beside an outlier, one value throughout, and equal groups: no partition gathers a group."""
    data = {"close": [1000 + i * 1e-9 for i in range(20_000)] + [1001.0], "same": [5.0] * 20_000, "tiny": [1.0]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v double").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in in_order(df, ["k"], "v").groupBy("_chunk").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) == 4 and max(sizes) < 1.5 * 40_002 / 4


def test_infinite_values_have_their_place(spark):
    inf, nan = math.inf, math.nan
    data = {"one": [1.0, 2.0, inf], "all": [inf, inf], "both": [-inf, 0.0, inf], "nan": [1.0, nan]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v double")
    got = {r["k"]: (r.p0, r.p50, r.p100) for r in exact_percentiles(df, ["k"], "v", {"p0": 0.0, "p50": 0.5, "p100": 1.0}).collect()}
    assert got["one"] == (1.0, 2.0, inf) and got["all"] == (inf, inf, inf) and got["both"] == (-inf, 0.0, inf)
    assert got["nan"][0] == 1.0 and math.isnan(got["nan"][2])


@pytest.mark.parametrize("kind", ["bigint", "double"])
def test_top_share(spark, kind):
    rng = random.Random(7)
    data = {"hot": [rng.randint(0, 400) for _ in range(5000)], "ties": [5] * 30, "zero": [0] * 12, "solo": [3],
            "nine": list(range(9)), "eleven": list(range(11)), "big": [10**6] + [1] * 99}
    if kind == "double":
        data = {k: [v + rng.random() / 3 for v in vs] for k, vs in data.items()}
        data["zero"] = [0.0] * 12
        data["narrow"] = [500 + rng.random() / 1000 for _ in range(3000)]
        data["negative"] = [-rng.random() for _ in range(50)]
    df = spark.createDataFrame([(k, v if kind == "double" else int(v)) for k, vs in data.items() for v in vs], f"k string, v {kind}")
    cells = df.groupBy("k", "v").agg(F.count("*").alias("n"))
    got = {r["k"]: r for r in top_share(cells, ["k"], "v", "n", C.top_decile_size, kind == "bigint",
                                        also=[F.sum("n").alias("users")]).collect()}
    for key, values in data.items():
        size = max(1, math.ceil(len(values) * 0.10))
        assert got[key]["users"] == len(values)
        assert got[key]["_top"] == pytest.approx(sum(sorted(values)[-size:]))


PROBS = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}


def columns_of(spark, n):
    """Columns of several kinds: spread out, nearly all equal, heavy-tailed, few values with gaps, mostly missing, none."""
    draw = np.random.default_rng(n)
    return {"flat": draw.random(n), "ties": np.where(draw.random(n) < 0.9, 7.0, draw.random(n)), "tail": np.exp(draw.normal(0, 20, n)),
            "few": draw.integers(0, 3, n).astype(float), "ends": np.where(draw.random(n) < 0.3, np.inf, draw.normal(size=n)),
            "sparse": [float(x) if x < 50 else None for x in draw.integers(0, 1000, n)], "none": [None] * n}


def table(spark, columns):
    rows = zip(*[[None if x is None else float(x) for x in c] for c in columns.values()])
    return spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in columns)).repartition(5)


@pytest.mark.parametrize("n, few", [(1, 100), (2, 1), (37, 5), (4_000, 60), (30_000, 100_000), (30_000, 300)])
def test_column_percentiles(spark, monkeypatch, n, few):
    """Whatever the number of rows that are put in order; with few of them several turns are taken."""
    monkeypatch.setattr(order_stats, "FEW_ROWS", few)
    columns = columns_of(spark, n)
    got, also = order_stats.column_percentiles(table(spark, columns), list(columns), PROBS, {"few": [F.max("few"), F.count("few")]})
    assert also["few"] == [max(columns["few"]), n] and also["flat"] == []
    for name, values in columns.items():
        values = sorted(x for x in values if x is not None)
        assert (name in got) == bool(values)
        for prob, at in PROBS.items() if values else ():
            place = at * (len(values) - 1)
            low, high = values[math.floor(place)], values[math.ceil(place)]
            want = low if low == high else low + (high - low) * (place - math.floor(place))
            assert got[name][prob] == pytest.approx(want, rel=1e-12), (name, prob)


def test_column_percentiles_put_little_in_order(spark, monkeypatch):
    """Of a long column only the neighbourhood of the wanted ranks is shuffled; ranks on a value of many rows need none of it."""
    seen, whole = [], order_stats.read_off
    monkeypatch.setattr(order_stats, "FEW_ROWS", 1_000)
    monkeypatch.setattr(order_stats, "read_off", lambda df, asks: seen.extend(asks) or whole(df, asks))
    n = 60_000
    columns = {k: v for k, v in columns_of(spark, n).items() if k in ("flat", "ties", "few")}
    order_stats.column_percentiles(table(spark, columns), list(columns), {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    assert {one.column for one in seen} == {"flat"} and all(one.rows < 0.01 * n for one in seen)


@pytest.mark.parametrize("bad", [(0.0, 0.0), (1.0, 1.0), (0.2, 0.5)])
def test_column_percentiles_with_bad_sketches(spark, monkeypatch, bad):
    """Bounds that miss their rank cost turns and no result."""
    monkeypatch.setattr(order_stats, "FEW_ROWS", 2_000)
    real, calls = F.percentile_approx, []

    def first_bad(value, shares, accuracy):
        calls.append(shares)
        return F.array(*[F.lit(x) for _ in shares[::2] for x in bad]) if len(calls) == 1 else real(value, shares, accuracy)

    monkeypatch.setattr(F, "percentile_approx", first_bad)
    values = np.random.default_rng(1).random(20_000)
    got = order_stats.column_percentiles(table(spark, {"v": values}), ["v"], PROBS)[0]["v"]
    assert [got[p] for p in PROBS] == pytest.approx(np.quantile(values, list(PROBS.values())), rel=1e-12)


@pytest.mark.parametrize("few", [100, 100_000])
def test_column_percentiles_not_a_number_is_largest(spark, monkeypatch, few):
    monkeypatch.setattr(order_stats, "FEW_ROWS", few)
    values = [1.0] * 6_000 + [float("nan")] * 6_000 + [2.0] * 6_000
    got = order_stats.column_percentiles(table(spark, {"a b": values}), ["a b"], {"low": 0.1, "mid": 0.5, "top": 0.9})[0]["a b"]
    assert (got["low"], got["mid"]) == (1.0, 2.0) and math.isnan(got["top"])
    assert order_stats.column_percentiles(table(spark, {"v": [1.0]}).where("false"), ["v"], PROBS) == ({}, {"v": []})
