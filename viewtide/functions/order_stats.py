"""Exact order statistics of groups of any size and any values, by one path.

``percentile`` keeps all distinct values of a group in one task. That is wrong for a group that holds a large part of the
table. Here the rows are range-partitioned by group, value and a number of their own, so that even equal values of one
group spread over tasks of even size, and stored in that order. Ranks then follow from one count per group and partition;
the wanted rows are read off by their place. NaN is the largest value, as in Spark's own order.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from viewtide.functions import columns as C
from viewtide.session import staged

#: Sketches that narrow a column down miss a rank by at most one in so many rows.
SKETCH_ACCURACY = 1000

#: So many rows of one rank's range are put in order by one task, more are narrowed down first.
FEW_ROWS = 100_000

PLACE_BITS = 33  # monotonically_increasing_id keeps the partition above 33 bits of row number


def running(keys: Sequence[str], order: Column, amount: str) -> Column:
    """Running sum of ``amount`` inside the keys, current row included."""
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.sum(amount).over(frame)


def in_order(rows: DataFrame, keys: Sequence[str], value: str, descending: bool = False) -> DataFrame:
    """``rows`` sorted by keys and value over evenly filled partitions, stored, with their place ``_id`` and ``_chunk``."""
    order = [*keys, F.col(value).desc() if descending else F.col(value), "_tie"]
    numbered = rows.withColumn("_tie", F.monotonically_increasing_id())
    placed = (numbered.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")
              .withColumn("_id", F.monotonically_increasing_id()))
    return staged(placed, "in-order").withColumn("_chunk", F.shiftright("_id", PLACE_BITS))


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Linear-interpolated percentiles, one row per key: ``keys`` plus one column per entry of ``probs``.

    Rows without key or value are ignored. The rows are shuffled once; a group has one count per partition it lies in.
    """
    keys = list(keys)
    rows = in_order(C.filled(df, [*keys, value]).select(*keys, F.col(value).cast("double").alias("_v")), keys, "_v")
    whole = Window.partitionBy(*keys)
    chunks = (rows.groupBy(*keys, "_chunk").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
              .withColumn("_all", F.sum("_n").over(whole))
              .withColumn("_before", running(keys, F.col("_chunk"), "_n") - F.col("_n")))
    asks = []
    for name, prob in probs.items():
        position = F.lit(float(prob)) * (F.col("_all") - 1)
        for side, rank in (("low", F.floor(position)), ("high", F.ceil(position))):
            asks.append(F.struct(F.lit(name).alias("_prob"), F.lit(side).alias("_side"), rank.cast("bigint").alias("_rank"),
                                 (position - F.floor(position)).alias("_frac")))
    inside = F.filter(F.array(*asks), lambda x: (F.col("_before") <= x["_rank"]) & (x["_rank"] < F.col("_before") + F.col("_n")))
    wanted = (chunks.withColumn("_ask", F.explode(inside))
              .select((F.col("_first") + F.col("_ask._rank") - F.col("_before")).alias("_id"),
                      "_ask._prob", "_ask._side", "_ask._frac"))
    hits, aggs = rows.join(wanted, "_id"), []
    for name in probs:
        of = F.col("_prob") == name
        low = F.max(F.when(of & (F.col("_side") == "low"), F.col("_v")))
        high = F.max(F.when(of & (F.col("_side") == "high"), F.col("_v")))
        frac = F.max(F.when(of, F.col("_frac")))
        # between equal values, infinite ones too, there is nothing to interpolate
        aggs.append(F.when((frac == 0) | (low == high), low).otherwise(low + (high - low) * frac).alias(name))
    return hits.groupBy(*keys).agg(*aggs)


@dataclass(frozen=True)
class Wanted:
    """A rank of a column and the open range it lies in, which ``rows`` rows share and ``below`` rows come before (None: no bound)."""

    column: str
    rank: int
    rows: int
    low: float | None = None
    high: float | None = None
    below: int = 0

    @property
    def value(self) -> Column:
        return C.quoted(self.column).cast("double")

    @property
    def inside(self) -> Column:
        bounds = ([] if self.low is None else [self.value > F.lit(self.low)]) + (
            [] if self.high is None else [self.value < F.lit(self.high)])
        return reduce(Column.__and__, bounds, self.value.isNotNull())

    @property
    def shares(self) -> list[float]:
        """Where to ask a sketch of the range for bounds that hold the rank, whichever way the sketch errs."""
        at = (self.rank - self.below) / self.rows
        return [max(0.0, at - 2 / SKETCH_ACCURACY), min(1.0, at + 2 / SKETCH_ACCURACY)]


def one_row(df: DataFrame, aggregates: Sequence[Column]) -> Sequence:
    return df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggregates)]).first() if aggregates else []


def narrowed(df: DataFrame, asks: Sequence[Wanted], bounds: Sequence[Sequence[float]]) -> tuple[dict, list[Wanted]]:
    """The ranks that equal one of their bounds, with their values, and the others inside them: one scan that only counts.

    Bounds that miss their rank are dropped: what lies beyond them is searched instead.
    """
    counters = [F.count_if(one.inside & test) for one, (low, high) in zip(asks, bounds) for test in (
        one.value < F.lit(low), one.value == F.lit(low), one.value > F.lit(high), one.value == F.lit(high))]
    counts = one_row(df, counters)
    known, open_ = {}, []
    for i, (one, (low, high)) in enumerate(zip(asks, bounds)):
        less, at_low, more, at_high = counts[4 * i:4 * i + 4]
        place, end = one.rank - one.below, one.rows - more - (at_high if high != low else 0)
        if place < less:
            open_.append(replace(one, high=low, rows=less))
        elif place < less + at_low:
            known[one.column, one.rank] = low
        elif place < end:
            open_.append(replace(one, low=low, high=high, rows=end - less - at_low, below=one.below + less + at_low))
        elif place < one.rows - more:
            known[one.column, one.rank] = high
        else:
            open_.append(replace(one, low=high, rows=more, below=one.below + one.rows - more))
    return known, open_


def read_off(df: DataFrame, asks: Sequence[Wanted]) -> dict:
    """Values of ranks whose ranges hold at most ``FEW_ROWS`` rows: these rows only are shuffled, equal ones counted first."""
    if not asks:
        return {}
    places = F.create_map(*[F.lit(x) for i, one in enumerate(asks) for x in (i, one.rank - one.below)])
    entries = F.array(*[F.when(one.inside, F.struct(F.lit(i).alias("_ask"), one.value.alias("_v"))) for i, one in enumerate(asks)])
    cells = df.select(F.inline(F.filter(entries, lambda x: x.isNotNull()))).groupBy("_ask", "_v").agg(F.count("*").alias("_n"))
    upto, place = F.col("_upto"), places[F.col("_ask")]
    hits = (cells.withColumn("_upto", running(["_ask"], F.col("_v"), "_n"))
            .where((upto - F.col("_n") <= place) & (place < upto)).select("_ask", "_v"))
    return {(asks[i].column, asks[i].rank): value for i, value in hits.collect()}


def column_percentiles(df: DataFrame, names: Sequence[str], probs: Mapping[str, float],
                       also: Mapping[str, Sequence[Column]] | None = None) -> tuple[dict[str, dict[str, float]], dict[str, list]]:
    """Linear-interpolated percentiles of whole columns, exact: by column and name of the entry of ``probs``; and aggregates ``also``.

    Nothing is sorted but at most ``FEW_ROWS`` rows a rank. Mergeable sketches narrow every wanted rank down to a short
    range, a second scan counts what lies below and inside, and that goes on inside the range until it is short enough: each
    turn leaves less than a hundredth of the rows. Ranks that fall on a value of many rows are found by counting alone. Two numbers a rank
    reach the driver. ``df`` is scanned several times: it should be a stored table. Missing values are ignored, a column without values
    has no entry. NaN is the largest value.
    """
    slack = 2 / SKETCH_ACCURACY
    wide = [x for at in probs.values() for x in (max(0.0, at - slack), min(1.0, at + slack))]
    per_column, also = [], also or {}
    for name in names:
        value = C.quoted(name).cast("double")
        per_column.append([F.count(value), F.percentile_approx(value, wide, SKETCH_ACCURACY), *also.get(name, ())])
    row = iter(one_row(df, [a for aggregates in per_column for a in aggregates]))
    places, extra, asks, bounds = {}, {}, {}, {}
    for name, aggregates in zip(names, per_column):
        rows, sketch, *extra[name] = [next(row) for _ in aggregates]
        for i, (prob, at) in enumerate(probs.items() if rows else ()):
            places[name, prob] = float(at) * (rows - 1)
            for rank in {math.floor(places[name, prob]), math.ceil(places[name, prob])}:
                asks[name, rank], bounds[name, rank] = Wanted(name, rank, rows), sketch[2 * i:2 * i + 2]
    known, left = {}, list(asks.values())
    while left:
        known |= read_off(df, [one for one in left if one.rows <= FEW_ROWS])
        long = [one for one in left if one.rows > FEW_ROWS]
        if long and not bounds:
            found = one_row(df, [F.percentile_approx(F.when(one.inside, one.value), one.shares, SKETCH_ACCURACY) for one in long])
            bounds = {(one.column, one.rank): pair for one, pair in zip(long, found)}
        more, left = narrowed(df, long, [bounds[one.column, one.rank] for one in long])
        known, bounds = known | more, {}
    result = {}
    for (name, prob), place in places.items():
        low, high = known[name, math.floor(place)], known[name, math.ceil(place)]
        # between equal values, infinite ones too, there is nothing to interpolate
        result.setdefault(name, {})[prob] = low if low == high or place == math.floor(place) else low + (high - low) * (place - math.floor(place))
    return result, extra


def top_share(cells: DataFrame, keys: Sequence[str], value: str, users: str, size, integral: bool,
              also: Sequence[Column] = ()) -> DataFrame:
    """Sum of the ``size(users)`` largest values per key, from a histogram of values.

    ``cells`` has one row per (keys, value) with the number of users at that value. Sorting the
    histogram instead of the users keeps a hot key small: whole-numbered values of sum S have fewer
    than ``sqrt(2 S)`` distinct values. Fractional values have no such bound, so their histogram is
    put in order over evenly filled partitions, and running sums start anew in each.

    Returns keys, ``_top`` (sum over the top users) and the aggregates ``also`` of the histogram. Ties
    do not matter: equal values add equally.
    """
    keys = list(keys)
    if integral:
        cut = size(F.sum(users).over(Window.partitionBy(*keys)))
        upto = running(keys, F.col(value).desc(), users)
        placed = cells.withColumn("_cut", cut).withColumn("_upto", upto)
    else:
        cells = in_order(cells, keys, value, descending=True)
        chunks = (cells.groupBy(*keys, "_chunk").agg(F.sum(users).alias("_n"))
                  .withColumn("_cut", size(F.sum("_n").over(Window.partitionBy(*keys))))
                  .withColumn("_before", running(keys, F.col("_chunk"), "_n") - F.col("_n")))
        upto = F.col("_before") + running([*keys, "_chunk"], F.col("_id"), users)
        placed = cells.join(chunks.drop("_n"), [*keys, "_chunk"]).withColumn("_upto", upto)
    taken = F.least(F.col(users), F.greatest(F.lit(0), F.col("_cut") - (F.col("_upto") - F.col(users))))
    return placed.groupBy(*keys).agg(F.sum(taken * F.col(value)).alias("_top"), *also)
