"""Matches of regular expressions with their places, by SQL functions alone.

``split`` gives the text between the matches and ``regexp_extract_all`` the matches, so the lengths of both, summed in
order, are the places. Only lengths, matches and a few characters around them leave the row; texts are not shuffled.
Places count code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from viewtide.llm import common

BEFORE, AFTER = 40, 20


def matched(text: Column, pattern: str) -> Column:
    """gaps: length and edges of the texts before, between and after the matches; found: the matches."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.struct(
        F.length(x).alias("size"), F.lower(F.right(x, F.lit(BEFORE))).alias("before"),
        F.lower(F.left(x, F.lit(AFTER))).alias("after")))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.struct(gaps.alias("gaps"), found.alias("found"))


def scan(docs: DataFrame, patterns: dict[str, str], label: str) -> DataFrame:
    """row, doc_id and the matches of every kind, stored. ``row`` tells apart rows that repeat a doc_id."""
    text = common.whole_text()
    rows = common.pick(docs, "doc_id", "text").select(
        F.monotonically_increasing_id().alias("row"), "doc_id", *[matched(text, p).alias(k) for k, p in patterns.items()])
    some = [F.when(F.size(F.col(f"{k}.found")) > 0, F.col(k)).alias(k) for k in patterns]
    return common.stage(rows.select("row", "doc_id", *some), label)


def placed(scanned: DataFrame, kinds: list[str]) -> DataFrame:
    """One row per match: row, kind, rank (place of the kind in ``kinds``), start, end, found, before, after."""
    all_kinds = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(i).alias("rank"), F.col(f"{k}.gaps").alias("gaps"),
                                            F.col(f"{k}.found").alias("found")) for i, k in enumerate(kinds)]),
                         lambda x: x["found"].isNotNull())
    each = scanned.select("row", F.explode(all_kinds).alias("x"))
    after = F.slice("x.gaps", F.lit(2), F.size("x.found"))
    gap = F.slice("x.gaps", F.lit(1), F.size("x.found"))
    one = each.select("row", "x.kind", "x.rank", F.posexplode(F.arrays_zip(
        gap.alias("gap"), F.col("x.found").alias("found"), after.alias("next"))).alias("i", "m"))
    order = Window.partitionBy("row", "kind").orderBy("i")
    end = F.sum(F.col("m.gap.size") + F.length("m.found")).over(order)
    return one.select("row", "kind", "rank", (end - F.length("m.found")).alias("start"), end.alias("end"),
                      F.col("m.found").alias("found"), F.col("m.gap.before").alias("before"),
                      F.col("m.next.after").alias("after"))


def listed(order: list[str], which: Column | None = None) -> Column:
    """kind:start:end of a group's spans, sorted by ``order`` and comma-joined."""
    fields = F.struct(*order, F.concat_ws(":", "kind", "start", "end").alias("text"))
    spans = F.collect_list(fields if which is None else F.when(which, fields))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: x["text"]), ",")


def apart(spans: DataFrame) -> DataFrame:
    """The spans without those others that overlap a base one of their row."""
    order = Window.partitionBy("row").orderBy("start", F.col("base").desc(), "rank")
    before = F.max(F.when(F.col("base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    marked = spans.withColumn("up_to", before).withColumn("from", after)
    clear = (F.coalesce(F.col("up_to") <= F.col("start"), F.lit(True))
             & F.coalesce(F.col("from") >= F.col("end"), F.lit(True)))
    return marked.where(F.col("base") | clear).drop("up_to", "from")
