"""Quality rules with adaptive thresholds.

Every whole text is measured once. Documents that break a base rule go. For the others each measure is put into a
logarithmic histogram per language and source: a quantile sketch of known relative error whose merging is the sum of
counts, so that partial sketches combine before the shuffle, sources merge into languages and languages into one.
A document is kept if no measure lies beyond the fences of its group: its language and source, or the language, or all
documents where a group has fewer than ``least`` documents. All fences come from the group's sketches:

* The word length has fences at the median +/- ``spread`` quartile distances, wider for short texts, whose mean scatters by
  the group's median over the root of their words.
* The rates (symbols, capitals, repeats, ..) are zero for most documents, so their quartiles say nothing, and their highest
  quantiles are those of the junk. Their fence lies in the lowest valley of the sketch above the third quartile: a stretch
  of factor ``VALLEY`` with ``DEEP`` times fewer documents than lie beyond it. A sketch that only falls off has no valley and no fence.
  Zero stands at the group's resolution, one occurrence in a text of median size.

The thresholds are a small table that is joined to the documents.

Edge cases: a null text has no words and fails; null language or source form groups of their own; an empty table gives
no rows; repeated rows get the same result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from viewtide.llm import common

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
GAMMA = 1.02
#: measure with fences by quartiles, on both sides
QUARTILES = "word_length"
#: rate: the size that it is a share of
RATES = {"symbols_per_word": "n_words", "capitals": "n_words", "dup_lines": "n_lines", "repeated": "n_words",
         "exclamations": "n_words"}
VALLEY, DEEP = 8.0, 10
BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
SCHEMA = BASE + "n_lines bigint, n_capitals bigint, n_exclamations bigint"
SYMBOLS = b"#*$%&|<>"
#: The lengths of words scatter by about half their mean: fences are four times that / sqrt(words) wider.
SCATTER = 2.0
ZERO = -1_000_000


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows found twice or more, the first included."""
    windows = list(zip(*[words[k:] for k in range(window)]))
    if len(set(windows)) == len(windows):
        return 0
    found = Counter(windows)
    starts = np.array([k for k, w in enumerate(windows) if found[w] > 1])
    steps = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(steps[:-1])))


def measure(text: bytes | None) -> tuple[int, ...]:
    """The counts of SCHEMA for one text."""
    if not text:
        return (0,) * 8
    words = text.split()
    if not words:
        return (0,) * 8
    chars = sum(map(len, words))
    if not text.isascii():
        chars -= len(text.translate(None, ASCII_AND_HEADS))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    capitals = sum(map(bytes.isupper, words))
    return len(words), chars, symbols, dup_lines, repeats, len(lines), capitals, text.count(b"!")


#: All bytes that are not UTF-8 continuation bytes.
ASCII_AND_HEADS = bytes(b for b in range(256) if not 0x80 <= b < 0xC0)


def measured(docs: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and the counts of every whole text; texts go through Python in batches, one task holds one batch."""
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batch):
        rows = list(zip(*map(measure, common.text_bytes(batch["text"]))))
        return {k: batch[k] for k in keys} | dict(zip(names, rows))

    return common.arrow_map(docs.select(*keys, "text"), run, "".join(f"{k} {types[k]}, " for k in keys) + SCHEMA)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def values() -> dict[str, Column]:
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return {"symbols_per_word": F.col("n_symbols") / words, "word_length": F.col("word_chars") / words,
            "capitals": F.col("n_capitals") / words, "dup_lines": F.col("n_dup_lines") / lines,
            "repeated": F.col("n_repeat_words") / words, "exclamations": F.col("n_exclamations") / words}


def bucket(value: Column) -> Column:
    """Logarithmic bucket of a value of at least 0; small ones share the lowest."""
    return F.when(value < 1e-4, F.lit(ZERO)).otherwise(F.floor(F.log(value) / F.log(F.lit(GAMMA)))).cast("int")


def middle(column: Column) -> Column:
    return F.when(column == ZERO, F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), column + 0.5))


def sketches(rows: DataFrame) -> DataFrame:
    """Histogram per (lang, source, measure or size): n documents by bucket. Bounded by groups x buckets, not by documents."""
    measures = values() | {size: F.col(size) for size in set(RATES.values())}
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(v).alias("bucket"))
                                for m, v in sorted(measures.items())]))
    return (rows.where(~base_failed()).select("lang", "source", pairs.alias("x"))
            .groupBy("lang", "source", "x.measure", "x.bucket").agg(F.count("*").alias("n")))


def merged(sketch: DataFrame, *by: str) -> DataFrame:
    """Sketches merged to a coarser group: the sum of the counts."""
    return sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, by: list[str], spread: float) -> DataFrame:
    """Limits of every measure, one row per group, and its number of documents. A rate without a valley has no limit."""
    group, one = Window.partitionBy(*by), Window.partitionBy(*by, "measure")
    so_far = F.sum("n").over(one.orderBy("bucket").rangeBetween(Window.unboundedPreceding, 0))
    at = lambda q: F.min(F.when(F.col("so_far") >= q * F.col("total"), F.col("bucket")))
    ranked = sketch.withColumn("so_far", so_far).withColumn("total", F.sum("n").over(one)).withColumn("mid", at(0.5).over(one))
    # one occurrence in a text of median size
    resolution = {size: F.max(F.when(F.col("measure") == size, -F.col("mid") - 1)).over(group) for size in set(RATES.values())}
    ranked = ranked.withColumns({f"{size}_one": c for size, c in resolution.items()})
    lowest = F.coalesce(*[F.when(F.col("measure") == m, F.col(f"{size}_one")) for m, size in RATES.items()])
    placed = ranked.withColumn("place", F.greatest("bucket", lowest))
    wide = round(math.log(VALLEY) / math.log(GAMMA))
    along = one.orderBy("place")
    count = lambda first, last: F.coalesce(F.sum("n").over(along.rangeBetween(first, last)), F.lit(0))
    valley = ((count(Window.unboundedPreceding, 0) >= 0.75 * F.col("total"))
              & (count(wide + 1, Window.unboundedFollowing) >= DEEP * (count(1, wide) + 1)))
    placed = placed.withColumn("fence", F.when(valley, F.pow(F.lit(GAMMA), F.col("place") + 1 + wide / 2)))
    quartile = lambda q: middle(F.min(F.when(
        (F.col("measure") == QUARTILES) & (F.col("so_far") >= q * F.col("total")), F.col("bucket"))))
    width = spread * (quartile(0.75) - quartile(0.25))
    return placed.groupBy(*by).agg(
        F.max("total").alias("documents"), quartile(0.5).alias("word_length_mid"),
        (quartile(0.5) - width).alias("word_length_low"), (quartile(0.5) + width).alias("word_length_high"),
        *[F.min(F.when(F.col("measure") == m, F.col("fence"))).alias(f"{m}_high") for m in RATES])


LIMITS = ["word_length_mid", "word_length_low", "word_length_high", *[f"{m}_high" for m in RATES]]


def thresholds(rows: DataFrame, spread: float = 6.0, least: int = 500) -> DataFrame:
    """One row per (lang, source) with the fences that hold for it and the level they come from. ``rows``: lang, source and
    the counts."""
    fine = common.stage(sketches(rows), "quality-sketch")
    by_lang, everything = merged(fine, "lang"), merged(fine)
    groups = rows.select("lang", "source").distinct()
    a = fences(fine, ["lang", "source"], spread).alias("a")
    b = fences(by_lang, ["lang"], spread).alias("b")
    c = fences(everything, [], spread).first()  # one row
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    joined = (groups.alias("g").join(a, same("g.lang", "a.lang") & same("g.source", "a.source"), "left")
              .join(b, same("g.lang", "b.lang"), "left"))
    own, lang = F.col("a.documents") >= least, F.col("b.documents") >= least
    pick = lambda x: (F.when(own, F.col(f"a.{x}")).when(lang, F.col(f"b.{x}"))
                      .otherwise(F.lit(c[x]).cast("double")).alias(x))
    return joined.select("g.lang", "g.source", F.when(own, "source").when(lang, "lang").otherwise("all").alias("level"),
                         *map(pick, LIMITS))


def verdict(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """The rows with base_failed, kept and the names of the measures beyond their fences."""
    limits = limits.withColumnsRenamed({"lang": "limit_lang", "source": "limit_source"})
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("limit_lang"))
                       & F.col("source").eqNullSafe(F.col("limit_source")), "left")
    slack = SCATTER * F.col("word_length_mid") / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    each = values()
    length = each[QUARTILES]
    beyond = [F.when((length > F.col("word_length_high") + slack) | (length < F.col("word_length_low") - slack), F.lit(QUARTILES)),
              *[F.when(each[m] > F.col(f"{m}_high"), F.lit(m)) for m in RATES]]
    joined = joined.withColumn("beyond", F.concat_ws(",", *beyond)).withColumn("base_failed", base_failed())
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("beyond") == ""))


def quality(docs: DataFrame, spread: float = 6.0, least: int = 500) -> DataFrame:
    """doc_id, the counts, base_failed, kept, beyond. ``docs``: doc_id, text, lang, source."""
    rows = common.stage(measured(common.pick(docs, "doc_id", "text", "lang", "source"), "doc_id", "lang", "source"),
                        "quality-counts")
    return verdict(rows, common.stage(thresholds(rows, spread, least), "quality-limits")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "beyond")


def kept_documents(docs: DataFrame, spread: float = 6.0, least: int = 500) -> DataFrame:
    """The documents that pass, with all their columns. Counts are taken anew beside the text, so no text is shuffled."""
    flat = common.numbered(docs)
    at = {n: f"c{common.position(docs, n)}" for n in ("text", "lang", "source")}
    rows = common.stage(measured(common.pick(docs, "text", "lang", "source"), "lang", "source"), "quality-counts")
    limits = common.stage(thresholds(rows, spread, least), "quality-limits")
    counts = F.arrow_udf(counted, SCHEMA)
    with_counts = flat.withColumn("m", counts(at["text"])).select(
        "*", "m.*", F.col(at["lang"]).alias("lang"), F.col(at["source"]).alias("source"))
    kept = verdict(with_counts, limits).where("kept")
    return kept.select(*flat.columns).toDF(*docs.columns)


def counted(texts):
    """The counts of SCHEMA for a batch of texts, as a struct."""
    rows = [measure(t) for at in range(0, len(texts), 500) for t in common.text_bytes(texts.slice(at, 500))]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    columns = list(zip(*rows)) or [[]] * len(names)
    return pa.StructArray.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=names)
