"""Language identification by rank-order profiles of character n-grams.

A language's profile is its ``size`` most frequent n-grams (n of 1 to 3, inside words, a blank at each word end) in rank
order. A text's own most frequent n-grams are ranked the same way; its distance to a language is the sum over its n-grams
of how far each lies out of place, ``size`` for one that the profile lacks. The nearest language is predicted. Equal
counts share their mean rank in a text, so short texts, in which most n-grams occur once, are not ordered by accident.

N-grams are counted over all texts to learn from: each task sums its own, Spark sums the rest. The profiles (languages x
``size`` rows) are the only thing collected.

Edge cases: null texts and texts without a letter are ``und`` with score 0, as is everything when there is nothing to
learn from; equal distances go to the language first in the alphabet; a null doc_id is neither held out nor learned from;
rows repeated count as often as they occur; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from viewtide.llm import common

BLANK, BITS = 1, 21
SLICE = 1_000_000
SUMS = 2_000_000


@functools.cache
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def codes(text: str) -> np.ndarray:
    """Lower-case letters as numbers, runs of anything else as one blank, a blank at both ends."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    word = letters()[raw]
    out = np.empty(len(raw) + 2, dtype=np.int64)
    out[0] = out[-1] = BLANK
    out[1:-1] = np.where(word, raw, BLANK)
    keep = np.empty(len(out), dtype=bool)
    keep[0] = True
    keep[1:] = (out[1:] != BLANK) | (out[:-1] != BLANK)
    return out[keep]


def grams(c: np.ndarray) -> np.ndarray:
    """All n-grams as numbers: n times 21 bits."""
    one = c[c != BLANK]
    two = (c[:-1] << BITS) | c[1:]
    three = ((two[:-1] << BITS) | c[2:])[c[1:-1] != BLANK]
    return np.concatenate([one, two, three])


def top(text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams of a text and their ranks; n-grams of one count share the mean of their ranks."""
    found, n = np.unique(grams(codes(text)), return_counts=True)
    order = np.argsort(-n, kind="stable")[:size]
    n = n[order]
    starts = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]]))
    ends = np.append(starts[1:], len(n))
    return found[order], np.repeat((starts + ends - 1) / 2.0, ends - starts)


class Sums:
    """Counts of n-grams per language; given out when too many to hold, and at the end."""

    def __init__(self):
        self.parts: dict[str, list] = {}
        self.sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, lang: str, c: np.ndarray) -> None:
        part = self.parts.setdefault(lang, [])
        part.append(c)
        if sum(map(len, part)) >= SLICE:
            self.flush(lang)

    def flush(self, lang: str) -> None:
        found, n = np.unique(grams(np.concatenate(self.parts.pop(lang))), return_counts=True)
        if lang in self.sums:
            a, b = self.sums[lang]
            found, place = np.unique(np.concatenate([a, found]), return_inverse=True)
            n = np.bincount(place, weights=np.concatenate([b, n])).astype(np.int64)
        self.sums[lang] = found, n

    def rows(self):
        for lang in list(self.parts):
            self.flush(lang)
        for lang, (found, n) in self.sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(found), pa.array(n)],
                                             names=["lang", "gram", "n"])
        self.sums = {}


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, gram, n over whole texts of ``docs`` (lang, text)."""
    def run(batches):
        sums = Sums()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums.add(lang, codes(text.as_py()))
            if sum(len(x) for x, _ in sums.sums.values()) > SUMS:
                yield from sums.rows()
        yield from sums.rows()

    parts = docs.where("lang is not null and text is not null").select("lang", "text").mapInArrow(
        run, "lang string, gram bigint, n bigint")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Profiles:
    """Ranks of n-grams by language: one table of all n-grams of all profiles."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        self.grams = np.array(sorted({r[1] for r in rows}), dtype=np.int64)
        self.ranks = np.full((len(self.grams), len(self.langs)), np.inf)
        place = {g: i for i, g in enumerate(self.grams.tolist())}
        for lang, gram, rank in rows:
            self.ranks[place[gram], self.langs.index(lang)] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return "und", 0.0
        mine, rank = top(text, self.size)
        if not len(mine) or (len(mine) == 1 and mine[0] == (BLANK << BITS | BLANK)):
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.grams, mine), len(self.grams) - 1)
        ranks = np.where((self.grams[at] == mine)[:, None], self.ranks[at], np.inf)
        away = np.minimum(np.abs(ranks - rank[:, None]), self.size).sum(axis=0)
        best = int(np.argmin(away))
        return self.langs[best], float(1.0 - away[best] / (self.size * len(mine)))


def learn(docs: DataFrame, size: int = 400) -> Profiles:
    """Profiles from ``docs`` (lang, text)."""
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    ranked = count_grams(docs).withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size)
    return Profiles([(r.lang, r.gram, r.rank) for r in ranked.select("lang", "gram", "rank").collect()], size)


def predict(docs: DataFrame, profiles: Profiles, *keys: str) -> DataFrame:
    """``keys``, lang_pred and score for every whole text."""
    types = dict(docs.dtypes)

    def run(batch):
        found = [profiles.predict(t.as_py()) for t in batch["text"]]
        return {k: batch[k] for k in keys} | {"lang_pred": [x[0] for x in found], "score": [x[1] for x in found]}

    return common.arrow_map(docs.select(*keys, "text"), run,
                            "".join(f"{k} {types[k]}, " for k in keys) + "lang_pred string, score double")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, size: int = 400) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from those that are not held out."""
    rows = common.pick(docs, "doc_id", "text", "lang").withColumn("held_out", held_out())
    profiles = learn(rows.where("doc_id is not null and not held_out"), size)
    return predict(rows, profiles, "doc_id", "held_out")
