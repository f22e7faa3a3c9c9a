"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters and digits in lower case; in scripts written without blanks every character is one. Rolling (Karp-Rabin) hashes of every ``seed`` tokens of the
benchmark items meet those of the documents in an equi-join. Before the join a bitmap of fixed size drops document seeds
that no item can have; it lets through some others, which the join drops. The hits of a document and an item lie on
diagonals; consecutive hits are one match. Tiling marks the longest match whose tokens are all unmarked, again and again,
until none of ``seed`` tokens is left, so passages in another order count in full. A document leaks an item if its tiles
cover at least ``coverage`` of the item's tokens.

An item of fewer than ``seed`` tokens is one seed of its own length: documents that hold all of it in a row leak it.

Edge cases: null and empty texts have no tokens; items without tokens cannot be found; rows without
doc_id or item_id are not searched; rows of one id are searched as one document; equal matches are marked from the item's
begin on; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, functions as F

from viewtide.llm import common

SEED, COVERAGE = 5, 0.5
#: Bits of the bitmap: 2 MB whatever the benchmark's size.
BITMAP_BITS = 1 << 24
TOKEN = re.compile(r"[^\W_]+")
#: Blocks of scripts written without blanks (Thai and Lao, Burmese, Khmer, kana, Han).
SOLID = ("\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
         "\U00020000-\U0003ffff")
SOLID_CHARACTER = re.compile(f"[{SOLID}]")
MIXED_TOKEN = re.compile(rf"[{SOLID}]|(?:(?![{SOLID}])[^\W_])+")
LEAKS = "doc_id bigint, item_id bigint, item_tokens int, matched_tokens int, n_tiles int, coverage double"


@functools.cache
def hasher() -> common.WordHashes:
    return common.WordHashes()


def tokens(text: str | None) -> list[bytes]:
    text = (text or "").lower()
    plain = text.isascii() or not SOLID_CHARACTER.search(text)
    return [w.encode() for w in (TOKEN if plain else MIXED_TOKEN).findall(text)]


def seeds_of(text: str | None, seed: int) -> tuple[int, np.ndarray]:
    """Number of tokens, and the hash of each window of ``seed`` tokens; of all tokens if they are fewer."""
    words = tokens(text)
    return len(words), common.shingles(hasher().of(words), seed)


def item_seeds(benchmark: DataFrame, seed: int) -> DataFrame:
    """seed, item_id, ipos, item_tokens of every item."""
    def run(batch):
        out = defaultdict(list)
        for item, text in zip(batch["item_id"].to_pylist(), batch["text"]):
            n, found = seeds_of(text.as_py(), seed)
            if item is not None and len(found):
                out["seed"] += found.view(np.int64).tolist()
                out["ipos"] += range(len(found))
                out["item_id"] += [item] * len(found)
                out["item_tokens"] += [n] * len(found)
        return out or None

    return common.arrow_map(common.pick(benchmark, "item_id", "text"), run,
                            "seed bigint, item_id bigint, ipos int, item_tokens int").distinct()


def bitmap(seeds: DataFrame) -> np.ndarray:
    """BITMAP_BITS bits in words of 64; at most BITMAP_BITS / 64 rows reach the driver."""
    bit = F.col("seed").bitwiseAND(F.lit(BITMAP_BITS - 1))
    one = F.expr("shiftleft(1L, cast(bit & 63 as int))")
    rows = (seeds.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word"))
            .agg(F.bit_or(one).alias("bits")).collect())
    words = np.zeros(BITMAP_BITS // 64, dtype=np.int64)
    for r in rows:
        words[r["word"]] = r["bits"]
    return words.view(np.uint64)


def document_seeds(docs: DataFrame, bits: np.ndarray, seed: int, sizes: list[int]) -> DataFrame:
    """seed, doc_id, dpos of those seeds of the whole texts that the bitmap has. ``sizes``: lengths of the items' seeds.

    Of a seed shorter than ``seed``, which is a whole item, the first place is enough.
    """
    def run(batch):
        out = defaultdict(list)
        for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
            if doc is None:
                continue
            hashes = hasher().of(tokens(text.as_py()))
            for size in sizes:
                if len(hashes) < size:
                    continue
                found = common.shingles(hashes, size)
                bit = found & np.uint64(BITMAP_BITS - 1)
                at = np.flatnonzero((bits[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1))
                if size < seed:
                    at = at[np.unique(found[at], return_index=True)[1]]
                if len(at):
                    out["seed"] += found[at].view(np.int64).tolist()
                    out["dpos"] += at.tolist()
                    out["doc_id"] += [doc] * len(at)
        return out or None

    return common.arrow_map(common.pick(docs, "doc_id", "text"), run, "seed bigint, doc_id bigint, dpos int",
                            lambda: hasher().known.clear())


def matches(hits: list[tuple[int, int]], seed: int) -> list[tuple[int, int, int]]:
    """(length, ipos, dpos) of the maximal matches: runs of hits on a diagonal."""
    diagonals = defaultdict(list)
    for dpos, ipos in set(hits):
        diagonals[dpos - ipos].append(ipos)
    found = []
    for away, starts in diagonals.items():
        starts.sort()
        first = last = starts[0]
        for i in starts[1:]:
            if i > last + 1:
                found.append((last - first + seed, first, first + away))
                first = i
            last = i
        found.append((last - first + seed, first, first + away))
    return found


def tile(hits: list[tuple[int, int]], seed: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (ipos, dpos, length): the longest match of unmarked tokens first."""
    heap = [(-n, i, d) for n, i, d in matches(hits, seed)]
    heapq.heapify(heap)
    item_marks, doc_marks, tiles = set(), set(), []
    while heap:
        n, i, d = heapq.heappop(heap)
        n = -n
        free = [k for k in range(n) if i + k not in item_marks and d + k not in doc_marks]
        if len(free) == n:
            tiles.append((i, d, n))
            item_marks.update(range(i, i + n))
            doc_marks.update(range(d, d + n))
            continue
        start = 0
        for k in range(1, len(free) + 1):
            if k == len(free) or free[k] != free[k - 1] + 1:
                if k - start >= seed:
                    heapq.heappush(heap, (start - k, i + free[start], d + free[start]))
                start = k
    return tiles


def leaks(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """One row per document and item that it leaks."""
    items = common.stage(item_seeds(benchmark, seed), "item-seeds")
    sizes = items.select(F.least("item_tokens", F.lit(seed)).alias("size")).distinct()  # at most ``seed`` of them
    hits = document_seeds(docs, bitmap(items), seed, sorted(r["size"] for r in sizes.collect())).distinct().join(items, "seed")
    pairs = (hits.groupBy("doc_id", "item_id").agg(
        F.max("item_tokens").alias("item_tokens"), F.collect_list(F.struct("dpos", "ipos")).alias("hits"))
        # hits at n places of an item cover at most n * seed tokens
        .where(F.size(F.array_distinct("hits.ipos")) * seed >= coverage * F.col("item_tokens")))

    def run(batch):
        out = defaultdict(list)
        for doc, item, n, found in zip(*(batch[c].to_pylist() for c in ("doc_id", "item_id", "item_tokens", "hits"))):
            tiles = tile([(h["dpos"], h["ipos"]) for h in found], min(seed, n))
            matched = sum(t[2] for t in tiles)
            if matched >= coverage * n:
                for name, value in zip(("doc_id", "item_id", "item_tokens", "matched_tokens", "n_tiles", "coverage"),
                                       (doc, item, n, matched, len(tiles), matched / n)):
                    out[name].append(value)
        return out or None

    return common.arrow_map(pairs, run, LEAKS)


def clean_documents(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """The documents that leak no item, with all their columns."""
    found = common.stage(leaks(docs, benchmark, seed, coverage).select(F.col("doc_id").alias("leaking")).distinct(), "leaks")
    flat = common.numbered(docs)
    return flat.join(found, flat[f"c{common.position(docs, 'doc_id')}"] == found["leaking"], "left_anti").toDF(*docs.columns)
