"""Phrase collocations by set-oriented (relational) mining.

The occurrences of words are a stored relation, sorted by piece and position. Phrases of one more word come from a merge
join of the last relation with itself at adjacent positions (a phrase can only be frequent if what it has without its
last, and without its first word is), are counted as groups, and occurrences of groups that are not frequent leave the
relation by a semi-join before the next length. The merge join runs inside the blocks of the relation, as a piece's
occurrences are adjacent; the group counts are Spark's.

Most phrases are rare, so groups are first counted by a hash of ``HASH_BITS`` bits, and the semi-join goes through a bitmap of the
frequent hashes of at most ``MOST_BITS`` bits, whatever their number. Both can only let through too much: what is left is
counted by the phrases themselves, and these counts, which are exact, are the result.

Edge cases: null texts are empty; a null language is ``und``; empty texts and pieces give nothing; repeated rows
count as often as they occur; a text longer than a block goes on in the next one, which repeats its last words as context;
empty tables give no rows; equal scores are ordered by count, then by phrase; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from viewtide.llm import common

LONGEST, LEAST, TOP = 4, 30, 2000
#: Words of a block, different words a task holds, rows of a batch of counts.
BLOCK, WORDS, ROWS = 1_000_000, 250_000, 100_000
#: Hashes of groups are short, so that they travel cheaply.
HASH_BITS = 40
#: The bitmap of frequent phrases is at most 16 MB.
MOST_BITS = 1 << 27
END, CUT = 0, b"\xff"
RELATION = "lang string, context int, own bigint, words binary, ids binary, starts binary"

FOLD = bytearray(common.LOWER_ASCII)
for _b in b".,;:!?\n\x0b\x0c\r":
    FOLD[_b] = CUT[0]
FOLD = bytes(FOLD)
GAP = re.compile(rb"[ \t\xff]")


def piece_words(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text and ``CUT`` between its pieces, in lists from about ``size`` bytes."""
    folded, at = text.translate(FOLD), 0
    while at < len(folded):
        gap = GAP.search(folded, at + size)
        upto = gap.start() if gap else len(folded)
        yield folded[at:upto].replace(CUT, b" \xff ").split()
        at = upto


class Blocks:
    """Collects the words of many texts per language and gives them out as blocks of the relation."""

    def __init__(self, longest: int, block: int = BLOCK, most_words: int = WORDS):
        self.longest, self.block, self.most_words = longest, block, most_words
        self.parts: dict[str, list[np.ndarray]] = defaultdict(list)
        self.size: dict[str, int] = defaultdict(int)
        self.context: dict[str, int] = {}
        self.forget()

    def forget(self) -> None:
        self.known, self.names = {CUT: END}, [CUT]

    def encode(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.array([known[w] for w in words], dtype=np.int32)
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = len(self.names)
                    self.names.append(w)
            return np.array([known[w] for w in words], dtype=np.int32)

    def add(self, lang: str, text: bytes) -> Iterator[pa.RecordBatch]:
        for words in piece_words(text):
            self.put(lang, self.encode(words))
            yield from self.full(lang)
        self.put(lang, np.array([END], dtype=np.int32))

    def put(self, lang: str, ids: np.ndarray) -> None:
        self.parts[lang].append(ids)
        self.size[lang] += len(ids)

    def full(self, lang: str) -> Iterator[pa.RecordBatch]:
        if self.size[lang] >= self.block:
            tail = yield from self.flush(lang)
            self.resume(lang, tail)
        if len(self.names) > self.most_words:
            tails = {}
            for each in list(self.parts):
                tails[each] = yield from self.flush(each)
            self.forget()
            for each, tail in tails.items():
                self.resume(each, tail)

    def resume(self, lang: str, tail: list[bytes]) -> None:
        """The next block begins with the last words of a piece that goes on."""
        if tail:
            self.put(lang, self.encode(tail))
            self.context[lang] = len(tail)

    def flush(self, lang: str):
        ids, context = np.concatenate(self.parts.pop(lang)), self.context.pop(lang, 0)
        del self.size[lang]
        tail = []
        for i in ids[:-self.longest:-1].tolist():
            if i == END:
                break
            tail.append(self.names[i])
        if len(ids) > context:
            yield block(lang, context, ids, self.names)
        return tail[::-1]

    def rest(self) -> Iterator[pa.RecordBatch]:
        for lang in list(self.parts):
            yield from self.flush(lang)


def block(lang: str, context: int, ids: np.ndarray, names: list[bytes], starts: np.ndarray | None = None) -> pa.RecordBatch:
    """A row of the relation; its words are numbered anew, without those that no longer occur."""
    used, ids = np.unique(np.append(ids, END), return_inverse=True)
    ids = ids[:-1].astype(np.int32)
    words = [names[i] for i in used.tolist()]
    words[END] = b""
    if starts is None:
        starts = np.flatnonzero(ids != END)
    begins = np.zeros(len(ids), dtype=bool)
    begins[starts] = True
    packed = [b"\n".join(words), ids.tobytes(), np.packbits(begins).tobytes()]
    return pa.RecordBatch.from_arrays(
        [pa.array([lang]), pa.array([context], type=pa.int32()), pa.array([int((ids[context:] != END).sum())], type=pa.int64()),
         *[pa.array([x], type=pa.binary()) for x in packed]], names=["lang", "context", "own", "words", "ids", "starts"])


def occurrences(docs: DataFrame, longest: int = LONGEST, block_words: int = BLOCK, most_words: int = WORDS) -> DataFrame:
    """The relation of single words: a row per block; ``starts`` are the sorted positions at which a phrase begins."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(longest, block_words, most_words)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from blocks.add(lang, text.as_buffer().to_pybytes())
        yield from blocks.rest()

    rows = common.pick(docs, "lang", "text").select(F.coalesce("lang", F.lit("und")).alias("lang"), common.whole_text().alias("text"))
    return rows.mapInArrow(run, RELATION)


class Row:
    """One block of the relation, ready for the next length."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        self.lang, self.context = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
        self.words = batch.column(3)[i].as_py().split(b"\n")
        self.ids = np.frombuffer(batch.column(4)[i].as_buffer(), dtype=np.int32)
        self.starts = np.flatnonzero(np.unpackbits(np.frombuffer(batch.column(5)[i].as_buffer(), dtype=np.uint8), count=len(self.ids)))

    def joined(self, k: int) -> np.ndarray:
        """Sorted positions of k-word phrases whose parts of k - 1 words both are in the relation: the merge join."""
        return self.starts if k == 1 else self.starts[:-1][np.diff(self.starts) == 1]

    def hashes(self, starts: np.ndarray, k: int) -> np.ndarray:
        """A hash of the language and the words of each occurrence."""
        known = np.array([xxhash.xxh3_64_intdigest(w) for w in self.words], dtype=np.uint64)
        out = np.full(len(starts), xxhash.xxh3_64_intdigest(self.lang), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                out = common.mix(out * np.uint64(0x9E3779B97F4A7C15) + known[self.ids[starts + j]])
        return out >> np.uint64(64 - HASH_BITS)

    def groups(self, starts: np.ndarray, k: int) -> tuple[list[bytes], np.ndarray]:
        """The different phrases of k words at these places, and how often each occurs."""
        group, first = self.ids[starts].astype(np.int64), starts
        for j in range(1, k + 1):
            _, at, group = np.unique(group, return_index=True, return_inverse=True)
            first = starts[at]
            if j < k:
                group = (group.astype(np.int64) << 32) | self.ids[starts + j]
        parts = [[self.words[i] for i in self.ids[first + j].tolist()] for j in range(k)]
        return [b" ".join(p) for p in zip(*parts)], np.bincount(group, minlength=len(first))

    def only(self, starts: np.ndarray, k: int) -> pa.RecordBatch:
        """The row with these occurrences of k words; what they do not cover shrinks to single gaps."""
        inside = np.zeros(len(self.ids) + 1, dtype=np.int32)
        inside[starts] += 1
        inside[starts + k] -= 1
        ids = np.where(np.cumsum(inside[:-1]) > 0, self.ids, END)
        stays = np.ones(len(ids), dtype=bool)
        stays[1:] = (ids[1:] != END) | (ids[:-1] != END)
        place = np.cumsum(stays) - 1
        return block(self.lang, int(stays[:self.context].sum()), ids[stays], self.words, place[starts])


def counted(relation: DataFrame, k: int) -> DataFrame:
    """h, n: how often each hash of a k-word phrase of the merge join occurs; equal phrases have equal hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = Row(batch, i)
                starts = row.joined(k)
                h, n = np.unique(row.hashes(starts[starts + k > row.context], k), return_counts=True)
                for at in range(0, len(h), ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(h[at:at + ROWS].view(np.int64)), pa.array(n[at:at + ROWS])], names=["h", "n"])

    return relation.mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def bitmap(hashes: DataFrame, most_bits: int = MOST_BITS) -> np.ndarray:
    """Bits of the low ends of the hashes ``h``, as bytes; their number grows up to ``most_bits``."""
    count = hashes.count()
    bits = min(1 << 16, most_bits)
    while bits < min(most_bits, 16 * count):
        bits *= 2
    place = F.col("h").bitwiseAND(F.lit(bits - 1)) + 1
    rows = hashes.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in rows:
        at = (r["part"] - 1) * 4096
        out[at:at + 4096] = np.frombuffer(r["bits"], dtype=np.uint8)[:len(out) - at]
    return out


def semi_joined(relation: DataFrame, k: int, bits: np.ndarray) -> DataFrame:
    """The relation of k words: the occurrences whose phrase may be frequent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = Row(batch, i)
                starts = row.joined(k)
                bit = row.hashes(starts, k) & np.uint64(8 * len(bits) - 1)
                starts = starts[((bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)]
                if len(starts):
                    yield row.only(starts, k)

    return relation.mapInArrow(run, RELATION)


def phrases(relation: DataFrame, k: int) -> DataFrame:
    """lang, phrase, f of the k-word phrases in the relation of that length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = Row(batch, i)
                found, n = row.groups(row.starts[row.starts + k > row.context], k)
                for at in range(0, len(found), ROWS):
                    some = found[at:at + ROWS]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row.lang] * len(some)), pa.array(some, type=pa.binary()).cast(pa.string()), pa.array(n[at:at + ROWS])],
                        names=["lang", "phrase", "f"])

    return relation.mapInArrow(run, "lang string, phrase string, f bigint").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def mined(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, most_bits: int = MOST_BITS) -> tuple[list[DataFrame], DataFrame]:
    """lang, phrase, f of the frequent phrases of each length from 1 on, and the number of words per language."""
    spark = docs.sparkSession
    relation, path = common.staged_at(occurrences(docs, longest), "occurrences", "zstd")
    totals = common.stage(relation.groupBy("lang").agg(F.sum("own").alias("n")), "words")
    found = []
    for k in range(1, longest + 1):
        frequent, hashes = common.staged_at(counted(relation, k).where(F.col("n") >= least), f"hashes-{k}")
        shorter = path
        relation, path = common.staged_at(semi_joined(relation, k, bitmap(frequent, most_bits)), f"occurrences-{k}", "zstd")
        common.discard(spark, shorter)
        common.discard(spark, hashes)
        found.append(common.stage(phrases(relation, k).where(F.col("f") >= least), f"phrases-{k}"))
    common.discard(spark, path)
    return found, totals


def part(words: Column, at, size) -> Column:
    return F.array_join(F.slice(words, at, size), " ")


def scored(found: list[DataFrame]) -> DataFrame:
    """Candidates with their lowest-scoring cut: lang, phrase, a, l, r, score."""
    candidates, parts = union(found[1:]), union(found[:-1])
    words = F.split("phrase", " ")
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), words.alias("w"),
                             F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.col("w"), F.lit(1), F.col("k")).alias("first"),
                       part(F.col("w"), F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    left = parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    score = F.expr("(cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + r)").alias("score")
    return (cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).select("lang", "phrase", "a", "k", "l", "r", score)
            .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
            .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))


def union(tables: list[DataFrame]) -> DataFrame:
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionByName(table)
    return whole


def covering(found: list[DataFrame]) -> DataFrame:
    """The largest count of a longer candidate that holds the phrase: lang, phrase, longer."""
    words = F.col("w")
    parts = []
    for k, table in enumerate(found[2:], start=3):
        inside = [part(words, F.lit(at), F.lit(size)) for size in range(2, k) for at in range(1, k - size + 2)]
        parts.append(table.select("lang", "f", F.split("phrase", " ").alias("w")).select("lang", "f", F.explode(F.array(*inside)).alias("phrase")))
    return union(parts).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, most_bits: int = MOST_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``top`` collocations."""
    if longest < 3:
        raise ValueError("phrases of at least three words are needed")
    found, totals = mined(docs, longest, least, most_bits)
    rows = scored(found).join(covering(found), ["lang", "phrase"], "left")
    rows = rows.where("longer is null or cast(longer as decimal(20, 0)) * 100 < cast(a as decimal(20, 0)) * 80")
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # a language's candidates are ranked in parts first, so that none is one task's work
    salt = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = rows.withColumn("salt", salt).withColumn("at", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best)))
    ranked = some.where(F.col("at") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)))
    return (ranked.where(F.col("rank") <= top).join(totals, "lang")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
