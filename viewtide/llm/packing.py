"""Best-fit packing with certified bin counts.

Documents are tokenized whole, closed by ``end_id`` and cut only where longer than ``capacity``. Pieces are dealt over
parts of about ``part_rows`` pieces and packed best-fit decreasing within each. For every part a lower bound on its
bins follows from dual feasible functions over the histogram of its lengths. A part whose bins meet its bound is certified
and final, and so is every bin that is filled well: what a part can still gain lies in its poorly filled bins. Their
pieces are exchanged between the parts that miss their bound: dealt anew over fewer parts and packed again, until a single
part remains or an exchange brings nothing.

Parts have a bounded size whatever the input, as their number follows the number of pieces. Only counts reach the driver.

Edge cases: a null text is empty, so its document is the end id alone; repeated rows are packed as often as they occur;
an empty table gives no rows; a null doc_id is packed like any other; other columns are ignored.
"""

from __future__ import annotations

import codecs
import functools
import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from viewtide.llm import common

CAPACITY, END_ID, PART_ROWS, WORDS_AT_ONCE = 4096, 1, 100_000, 50_000
#: Known words at once, and as many that were known before; as many parts of words beside them. Each takes some 200 bytes.
MOST_WORDS = 100_000
#: A bin is poorly filled if more than one part in so many is free.
POOR = 8
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = ("item bigint, length bigint, bin bigint, `offset` bigint, filled bigint, bins bigint, bound double, part bigint")
#: Characters whose lower-casing, composition and class are plain: ASCII and the letters of Latin-1.
PLAIN = re.compile(r"[\x00-\x7F\xC0-\xD6\xD8-\xF6\xF8-\xFF]*")
#: Parts of a lower-case text of such characters, in UTF-8, as the vocabulary's own pre-tokenizer gives them.
PARTS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|(?:[a-z]|\xC3[\x9F-\xB6\xB8-\xBF])+|[0-9]|[^ \t-\ra-z0-9\x80-\xFF]+")


def byte_letters() -> str:
    """The letter that stands for each byte in a byte-level vocabulary: itself if visible, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(hidden)) for b in range(256))


class Words(dict):
    """Ids of known words; those of a missing one are what ``learn`` gives."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, word: bytes) -> bytes:
        ids = self[word] = self.learn(word)
        return ids


class Encoder:
    """Ids of whole texts as bytes. White space always ends a token of this vocabulary, so words are looked up one by one.

    Words that are not known are tokenized by the library; the tables of known words have a bounded size. A full table is
    put aside and the next one takes from it what still occurs, so frequent words stay known and rare ones are dropped.
    A lower-case word of letters is a part by itself and kept once, as a word; ``parts`` holds those that are no word yet.
    """

    def __init__(self, path: str, most: int = MOST_WORDS):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most, self.has_special = most, False
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.codes = [struct.pack("<I", n) for n in range(max(self.tokenizer.get_vocab().values()) + 1)]
        self.forget()

    def forget(self) -> None:
        self.words, self.parts, self.earlier_words, self.earlier_parts = Words(self.learn), {}, {}, {}

    def tokens(self, x: bytes) -> bytes:
        codes = self.codes
        return b"".join([codes[t.id] for t in self.model.tokenize(codecs.charmap_decode(x, "strict", self.letters)[0])])

    def part(self, x: bytes) -> bytes:
        """Ids of a part that is neither in ``words`` nor in ``parts``."""
        ids = self.earlier_words.pop(x, None)
        if ids is not None:
            self.words[x] = ids
        else:
            ids = self.parts[x] = self.earlier_parts.pop(x, None) or self.tokens(x)
        return ids

    def learn(self, word: bytes) -> bytes:
        """Ids of a word that is not in ``words``."""
        ids = self.earlier_words.pop(word, None)
        if ids is not None:
            return ids
        words, parts = self.words, self.parts
        if self.has_special and any(x in word for x in self.special):      # such a token may stand inside a word
            return self.whole(word)
        if word.isascii():
            low = word.lower()
            alone = low.isalpha()
        else:
            text = word.decode()
            if not PLAIN.fullmatch(text):
                return self.whole(word)
            text = text.lower()
            low, alone = text.encode(), text.isalpha()
        if not alone:
            return b"".join([words.get(x) or parts.get(x) or self.part(x) for x in PARTS.findall(low)])
        if low != word:
            return words.get(low) or parts.get(low) or self.part(low)
        return parts.pop(word, None) or self.earlier_parts.pop(word, None) or self.tokens(word)

    def whole(self, word: bytes) -> bytes:
        ids = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: bytes) -> bytes:
        words, out = text.split(), []
        self.has_special = any(x in text for x in self.special)
        for at in range(0, len(words), WORDS_AT_ONCE):
            if len(self.words) > self.most:
                self.words, self.earlier_words = Words(self.learn), self.words
            if len(self.parts) > self.most:
                self.parts, self.earlier_parts = {}, self.parts
            known = self.words
            out.append(b"".join([known[w] for w in words[at:at + WORDS_AT_ONCE]]))
        return b"".join(out)


@functools.cache
def encoder(path: str) -> Encoder:
    """One per worker, as the vocabulary takes a while to load; its tables of words last for a task."""
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for every piece of every whole text."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batch):
        encode, rows = encoder(tokenizer).ids, []
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].cast("binary")):
            ids = encode(text.as_py() or b"") + end
            for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at:at + 4 * capacity]
                rows.append((doc_id, n, at // 4, len(part) // 4, zlib.crc32(part)))
        return dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), zip(*rows)))

    return common.arrow_map(common.pick(docs, "doc_id", "text"), run, PIECES, lambda: encoder(tokenizer).forget())


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length. ``lengths`` are in decreasing order."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free space
    gaps, count = 0, 0  # bit g is set if some bin has g free
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    for i, n in enumerate(lengths.tolist()):
        fitting = gaps >> n
        if fitting:
            gap = n + (fitting & -fitting).bit_length() - 1
            b = open_bins[gap].pop()
            if not open_bins[gap]:
                gaps &= ~(1 << gap)
        else:
            gap, b = capacity, count
            count += 1
        bins[i], offsets[i] = b, capacity - gap
        rest = gap - n
        if rest:
            open_bins[rest].append(b)
            gaps |= 1 << rest
    return bins, offsets


def bound(lengths: np.ndarray, capacity: int) -> float:
    """Least number of bins, not rounded: the best of two families of dual feasible functions.

    Both map a length x to a share of a bin so that lengths that fit one bin never get more than 1 together: (a) lengths
    above 1 - e count 1, below e count 0, others x; (b) x with x * (k + 1) / capacity whole stays, others are
    rounded down to multiples of 1 / k.
    """
    size, n = np.unique(lengths, return_counts=True)
    x, best = size / capacity, float((size * n).sum() / capacity)
    for e in np.unique(np.concatenate([size[2 * size <= capacity], [0]])):
        big, small = size > capacity - e, size < e
        best = max(best, float((n * np.where(big, 1.0, np.where(small, 0.0, x))).sum()))
    for k in range(1, 33):
        whole = (size * (k + 1)) % capacity == 0
        best = max(best, float((n * np.where(whole, x, (size * (k + 1) // capacity) / k)).sum()))
    return best


def pack_parts(items: DataFrame, parts: int, capacity: int, turn: int) -> DataFrame:
    """``items`` (item, length) dealt over ``parts`` and packed there."""
    def run(part: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "item"], ascending=[False, True], kind="stable").reset_index(drop=True)
        lengths = rows["length"].to_numpy()
        bins, offsets = best_fit(lengths, capacity)
        filled = np.bincount(bins, weights=lengths).astype(np.int64)
        number = (turn << 56) | (int(part[0]) << 24)
        return pd.DataFrame({"item": rows["item"], "length": lengths, "bin": number | bins, "offset": offsets,
                             "filled": filled[bins], "bins": len(filled), "bound": bound(lengths, capacity),
                             "part": int(part[0])})

    dealt = items.withColumn("part", F.pmod(F.xxhash64("item", F.lit(turn)), F.lit(parts)))
    return dealt.groupBy("part").applyInPandas(run, PACKED)


def pack(items: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS, turns: int = 8) -> list[DataFrame]:
    """The packed rows of each turn, stored; together they hold every item once in its final place."""
    done, left, last = [], items, None
    for turn in range(turns):
        n = left.count()
        if not n:
            break
        parts = -(-n // part_rows)
        packed = common.stage(pack_parts(left, parts, capacity, turn), "packed")
        final = parts == 1 or turn == turns - 1 or (last is not None and n > 0.9 * last)
        open_bin = (POOR * (capacity - F.col("filled")) > capacity) & (F.col("bins") > F.col("bound"))
        done.append(packed if final else packed.where(~open_bin))
        if final:
            break
        left, last = packed.where(open_bin).select("item", "length"), n
    return done


def certificates(done: list[DataFrame], capacity: int = CAPACITY) -> DataFrame:
    """turn, part, pieces, bins and lower bound of every part as it was packed."""
    rows = [x.withColumn("turn", F.lit(i)) for i, x in enumerate(done)]
    whole = functools.reduce(DataFrame.unionByName, rows)
    return whole.groupBy("turn", "part").agg(
        F.count("*").alias("pieces"), F.max("bins").alias("bins"), F.ceil(F.max("bound") - 1e-9).alias("bound"))


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
                     part_rows: int = PART_ROWS) -> DataFrame:
    """The pieces with sequence_id and offset."""
    cut = common.stage(pieces(docs, tokenizer, capacity, end_id).withColumn("item", F.monotonically_increasing_id()),
                       "pieces")
    full = cut.where(F.col("length") == capacity).select(
        *PIECE_COLUMNS, (F.lit(-1) - F.col("item")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    done = pack(cut.where(F.col("length") < capacity).select("item", "length"), capacity, part_rows)
    if not done:
        return full
    places = functools.reduce(DataFrame.unionByName, done).select("item", F.col("bin").alias("sequence_id"), "offset")
    return full.unionByName(cut.join(places, "item").select(*PIECE_COLUMNS, "sequence_id", "offset"))


PIECE_COLUMNS = ("doc_id", "piece", "start", "length", "ids_crc32")
