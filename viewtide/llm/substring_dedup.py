"""Exact removal of repeated byte strings by distributed prefix doubling over sampled positions.

A byte goes if it lies in a ``LENGTH``-byte string that also starts in a document with a smaller doc_id.

Ranking every byte position would move a position-rank pair per byte and round, many times the corpus. So positions are
sampled by content: of the ``WIDTH`` positions inside a string at which ``PREFIX`` more bytes follow, the one with the
smallest hashed prefix is the string's sample. Equal strings sample the same place, so each repeated string is found at its
sample. The strings that share a sample are neighbours; their common stretch of text is the sample's context.

Ranks are hashes that double: the name of 16 bytes is that of two names of 8 bytes, and so on (24 = 16 and 8 bytes,
50 = two overlapping names of 32). Spark deals (rank, position) pairs over ranges of ranks, each range is sorted and the
ranks found in one document only drop out:

1. prefixes of samples (24 bytes): a sample whose prefix no other document has is unique and leaves;
2. contexts of the remaining samples: those that a smaller document has are repeated as a whole; samples with a prefix
   that has more than one context go on, one document for each context;
3. the single strings of those (50 bytes, the threshold): repeated if a smaller document has them.

Pairs travel as packed arrays. Before each shuffle, pairs of one rank in one batch shrink to those of its smallest
document, as the answer for the others is then known; a hot passage is a few pairs per batch. Contexts of a prefix with
very many of them are dealt by context. Exact copies of whole texts are set aside first. The text is dealt by row once, into
a bucketed table that the later steps read without another shuffle.

Edge cases: null texts are empty; texts below ``LENGTH`` bytes lose nothing; rows without doc_id neither lose bytes nor
make others lose any; rows that repeat a doc_id are documents of equal id, none smaller than the other; an empty table
gives no rows; other columns are ignored. Texts of any length are read in blocks.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from viewtide.llm import common
from viewtide.llm.common import mix
from viewtide.session import scratch_path

LENGTH, PREFIX = 50, 24
WIDTH = LENGTH - PREFIX + 1
#: Bytes of text named at once, of text whose pairs are packed at once, of text per bucket, and pairs per range of ranks.
BLOCK_BYTES, BATCH_BYTES, BUCKET_BYTES, RANGE_PAIRS = 1 << 20, 16 << 20, 64 << 20, 1_500_000
MANY_CONTEXTS = 64
LOW32 = np.uint64(0xFFFFFFFF)
ODD = np.uint64(0x9E3779B97F4A7C15)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of two names that follow each other."""
    return mix(a * ODD + mix(b + ODD))


def eights(buffer: bytes) -> np.ndarray:
    """The eight bytes from every position on, as numbers; zeros follow the end."""
    return np.ndarray((len(buffer),), dtype="<u8", buffer=buffer + bytes(8), strides=(1,)).astype(np.uint64)


class Block:
    """Some bytes and the samples of their strings: one entry for each stretch of strings with one sample."""

    def __init__(self, buffer: bytes, ends: np.ndarray, begins: np.ndarray):
        """``begins`` and ``ends``: of the texts in the buffer."""
        self.begins = begins
        self.eight = np.concatenate([eights(buffer), np.zeros(2 * LENGTH, dtype=np.uint64)])
        n = len(buffer)
        with np.errstate(over="ignore"):
            e = self.eight
            self.prefix = pair(pair(e[:n], e[8:n + 8]), e[16:n + 16])
        order = (self.prefix & ~LOW32) | np.arange(n, dtype=np.uint64)
        step = 1
        while 2 * step <= WIDTH:
            order = np.minimum(order[:-step], order[step:])
            step *= 2
        if WIDTH > step:
            rest = WIDTH - step
            order = np.minimum(order[:-rest], order[rest:])
        sample = (order & LOW32).astype(np.int64)
        # starts of strings that end inside their text
        change = np.zeros(n + 1, dtype=np.int64)
        long = ends - begins >= LENGTH
        np.add.at(change, begins[long], 1)
        np.add.at(change, ends[long] - LENGTH + 1, -1)
        start = np.flatnonzero(np.cumsum(change[:n]))
        at = sample[start]
        first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)])[:len(at)])
        self.start = start[first]
        self.size = np.diff(np.append(first, len(start)))
        self.sample = at[first]
        self.text = np.searchsorted(ends, self.start, side="right")

    def context(self, pick: np.ndarray) -> np.ndarray:
        """The names of the stretches: all their bytes, length and place of the sample."""
        start, span = self.start[pick], self.size[pick] + LENGTH - 1
        with np.errstate(over="ignore"):
            name = (span * 128 + (self.sample[pick] - start)).astype(np.uint64)
            for k in range(0, LENGTH + WIDTH - 1, 8):
                name = pair(name, self.eight[start + np.minimum(k, span - 8)])
        return name


def strings(text: bytes, starts: np.ndarray) -> np.ndarray:
    """The names of a text's strings of LENGTH bytes at these places."""
    out = np.empty(len(starts), dtype=np.uint64)
    block = starts // BLOCK_BYTES
    for k in np.unique(block):
        here = np.flatnonzero(block == k)
        begin = int(k) * BLOCK_BYTES
        eight = eights(text[begin:begin + BLOCK_BYTES + LENGTH])
        at = starts[here] - begin
        with np.errstate(over="ignore"):
            sixteen = [pair(eight[at + j], eight[at + j + 8]) for j in (0, 16, 18, 34)]
            out[here] = pair(pair(sixteen[0], sixteen[1]), pair(sixteen[2], sixteen[3]))
    return out


def blocks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, Block]]:
    """Texts in blocks: which texts they are, where in its text each one begins, and the block.

    A block holds short texts whole or a part of a long one. Parts overlap, so that no string is lost; they begin at
    multiples of the block's size, so a text always gives the same entries in the same order.
    """
    some, size = [], 0
    for i, t in enumerate(texts):
        if len(t) < LENGTH:
            continue
        if len(t) > BLOCK_BYTES:
            for at in range(0, len(t) - LENGTH + 1, BLOCK_BYTES):
                part = t[at:at + BLOCK_BYTES + LENGTH - 1]
                yield np.array([i]), np.array([at]), Block(part, np.array([len(part)]), np.array([0]))
            continue
        if size + len(t) > BLOCK_BYTES:
            yield joined(texts, some)
            some, size = [], 0
        some.append(i)
        size += len(t)
    if some:
        yield joined(texts, some)


def joined(texts: list[bytes], some: list[int]) -> tuple[np.ndarray, np.ndarray, Block]:
    ends = np.cumsum([len(texts[i]) for i in some])
    begins = np.concatenate([[0], ends[:-1]])
    return np.array(some), np.zeros(len(some), dtype=np.int64), Block(b"".join(texts[i] for i in some), ends, begins)


def gathered(batches, *extra: str) -> Iterator[tuple]:
    """Row numbers, ids, texts and further columns of some rows at a time, BATCH_BYTES of text or one row."""
    parts, size = [], 0
    for batch in batches:
        for at in range(batch.num_rows):
            text = batch.column("text")[at].as_py() or b""
            parts.append((batch.column("row")[at].as_py(), batch.column("doc_id")[at].as_py(), text,
                          *(batch.column(c)[at].as_py() for c in extra)))
            size += len(text) + 100
            if size >= BATCH_BYTES:
                yield tuple(zip(*parts))
                parts, size = [], 0
    if parts:
        yield tuple(zip(*parts))


PACKED = ("range", "known", "rows", "ids", "counts")


def packed_schema(columns: dict[str, str]) -> str:
    return "range int, known boolean, rows binary, ids binary, counts binary, " + ", ".join(f"{c} binary" for c in columns)


def packed(known: bool, ranges: np.ndarray, doc: np.ndarray, rows: np.ndarray, ids: np.ndarray,
           columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Entries of one batch as one row per range: arrays of documents, of entries per document and of the columns."""
    if not len(ranges):
        return
    order = np.lexsort((doc, ranges))
    ranges, doc = ranges[order], doc[order]
    cuts = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1]]))
    out = {k: [] for k in (*PACKED, *columns)}
    sorted_columns = {k: v[order] for k, v in columns.items()}
    for a, b in zip(cuts, np.append(cuts[1:], len(ranges))):
        d = doc[a:b]
        runs = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        out["range"].append(int(ranges[a]))
        out["known"].append(known)
        out["rows"].append(rows[d[runs]].tobytes())
        out["ids"].append(ids[d[runs]].tobytes())
        out["counts"].append(np.diff(np.append(runs, len(d))).astype(np.uint32).tobytes())
        for k, v in sorted_columns.items():
            out[k].append(v[a:b].tobytes())
    types = {"range": pa.int32(), "known": pa.bool_()}
    yield pa.RecordBatch.from_arrays([pa.array(v, types.get(k, pa.binary())) for k, v in out.items()], names=list(out))


def unpacked(table: pa.Table, known: bool, columns: dict[str, str]) -> dict[str, np.ndarray]:
    """The entries of a range: row, id and the columns."""
    mask = np.array(table["known"].to_pylist(), dtype=bool) == known
    parts = table.filter(pa.array(mask))
    whole = lambda c, t: np.frombuffer(b"".join(parts[c].to_pylist()), dtype=t)
    counts = whole("counts", np.uint32)
    out = {"row": np.repeat(whole("rows", np.int64), counts), "id": np.repeat(whole("ids", np.int64), counts)}
    return out | {c: whole(c, t) for c, t in columns.items()}


def smallest(names: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the smallest id of its name's entries, and whether its name has more than one id."""
    order = np.argsort(names, kind="stable")
    sorted_names, sorted_ids = names[order], ids[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_names[1:] != sorted_names[:-1]])[:len(names)])
    times = np.diff(np.append(first, len(names)))
    least, most = np.empty_like(ids), np.empty_like(ids)
    if len(names):
        least[order] = np.repeat(np.minimum.reduceat(sorted_ids, first), times)
        most[order] = np.repeat(np.maximum.reduceat(sorted_ids, first), times)
    return least, least < most


ANSWER = ("part", "expand", "rows", "counts")


def answers(row: np.ndarray, columns: dict[str, np.ndarray], parts: int, expand: bool = False) -> pa.Table:
    """Entries by part of the documents: row numbers, entries per document, and arrays of the columns."""
    with np.errstate(over="ignore"):
        part = (mix(row.astype(np.uint64)) % np.uint64(parts)).astype(np.int32)
    order = np.lexsort((row, part))
    part, row = part[order], row[order]
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])[:len(part)])
    columns = {k: v[order] for k, v in columns.items()}
    out = {k: [] for k in (*ANSWER, *columns)}
    for a, b in zip(cuts, np.append(cuts[1:], len(part))):
        first = np.flatnonzero(np.concatenate([[True], row[a + 1:b] != row[a:b - 1]]))
        out["part"].append(int(part[a]))
        out["expand"].append(expand)
        out["rows"].append(row[a:b][first].tobytes())
        out["counts"].append(np.diff(np.append(first, b - a)).astype(np.uint32).tobytes())
        for k, v in columns.items():
            out[k].append(v[a:b].tobytes())
    types = {"part": pa.int32(), "expand": pa.bool_()}
    return pa.table({k: pa.array(v, types.get(k, pa.binary())) for k, v in out.items()})


def answer_schema(columns: dict[str, str]) -> str:
    return "part int, expand boolean, rows binary, counts binary, " + ", ".join(f"{c} binary" for c in columns)


def by_document(packed_answers: DataFrame, columns: dict) -> DataFrame:
    """The answers of all ranges by document: row and one array per column. A part holds those of a bounded text."""
    def merge(table: pa.Table) -> pa.Table:
        whole = lambda c, t: np.frombuffer(b"".join(table[c].to_pylist()), dtype=t)
        row = np.repeat(whole("rows", np.int64), whole("counts", np.uint32))
        order = np.argsort(row, kind="stable")
        row = row[order]
        cuts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])[:len(row)])
        ends = np.append(cuts[1:], len(row))
        out = {"row": pa.array(row[cuts], pa.int64())}
        for c, t in columns.items():
            v = whole(c, t)[order]
            out[c] = pa.array([v[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary())
        return pa.table(out)

    return packed_answers.groupBy("part").applyInArrow(merge, "row bigint, " + ", ".join(f"{c} binary" for c in columns))


FIRST = {"names": np.uint32, "ordinals": np.uint32}
SECOND = {"names": np.uint32, "contexts": np.uint64, "starts": np.uint32, "sizes": np.uint16, "many": np.uint8}
THIRD = {"names": np.uint64, "starts": np.uint32}
LEFT = {"ordinals": np.uint32}
PLACES = {"starts": np.uint32, "sizes": np.uint16}


def entries(texts, choose=None) -> Iterator[tuple]:
    """The entries of some texts by block: block, index in it, text, ordinal in the text, place of the stretch in the text.

    ``choose``: the ordinals wanted of each text.
    """
    seen = np.zeros(len(texts), dtype=np.int64)
    for which, begin, block in blocks(texts):
        doc = which[block.text]
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])[:len(doc)])
        times = np.diff(np.append(first, len(doc)))
        ordinal = np.arange(len(doc)) - np.repeat(first - seen[doc[first]], times)
        if choose is None:
            pick = np.arange(len(doc))
        else:
            some = []
            for a, n, d in zip(first, times, doc[first]):
                here = choose[d] - seen[d]
                some.append(a + here[(here >= 0) & (here < n)])
            pick = np.unique(np.concatenate(some)) if some else np.empty(0, dtype=np.int64)
        seen[doc[first]] += times
        text = block.text[pick]
        yield block, pick, doc[pick], ordinal[pick], block.start[pick] - block.begins[text] + begin[text]


def dealt(names: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each rank."""
    return ((names >> np.uint64(32)) % np.uint64(ranges)).astype(np.int32)


def prefixes(docs: DataFrame, ranges: int) -> DataFrame:
    """Step 1, before the shuffle: the samples' prefixes. ``docs``: row, doc_id, text in bytes."""
    def run(batches):
        for rows, ids, texts in gathered(batches):
            rows, ids = np.array(rows, dtype=np.int64), np.array(ids, dtype=np.int64)
            found = [(b.prefix[b.sample[p]], d, o) for b, p, d, o, _ in entries(texts)]
            if not found:
                continue
            names, doc, ordinal = (np.concatenate(x) for x in zip(*found))
            least, shared = smallest(names, ids[doc])
            for known, pick in ((False, ids[doc] == least), (True, shared)):
                yield from packed(known, dealt(names[pick], ranges), doc[pick], rows, ids, {
                    "names": (names[pick] & LOW32).astype(np.uint32), "ordinals": ordinal[pick].astype(np.uint32)})

    return docs.mapInArrow(run, packed_schema(FIRST))


def shared_prefixes(table: pa.Table, parts: int) -> pa.Table:
    """Step 1, within a range: the samples whose prefix more than one document has."""
    new, known = unpacked(table, False, FIRST), unpacked(table, True, FIRST)
    _, shared = smallest(new["names"], new["id"])
    return answers(np.concatenate([new["row"][shared], known["row"]]),
                   {"ordinals": np.concatenate([new["ordinals"][shared], known["ordinals"]])}, parts)


def several(names: np.ndarray, context: np.ndarray, least: int) -> np.ndarray:
    """For each entry whether its prefix has at least so many contexts."""
    order = np.lexsort((context, names))
    n, c = names[order], context[order]
    new_name = np.concatenate([[True], n[1:] != n[:-1]])[:len(n)]
    new_pair = new_name | np.concatenate([[True], c[1:] != c[:-1]])[:len(n)]
    first = np.flatnonzero(new_name)
    out = np.empty(len(n), dtype=bool)
    if len(n):
        out[order] = np.repeat(np.add.reduceat(new_pair.astype(np.int64), first) >= least, np.diff(np.append(first, len(n))))
    return out


def contexts(docs: DataFrame, ranges: int) -> DataFrame:
    """Step 2, before the shuffle: the contexts of the samples that are left. ``docs`` has their ordinals as well."""
    def run(batches):
        for rows, ids, texts, ordinals in gathered(batches, "ordinals"):
            rows, ids = np.array(rows, dtype=np.int64), np.array(ids, dtype=np.int64)
            choose = [np.frombuffer(x, dtype=np.uint32).astype(np.int64) for x in ordinals]
            found = [(b.prefix[b.sample[p]], b.context(p), d, at, b.size[p]) for b, p, d, _, at in entries(texts, choose)]
            if not found:
                continue
            names, context, doc, start, size = (np.concatenate(x) for x in zip(*found))
            least, _ = smallest(context, ids[doc])
            go = ids[doc] == least
            many = np.zeros(len(names), dtype=bool)
            many[go] = several(names[go], context[go], MANY_CONTEXTS)
            deal = np.where(many, dealt(context, ranges), dealt(names, ranges))
            columns = {"names": (names & LOW32).astype(np.uint32), "contexts": context, "starts": start.astype(np.uint32),
                       "sizes": size.astype(np.uint16), "many": many.astype(np.uint8)}
            yield from packed(False, deal[go], doc[go], rows, ids, {k: v[go] for k, v in columns.items()})
            # what the batch knows: a smaller document has the context
            unused = {k: np.zeros(np.count_nonzero(~go), columns[k].dtype) for k in ("names", "contexts", "many")}
            yield from packed(True, (doc[~go] % ranges).astype(np.int32), doc[~go], rows, ids,
                              {k: unused.get(k, v[~go]) for k, v in columns.items()})
            # a prefix of many contexts tells so where the rest of its prefix goes, as a context of no document
            marks = np.unique(names[many])
            none = np.zeros(len(marks), dtype=np.int64)
            yield from packed(False, dealt(marks, ranges), none, np.array([-1]), np.array([np.iinfo(np.int64).max]), {
                k: (marks & LOW32).astype(v.dtype) if k == "names" else none.astype(v.dtype) for k, v in columns.items()})

    return docs.mapInArrow(run, packed_schema(SECOND))


def repeated_contexts(table: pa.Table, parts: int) -> pa.Table:
    """Step 2, within a range: stretches that a smaller document has, and those whose strings are to be compared."""
    new, known = unpacked(table, False, SECOND), unpacked(table, True, SECOND)
    least, _ = smallest(new["contexts"], new["id"])
    covered, real = new["id"] > least, new["row"] >= 0
    go = (new["many"] > 0) | several(new["names"], new["contexts"], 2)
    gone, left = covered & real, ~covered & go & real
    whole = lambda c: np.concatenate([new[c][gone], known[c]])
    return pa.concat_tables([
        answers(whole("row"), {"starts": whole("starts"), "sizes": whole("sizes")}, parts),
        answers(new["row"][left], {"starts": new["starts"][left], "sizes": new["sizes"][left]}, parts, expand=True)])


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the strings of some stretches."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


def places_of(starts: bytes, sizes: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(starts, dtype=np.uint32).astype(np.int64), np.frombuffer(sizes, dtype=np.uint16).astype(np.int64)


def single_strings(docs: DataFrame, ranges: int) -> DataFrame:
    """Step 3, before the shuffle: the strings of the stretches in ``starts`` and ``sizes``."""
    def run(batches):
        for rows, ids, texts, starts, sizes in gathered(batches, "starts", "sizes"):
            rows, ids = np.array(rows, dtype=np.int64), np.array(ids, dtype=np.int64)
            at = [np.unique(spread(*places_of(*p))) for p in zip(starts, sizes)]
            names = np.concatenate([strings(t, a) for t, a in zip(texts, at)])
            doc, start = np.repeat(np.arange(len(rows)), list(map(len, at))), np.concatenate(at).astype(np.uint32)
            least, _ = smallest(names, ids[doc])
            go = ids[doc] == least
            yield from packed(False, dealt(names[go], ranges), doc[go], rows, ids, {"names": names[go], "starts": start[go]})
            yield from packed(True, (doc[~go] % ranges).astype(np.int32), doc[~go], rows, ids,
                              {"names": np.zeros(np.count_nonzero(~go), np.uint64), "starts": start[~go]})

    return docs.mapInArrow(run, packed_schema(THIRD))


def repeated_strings(table: pa.Table, parts: int) -> pa.Table:
    """Step 3, within a range: the strings that a smaller document has."""
    new, known = unpacked(table, False, THIRD), unpacked(table, True, THIRD)
    least, _ = smallest(new["names"], new["id"])
    gone = new["id"] > least
    starts = np.concatenate([new["starts"][gone], known["starts"]])
    return answers(np.concatenate([new["row"][gone], known["row"]]),
                   {"starts": starts, "sizes": np.ones(len(starts), dtype=np.uint16)}, parts)


def covered(size: int, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which of a text's bytes lie in a string of the stretches."""
    change = np.bincount(starts, minlength=size + 1) - np.bincount(starts + sizes - 1 + LENGTH, minlength=size + 1)
    return np.cumsum(change[:size]) > 0


def cut(docs: DataFrame, keep_text: bool) -> DataFrame:
    """row, n_removed, n_spans, kept_sha256 (and the kept bytes) of the rows of ``docs`` with their stretches."""
    def run(batch):
        out = {"row": batch["row"], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for text, starts, sizes in zip(batch["text"], batch["starts"], batch["sizes"]):
            text = text.as_py()
            gone = covered(len(text), *places_of(starts.as_py(), sizes.as_py()))
            kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
            out["n_removed"].append(int(np.count_nonzero(gone)))
            out["n_spans"].append(int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0]))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept if keep_text else None)
        return out

    return common.arrow_map(docs.select("row", "text", "starts", "sizes"), run,
                            "row bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def deduplicated(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs`` (doc_id, text); kept if ``keep_text``.

    kept holds the bytes that remain, null where nothing was removed.
    """
    spark = docs.sparkSession
    flat = common.pick(docs, "doc_id", "text").select(
        F.monotonically_increasing_id().alias("row"), "doc_id", common.whole_text().cast("binary").alias("text"))
    total = flat.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    # with fewer buckets than shuffle partitions a join would deal the text anew
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    ranges = max(1, -(-2 * total // ((WIDTH + 1) * RANGE_PAIRS)))
    table = f"viewtide_{uuid.uuid4().hex}"
    try:
        (flat.repartition(buckets, "row").write.bucketBy(buckets, "row").option("path", scratch_path(spark, "texts"))
         .saveAsTable(table, format="parquet"))
        return results(spark.table(table), ranges, max(1, -(-total // BUCKET_BYTES)), keep_text)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def results(texts: DataFrame, ranges: int, parts: int, keep_text: bool) -> DataFrame:
    known = common.stage(texts.select("row", "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"),
                                      F.sha2("text", 256).alias("sha")), "texts")
    least = known.where("doc_id is not null").groupBy("sha", "n_bytes").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    copies = common.stage(known.join(least, ["sha", "n_bytes"]).where(f"doc_id > least and n_bytes >= {LENGTH}").select("row"),
                          "copies")
    first = texts.where("doc_id is not null").join(copies, "row", "left_anti")
    dealt_out = lambda x, step, columns: x.groupBy("range").applyInArrow(
        lambda table: step(table, parts), answer_schema(columns))
    left = by_document(dealt_out(prefixes(first, ranges), shared_prefixes, LEFT), LEFT)
    places = common.stage(dealt_out(contexts(texts.join(left, "row").select("row", "doc_id", "text", "ordinals"), ranges),
                                    repeated_contexts, PLACES), "places")
    stretches = places.where("expand").agg(F.sum(F.octet_length("starts")).alias("n")).first()["n"] or 0
    narrow = max(1, -(-stretches // 4 * WIDTH // (2 * RANGE_PAIRS)))
    open_places = by_document(places.where("expand"), PLACES)
    more = dealt_out(single_strings(texts.join(open_places, "row").select("row", "doc_id", "text", "starts", "sizes"), narrow),
                     repeated_strings, PLACES)
    gone = by_document(places.where("not expand").unionByName(more), PLACES)
    done = common.stage(cut(texts.join(gone, "row"), keep_text), "kept")
    copied = copies.select("row", F.lit(True).alias("copy"))
    empty = hashlib.sha256(b"").hexdigest()
    is_copy = F.col("copy").isNotNull()
    out = known.join(copied, "row", "left").join(done, "row", "left").select(
        "doc_id", "n_bytes",
        F.when(is_copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("bigint"))).alias("n_removed"),
        F.when(is_copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0).cast("bigint"))).cast("bigint").alias("n_spans"),
        F.when(is_copy, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(is_copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))
    return out if keep_text else out.drop("kept")
