"""Exact ranked lexical search in sparse ball trees.

Terms are runs of letters, digits and all that is not ASCII. A document's score for an item is an inner product of whole
numbers: the weights of the item's terms and the document's saturated, length-normalised term counts. The weights are
multiplied into the documents' coordinates, so an item is a vector of ones. Coordinates that no item of the block has add
nothing to any score, so documents are projected on the terms of the items.

Ball trees of some thousand documents each halve their documents along the line between two far ones. A node keeps the
centroid of its documents and, for each band of term weights, the radius: the largest norm of what a document has beyond
the centroid there. Scores below a node are at most the centroid's score plus, by Cauchy-Schwarz, each band's radius
times the root of the number of the item's terms that occur below the node in that band. Bounds are rounded up by more than
the floating-point error can be, so subtrees are pruned best-first without losing a document; leaves are scored in
whole numbers. The search starts from the scores that the best of one document in ``PROBE`` reach; these are
lower limits of the final ones, so every document of the result is found among all documents.

The items are the stated query set. They are taken in blocks of at most ``ITEMS`` items and about ``TERMS`` terms; only a block's
terms, its document frequencies and the lower limits reach the driver.

Edge cases: null texts have no terms; documents and items without terms give no rows; repeated rows are documents (or items)
of their own; equal scores are ordered by doc_id, null first; a very long text is one document; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from viewtide.llm import common

TOP, ITEMS, TERMS = 50, 2000, 500_000
#: Documents and coordinates of a tree, documents of a leaf, bands of weights.
TREE, TREE_COORDINATES, LEAF, BANDS = 4096, 2_000_000, 32, 4
PROBE = 16
#: Relative allowance for rounding: sums of a million terms err by less than 1e-9.
SLACK = 1e-9
NULL_ID = -(1 << 63)

FOLD = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else common.LOWER_ASCII[b] for b in range(256))

VECTORS = "doc_id bigint, n bigint, terms array<int>, tf array<bigint>"
TREES = ("docs array<bigint>, at array<int>, terms array<int>, x array<bigint>, lo array<int>, hi array<int>, child array<int>, "
         "c_at array<int>, c_terms array<int>, c array<double>, radius array<double>")
FOUND = "q bigint, doc_id bigint, score bigint"


def term_counts(text: bytes | None) -> Counter:
    """How often each term occurs."""
    counts = Counter()
    for words in common.word_blocks((text or b"").translate(FOLD)):
        counts.update(words)
    return counts


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Every document with a term: the number of its terms, and its counts of the vocabulary's terms."""
    def run(batch):
        out = {"doc_id": [], "n": [], "terms": [], "tf": []}
        for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
            counts = term_counts(text.as_buffer().to_pybytes() if text.is_valid else None)
            if counts:
                hits = sorted((vocabulary[t], c) for t, c in counts.items() if t in vocabulary)
                out["doc_id"].append(doc)
                out["n"].append(counts.total())
                out["terms"].append([t for t, _ in hits])
                out["tf"].append([c for _, c in hits])
        return out

    rows = common.pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return common.arrow_map(rows, run, VECTORS)


class Statistics:
    """Number of documents, of all their terms, and the weight of each term of the vocabulary."""

    def __init__(self, rows: DataFrame, terms: int):
        whole = rows.agg(F.count("*").alias("docs"), F.sum("n").alias("words")).first()
        self.docs, self.words = whole["docs"], whole["words"]
        self.weights = np.zeros(terms, dtype=np.int64)
        for r in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():
            self.weights[r["t"]] = math.floor(1000 * math.log((2 * self.docs + 2) / (2 * r["df"] + 1)))

    def coordinates(self, n: int, terms: np.ndarray, tf: np.ndarray) -> np.ndarray:
        m = 100 - 50 + (50 * n * self.docs) // self.words
        return self.weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))

    def bands(self) -> np.ndarray:
        return self.weights * BANDS // (int(self.weights.max(initial=0)) + 1)


class Tree:
    """A ball tree over sparse rows: ``at`` limits each document's ``terms`` and whole-numbered coordinates ``x``.

    ``child`` is a node's first child, its second one follows; 0 marks a leaf.
    """

    def __init__(self, docs, at, terms, x, lo=None, hi=None, child=None, c_at=None, c_terms=None, c=None, radius=None):
        self.docs, self.at, self.terms, self.x = docs, at, terms, x
        self.lo, self.hi, self.child, self.c_at, self.c_terms, self.c, self.radius = lo, hi, child, c_at, c_terms, c, radius

    @classmethod
    def build(cls, docs: list, rows: list[tuple[np.ndarray, np.ndarray]], bands: np.ndarray) -> Tree:
        starts = np.concatenate([[0], np.cumsum([len(t) for t, _ in rows])])
        terms, x = np.concatenate([t for t, _ in rows]), np.concatenate([v for _, v in rows])
        values, lines = x.astype(np.float64), np.zeros(len(bands))
        order = np.arange(len(rows))
        lo, hi, child, centroids, radii = [0], [len(rows)], [0], [], []
        node = 0
        while node < len(lo):
            mine = order[lo[node]:hi[node]]
            sizes = starts[mine + 1] - starts[mine]
            begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            places = np.arange(sizes.sum()) + np.repeat(starts[mine] - begins, sizes)
            t, v = terms[places], values[places]
            support, inside = np.unique(t, return_inverse=True)
            centre = np.bincount(inside, weights=v) / len(mine)
            centroids.append((support, centre))
            beyond = np.square(np.maximum(v - centre[inside], 0.0))
            band = bands[t]
            radii.append([math.sqrt(np.add.reduceat(np.where(band == b, beyond, 0.0), begins).max()) for b in range(BANDS)])
            if len(mine) > LEAF:
                def along(row: int, sign: float = 1.0) -> None:
                    part = slice(starts[row], starts[row + 1])
                    lines[terms[part]] += sign * values[part]

                norms = np.add.reduceat(v * v, begins)
                far = mine[np.argmax(norms - 2 * np.add.reduceat(v * centre[inside], begins))]
                along(far)
                other = mine[np.argmax(norms - 2 * np.add.reduceat(v * lines[t], begins))]
                along(other, -1.0)
                side = np.argsort(np.add.reduceat(v * lines[t], begins), kind="stable")
                lines[terms[starts[far]:starts[far + 1]]] = 0.0
                lines[terms[starts[other]:starts[other + 1]]] = 0.0
                order[lo[node]:hi[node]] = mine[side]
                middle = lo[node] + len(mine) // 2
                child[node] = len(lo)
                lo += [lo[node], middle]
                hi += [middle, hi[node]]
                child += [0, 0]
            node += 1
        rows = [rows[i] for i in order]
        return cls([docs[i] for i in order], np.concatenate([[0], np.cumsum([len(t) for t, _ in rows])]),
                   np.concatenate([t for t, _ in rows]), np.concatenate([v for _, v in rows]), np.array(lo), np.array(hi),
                   np.array(child), np.concatenate([[0], np.cumsum([len(s) for s, _ in centroids])]),
                   np.concatenate([s for s, _ in centroids]), np.concatenate([c for _, c in centroids]), np.array(radii).ravel())

    def row(self) -> dict:
        return {name: [getattr(self, name)] for name in
                ("docs", "at", "terms", "x", "lo", "hi", "child", "c_at", "c_terms", "c", "radius")}

    def bound(self, node: int, item: np.ndarray, bands: np.ndarray) -> float:
        """No document below the node scores more."""
        part = slice(self.c_at[node], self.c_at[node + 1])
        support = self.c_terms[part]
        place = np.searchsorted(support, item)
        place[place == len(support)] = 0
        there = support[place] == item
        if not there.any():
            return 0.0
        most = self.c[part][place[there]].sum()
        radius = self.radius[node * BANDS:(node + 1) * BANDS]
        most += (radius * np.sqrt(np.bincount(bands[item[there]], minlength=BANDS))).sum()
        return most * (1 + SLACK) + 1

    def scores(self, node: int, chosen: np.ndarray) -> np.ndarray:
        """Exact scores of a leaf's documents; ``chosen`` marks the item's terms."""
        at = self.at[self.lo[node]:self.hi[node] + 1]
        part = slice(at[0], at[-1])
        return np.add.reduceat(np.where(chosen[self.terms[part]], self.x[part], 0), at[:-1] - at[0])

    def search(self, item: np.ndarray, chosen: np.ndarray, bands: np.ndarray, best: list[tuple[int, int]], top: int, floor: int) -> int:
        """Add to ``best`` (a heap of score and negated doc_id) what reaches it; the number of documents scored."""
        queue, scored = [(-self.bound(0, item, bands), 0)], 0
        while queue:
            limit = max(floor, best[0][0] if len(best) == top else 0)
            most, node = heapq.heappop(queue)
            if -most < limit:
                break
            if self.child[node]:
                for each in (self.child[node], self.child[node] + 1):
                    most = self.bound(each, item, bands)
                    if most >= limit:
                        heapq.heappush(queue, (-most, each))
                continue
            scores = self.scores(node, chosen)
            scored += len(scores)
            for i in np.flatnonzero(scores >= limit).tolist():
                doc = self.docs[self.lo[node] + i]
                entry = int(scores[i]), -(NULL_ID if doc is None else doc)
                if len(best) < top:
                    heapq.heappush(best, entry)
                else:
                    heapq.heappushpop(best, entry)
        return scored


def index(rows: DataFrame, statistics: Statistics) -> DataFrame:
    """Ball trees over the documents that have a term of the vocabulary, one a row."""
    bands = statistics.bands()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, points, size = [], [], 0
        for batch in batches:
            for doc, n, terms, tf in zip(*(batch.column(c) for c in range(4))):
                if not len(terms):
                    continue
                terms = terms.values.to_numpy().astype(np.int64)
                docs.append(doc.as_py())
                points.append((terms, statistics.coordinates(n.as_py(), terms, tf.values.to_numpy())))
                size += len(terms)
                if len(docs) >= TREE or size >= TREE_COORDINATES:
                    yield stored(Tree.build(docs, points, bands))
                    docs, points, size = [], [], 0
        if docs:
            yield stored(Tree.build(docs, points, bands))

    return rows.mapInArrow(run, TREES)


def stored(tree: Tree) -> pa.RecordBatch:
    types = {"docs": pa.int64(), "x": pa.int64(), "c": pa.float64(), "radius": pa.float64()}
    columns = {k: pa.array(v, type=pa.list_(types.get(k, pa.int32()))) for k, v in tree.row().items()}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def searched(trees: DataFrame, items: list[np.ndarray], bands: np.ndarray, top: int, floors: np.ndarray) -> DataFrame:
    """q, doc_id and score of what may be among the ``top`` documents of each item: at most ``top`` rows a task and item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in items]
        chosen = np.zeros(len(bands), dtype=bool)
        for batch in batches:
            for i in range(batch.num_rows):
                values = [batch.column(c)[i].values for c in range(len(batch.schema))]
                tree = Tree(values[0].to_pylist(), *[v.to_numpy() for v in values[1:]])
                for q, item in enumerate(items):
                    if len(item):
                        chosen[item] = True
                        tree.search(item, chosen, bands, best[q], top, int(floors[q]))
                        chosen[item] = False
        for q, found in enumerate(best):
            if found:
                ids = [-d for _, d in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([q] * len(found)), pa.array([None if d == NULL_ID else d for d in ids], type=pa.int64()),
                     pa.array([s for s, _ in found])], names=["q", "doc_id", "score"])

    return trees.mapInArrow(run, FOUND)


def ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def item_blocks(items: DataFrame) -> Iterator[list[tuple[object, list[bytes]]]]:
    """(item_id, terms) of all items, in blocks."""
    def run(batch):
        counts = [term_counts(t.as_buffer().to_pybytes() if t.is_valid else None) for t in batch["text"]]
        return {"item_id": batch["item_id"], "terms": [sorted(c) for c in counts]}

    rows = common.pick(items, "item_id", "text")
    terms = common.arrow_map(rows, run, f"item_id {rows.schema['item_id'].dataType.simpleString()}, terms array<binary>")
    block, size = [], 0
    for r in terms.toLocalIterator():
        if block and (len(block) == ITEMS or size + len(r["terms"]) > TERMS):
            yield block
            block, size = [], 0
        block.append((r["item_id"], [bytes(t) for t in r["terms"]]))
        size += len(r["terms"])
    if block:
        yield block


def search_block(docs: DataFrame, block: list[tuple[object, list[bytes]]], top: int) -> DataFrame:
    """q (the item's place in the block), rank, doc_id, score."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
    items = [np.array([vocabulary[t] for t in terms], dtype=np.int64) for _, terms in block]
    rows, rows_at = common.staged_at(vectors(docs, vocabulary), "vectors")
    statistics = Statistics(rows, len(vocabulary))
    bands, floors = statistics.bands(), np.ones(len(items), dtype=np.int64)
    probe = rows.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(PROBE)) == 0)
    for r in (ranked(searched(index(probe, statistics), items, bands, top, floors), top).where(F.col("rank") == top)
              .select("q", "score").collect()):
        floors[r["q"]] = r["score"]
    trees, trees_at = common.staged_at(index(rows, statistics), "ball-trees")
    common.discard(spark, rows_at)
    out = common.stage(ranked(searched(trees, items, bands, top, floors), top), "found")
    common.discard(spark, trees_at)
    return out


def search(docs: DataFrame, benchmark: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of every item with a score above 0."""
    spark = docs.sparkSession
    kind = common.pick(benchmark, "item_id").schema["item_id"].dataType.simpleString()
    whole = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    for block in item_blocks(benchmark):
        names = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(block)], f"q bigint, item_id {kind}")
        whole = whole.unionByName(search_block(docs, block, top).join(F.broadcast(names), "q")
                                  .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return whole
