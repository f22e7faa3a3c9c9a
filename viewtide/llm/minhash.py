"""Near-duplicates by b-bit MinHash, links confirmed on whole shingle sets.

1. Every whole text becomes its set of word shingles, kept as: size, 128-bit hash of the set, the low bits of its minima
   packed into a signature, and one key per band of minima.
2. Texts with one set are one node, named by the smallest doc_id; a hot group of copies shrinks before any shuffle.
3. Nodes that share a band key are candidates. Each group's smallest member is compared with the members outside its
   component, first in some bands, then in all. A pair goes on if the similarity that its signatures' equal lanes give,
   corrected for chance collisions, lies less than six standard deviations below the threshold; it is a link if its whole
   sets say so. That connects most groups without forming their pairs.
4. Groups that still hold several components (heavily edited copies) are compared in full, but as sets against posting
   lists in blocks of bounded size: a pair that shares nothing costs nothing, and only links leave a block.
5. Components are joined by alternating stars on tables in the shared folder.

128 minima in 32 bands of 4: a pair of similarity 0.8 meets in some band with a probability of 1 - 5e-8.

Edge cases: null, empty and blank texts have no shingles and are linked with nothing; a row without doc_id is compared
with nothing and kept, its component is null; rows of one doc_id are one node that has the links of each of its texts; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from viewtide.llm import common

SHINGLE, PERCENT = 5, 80
MINIMA, BANDS, BITS = 128, 32, 4
LANES = 64 // BITS
WORDS = MINIMA // LANES
FIRST_BANDS = 4
#: Shingles of one side of a block.
BLOCK_SHINGLES = 2_000_000
SCHEMA = "n bigint, set_hash binary, lanes array<bigint>, bands array<bigint>"


@functools.cache
def factors() -> tuple[np.ndarray, np.ndarray]:
    """Fixed odd factors and summands of the permutations."""
    x = common.mix(np.arange(1, 2 * MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:MINIMA, None] | np.uint64(1), x[MINIMA:, None]


def minima(found: np.ndarray) -> np.ndarray:
    a, b = factors()
    best = np.full(MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(found), 2048):
            best = np.minimum(best, (found[None, at:at + 2048] * a + b).min(axis=1))
    return best


def describe(found: np.ndarray) -> tuple:
    """n, set hash, packed low bits and band keys of a sorted set of shingles."""
    if not len(found):
        return 0, None, None, None
    with np.errstate(over="ignore"):
        best = minima(found)
        low = (common.mix(best) & np.uint64((1 << BITS) - 1)).reshape(WORDS, LANES)
        lanes = (low << (np.arange(LANES, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)
        keys = np.arange(1, BANDS + 1, dtype=np.uint64)
        for column in best.reshape(BANDS, MINIMA // BANDS).T:
            keys = common.mix(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return (len(found), xxhash.xxh3_128_digest(found.tobytes()), lanes.view(np.int64).tolist(),
            keys.view(np.int64).tolist())


@functools.cache
def hasher() -> common.WordHashes:
    return common.WordHashes()


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    return np.unique(common.shingles(common.text_hashes(text, hasher()), size))


def described(docs: DataFrame, size: int) -> DataFrame:
    """doc_id and the set's description for every row of ``docs`` (doc_id, text)."""
    def run(batch):
        rows = [describe(shingle_set(t.as_py(), size)) for t in batch["text"].cast("binary")]
        return {"doc_id": batch["doc_id"]} | dict(zip(("n", "set_hash", "lanes", "bands"), zip(*rows)))

    return common.arrow_map(docs, run, "doc_id bigint, " + SCHEMA, lambda: hasher().known.clear())


def sets_of(docs: DataFrame, size: int) -> DataFrame:
    """node and its whole set, for every row of ``docs`` (doc_id, text)."""
    def run(batch):
        return {"node": batch["doc_id"],
                "shingles": [shingle_set(t.as_py(), size).view(np.int64) for t in batch["text"].cast("binary")]}

    return common.arrow_map(docs, run, "node bigint, shingles array<bigint>", lambda: hasher().known.clear())


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for every node of ``edges`` (a, b).

    Large stars and small stars in turn: each node's neighbours are tied to the smallest one among them.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = common.stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                       .distinct(), "edges")
    state = None
    while True:
        # large star: every larger neighbour of a node goes to the smallest of the node's neighbours and itself
        around = both(now)
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = (around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")))
        large = large.where("a <> b").distinct()
        # small star: a node's smaller neighbours and itself go to the smallest of them
        small_least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = (large.join(small_least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
                 .unionByName(small_least.select("a", F.col("least").alias("b"))).where("a <> b").distinct())
        now = common.stage(small, "edges")
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sums) == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = tuple(sums)


def equal_lanes(a: str, b: str):
    """How many of the minima have equal low bits: lanes of the exclusive or that are zero, counted in 64-bit words."""
    ones = sum(1 << (BITS * i) for i in range(LANES))
    ones -= (ones >> 63) << 64
    differ = []
    for i in range(WORDS):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        folded = functools.reduce(lambda p, q: p.bitwiseOR(q), [F.shiftrightunsigned(x, k) for k in range(1, BITS)], x)
        differ.append(F.bit_count(folded.bitwiseAND(F.lit(ones).cast("bigint"))))
    return F.lit(MINIMA) - functools.reduce(lambda p, q: p + q, differ)


def estimate(a: str, b: str):
    """Similarity from equal lanes; different minima agree in their low bits by chance, which is taken off."""
    chance = 2.0 ** -BITS
    return (equal_lanes(a, b) / F.lit(float(MINIMA)) - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    """Six standard deviations below the threshold."""
    chance, j = 2.0 ** -BITS, percent / 100
    p = j + (1 - j) * chance
    return j - 6 * math.sqrt(p * (1 - p) / MINIMA) / (1 - chance)


class Links:
    """Candidates and links between nodes; every table is in the shared folder."""

    def __init__(self, nodes: DataFrame, sets: DataFrame, members: DataFrame, percent: int):
        self.nodes, self.sets, self.members, self.percent = nodes, sets, members, percent
        self.labels = members.select("node").distinct().select("node", F.col("node").alias("component"))
        self.labels = common.stage(self.labels, "labels")

    def labelled(self, members: DataFrame) -> DataFrame:
        return members.join(self.labels, "node")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b) that are links."""
        side = lambda x: self.nodes.select(F.col("node").alias(x), F.col("lanes").alias(f"l{x}"), F.col("n").alias(f"n{x}"))
        near = 100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb")
        seen = (pairs.distinct().join(side("a"), "a").join(side("b"), "b")
                .where(near & (estimate("la", "lb") >= least_estimate(self.percent))).select("a", "b").distinct())
        seen = common.stage(seen, "candidates")
        sa = self.sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
        sb = self.sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
        shared = F.size(F.array_intersect("sa", "sb"))
        union = F.size("sa") + F.size("sb") - shared
        return seen.join(sb, "b").join(sa, "a").where(100 * shared >= self.percent * union).select("a", "b")

    def union(self, links: DataFrame) -> None:
        """Join the components that the links (a, b) connect."""
        of = lambda side: self.labels.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
        ties = links.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        ties = common.stage(ties.where("a <> b").distinct(), "ties")
        if ties.isEmpty():
            return
        joined = components(ties).select(F.col("component").alias("least"), F.col("node").alias("component"))
        labels = self.labels.join(joined, "component", "left").select("node", F.coalesce("least", "component").alias("component"))
        self.labels = common.stage(labels, "labels")

    def star(self, members: DataFrame) -> None:
        """Compare each group's smallest member with the members outside its component."""
        here = self.labelled(members)
        centers = here.groupBy("key").agg(F.min_by(F.struct("node", "component"), "node").alias("c"))
        pairs = (here.join(centers, "key").where("component <> c.component")
                 .select(F.col("c.node").alias("a"), F.col("node").alias("b")))
        self.union(self.confirmed(pairs))

    def open_groups(self, members: DataFrame) -> DataFrame:
        """key, node, component, main of the groups that hold more than one component."""
        here = self.labelled(members)
        spans = here.groupBy("key").agg(F.min("component").alias("main"), F.max("component").alias("other")).where("main < other")
        return here.join(spans.select("key", "main"), "key")

    def blocks(self, groups: DataFrame) -> DataFrame:
        """Links (a, b) between different components of the nodes in ``groups`` (key, node, component).

        Groups that share nodes form a cluster. The nodes outside a cluster's largest component are compared with all of
        the cluster, in blocks of a bounded number of shingles; only links leave a block, one per node and component.
        """
        least = groups.groupBy("key").agg(F.min("node").alias("b"))
        clusters = components(groups.join(least, "key").select(F.col("node").alias("a"), "b"))
        clusters = clusters.withColumnRenamed("component", "cluster")
        clusters = clusters.unionByName(clusters.select(F.col("cluster").alias("node"), "cluster")).distinct()
        nodes = groups.select("node", "component").distinct().join(clusters, "node").join(
            self.nodes.groupBy("node").agg(F.sum("n").alias("n")), "node")
        nodes = common.stage(nodes, "open-nodes")
        sizes = nodes.groupBy("cluster", "component").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
        mains = sizes.groupBy("cluster").agg(F.max_by("component", F.struct("k", "component")).alias("main"),
                                             F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("parts"))
        dealt = (nodes.drop("n").join(mains, "cluster").join(self.sets, "node")
                 .withColumn("own", F.pmod(F.xxhash64("node"), "parts")))
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
        columns = ("cluster", "i", "j", "node", "component", "shingles")
        all_nodes = dealt.withColumn("i", every).withColumn("j", F.col("own")).select(*columns, F.lit(False).alias("seeks"))
        seekers = (dealt.where("component <> main").withColumn("j", every).withColumn("i", F.col("own"))
                   .select(*columns, F.lit(True).alias("seeks")))
        percent = self.percent
        return all_nodes.unionByName(seekers).groupBy("cluster", "i", "j").applyInArrow(
            lambda table: compare(table, percent), "a bigint, b bigint")

    def finish(self) -> None:
        self.star(self.members.where(F.col("band") < FIRST_BANDS))
        self.star(self.members)
        groups = common.stage(self.open_groups(self.members), "groups")
        if not groups.isEmpty():
            self.union(self.blocks(groups))


def compare(table: pa.Table, percent: int) -> pa.Table:
    """Links of the seeking nodes of a block with its other nodes of other components, one per component."""
    def side(seeks: bool):
        rows = table.filter(pa.compute.equal(table["seeks"], seeks)).combine_chunks()
        lists = rows["shingles"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        n = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        return (rows["node"].to_numpy(), rows["component"].to_numpy(), n, np.concatenate([[0], np.cumsum(n)]),
                lists.flatten().to_numpy())

    node, component, n, _, values = side(False)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], np.repeat(np.arange(len(n)), n)[order]
    links: list[tuple[int, int]] = []
    for a, own, size, found in seeking(*side(True)):
        low, high = np.searchsorted(values, found, "left"), np.searchsorted(values, found, "right")
        times = high - low
        places = np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        shared = np.bincount(owner[places], minlength=len(n))
        hit = np.flatnonzero((100 * shared >= percent * (size + n - shared)) & (component != own))
        links += [(a, int(node[hit[k]])) for k in np.unique(component[hit], return_index=True)[1]]
    return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})


def seeking(node, component, n, begins, values):
    for k in range(len(node)):
        yield int(node[k]), component[k], n[k], values[begins[k]:begins[k + 1]]


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    rows = common.pick(docs, "doc_id", "text")
    known = common.stage(described(rows, size), "sets")
    named = known.where("n > 0 and doc_id is not null")
    nodes = named.groupBy("set_hash").agg(F.min("doc_id").alias("node"), F.first("lanes").alias("lanes"), F.first("n").alias("n"),
                                          F.first("bands").alias("bands"))
    nodes = common.stage(nodes, "nodes")
    keys = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last")
    members = common.stage(keys.join(shared.select("key"), "key").select("band", "key", "node").distinct(), "members")
    wanted = members.select(F.col("node").alias("doc_id")).distinct()
    sets = common.stage(sets_of(rows.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]), size), "shingles")
    links = Links(nodes, sets, members, percent)
    links.finish()
    by_set = nodes.select("set_hash", "node").join(links.labels, "node", "left").select(
        "set_hash", F.coalesce("component", "node").alias("component"))
    out = known.join(by_set, "set_hash", "left").withColumn(
        "component_id", F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def distinct_documents(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest doc_id, with all its columns.

    Of equal texts of one doc_id one stays; different texts of one doc_id are documents of their own. Documents without doc_id
    all stay.
    """
    flat = common.numbered(docs)
    own, text = (f"c{common.position(docs, n)}" for n in ("doc_id", "text"))
    keyed = flat.where(F.col(own).isNotNull()).withColumn("text_key", F.xxhash64(F.coalesce(text, F.lit(""))))
    if keyed.groupBy(own).agg(F.min("text_key").alias("a"), F.max("text_key").alias("b")).where("a <> b").isEmpty():
        keyed = keyed.withColumn("own", F.col(own))
    else:
        # numbers in the order of (doc_id, text_key): ids of sorted partitions only grow
        numbers = common.stage(
            keyed.select(F.col(own).alias("number_of"), F.col("text_key").alias("number_key")).distinct()
            .orderBy("number_of", "number_key").withColumn("own", F.monotonically_increasing_id()), "numbers")
        keyed = common.stage(keyed.join(numbers, (F.col(own) == F.col("number_of")) & (
            F.col("text_key") == F.col("number_key"))).drop("number_of", "number_key"), "numbered")
    stay = near_duplicates(keyed.select(F.col("own").alias("doc_id"), F.col(text).alias("text")), size, percent)
    stay = common.stage(stay.where("kept").select(F.col("doc_id").alias("staying")).distinct(), "staying")
    order = Window.partitionBy("own").orderBy("text_key")
    one = (keyed.join(stay, keyed["own"] == stay["staying"], "left_semi")
           .withColumn("repeat", F.row_number().over(order)).where("repeat = 1").select(*flat.columns))
    return one.unionByName(flat.where(F.col(own).isNull())).toDF(*docs.columns)
