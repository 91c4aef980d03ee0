"""SimHash near-deduplication by a binary trie self-join.

A text is lower-cased (A-Z), cut into words and shingled; each bit of the
fingerprint is the majority of that bit over the XXH64 hashes of its shingles.
Distinct fingerprints are linked when they differ in at most ``budget`` bits.

The self-join walks a binary trie of fingerprints as pairs of nodes, adds up the
bits in which the two differ and drops a pair once the budget is spent. A node
without a branch is passed over, so a node stands for the bits that all its
fingerprints share, and a leaf is one fingerprint; a pair of nodes is judged by
the bits known of both. Subtrees that already hang together are not paired again,
so a group of near copies costs about its size, not its pairs, and gives the
edges of a spanning forest.

To deal the work out, the bits are cut into stretches, and one walk is made for each
choice of all but ``budget`` of them, which puts these at the top: two fingerprints
within the budget agree in that many stretches, so in one of the walks their paths
coincide down to the node where the chosen stretches end. The nodes there are
Spark's groups, and each is walked in its task down to the leaves. With budget + 1
stretches a node fixes 16 bits, with more it lies deeper: 25 bits with five, 31 with
six. The count of fingerprints settles how many, so that a node's mean stays under a
``LARGE``-th of ``GROUP``. A node of more than ``GROUP`` fingerprints is cut into blocks, and
each pair of blocks is a group of its own: no task's group grows with the table. The components come from Spark rounds that hook
each fingerprint to its smallest neighbour until nothing moves. Copies of one
fingerprint are one node.

Defined cases: a null or empty text, or one without words, has fingerprint zero,
linked like any other; fewer words than a shingle form one shingle; repeated
rows and ties share the component; a null doc_id is no component id unless all
ids are null; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import SMALL_BATCH, forget, passing, rows_of, small_batches, spread_join, table, written

BITS = 64
#: Shingles whose bits are counted at once.
STEP = 1 << 15
#: Fingerprints of a node that are one task's group, and how far the mean of all nodes stays below.
GROUP, LARGE = 50_000, 4


def shingle_hashes(text: bytes | None, shingle: int, seed: int) -> np.ndarray:
    """A row of 8 bytes, highest first, for each shingle; bytes.split cuts at U+0020 and U+0009
    to U+000D alone, and fewer words than a shingle are one."""
    found = (text or b"").lower().split()
    if not found:
        return np.empty((0, 8), np.uint8)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    last = ends[min(shingle, len(found)) - 1 :].tolist()
    first = [0, *(ends[: len(last) - 1] + 1).tolist()]
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in zip(first, last, strict=True)]), np.uint8).reshape(-1, 8)


def majority(grid: np.ndarray) -> int:
    """The bits set in over half of the rows, as an unsigned number; zero without rows."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(grid), STEP):
        counts += np.unpackbits(grid[at : at + STEP], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(grid)).tobytes(), "big")


def fingerprint(text: bytes | None, shingle: int, seed: int) -> int:
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(
    docs: DataFrame, *, shingle: int = 3, seed: int = 42, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every document."""
    small_batches(docs.sparkSession, SMALL_BATCH)

    def run(batches):
        for rows in batches:
            found = np.array([fingerprint(x, shingle, seed) for x in rows.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


class Node:
    """A trie node: the fingerprints that share all but the lowest ``open`` bits of ``value``."""

    __slots__ = ("open", "value", "zero", "one", "at", "whole")

    def __init__(self, values: list[int], lo: int, hi: int):
        self.value, self.at = values[lo], lo
        self.open = (values[lo] ^ values[hi - 1]).bit_length()
        self.zero = self.one = None
        self.whole = hi - lo == 1  # all its fingerprints hang together
        if not self.whole:
            low = self.open - 1
            cut = bisect_left(values, values[hi - 1] >> low << low, lo, hi)
            self.zero, self.one = Node(values, lo, cut), Node(values, cut, hi)


class TrieJoin:
    """A spanning forest of the links among sorted distinct unsigned fingerprints: ``edges``
    are pairs of positions, and ``seen`` is how many pairs of nodes were met."""

    def __init__(self, values: list[int], budget: int):
        self.budget, self.edges, self.seen = budget, [], 0
        self.root = list(range(len(values)))
        if len(values) > 1:
            self.within(Node(values, 0, len(values)))

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    def within(self, node: Node) -> None:
        """All links in a node."""
        if node.zero is not None:
            self.within(node.zero)
            self.within(node.one)
            self.between(node.zero, node.one)
            node.whole = node.zero.whole and node.one.whole and self.find(node.zero.at) == self.find(node.one.at)

    def between(self, a: Node, b: Node) -> None:
        """Links between two nodes, as many as join what they can join."""
        self.seen += 1
        still = max(a.open, b.open)
        if ((a.value ^ b.value) >> still).bit_count() > self.budget:
            return
        if a.whole and b.whole and self.find(a.at) == self.find(b.at):
            return
        if not still:
            i, j = self.find(a.at), self.find(b.at)
            self.root[max(i, j)] = min(i, j)
            self.edges.append((a.at, b.at))
        elif a.open >= b.open:
            self.between(a.zero, b)
            self.between(a.one, b)
        else:
            self.between(a, b.zero)
            self.between(a, b.one)


def forest(values: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among distinct sorted values."""
    edges = np.array(TrieJoin(values.tolist(), budget).edges, np.int64).reshape(-1, 2)
    return values[edges[:, 0]], values[edges[:, 1]]


def _groups(frames: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    """The fingerprints of each group; a group's rows follow one another."""
    held: list[np.ndarray] = []
    key = None
    for frame in frames:
        keys, values = frame[["r", "node", "lo", "hi"]].to_numpy(), frame["fp"].to_numpy().view(np.uint64)
        cuts = [0, *(np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if key is not None and tuple(keys[a]) != key:
                yield np.concatenate(held)
                held = []
            key = tuple(keys[a])
            held.append(values[a:b])
    if held:
        yield np.concatenate(held)


def _link(budget: int):
    def run(frames):
        out, size = [], 0
        for values in _groups(frames):
            if len(values) == 1:
                continue
            a, b = forest(np.unique(values), budget)
            if len(a):
                out.append((a.view(np.int64), b.view(np.int64)))
                size += len(a)
            if size >= 50_000:
                yield pd.DataFrame({"a": np.concatenate([x for x, _ in out]), "b": np.concatenate([x for _, x in out])})
                out, size = [], 0
        if out:
            yield pd.DataFrame({"a": np.concatenate([x for x, _ in out]), "b": np.concatenate([x for _, x in out])})

    return run


def stretches(budget: int, count: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of as many stretches as bring ``count`` fingerprints to small nodes."""
    for n in range(budget + 1, BITS):
        cuts = [BITS * i // n for i in range(n + 1)]
        found = [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
        fixed = sum(sorted(bits for _, bits in found)[: n - budget])
        if count >> fixed <= GROUP // LARGE:
            break
    return found


def _node(fp: Column, chosen: tuple[tuple[int, int], ...]) -> Column:
    """The bits of the chosen stretches, side by side."""
    found = F.lit(0).cast("long")
    for low, bits in chosen:
        found = F.shiftleft(found, bits).bitwiseOR(F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << bits) - 1).cast("long")))
    return found


def links(distinct: DataFrame, budget: int = 3) -> DataFrame:
    """Edges (a, b) of a graph whose components are those of all links among ``fp``."""
    small_batches(distinct.sparkSession, SMALL_BATCH)
    cut = stretches(budget, distinct.count())
    walks = [_node(F.col("fp"), chosen) for chosen in combinations(cut, len(cut) - budget)]
    at_node = distinct.select("fp", F.posexplode(F.array(*walks)).alias("r", "node"))
    sizes = written(at_node.groupBy("r", "node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-sizes")
    # blocks of a node: pairs (lo, hi) of block numbers, each fingerprint in the pairs of its own block
    blocks = F.ceil(F.col("n") / F.lit(GROUP)).cast("long")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    dealt = (
        at_node.join(sizes, ["r", "node"])
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select(
            F.col("r").cast("long").alias("r"),
            "node",
            F.least("own", "other").alias("lo"),
            F.greatest("own", "other").alias("hi"),
            "fp",
        )
    )
    key = ["r", "node", "lo", "hi"]
    grouped = dealt.repartition(*key).sortWithinPartitions(*key)
    return grouped.mapInPandas(_link(budget), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(child, parent): every node but the smallest of its component, and that smallest.

    A round gives each child its smallest parent; a further parent is hooked to
    that one, and a child follows its parent to the parent's own smallest.
    """
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent"))
    now = written(ordered.distinct(), "components")
    while True:
        up = written(now.groupBy("child").agg(F.min("parent").alias("top")), "components-up")
        above = up.select(F.col("child").alias("parent"), F.col("top").alias("above"))
        seen = now.join(up, "child").join(above, "parent", "left")
        extra = F.col("parent") != F.col("top")
        moved = seen.select(
            F.when(extra, F.col("parent")).otherwise(F.col("child")).alias("child"),
            F.when(extra, F.col("top")).otherwise(F.coalesce("above", "top")).alias("parent"),
            (extra | F.col("above").isNotNull()).alias("moved"),
        )
        later = written(moved.groupBy("child", "parent").agg(F.max("moved").alias("moved")), "components")
        forget(now)
        forget(up)
        now = later
        if now.where("moved").isEmpty():
            return now.select("child", "parent")
        now = now.select("child", "parent")


def near_duplicates(
    docs: DataFrame,
    *,
    shingle: int = 3,
    seed: int = 42,
    budget: int = 3,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id that links reach)."""
    prints = written(fingerprints(docs, shingle=shingle, seed=seed, text=text, doc_id=doc_id), "simhash-prints")
    with passing(docs.sparkSession):
        nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows")), "simhash-nodes")
        hooked = components(links(nodes, budget))
        joined = nodes.join(hooked, nodes["fp"] == hooked["child"], "left")
        rooted = written(joined.select("fp", "first_id", "rows", F.coalesce("parent", "fp").alias("root")), "simhash-rooted")
        first = written(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-first")
        named = written(rooted.join(first, "root").select("fp", "component_id", "rows"), "simhash-named")
    return spread_join(prints, named, "fp", size="rows", by="doc_id").select("doc_id", "fp", "component_id")


def keep_one_of_each(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The first document of every component, with its columns. The id names a row: rows
    without one all stay, and rows repeated whole become one."""
    found = near_duplicates(docs, text=text, doc_id=doc_id, **options)
    return rows_of(docs, found.where("doc_id = component_id").select("doc_id"), doc_id)


def op4_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
