"""Near-copies: SimHash links, completed and checked by Jaccard similarity.

Two texts are near-copies when the sets of their shingles of five words (A-Z
lower-cased) have a Jaccard similarity of at least 0.8. SimHash alone cannot find
them all: at 0.8 some 10 of 64 bits differ. So candidates come from two sides:

* the SimHash trie self-join (`simhash.links`) over fingerprints of five-word
  shingles, which finds the close ones;
* ``BANDS`` bands of ``ROWS`` MinHash values for the others: a pair of similarity
  0.8 shares no band with a probability of 3e-6. A sketch of a byte of each
  value drops pairs that agree in fewer than ``AGREE`` of them, which one of
  similarity 0.8 does with a probability of some 2e-6. Four bytes of each band's key
  tell which band a pair shares first.

Every candidate is then checked exactly, on the 64-bit hashes of all shingles.

A bucket of many near-copies gives no pairs of all its members. The rows of all
buckets are sorted over the tasks, and each meets the ``REACH`` rows behind it, or
the next ``FEW`` in a bucket of more; smaller buckets are then done. In a larger one
whose members still lie in several components, those outside its largest one meet
all others, in blocks of bounded size and in the first band that a pair shares, so
no pair is left out.

Defined cases: texts with fewer words than a shingle are one shingle, those
without words equal one another; rows without an id are no near-copies of any
row; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import SMALL_BATCH, forget, passing, rows_of, small_batches, written
from leadloom.llm.simhash import components, links, majority, shingle_hashes

SHINGLE, LEAST, SEED = 5, 0.8, 42
BANDS, ROWS, AGREE = 32, 5, 102
#: Rows of a bucket that each row meets, and rows of a block of a larger bucket.
REACH, FEW, BLOCK = 8, 2, 1000
#: Rows up to which a bucket stays in one partition.
SPREAD = 10_000
#: Shingle hashes (of 8 bytes) that a block of mates has on average, or a piece of those who ask it.
HELD = 1 << 22
#: Shingles that are hashed by all functions at once.
STEP = 1 << 12


def hashes_of(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles as bytes, and those of the distinct ones, ascending."""
    grid = shingle_hashes(text, SHINGLE, SEED)
    return grid, np.unique(grid.view(">u8").reshape(-1).astype(np.uint64))


def _functions() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    draw = lambda: r.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
    return draw() | np.uint32(1), draw()


def min_values(distinct: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    odd, add = functions
    short = (distinct >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(odd), np.iinfo(np.uint32).max)
    for at in range(0, len(short), STEP):
        np.minimum(least, (short[at : at + STEP, None] * odd + add).min(axis=0), out=least)
    return least


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n (its distinct shingles), SimHash, the keys of its bands and the sketch."""

    def run(batches):
        functions = _functions()
        weights = np.random.default_rng(SEED + 1).integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)
        for rows in batches:
            found = [hashes_of(x) for x in rows.column(1).to_pylist()]
            least = np.array([min_values(x, functions) for _, x in found], np.uint32).reshape(-1, BANDS, ROWS)
            keys = (least * weights).sum(axis=2, dtype=np.uint64)
            keys ^= keys >> np.uint64(29)
            sketch = (least & np.uint32(255)).astype(np.uint8).reshape(len(found), BANDS * ROWS)
            tags = (keys >> np.uint64(32)).astype("<u4").view(np.uint8).reshape(len(found), 4 * BANDS)
            ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array([len(x) for _, x in found], pa.int32()),
                    pa.array(np.array([majority(grid) for grid, _ in found], np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(ends, pa.array(keys.reshape(-1).view(np.int64))),
                    pa.array([x.tobytes() for x in np.concatenate([sketch, tags], axis=1)], pa.binary()),
                ],
                ["doc_id", "n", "fp", "keys", "sketch"],
            )

    return docs.mapInArrow(run, "doc_id long, n int, fp long, keys array<long>, sketch binary")


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, BANDS * (ROWS + 4))


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of sketches can reach the similarity."""
    n = BANDS * ROWS
    return (x[..., :n] == y[..., :n]).sum(axis=-1) >= AGREE


def _first(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The first band that pairs of sketches share."""
    shared = (x == y)[..., BANDS * ROWS :]
    return shared.reshape(*shared.shape[:-1], BANDS, 4).all(axis=-1).argmax(axis=-1)


def _sliding(members: DataFrame) -> DataFrame:
    """Pairs of rows that lie close to one another in a bucket."""

    def run(frames):
        held = None
        for frame in frames:
            rows = frame if held is None else pd.concat([held, frame])
            key, doc, n, size = (rows[c].to_numpy() for c in ("key", "doc_id", "n", "rows"))
            sketch, old, out = _sketches(rows["sketch"]), 0 if held is None else len(held), []
            for lag in range(1, min(REACH, len(rows) - 1) + 1):
                # pairs whose later row is new
                i = np.arange(max(0, old - lag), len(rows) - lag)
                j = i + lag
                near = (key[i] == key[j]) & (np.minimum(n[i], n[j]) >= LEAST * np.maximum(n[i], n[j]))
                near &= (lag <= FEW) | (size[i] <= REACH + 1)
                i, j = i[near], j[near]
                near = _alike(sketch[i], sketch[j])
                out.append(np.stack([doc[i[near]], doc[j[near]]]))
            if out:
                a, b = np.concatenate(out, axis=1)
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})
            held = rows.iloc[-REACH:]

    order = F.xxhash64("doc_id", "key")
    # only a very large bucket is cut where partitions meet; those pairs are left to _apart
    spread = F.when(F.col("rows") > SPREAD, order).otherwise(0)
    laid = members.select("key", spread.alias("spread"), order.alias("o"), "rows", "doc_id", "n", "sketch").repartitionByRange("key", "spread")
    return laid.sortWithinPartitions("key", "o").mapInPandas(run, "a long, b long")


def _apart(members: DataFrame, hooked: DataFrame, blocks: int) -> DataFrame:
    """The pairs of larger buckets that lie in different components: for a document its mates,
    by the mates' block, so there is no row for each pair."""
    roots = hooked.select(F.col("child").alias("doc_id"), F.col("parent").alias("root"))
    rooted = members.join(roots, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    parts = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"))
    of_key = parts.groupBy("key").agg(F.max(F.struct("size", "root")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("size").alias("rows"))
    mixed = of_key.where((F.col("parts") > 1) & (F.col("rows") > REACH + 1)).select(
        F.col("key"),
        F.col("main.root").alias("main"),
        F.ceil(F.col("rows") / BLOCK).alias("blocks"),
        F.ceil((F.col("rows") - F.col("main.size")) / BLOCK).alias("asking"),
    )
    rows = rooted.join(mixed, "key").withColumn("asks", F.col("root") != F.col("main"))
    spread = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    own = lambda n: F.pmod(F.xxhash64("doc_id", "key"), F.col(n))
    columns = ["key", "band", "doc_id", "n", "root", "sketch"]
    asked = rows.select(*columns, "asks", F.lit(False).alias("query"), own("blocks").alias("m"), F.explode(spread("asking")).alias("q"))
    asking = rows.where("asks").select(*columns, "asks", F.lit(True).alias("query"), F.explode(spread("blocks")).alias("m"), own("asking").alias("q"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x, y = frame[frame["query"]], frame[~frame["query"]]
        doc, n, root, asks, sketch = (y[c].to_numpy() for c in ("doc_id", "n", "root", "asks", "sketch"))
        sketch, out = _sketches(sketch), []
        for d, m, r, band, s in zip(x["doc_id"], x["n"], x["root"], x["band"], _sketches(x["sketch"]), strict=True):
            near = np.nonzero((root != r) & (~asks | (doc > d)) & (np.minimum(n, m) >= LEAST * np.maximum(n, m)))[0]
            near = near[_alike(sketch[near], s)]
            near = near[_first(sketch[near], s) == band]
            mates = doc[near]
            out += [(d, int(k), mates[mates % blocks == k]) for k in np.unique(mates % blocks)]
        return pd.DataFrame(out, columns=["a", "block", "mates"])

    found = asked.unionByName(asking).groupBy("key", "m", "q").applyInPandas(run, "a long, block long, mates array<long>")
    return found.groupBy("a", "block").agg(F.array_distinct(F.flatten(F.collect_list("mates"))).alias("mates"))


def _by_block(pairs: DataFrame, blocks: int) -> DataFrame:
    """Pairs as a document's mates in each block."""
    block = F.pmod("b", F.lit(blocks).cast("long"))
    return pairs.where("a <> b").groupBy("a", block.alias("block")).agg(F.collect_set("b").alias("mates"))


def _settled(asked: DataFrame, sets: DataFrame, blocks: int) -> DataFrame:
    """The pairs whose similarity reaches the least. A block of mates is one group, so a
    document's hashes travel once for each block that it asks, not once for each pair. Where
    those who ask a block have many hashes, they come in pieces, and the block to each of them."""
    asked = written(asked, "near-asked")
    load = asked.select("a", "block").join(sets.select(F.col("doc_id").alias("a"), "n"), "a").groupBy("block")
    pieces = written(load.agg(F.ceil(F.sum("n") / HELD).cast("long").alias("pieces")), "near-pieces")
    piece = F.pmod(F.xxhash64("a"), F.col("pieces")).alias("piece")
    asking = asked.join(pieces, "block").select("a", "block", "mates", piece)
    asking = asking.join(sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("a_hashes")), "a")
    block = F.pmod("doc_id", F.lit(blocks).cast("long")).alias("block")
    placed = sets.select(block, F.col("doc_id").alias("b"), F.col("hashes").alias("b_hashes")).join(pieces, "block")
    theirs = placed.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"), "b", "b_hashes")

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        known, out = dict(zip(y["b"], y["b_hashes"], strict=True)), []
        for a, mates, hashes in zip(x["a"], x["mates"], x["a_hashes"], strict=True):
            out += [(min(a, b), max(a, b)) for b in mates.tolist() if similar(hashes, known[b])]
        return pd.DataFrame(out, columns=["a", "b"])

    met = asking.groupBy("block", "piece").cogroup(theirs.groupBy("block", "piece"))
    return written(met.applyInPandas(run, "a long, b long"), "near-settled")


def similar(s: bytes, t: bytes) -> bool:
    """Whether two sets of shingle hashes reach the similarity."""
    x, y = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= LEAST * (len(x) + len(y) - both)


def _hashed(source: DataFrame, needed: DataFrame) -> DataFrame:
    """doc_id, the number of its shingles and their hashes, for the documents of ``needed``. Rows of one id
    count as one document: any of them stands for it."""

    def run(batches):
        for rows in batches:
            found = [hashes_of(x)[1] for x in rows.column(1).to_pylist()]
            columns = [pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([rows.column(0), *columns], ["doc_id", "n", "hashes"])

    sets = source.join(needed.distinct(), "doc_id", "left_semi").mapInArrow(run, "doc_id long, n long, hashes binary")
    return written(sets.dropDuplicates(["doc_id"]), "near-sets")


def _close(signed: DataFrame, budget: int) -> DataFrame:
    """Candidates (a, b) by SimHash: documents of one fingerprint, and those of linked ones."""
    nodes = written(signed.groupBy("fp").agg(F.min("doc_id").alias("first")), "near-nodes")
    same = signed.join(nodes, "fp").where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    first = lambda c: nodes.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_first"))
    linked = links(nodes, budget).join(first("a"), "a").join(first("b"), "b")
    return written(same.unionByName(linked.select(F.least("a_first", "b_first").alias("a"), F.greatest("a_first", "b_first").alias("b"))), "near-close")


def _members(signed: DataFrame) -> DataFrame:
    """The rows of MinHash buckets of two or more."""
    banded = signed.select("doc_id", F.posexplode("keys").alias("band", "key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    return written(banded.join(shared, "key").join(signed.select("doc_id", "n", "sketch"), "doc_id"), "near-members")


def near_copies(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", budget: int = 3) -> DataFrame:
    """(child, parent): each document with a smaller one in its component, and the smallest."""
    small_batches(docs.sparkSession, SMALL_BATCH)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).where("doc_id is not null")
    spark = docs.sparkSession
    with passing(spark):
        signed = written(signatures(source), "near-signed")
        members = _members(signed)
        with passing(spark):
            close = _close(signed, budget)
        forget(signed)
        asked = members.select("doc_id").unionByName(close.select(F.explode(F.array("a", "b")).alias("doc_id")))
        sets = _hashed(source, asked)
        count, held = sets.agg(F.count(F.lit(1)), F.sum("n")).first()
        blocks = max(1, -(-count // BLOCK), -(-(held or 0) // HELD))
        with passing(spark):
            found = _settled(_by_block(_sliding(members).unionByName(close), blocks), sets, blocks)
        forget(close)
        hooked = components(found)
        with passing(spark):
            more = _settled(_apart(members, hooked, blocks), sets, blocks)
        forget(members)
        forget(sets)
        if not more.isEmpty():
            hooked = components(found.unionByName(more))
        else:
            hooked = written(hooked, "near-hooked")
    return hooked


def keep_one_of_each(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The first document of every component, with its columns. The id names a row: rows
    without one all stay, and rows repeated whole become one."""
    gone = near_copies(docs, text=text, doc_id=doc_id).select(F.col("child").alias("doc_id"))
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"))
    return rows_of(docs, ids.join(gone, "doc_id", "left_anti"), doc_id)
