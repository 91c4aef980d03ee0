"""Audit of how filters interact, with duplicates told by radix text tries.

Five filters judge whole texts; the fifth fails a document whose text a smaller
``doc_id`` of the table has too. For every order of the filters the audit tells what
each step removes, in total and of the labelled documents.

1. Each task puts the texts it reads into compressed (radix) tries that hold the
   smallest id at each terminal. A document above the smallest id is a duplicate at
   once; only a text's row of smallest id goes on with its text. Both are written to
   the shared folder.
2. Ranges of the text order are named by prefixes that adapt to the texts: bytes
   are summed for prefixes of several lengths, and a text belongs to its shortest
   prefix that is not heavy. Heavy prefixes number at most `LEVELS` times
   `MOST_RANGES`, whatever the input.
3. The texts are dealt by range and sorted by their heads inside a task, which inserts
   whole texts into tries, settles all rows but those of the smallest id, traverses the
   trie when no later text can belong to it, and goes on with an empty one.
4. Rows without texts (id, part, mask) take the labels of their ids and are reduced to
   counts by mask. All 120 orders are sums over the 32 masks of a part.

A text that a third of all documents share leaves each task once for each block of
`LOCAL_BYTES`, and streams through its range as one terminal.

Defined cases: a null text is empty, a null source is the part of the empty string; a
row without an id has no smaller or larger one, so it never is a duplicate nor makes one,
and takes no label; rows repeated with their id are not duplicates of each other, each
counts; several labels of an id count as one that is good (toxic) if any is; an empty
table has no parts and gives no rows; further columns are not read, those of a clashing
name are not touched. The longest text must fit a task, as it does in the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import forget, small_batches, table, written

FILTERS = "ABCDE"
DUPLICATE = 16
#: Bytes of text in the trie of a task; bytes of a range, and the most ranges.
LOCAL_BYTES, RANGE_BYTES, MOST_RANGES = 32 << 20, 1 << 20, 65536
#: Lengths of the prefixes that ranges choose from, and of the head that a task sorts by.
LEVELS, HEAD = (2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096), 256
CAPITALS, SYMBOLS, FOLLOWING = bytes(range(65, 91)), b"#$%&*|", bytes(range(0x80, 0xC0))


def text_mask(text: bytes) -> int:
    """Which of the filters A to D a text fails, as bits 1, 2, 4, 8."""
    words = text.split()  # cuts at U+0020 and U+0009 to U+000D
    without = lambda drop: len(text.translate(None, drop))
    fails = (
        len(words) < 200,
        100 * len(set(words)) < 50 * len(words),
        100 * (len(text) - without(CAPITALS)) > 2 * without(FOLLOWING),
        len(text) > without(SYMBOLS),
    )
    return sum(1 << i for i, failed in enumerate(fails) if failed)


def shared_length(label: bytes, text: bytes, at: int) -> int:
    """How far ``label`` agrees with ``text`` from ``at`` on."""
    low, high = 0, min(len(label), len(text) - at)
    step = 64
    while low < high:
        end = min(low + step, high)
        if label[low:end] == text[at + low : at + end]:
            low, step = end, step * 2
        else:
            high, step = end - 1 if end - low == 1 else end, max(1, (end - low) // 2)
            if end - low == 1:
                return low
    return low


class Node:
    __slots__ = ("label", "kids", "end")

    def __init__(self, label: bytes):
        self.label, self.kids, self.end = label, {}, None


class RadixTrie:
    """A compressed trie of whole texts: edges are labelled with stretches of bytes, and the
    terminal of a text holds its smallest id, its mask and the rows of that id."""

    def __init__(self):
        self.root, self.size = Node(b""), 0

    def terminal(self, text: bytes) -> Node:
        node, at = self.root, 0
        while at < len(text):
            kid = node.kids.get(text[at])
            if kid is None:
                kid = node.kids[text[at]] = Node(text[at:])
                self.size += len(text) - at + 400
                return kid
            if not text.startswith(kid.label, at):
                n = shared_length(kid.label, text, at)
                fork = Node(kid.label[:n])
                kid.label = kid.label[n:]
                fork.kids[kid.label[0]] = kid
                node.kids[text[at]] = kid = fork
                self.size += 400
            node, at = kid, at + len(kid.label)
        return node

    def add(self, text: bytes, doc_id: int, part: str, n: int, mask: int | None, out: list) -> None:
        """Insert a row; rows that are duplicates now go to ``out`` as (id, part, mask, n)."""
        node = self.terminal(text)
        if node.end is None:
            node.end = [doc_id, text_mask(text) if mask is None else mask, {part: n}]
            return
        least, mask, rows = node.end
        if doc_id == least:
            rows[part] = rows.get(part, 0) + n
        elif doc_id > least:
            out.append((doc_id, part, mask | DUPLICATE, n))
        else:
            out.extend((least, p, mask | DUPLICATE, k) for p, k in rows.items())
            node.end = [doc_id, mask, {part: n}]

    def terminals(self) -> Iterator[tuple[bytes, int, int, dict[str, int]]]:
        """(text, smallest id, mask, rows of that id by part), depth first."""
        stack = [(self.root, b"")]
        while stack:
            node, above = stack.pop()
            text = above + node.label
            if node.end is not None:
                yield text, *node.end
            stack.extend((kid, text) for kid in node.kids.values())


SCHEMA = "doc_id long, part string, mask int, n long, text binary"
KINDS = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary())


def _batches(rows: Iterator[tuple], names: list[str], kinds: tuple, most: int = 4 << 20):
    """Arrow batches of some megabytes; the last column may hold a text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + len(row[-1] or b"" if isinstance(row[-1], bytes | None) else b"")
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)


def _combine(local_bytes: int):
    """Documents of a task: duplicates without their text, and each text once a block."""

    def rows(batches):
        trie, out = RadixTrie(), []
        for batch in batches:
            for doc_id, text, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text, part = text or b"", part or ""
                if doc_id is None:
                    out.append((None, part, text_mask(text), 1))
                else:
                    trie.add(text, doc_id, part, 1, None, out)
                if trie.size > local_bytes:
                    yield from _ends(trie)
                    trie = RadixTrie()
            yield from ((*row, None) for row in out)
            out.clear()
        yield from _ends(trie)

    return lambda batches: _batches(rows(batches), ["doc_id", "part", "mask", "n", "text"], KINDS)


def _ends(trie: RadixTrie):
    for text, doc_id, mask, rows in trie.terminals():
        yield from ((doc_id, part, mask, n, text) for part, n in rows.items())


def range_of(text: bytes, heavy: frozenset) -> int:
    """The hash of the shortest prefix that is not heavy; the longest if all are."""
    found = 0
    for level, length in enumerate(LEVELS):
        found = xxhash.xxh64_intdigest(text[:length], level)
        if found not in heavy or len(text) <= length:
            break
    return found - (1 << 64) if found >> 63 else found


def _prefixes(batches):
    """Bytes of the texts under each prefix, summed over a batch; (hash, bytes)."""
    for batch in batches:
        sums: dict[int, int] = {}
        for text in batch.column(0).to_pylist():
            for level, length in enumerate(LEVELS):
                key = xxhash.xxh64_intdigest(text[:length], level)
                sums[key] = sums.get(key, 0) + len(text) + 64
                if len(text) <= length:
                    break
        yield pa.RecordBatch.from_arrays([pa.array([k - (1 << 64) if k >> 63 else k for k in sums], pa.int64()), pa.array(list(sums.values()), pa.int64())], ["prefix", "bytes"])


def heavy_prefixes(texts: DataFrame, range_bytes: int = RANGE_BYTES) -> frozenset:
    """Hashes of the prefixes over more bytes than a range should have. They are no more than
    len(LEVELS) * MOST_RANGES, since the bytes of a range follow the input from there on."""
    total = texts.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    most = max(range_bytes, total // MOST_RANGES)
    sums = texts.select("text").mapInArrow(_prefixes, "prefix long, bytes long").groupBy("prefix").agg(F.sum("bytes").alias("bytes"))
    return frozenset(row.prefix % (1 << 64) for row in sums.where(F.col("bytes") > most).collect())


def _placed(heavy: frozenset):
    def run(batches):
        for batch in batches:
            texts = batch.column(4)
            cells = pa.array([range_of(t, heavy) for t in texts.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], [*batch.schema.names, "cell"])

    return run


def _settle(most: int):
    """Rows of whole ranges, sorted by range and head: each leaves without its text, with its mask."""

    def rows(batches):
        trie, out, last = RadixTrie(), [], None
        for batch in batches:
            for doc_id, part, mask, n, text, cell in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = cell, text[:HEAD]
                if at != last and trie.size > most:  # no later text is equal to one in the trie
                    yield from ((*row[:4],) for row in _ends(trie))
                    trie = RadixTrie()
                last = at
                trie.add(text, doc_id, part, n, mask, out)
            yield from out
            out.clear()
        yield from ((*row[:4],) for row in _ends(trie))

    return lambda batches: _batches(rows(batches), ["doc_id", "part", "mask", "n"], KINDS[:4])


def masks(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", part: str = "source", range_bytes: int = RANGE_BYTES, local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """(doc_id, part, mask, n): how many rows of an id fail which filters, E included."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("content"), F.col(part).cast("string").alias("part"))
    combined = written(rows.mapInArrow(_combine(local_bytes), SCHEMA), "audit-texts")
    firsts = combined.where("text is not null")
    cells = firsts.mapInArrow(_placed(heavy_prefixes(firsts, range_bytes)), f"{SCHEMA}, cell long").repartition("cell")
    flags = cells.sortWithinPartitions("cell", F.substring("text", 1, HEAD)).mapInArrow(_settle(local_bytes), "doc_id long, part string, mask int, n long")
    narrow = written(combined.where("text is null").drop("text").unionByName(flags), "audit-masks")
    forget(combined)
    return narrow


def counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents, and those labelled good or toxic, by mask."""
    one = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    per_id = masks.where("doc_id is not null").groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    named = per_id.join(one, "doc_id", "left").select("part", "mask", "n", *[F.when(F.col(c), F.col("n")).otherwise(0).alias(c) for c in ("good", "toxic")])
    rest = masks.where("doc_id is null").select("part", "mask", "n", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    return named.unionByName(rest).groupBy("part", "mask").agg(*[F.sum(c).cast("long").alias(c) for c in ("n", "good", "toxic")])


def order_steps(spark) -> DataFrame:
    """(filter_order, step, bit, before): all orders with the filters that came before each step."""
    rows = [("".join(order), k + 1, 1 << FILTERS.index(f), sum(1 << FILTERS.index(x) for x in order[:k])) for order in permutations(FILTERS) for k, f in enumerate(order)]
    return spark.createDataFrame(rows, "filter_order string, step int, bit int, before int")


def interactions(counts: DataFrame) -> DataFrame:
    """One row per part, order and step."""
    # a part is one row of 32 counts, so the orders repeat parts and not documents
    slots = [[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)).cast("long") for m in range(32)] for c in ("n", "good", "toxic")]
    parts = counts.groupBy("part").agg(*[F.array(*s).alias(c) for s, c in zip(slots, ("n", "good", "toxic"), strict=True)])
    every = parts.crossJoin(F.broadcast(order_steps(counts.sparkSession)))  # 600 rows, always
    over = lambda c, test: " + ".join(f"if({test.format(m=m)}, {c}[{m}], 0)" for m in range(32))
    here = "({m} & bit) > 0 and ({m} & before) = 0"
    share = " + ".join(f"if(({m} & bit) > 0, n[{m}] * {120 // m.bit_count()}, 0)" for m in range(1, 32))
    return every.select(
        "part", "filter_order", "step",
        F.expr(over("n", "({m} & (bit | before)) = 0")).alias("kept"), F.expr(over("n", here)).alias("removed"),
        F.expr(over("n", "({m} & bit) > 0 and ({m} & before) > 0")).alias("redundant"), F.expr(over("n", "{m} = bit")).alias("unique_fails"),
        F.expr(over("good", here)).alias("good_lost"), F.expr(over("toxic", here)).alias("toxic_lost"), F.expr(share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """What each filter removes in every order, by part; see the module."""
    return interactions(counts(masks(docs, **options), labels))


def op11_filter_audit(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
f as (
  select doc_id, part, (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int
         + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t))::int
         + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > min(doc_id) over (partition by t), false)::int as mask
  from d),
l as (select doc_id, coalesce(bool_or(quality = 1), false) as good, coalesce(bool_or(toxic = 1), false) as toxic from labels group by doc_id),
c as (select part, mask, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic from f left join l using (doc_id) group by 1, 2),
x(letter, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o as (
  select a.letter || b.letter || g.letter || h.letter || e.letter as filter_order, [a.bit, b.bit, g.bit, h.bit, e.bit] as bits
  from x a, x b, x g, x h, x e where a.bit | b.bit | g.bit | h.bit | e.bit = 31),
s as (select filter_order, k::int as step, bits[k] as bit, coalesce(list_sum(bits[1 : k - 1]), 0)::int as before from o, range(1, 6) r(k)),
y as (
  select part, filter_order, step, bit, coalesce(sum(n) filter (where mask & (bit | before) = 0), 0)::bigint as kept,
         coalesce(sum(n) filter (where mask & bit > 0 and mask & before = 0), 0)::bigint as removed,
         coalesce(sum(n) filter (where mask & bit > 0 and mask & before > 0), 0)::bigint as redundant,
         coalesce(sum(n) filter (where mask = bit), 0)::bigint as unique_fails,
         coalesce(sum(good) filter (where mask & bit > 0 and mask & before = 0), 0)::bigint as good_lost,
         coalesce(sum(toxic) filter (where mask & bit > 0 and mask & before = 0), 0)::bigint as toxic_lost
  from c, s group by 1, 2, 3, 4)
select * exclude (bit), (sum(removed) over (partition by part, bit))::bigint as shapley from y
"""
