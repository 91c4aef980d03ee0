"""Packing documents into windows by best-fit decreasing.

A document longer than a window is first cut into full windows; what remains of
it, and every shorter document, is packed best-fit decreasing: longest first,
each into the open window that it fills most tightly. A segment tree over the
remaining capacities counts the open windows of each, and finds the tightest in
O(log window). Windows that end with more than ``slack`` unused are opened again
and their pieces cut to fill whole windows; the last of them waits for the next
block. At the end of a task its ids go into sequences of a power of two each, so
they need no padding.

Each scan task packs its own documents in blocks of ``BLOCK_IDS`` ids: nothing
is shuffled, memory is bounded by a block and the longest text, and waste does
not depend on how many tasks there are. Sequence ids hold the task's number in
their upper bits, so they are unique and a task that runs again repeats them.

Defined cases: a null text is empty, and an empty one has its end id alone; rows
repeated with the same id are packed each; a null doc_id stays null; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import small_batches, table
from leadloom.llm.tokens import CACHE_CHUNKS, ID, encoder

WINDOW = 4096
BLOCK_IDS = 4 << 20
SLACK = 32
OUT_BYTES = 8 << 20
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class OpenWindows:
    """A segment tree indexed by remaining capacity: counts, and the windows at each leaf."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.at[capacity].append(window)
        node = self.leaves + capacity
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) of the tightest window with room for ``need``."""
        count, node = self.count, self.leaves + need
        while not count[node]:
            while node & 1:  # a right child: what is larger lies beyond its parent
                node >>= 1
                if not node:
                    return None
            node += 1
        while node < self.leaves:
            node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        while node:
            count[node] -= 1
            node >>= 1
        return capacity, self.at[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> list[list[int]]:
    """Windows as lists of indexes into ``lengths`` (each at most ``window``)."""
    tree, windows = OpenWindows(window), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        if found is None:
            found = window, len(windows)
            windows.append([])
        capacity, w = found
        windows[w].append(i)
        if capacity > lengths[i]:
            tree.add(capacity - lengths[i], w)
    return windows


def recut(pieces: list, window: int) -> tuple[list[list], list]:
    """Cut pieces (doc, start, ids) one behind another into full windows; the rest is returned apart."""
    full, now, room = [], [], window
    for doc, start, ids in pieces:
        while len(ids):
            part = ids[:room]
            now.append((doc, start, part))
            room -= len(part)
            ids, start = ids[len(part) :], start + len(part)
            if not room:
                full.append(now)
                now, room = [], window
    return full, now


def powers_of_two(pieces: list) -> list[list]:
    """Sequences whose lengths are the powers of two in the length of all pieces, largest first."""
    left, found = sum(len(p[2]) for p in pieces), []
    while left:
        size = 1 << (left.bit_length() - 1)
        full, rest = recut(pieces, size)
        found.append(full[0])
        pieces = [p for more in full[1:] for p in more] + rest
        left -= size
    return found


def pack_block(pieces: list, window: int, slack: int) -> tuple[list[list], list]:
    """Sequences of the block, and the pieces that wait for the next one."""
    done, loose = [], []
    for members in best_fit_decreasing([len(p[2]) for p in pieces], window):
        sequence = [pieces[i] for i in members]
        fill = sum(len(p[2]) for p in sequence)
        if window - fill <= slack:
            done.append(sequence)
        else:
            loose += sequence
    full, rest = recut(loose, window)
    return done + full, rest


def _packer(path: str, chunks: int, end: int, window: int, block: int, slack: int):
    def run(batches):
        task, made, out, size = TaskContext.get().partitionId(), 0, [], 0
        encode = encoder(path, chunks).batch

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")]
            )

        def emit(sequence: list) -> None:
            nonlocal made, size
            offset = 0
            for (doc_id, tokens), start, ids in sequence:
                out.append((doc_id, start, len(ids), ids.tobytes(), tokens, (task << 40) + made, offset))
                offset += len(ids)
            made, size = made + 1, size + 4 * offset

        pool, held = [], 0
        for rows in batches:
            at, (every, ends) = 0, encode(rows.column(1), end)
            for doc_id, to in zip(rows.column(0).to_pylist(), ends.tolist(), strict=True):
                ids, at = every[at:to], to
                doc, whole = (doc_id, len(ids)), len(ids) - len(ids) % window
                for start in range(0, whole, window):
                    emit([(doc, start, ids[start : start + window])])
                if whole < len(ids):
                    pool.append((doc, whole, ids[whole:].copy()))
                    held += len(ids) - whole
                if held >= block:
                    sequences, pool = pack_block(pool, window, slack)
                    held = sum(len(p[2]) for p in pool)
                    for sequence in sequences:
                        emit(sequence)
                        if size >= OUT_BYTES:
                            yield batch()
                            out, size = [], 0
                if size >= OUT_BYTES:
                    yield batch()
                    out, size = [], 0
        sequences, rest = pack_block(pool, window, slack)
        for sequence in sequences + powers_of_two(rest):
            emit(sequence)
            if size >= OUT_BYTES:
                yield batch()
                out, size = [], 0
        if out:
            yield batch()

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    end: int,
    chunks: int = CACHE_CHUNKS,
    window: int = WINDOW,
    block: int = BLOCK_IDS,
    slack: int = SLACK,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, and its ids
    (little-endian unsigned 32-bit). ``tokenizer`` is the path of a tokenizers file."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_packer(tokenizer, chunks, end, window, block, slack), SCHEMA)


def packed_words(docs: DataFrame, *, with_ids: bool = False) -> DataFrame:
    """`pack` as the query and the pipeline use it, with the checksum of each piece, and its ids if wanted."""
    import public_tokenizers

    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"), end=2)
    columns = ["doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"]
    return pieces.select(*columns, *(["ids"] if with_ids else []))


def op2_packing(spark, sf_dir):
    return packed_words(table(spark, sf_dir, "documents"))
