"""Exact deduplication by skew-safe combining.

Texts are equal when their bytes agree after lower-casing A-Z only. Each task
first combines the equal texts that it meets (full content, not digests, is the
key), the local winners meet in salted digest groups, and the winners of the
salts meet in the global group of the digest. Every stage groups by digest *and*
content, so texts of equal digest but other content stay apart. A task's salt is
the root of its number: of T tasks some 2 sqrt(T) at most share a salt and sqrt(T)
salts meet in the end, so a hot text brings neither group more rows than that,
however many tasks there are. The way back, from a digest's winner to its documents,
deals out the rows of a hot digest.

Defined cases: a null text is the empty text; a null ``doc_id`` is smaller than
any other (``keep_id`` is null if all ids of the group are); rows repeated with
the same id and text count each, and one of them stays (so do ties: of rows with
one id the first); a text is read whole and must fit a task some four times over;
an empty table gives no rows; further columns of the input are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import SMALL_BATCH, rows_of, small_batches, spread_join, table, written

#: Bytes of text that a task holds while it combines equal texts.
LOCAL_BYTES = 32 << 20


def sha256(content: bytes) -> bytes:
    return hashlib.sha256(content).digest()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes]]:
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield doc_id, (text or b"").lower()  # bytes.lower changes A-Z alone


def _digests(digest: Callable[[bytes], bytes], with_content: bool):
    def run(batches):
        for batch in batches:
            rows = list(_rows([batch]))
            columns = [batch.column(0), pa.array([digest(x) for _, x in rows], pa.binary())]
            names = ["doc_id", "digest"]
            if with_content:
                columns.append(pa.array([x for _, x in rows], pa.binary()))
                names.append("content")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def salt_of(task: int) -> int:
    """Salts 0 to sqrt(T) over T tasks; salt s gets 2 s + 1 of them."""
    return math.isqrt(task)


def _local_winners(digest: Callable[[bytes], bytes]):
    def flush(held: dict, salt: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([digest(x) for x in held], pa.binary()),
                pa.array(list(held), pa.binary()),
                pa.array([salt] * len(held), pa.int32()),
                pa.array([v[0] for v in held.values()], pa.int64()),
                pa.array([v[1] for v in held.values()], pa.int64()),
            ],
            ["digest", "content", "salt", "keep_id", "group_size"],
        )

    def run(batches):
        held: dict[bytes, list] = {}
        size, salt = 0, salt_of(TaskContext.get().partitionId())
        for doc_id, content in _rows(batches):
            if (best := held.get(content)) is None:
                held[content] = [doc_id, 1]
                size += len(content) + 100
                if size >= LOCAL_BYTES:
                    yield flush(held, salt)
                    held, size = {}, 0
            else:
                best[1] += 1
                if best[0] is None or (doc_id is not None and doc_id > best[0]):
                    best[0] = doc_id
        if held:
            yield flush(held, salt)

    return run


def exact_duplicates(
    docs: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    digest: Callable[[bytes], bytes] = sha256,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest (bytes)."""
    small_batches(docs.sparkSession, SMALL_BATCH)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("content"))
    local = source.mapInArrow(
        _local_winners(digest), "digest binary, content binary, salt int, keep_id long, group_size long"
    )
    merge = (F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    classes = local.groupBy("digest", "content", "salt").agg(*merge).groupBy("digest", "content").agg(*merge)
    by_digest = written(classes.groupBy("digest").agg(*merge, F.count(F.lit(1)).alias("contents")), "exact-digests")
    members = source.mapInArrow(_digests(digest, False), "doc_id long, digest binary")
    counted = members.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    single = by_digest.where("contents = 1").select("digest", "keep_id", "group_size", F.col("group_size").alias("rows"))
    found = spread_join(counted, single, "digest", size="rows", by="doc_id")
    shared = by_digest.where("contents > 1").select("digest")
    if not shared.isEmpty():  # other content under one digest: settle these by content
        full = source.mapInArrow(_digests(digest, True), "doc_id long, digest binary, content binary")
        rest = (
            full.join(shared, "digest", "left_semi")
            .groupBy("digest", "content", "doc_id")
            .agg(F.count(F.lit(1)).alias("copies"))
            .join(classes.join(shared, "digest", "left_semi"), ["digest", "content"])
        )
        found = found.unionByName(rest.drop("content"))
    # one row again for each repeated row; the first of them may stay
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        "doc_id",
        "keep_id",
        "group_size",
        ((F.col("copy") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "digest",
    )


def keep_one_of_each(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns. The id names a row: rows
    without one all stay, and rows repeated whole become one."""
    found = exact_duplicates(docs, text=text, doc_id=doc_id)
    return rows_of(docs, found.where("kept").select("doc_id"), doc_id)


def op5_exact_dedup(spark, sf_dir):
    return exact_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


ORACLE_SQL = """
with n as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
  from documents)
select doc_id,
       max(doc_id) over (partition by t) as keep_id,
       count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept,
       sha256(t) as text_sha256
from n
"""
