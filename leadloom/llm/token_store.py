"""Token ids as bit-plane files.

Documents are encoded in ascending doc_id order. Their ids are cut into frames
of whole documents; a frame has the header, the document index, the chunk index
and the chunks. A chunk is a fixed-size block of ids transposed into bit or byte
planes, so equal bits lie together, and each plane is compressed with zstandard;
planes of zeros are left out. The chunk index holds the sizes of the planes, so
any block can be read alone.

The ids of a range of doc_ids (a shard) are one Parquet file in the table's
folder: one frame a row, binary, with the columns that place it. Spark writes
and reads the files, so they may lie in any store that Spark reaches.

Frame, little-endian: magic ``LBP1``; u8 planes in a chunk (32 bit planes or 4
byte planes); u32 ids in a chunk; u64 documents; u64 ids; u32 sizes of the three
compressed parts of the index (doc ids i64, their validity u8, lengths u64) and
the parts; then u32 sizes of all planes, chunk by chunk; then the planes.

Defined cases: a null text is empty; null doc_ids come first; rows with equal
ids are ordered by text; an empty table gives an empty store; further columns
are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.llm.common import shared_dir, small_batches, table
from leadloom.llm.tokens import CACHE_CHUNKS, ID, encoder

MAGIC = b"LBP1"
CHUNK_IDS = 1 << 16
FRAME_IDS = 1 << 18
FRAME_SCHEMA = "shard int, frame long, n_docs long, n_ids long, payload binary"
DOC_SCHEMA = "doc_id long, start long, n_tokens long, ids binary"
HEAD = struct.Struct("<4sBIQQIII")


def planes_of(ids: np.ndarray, bits: bool) -> np.ndarray:
    """A row for each byte (4) or bit (32) of the ids, lowest first."""
    as_bytes = ids.astype(ID).view(np.uint8).reshape(-1, 4)
    if not bits:
        return np.ascontiguousarray(as_bytes.T)
    return np.packbits(np.unpackbits(as_bytes, axis=1, bitorder="little").T, axis=1, bitorder="little")


def ids_of(planes: np.ndarray, n: int) -> np.ndarray:
    if len(planes) == 4:
        return np.ascontiguousarray(planes.T).view(ID).reshape(-1)
    bits = np.unpackbits(planes, axis=1, count=n, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(ID).reshape(-1)


def encode_frame(doc_ids: list, parts: list[np.ndarray], bits: bool, chunk: int) -> bytes:
    pack = zstandard.ZstdCompressor(level=3).compress
    ids = np.concatenate(parts) if parts else np.empty(0, ID)
    index = [
        pack(np.array([x or 0 for x in doc_ids], "<i8").tobytes()),
        pack(np.array([x is not None for x in doc_ids], np.uint8).tobytes()),
        pack(np.array([len(x) for x in parts], "<u8").tobytes()),
    ]
    sizes, body = [], []
    for at in range(0, len(ids), chunk):
        for plane in planes_of(ids[at : at + chunk], bits):
            data = pack(plane.tobytes()) if plane.any() else b""
            sizes.append(len(data))
            body.append(data)
    head = HEAD.pack(MAGIC, 32 if bits else 4, chunk, len(doc_ids), len(ids), *map(len, index))
    return b"".join([head, *index, np.array(sizes, "<u4").tobytes(), *body])


def decode_frame(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, their lengths, and all ids."""
    unpack = zstandard.ZstdDecompressor().decompress
    magic, planes, chunk, n_docs, n_ids, *index = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a frame of this format")
    at, parts = HEAD.size, []
    for size in index:
        parts.append(unpack(data[at : at + size]))
        at += size
    doc_ids = np.frombuffer(parts[0], "<i8").tolist()
    valid = np.frombuffer(parts[1], np.uint8)
    if not valid.all():
        doc_ids = [x if ok else None for x, ok in zip(doc_ids, valid, strict=True)]
    chunks = -(-n_ids // chunk)
    sizes = np.frombuffer(data, "<u4", chunks * planes, at).reshape(chunks, planes)
    at += 4 * chunks * planes
    found = np.empty(n_ids, ID)
    for k, row in enumerate(sizes.tolist()):
        n = min(chunk, n_ids - k * chunk)
        width = n if planes == 4 else -(-n // 8)
        block = np.zeros((planes, width), np.uint8)
        for i, size in enumerate(row):
            if size:
                block[i] = np.frombuffer(unpack(data[at : at + size]), np.uint8)
                at += size
        found[k * chunk : k * chunk + n] = ids_of(block, n)
    return doc_ids, np.frombuffer(parts[2], "<u8"), found


def _writer(path: str, chunks: int, end: int, bits: bool, chunk: int, frame_ids: int):
    def run(batches):
        shard, made = TaskContext.get().partitionId(), 0
        encode = encoder(path, chunks).batch
        docs, parts, held = [], [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([made], pa.int64()),
                    pa.array([len(docs)], pa.int64()),
                    pa.array([held], pa.int64()),
                    pa.array([encode_frame(docs, parts, bits, chunk)], pa.binary()),
                ],
                [x.split()[0] for x in FRAME_SCHEMA.split(", ")],
            )

        for rows in batches:
            at, (every, ends) = 0, encode(rows.column(1), end)
            for doc_id, to in zip(rows.column(0).to_pylist(), ends.tolist(), strict=True):
                ids, at = every[at:to], to
                docs.append(doc_id)
                parts.append(ids)
                held += len(ids)
                if held >= frame_ids:
                    yield row()
                    docs, parts, held, made = [], [], 0, made + 1
        if docs:
            yield row()

    return run


def write_store(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    *,
    end: int,
    chunks: int = CACHE_CHUNKS,
    planes: str = "byte",
    chunk: int = CHUNK_IDS,
    frame_ids: int = FRAME_IDS,
    text: str = "text",
    doc_id: str = "doc_id",
) -> None:
    """Write the ids of every document, in doc_id order, as a store at ``path``."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    in_order = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "text"
    )
    frames = in_order.mapInArrow(_writer(tokenizer, chunks, end, planes == "bit", chunk, frame_ids), FRAME_SCHEMA)
    frames.write.parquet(path)


def _reader(batches):
    for rows in batches:
        for base, payload in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
            doc_ids, lengths, ids = decode_frame(payload)
            ends = np.cumsum(lengths, dtype=np.int64)
            starts = ends - lengths.astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_ids, pa.int64()),
                    pa.array(starts + base),
                    pa.array(lengths.astype(np.int64)),
                    pa.array([ids[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary()),
                ],
                [x.split()[0] for x in DOC_SCHEMA.split(", ")],
            )


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids."""
    small_batches(spark)
    frames = spark.read.schema(FRAME_SCHEMA).parquet(path)
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    within = Window.partitionBy("shard").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    shards = frames.groupBy("shard").agg(F.sum("n_ids").alias("n")).select(
        "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    bases = frames.select("shard", "frame", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("at"))
    placed = bases.join(shards, "shard").select("shard", "frame", (F.col("at") + F.col("before")).alias("base"))
    joined = frames.select("shard", "frame", "payload").join(placed, ["shard", "frame"])
    return joined.select("base", "payload").mapInArrow(_reader, DOC_SCHEMA)


def op3_token_store(spark, sf_dir):
    import uuid

    import public_tokenizers

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_store(
        table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end=0
    )
    return read_store(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
