"""Removal of repeated passages with a count-min prefilter.

A window is ``width`` consecutive words of one document. A word goes when some
window over it has a word sequence that also starts earlier: in a document of
smaller id, or earlier in the same one. Windows are judged on the input.

1. Documents are dealt to homes, by id; each home counts its windows in a
   count-min sketch of two rows and sends the cells it met, block by block, with a
   mark on those it met more often. A block of the sketch is merged in one group,
   which tells every home which of its cells were met twice or more in all. A
   count is never too low, so a window whose two cells do not both reach two is
   unique, and no repeated window is lost.
2. The homes keep the windows estimated repeated, by 128 bits of two independent
   hashes of the word sequence. Equal windows of a home meet there: the earliest
   goes on, the others are settled. The earliest of all homes meet in hash buckets,
   where all but the first are settled.
3. The settled starts go back to the homes, which drop the covered words.

A window that a third of all documents share reaches its bucket once for each
home. Records travel as compressed columns of many windows, so a shuffle row is a
block, not a window. The sketch has two cells or so for each window at every size
of the input; it is never held whole, by the driver or a task: memory is bounded by
a home, a block, a bucket and the longest text. The documents' shuffle by home is
written once and read by all three steps.

Defined cases: a null text has no words; fewer words than a window are kept;
white space is not kept, words are joined by one space; rows without an id are
neither compared nor changed; rows repeated with the same id and text are judged
alike, as one position (an id names one text); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import small_batches, table

WIDTH = 20
#: log2 of the cells in a block of the sketch (a byte each while merged), within these bounds; a
#: home sends a block some 40 to 160 of its cells, and 30 where blocks are largest, at 100 TB.
LEAST_BLOCK, MOST_BLOCK = 20, 28
CELLS = 80
ROWS = 2
#: Bytes of text that a home of documents, or a bucket of windows, stands for: they grow with the
#: root of the input from ROOT bytes on, so that homes do, to GROWN times as many, which a task
#: holds in some 700 MB. A word and its space are about WORD_BYTES.
HOME_BYTES, LEAST_HOMES, ROOT, GROWN, WORD_BYTES = 4 << 20, 512, 64 << 30, 8, 6
FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


_PACK, _UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeeze(*columns: np.ndarray) -> bytes:
    """Columns of equal length, byte plane by byte plane, compressed."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns]
    return _PACK.compress(b"".join(planes))


def unsqueeze(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(_UNPACK.decompress(data), np.uint8)
    kinds = [np.dtype(k) for k in kinds]
    n, at, found = len(raw) // sum(k.itemsize for k in kinds), 0, []
    for kind in kinds:
        part = raw[at : at + n * kind.itemsize].reshape(kind.itemsize, n)
        found.append(np.ascontiguousarray(part.T).view(kind).reshape(n))
        at += n * kind.itemsize
    return found


def squeeze_bits(bits: np.ndarray) -> bytes:
    return _PACK.compress(np.packbits(bits).tobytes())


def unsqueeze_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(_UNPACK.decompress(data), np.uint8), count=n).view(bool)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Two 64-bit hashes (rows) of every run of ``width`` words, from two of each word."""
    found = []
    for lane, factor in enumerate(FACTORS):
        run, n, base = words[:, lane], 1, factor
        total, have = None, 0
        while True:  # runs of 1, 2, 4, ... words; those in the binary form of width are put together
            if width & n:
                power = np.uint64(pow(factor, n, 1 << 64))
                total = run if total is None else total[: len(run) - have] * power + run[have:][: len(total)]
                have += n
            if 2 * n > width:
                break
            run = run[:-n] * np.uint64(base) + run[n:]
            base = base * base % (1 << 64)
            n *= 2
        total = total[: len(words) - width + 1].copy()
        total ^= total >> np.uint64(32)
        total *= np.uint64(0xFF51AFD7ED558CCD)
        total ^= total >> np.uint64(29)
        found.append(total)
    return np.stack(found)


def _documents(rows: pa.Table) -> tuple[np.ndarray, list[list[bytes]]]:
    """ids and words of the documents with text; bytes.split cuts at U+0020 and U+0009 to U+000D."""
    pairs = zip(rows["doc_id"].to_pylist(), rows["content"].to_pylist(), strict=True)
    found = [(i, text.split()) for i, text in pairs if text]
    return np.array([i for i, _ in found], np.int64), [words for _, words in found]


def _windows(ids: np.ndarray, docs: list[list[bytes]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, document ids and starts of all windows."""
    counts = np.array([len(d) for d in docs], np.int64)
    total = int(counts.sum())
    if total < width:
        return np.empty((2, 0), np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    digest = xxhash.xxh3_128_digest
    words = np.frombuffer(b"".join([digest(w) for d in docs for w in d]), "<u8").reshape(-1, 2)
    hashes = window_hashes(words, width)
    of = np.repeat(np.arange(len(docs)), counts)
    start = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    inside = np.nonzero(of[: total - width + 1] == of[width - 1 :])[0]
    return hashes[:, inside], ids[of[inside]], start[inside]


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return hashes[row] >> np.uint64(64 - bits)


def _sketch(width: int, bits: int, block_bits: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """The cells that a home met in each block, as gaps, and whether it met them more than once."""
        hashes, _, _ = _windows(*_documents(rows), width)
        out = []
        for row in range(ROWS):
            cells = np.sort(_cells(hashes, row, bits))
            first = np.nonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))[0] if len(cells) else np.empty(0, np.int64)
            more = np.diff(first, append=len(cells)) > 1
            cells = cells[first]
            for block, (local, twice) in _split((cells >> np.uint64(block_bits)).astype(np.int64), cells, more):
                gaps = np.diff(local, prepend=np.uint64(block << block_bits)).astype("<u4")
                out.append((row, block, key[0].as_py(), squeeze(gaps, twice)))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["row", "block", "home", "cells"])

    return run


def _merge(block_bits: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """For each home, a bit for each of its cells: whether all homes together met it twice or more."""
        met = np.zeros(1 << block_bits, np.uint8)

        def parts():
            for data in rows["cells"]:
                gaps, more = unsqueeze(data.as_py(), "<u4", "?")
                yield np.cumsum(gaps, dtype=np.int64), more

        for cells, more in parts():
            met[cells] = np.minimum(met[cells] + (more + np.uint8(1)), 2)
        bits = [squeeze_bits(met[cells] == 2) for cells, _ in parts()]
        n = len(bits)
        return pa.table([rows["home"], pa.array([key[0].as_py()] * n, pa.int32()), pa.array([key[1].as_py()] * n, pa.int64()), pa.array(bits, pa.binary())], ["home", "row", "block", "bits"])

    return run


def repeated(hashes: np.ndarray, marks: pa.Table, bits: int, block_bits: int) -> np.ndarray:
    """Which windows of a home are estimated repeated, by the bits that came back for its cells."""
    keep = np.ones(hashes.shape[1], bool)
    if not len(keep):
        return keep
    came = {(r, b): data for r, b, data in zip(*(marks[c].to_pylist() for c in ("row", "block", "bits")), strict=True)}
    for row in range(ROWS):
        cells, back = np.unique(_cells(hashes, row, bits), return_inverse=True)
        blocks = _split((cells >> np.uint64(block_bits)).astype(np.int64), cells)
        keep &= np.concatenate([unsqueeze_bits(came[row, block], len(x[0])) for block, x in blocks])[back]
    return keep


RECORD = ("<u8", "<u8", "<i8", "<i4")  # two hashes, document, start
SETTLED = ("<i8", "<i4")


def layout(size: int, home_bytes: int = HOME_BYTES) -> tuple[int, int, int]:
    """For bytes of text: log2 of the cells of the sketch and of a block's, and the buckets."""
    home_bytes = int(home_bytes * min(GROWN, max(1.0, (size / ROOT) ** 0.5)))
    bits = max(LEAST_BLOCK, max(1, size // 4 - 1).bit_length())
    blocks = max(1, home_bytes // (WORD_BYTES * CELLS)).bit_length() - 1
    block_bits = min(MOST_BLOCK, max(LEAST_BLOCK, bits - blocks))
    return bits, block_bits, 1 << max(LEAST_HOMES - 1, size // home_bytes).bit_length()


def homes(buckets: int) -> int:
    """The least prime from ``buckets`` on: documents live in the bucket of id mod that."""
    n = buckets | 1
    while any(n % k == 0 for k in range(3, int(n**0.5) + 1, 2)):
        n += 2
    return n


def _split(key: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Runs of equal, ascending ``key``."""
    if len(key):
        cuts = [0, *(np.nonzero(key[1:] != key[:-1])[0] + 1).tolist(), len(key)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield int(key[a]), [c[a:b] for c in columns]


def _first_and_later(h, g, ids, starts):
    """Sorted by window, document and start: which records are their window's first place, and which lie later."""
    order = np.lexsort((starts, ids, g, h))
    h, g, ids, starts = h[order], g[order], ids[order], starts[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    lead = np.nonzero(new)[0][np.cumsum(new) - 1]
    later = (ids != ids[lead]) | (starts != starts[lead])
    return (h, g, ids, starts), new, later


def _blocks_of_settled(ids: np.ndarray, starts: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    home = ids % homes(buckets)
    order = np.lexsort((starts, ids, home))
    parts = _split(home[order], ids[order].astype("<i8"), starts[order].astype("<i4"))
    return [(k, squeeze(*columns)) for k, columns in parts]


def _candidates(width: int, bits: int, block_bits: int, buckets: int):
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        hashes, doc, start = _windows(*_documents(docs), width)
        keep = repeated(hashes, marks, bits, block_bits)
        columns, new, later = _first_and_later(hashes[0][keep], hashes[1][keep], doc[keep], start[keep].astype("<i4"))
        h, g, doc, start = (c[new] for c in columns)
        out = [(k, False, squeeze(*part)) for k, part in _split((h >> shift).astype(np.int64), h, g, doc, start)]
        out += [(k, True, data) for k, data in _blocks_of_settled(columns[2][later], columns[3][later], buckets)]
        kinds = (pa.int64(), pa.bool_(), pa.binary())
        return pa.table([pa.array(x, k) for x, k in zip(list(zip(*out, strict=True)) or [[]] * 3, kinds, strict=True)], ["bucket", "settled", "data"])

    return run


def _resolve(buckets: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """Among the batches' firsts all but the first of all are settled; those settled before pass."""
        passed, firsts, bucket = [], [], key[0].as_py()
        for settled, data in zip(rows["settled"].to_pylist(), rows["data"].to_pylist(), strict=True):
            (passed if settled else firsts).append(data)
        out = [(bucket, data) for data in passed]
        if firsts:
            parts = [unsqueeze(x, *RECORD) for x in firsts]
            columns, _, later = _first_and_later(*(np.concatenate(c) for c in zip(*parts, strict=True)))
            out += _blocks_of_settled(columns[2][later], columns[3][later], buckets)
        return pa.table(
            [pa.array([k for k, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], ["home", "data"]
        )

    return run


def _cut(width: int):
    def run(docs: pa.Table, settled: pa.Table) -> pa.Table:
        starts: dict[int, np.ndarray] = {}
        if settled.num_rows:
            parts = [unsqueeze(x, *SETTLED) for x in settled["data"].to_pylist()]
            ids, at = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.argsort(ids, kind="stable")
            starts = {k: part[0] for k, part in _split(ids[order], at[order])}
        counts, gone, texts = [], [], []
        for doc_id, text in zip(docs["doc_id"].to_pylist(), docs["content"].to_pylist(), strict=True):
            kept = words = (text or b"").split()
            if doc_id is not None and (places := starts.get(doc_id)) is not None:
                places = places[places <= len(words) - width]
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, places, 1)
                np.add.at(edge, places + width, -1)
                covered = np.cumsum(edge[:-1]) > 0
                kept = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
            counts.append(len(words))
            gone.append(len(words) - len(kept))
            texts.append(b" ".join(kept))
        return pa.table(
            [
                docs["doc_id"],
                pa.array(counts, pa.int64()),
                pa.array(gone, pa.int64()),
                pa.array(texts, pa.binary()).cast(pa.string()),
            ],
            ["doc_id", "n_words", "n_removed", "kept_text"],
        )

    return run


def _unchanged(batches):
    """Rows without an id keep all their words."""
    for rows in batches:
        words = [(x or b"").split() for x in rows.column(1).to_pylist()]
        counts = pa.array([len(w) for w in words], pa.int64())
        texts = pa.array([b" ".join(w) for w in words], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([rows.column(0), counts, pa.array([0] * len(words), pa.int64()), texts], ["doc_id", "n_words", "n_removed", "kept_text"])


RESULT = "doc_id long, n_words long, n_removed long, kept_text string"


def drop_repeated(docs: DataFrame, *, width: int = WIDTH, text: str = "text", doc_id: str = "doc_id", home_bytes: int = HOME_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("content"))
    size = rows.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    bits, block_bits, buckets = layout(size, home_bytes)
    named = rows.where("doc_id is not null")
    placed = named.withColumn("home", F.pmod("doc_id", F.lit(homes(buckets)).cast("long"))).repartition("home")
    met = placed.groupBy("home").applyInArrow(_sketch(width, bits, block_bits), "row int, block long, home long, cells binary")
    marks = met.groupBy("row", "block").applyInArrow(_merge(block_bits), "home long, row int, block long, bits binary")
    found = placed.groupBy("home").cogroup(marks.groupBy("home")).applyInArrow(
        _candidates(width, bits, block_bits, buckets), "bucket long, settled boolean, data binary"
    )
    # blocks settled before the buckets go through them under the number of their home
    settled = found.groupBy("bucket").applyInArrow(_resolve(buckets), "home long, data binary")
    kept = placed.groupBy("home").cogroup(settled.groupBy("home")).applyInArrow(_cut(width), RESULT)
    return kept.unionByName(rows.where("doc_id is null").mapInArrow(_unchanged, RESULT))


def op10_substring_dedup(spark, sf_dir):
    return drop_repeated(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256")
    )


ORACLE_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, w, unnest(range(1, len(w) - 18)) as p from d),
x as (select doc_id, p, array_to_string(w[p : p + 19], ' ') as win from s),
f as (select doc_id, p, row_number() over (partition by win order by doc_id, p) as k from x),
c as (select distinct doc_id, q from (select doc_id, unnest(range(p, p + 20)) as q from f where k > 1)),
g as (select doc_id, list(q) as gone, count(*) as n from c group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(g.n, 0)::bigint as n_removed,
       sha256(array_to_string(case when g.gone is null then w
         else list_filter(w, lambda v, i: not list_contains(g.gone, i)) end, ' ')) as kept_sha256
from d left join g on d.doc_id = g.doc_id
"""
