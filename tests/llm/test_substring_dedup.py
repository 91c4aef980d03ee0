"""Removal of repeated passages against brute force."""

import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from leadloom.llm import substring_dedup


def brute(rows, width):
    first, out = {}, []
    texts = sorted({(i, t) for i, t in rows if i is not None})
    split = {i: [w for w in __import__("re").split("[\x20\x09-\x0d]+", t or "") if w] for i, t in texts}
    for i, _ in texts:
        for p in range(len(split[i]) - width + 1):
            first.setdefault(tuple(split[i][p : p + width]), (i, p))
    for i, t in rows:
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", t or "") if w]
        gone = set()
        if i is not None:
            for p in range(len(words) - width + 1):
                if first[tuple(words[p : p + width])] != (i, p):
                    gone |= set(range(p, p + width))
        kept = [w for k, w in enumerate(words) if k not in gone]
        out.append((i is None, i or 0, len(words), len(gone), " ".join(kept)))
    return sorted(out)


def run(spark, rows, width, **options):
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, home int")
    found = substring_dedup.drop_repeated(docs, width=width, **options).collect()
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_text) for r in found)


def test_against_brute_force(spark):
    r = random.Random(3)
    passages = [" ".join(r.choice("abcdefg") * r.randint(1, 2) for _ in range(r.randint(3, 12))) for _ in range(6)]
    rows = [(i * 3 - 20, "\n".join(r.choice(passages) + f" x{r.randrange(4)}" for _ in range(r.randint(0, 5)))) for i in range(40)]
    rows += [(500, None), (501, ""), (502, " \t "), (503, "w " * 400), (None, rows[3][1]), (None, None), rows[7], (505, "É\x1cü é ö"), (506, "w " * 30)]
    for width in (1, 3, 5, 20):
        assert run(spark, rows, width) == brute(rows, width)


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "LEAST_BLOCK", 3)
    monkeypatch.setattr(substring_dedup, "MOST_BLOCK", 3)
    r = random.Random(9)
    rows = [(i, " ".join(r.choice("abcd") for _ in range(30))) for i in range(30)]
    assert run(spark, rows, 4) == brute(rows, 4)


def test_sketch_and_bits_of_one_home():
    """Windows met twice keep their bits; nearly all others lose them."""
    r = random.Random(1)
    texts = [" ".join(str(r.randrange(10**6)) for _ in range(400)) for _ in range(50)]
    texts += texts[:5]
    rows = pa.table([pa.array(range(55), pa.int64()), pa.array([t.encode() for t in texts], pa.binary())], ["doc_id", "content"])
    met = substring_dedup._sketch(20, 22, 20)((pa.scalar(7),), rows).to_pylist()
    marks = []
    for row, block in {(x["row"], x["block"]) for x in met}:
        part = pa.Table.from_pylist([x for x in met if (x["row"], x["block"]) == (row, block)])
        marks.append(substring_dedup._merge(20)((pa.scalar(row), pa.scalar(block)), part))
    hashes, doc, _ = substring_dedup._windows(*substring_dedup._documents(rows), 20)
    keep = substring_dedup.repeated(hashes, pa.concat_tables(marks), 22, 20)
    copied = (doc < 5) | (doc >= 50)
    assert keep[copied].all() and keep[~copied].mean() < 0.001


def test_layout_at_any_size():
    """Homes and blocks grow with the root of the text, and a shuffle row stays a block of many cells."""
    for size in (0, 10**6, 10**9, 30 * 10**9, 10**12, 10**13, 10**14):
        bits, block_bits, buckets = substring_dedup.layout(size)
        assert 1 << bits >= size // 4 and buckets & (buckets - 1) == 0
        assert (1 << block_bits) <= 256 << 20  # bytes that merging a block takes
        home = size / buckets
        assert home <= substring_dedup.GROWN * substring_dedup.HOME_BYTES
        if size >= 10**9:
            assert home / 6 / 2 ** (bits - block_bits) >= 28
    assert substring_dedup.layout(10**14)[2] < substring_dedup.layout(10**10)[2] * 10**4 / 4


def test_empty_table(spark):
    assert run(spark, [], 20) == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 21))
def test_window_hashes_tell_windows_apart(words, width):
    table = np.random.default_rng(1).integers(0, 2**64, (3, 2), np.uint64)
    if len(words) < width:
        return
    hashes = substring_dedup.window_hashes(table[words], width)
    windows = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
    assert hashes.shape == (2, len(windows))
    for lane in hashes.tolist():
        assert len(set(zip(windows, lane, strict=True))) == len(set(windows)) == len(set(lane))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(-(2**63), 2**63 - 1)), max_size=50))
def test_squeeze_round_trip(rows):
    a, b = np.array([x for x, _ in rows], "<u8"), np.array([y for _, y in rows], "<i8")
    got = substring_dedup.unsqueeze(substring_dedup.squeeze(a, b), "<u8", "<i8")
    assert got[0].tolist() == a.tolist() and got[1].tolist() == b.tolist()
