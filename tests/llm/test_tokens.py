"""Packing and the token store against plain encoding of whole texts."""

import json
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from leadloom.llm import packing, token_store
from leadloom.llm.tokens import ID, Encoder

WORD_FILE, BYTE_FILE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
TEXTS = [
    (5, "The cat, the *dog* -- it's 12.5 <|endoftext|>\n\n  x"),
    (3, None),
    (9, ""),
    (1, "word " * 9000),
    (7, "the same"),
    (7, "the same"),
    (None, "É\x1ctwo\x1f three"),
]


@lru_cache
def loaded(path):
    return Tokenizer.from_file(path)


@lru_cache
def known(path):
    return Encoder(path, 50)


def plain(path, text, end):
    return loaded(path).encode(text or "", add_special_tokens=False).ids + [end]


SPECIAL = st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|end", "oftext|>", " ", "a", "B.", "'s", "\n"])


@settings(max_examples=500, deadline=None)
@given(st.lists(SPECIAL, max_size=8))
def test_added_tokens_are_encoded_as_the_library_does(parts):
    test_chunks_encode_like_the_whole_text.hypothesis.inner_test("".join(parts))


def test_other_files_get_whole_texts(tmp_path):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        assert Encoder(path).kind == name.split("_")[0]
        file = json.loads(open(path).read())
        file["pre_tokenizer"] = {"type": "Whitespace"}
        (tmp_path / name).write_text(json.dumps(file))
        other = Encoder(str(tmp_path / name))
        assert other.kind is None
        text = "The cat, don't <|endoftext|>"
        assert other.batch(pa.array([text]), 7)[0].tolist() == Tokenizer.from_file(str(tmp_path / name)).encode(text, add_special_tokens=False).ids + [7]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a\x00B9é̈ \n\t\r\x0b\x0c\x1c\x1f\x85\xa0 　'stdlmreİıŒßÉǅÞΣ<|>.,*漢​😀", max_size=24))
def test_chunks_encode_like_the_whole_text(text):
    for path in (WORD_FILE, BYTE_FILE):
        want = plain(path, text, 7)
        ids, ends = known(path).batch(pa.array([text, None, text, "x " + text]), 7)
        assert ids.tolist() == [*want, 7, *want, *plain(path, "x " + text, 7)] and ends[:3].tolist() == [len(want), len(want) + 1, 2 * len(want) + 1]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, start string")


def test_pack_holds_every_id_once(docs):
    rows = packing.pack(docs, WORD_FILE, end=2, window=64).collect()
    found, sequences = {}, {}
    for r in rows:
        found.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(r.ids, ID).tolist()))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.length * 4 == len(r.ids)
    for doc_id, text in TEXTS:
        whole = plain(WORD_FILE, text, 2)
        pieces = sorted(found[doc_id, len(whole)])
        copies = sum(x == (doc_id, text) for x in TEXTS)
        assert sum(len(p) for _, p in pieces) == copies * len(whole)
        if copies == 1:
            assert [x for _, p in pieces for x in p] == whole
            assert [s for s, _ in pieces] == np.cumsum([0] + [len(p) for _, p in pieces])[:-1].tolist()
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64 and (64 - at <= packing.SLACK or at & (at - 1) == 0)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_best_fit_decreasing_against_a_scan_of_all_windows(lengths):
    rooms, want = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [(room, -k) for k, room in enumerate(rooms) if room >= lengths[i]]
        if fits:
            k = -min(fits)[1]
        else:
            k = len(rooms)
            rooms.append(40)
            want.append([])
        rooms[k] -= lengths[i]
        want[k].append(lengths[i])
    got = [[lengths[i] for i in w] for w in packing.best_fit_decreasing(lengths, 40)]
    assert sorted(map(sum, got)) == sorted(map(sum, want))
    assert all(sum(w) <= 40 for w in got) and sorted(sum(got, [])) == sorted(lengths)


def test_pack_of_an_empty_table(docs):
    assert packing.pack(docs.limit(0), WORD_FILE, end=2).count() == 0


def test_pack_wastes_little(spark):
    rows = spark.range(3000).selectExpr("id as doc_id", "repeat('some words here ', int(1 + id % 700)) as text")
    got = packing.packed_words(rows).groupBy("sequence_id").sum("length").collect()
    used = [r[1] for r in got]
    waste = sum(0 if u & (u - 1) == 0 else 4096 - u for u in used)
    assert max(used) <= 4096 and waste < 0.01 * sum(used)


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_store_round_trip(spark, docs, tmp_path, planes):
    path = str(tmp_path / planes)
    token_store.write_store(docs, path, BYTE_FILE, end=0, planes=planes, chunk=50, frame_ids=300)
    got = token_store.read_store(spark, path).orderBy("start").collect()
    order = sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    at = 0
    for row, (doc_id, text) in zip(got, order, strict=True):
        ids = plain(BYTE_FILE, text, 0)
        assert (row.doc_id, row.start, row.n_tokens) == (doc_id, at, len(ids))
        assert np.frombuffer(row.ids, ID).tolist() == ids
        at += len(ids)


def test_store_of_an_empty_table(spark, docs, tmp_path):
    path = str(tmp_path / "none")
    token_store.write_store(docs.limit(0), path, BYTE_FILE, end=0)
    assert token_store.read_store(spark, path).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=30), max_size=8), st.booleans(), st.integers(1, 17))
def test_frames_round_trip(lists, bits, chunk):
    parts = [np.array(x, ID) for x in lists]
    ids = [None if i % 3 == 1 else i - 4 for i in range(len(parts))]
    got_ids, lengths, flat = token_store.decode_frame(token_store.encode_frame(ids, parts, bits, chunk))
    assert got_ids == ids and lengths.tolist() == [len(x) for x in lists]
    assert flat.tolist() == [y for x in lists for y in x]


def test_queries_against_plain_encoding(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    at = 0
    for row in token_store.op3_token_store(spark, sf).orderBy("doc_id").collect():
        ids = np.array(plain(BYTE_FILE, texts[row.doc_id], 0), ID)
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    pieces = packing.op2_packing(spark, sf).collect()
    assert {r.doc_id for r in pieces} == set(texts)
    for r in pieces:
        ids = np.array(plain(WORD_FILE, texts[r.doc_id], 2), ID)
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
