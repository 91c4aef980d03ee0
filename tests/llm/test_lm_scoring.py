"""Language model scores against the model's definition, and the trie against plain tables."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leadloom.llm import elias_fano as ef
from leadloom.llm import lm_scoring as lm

SF = "/root/testdata/sf0.001"
S, END = "<s>", "</s>"


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", low) if w] + [END]


def plain_scores(docs):
    """(held_out, n_tokens, n_known, N, base, score) of each document, from counts in tables."""
    one, two, three = Counter(), Counter(), Counter()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    for i, text in docs:
        if i is not None and not held(i):
            x = [S, S, *tokens(text)]
            one.update(x[2:])
            two.update(zip(x[1:], x[2:], strict=False))
            two[S, S] += 1
            three.update(zip(x, x[1:], x[2:], strict=False))
    n, v = sum(one.values()), len(one)
    left = lambda c, ab: ab[0] * c ** -ab[1] if c else 1.0
    rows = []
    for i, text in docs:
        x, base, score = [S, S, *tokens(text)], 0.0, 0.0
        for u, w1, w in zip(x, x[1:], x[2:], strict=False):
            p = (one[w] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            c = one[END] if w1 == S else one[w1]
            p = (1 - left(c, lm.LEFT2)) * two[w1, w] / max(c, 1) + left(c, lm.LEFT2) * p
            c = two[u, w1]
            p = (1 - left(c, lm.LEFT3)) * three[u, w1, w] / max(c, 1) + left(c, lm.LEFT3) * p
            score += math.log10(p)
        rows.append((i, held(i), len(x) - 2, sum(one[w] > 0 for w in x[2:]), n, base, score))
    return rows


def same(got, want):
    order = lambda r: (r[0] is None, r[0] or 0, r[2])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=order)
    want = sorted(want, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9) and abs(a[6] - b[6]) <= 0.003 * a[2]


def test_query_against_the_definition(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = lm.op13_lm_scoring(spark, SF).collect()
    same(got, plain_scores(docs))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


ROWS = [(1, None), (2, ""), (3, "A b a B"), (4, "a b c"), (4, "a b c"), (None, "a b d"), (5, "x " * 4000 + "end"), (6, "É é É"), (7, "\x1c a\x0bb"), (8, "a b a b a b zz")]


@pytest.mark.parametrize("most_hot", [lm.MOST_HOT, 1, 4])
def test_edge_rows_and_hot_contexts(spark, most_hot):
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in ROWS], "doc_id long, text string, n int, home string")
    same(lm.score(docs.repartition(4), most_hot=most_hot).collect(), plain_scores(ROWS))


def test_without_training_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    same(lm.score(docs).collect(), plain_scores([(None, "a b"), (None, None)]))
    assert lm.score(docs.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5) | st.integers(0, 2**28 - 1)), max_size=60), st.sampled_from([36, 50, 60]))
def test_order_with_words_that_agree_in_the_key(rows, used):
    where, words = np.array([a for a, _ in rows], np.uint64), np.array([b for _, b in rows], np.uint32)
    order = lm.in_order(where, words, used)
    assert sorted(order.tolist()) == list(range(len(rows))) and [rows[i] for i in order] == sorted(rows)


def test_homes_and_shards_grow_with_the_root():
    homes, shards = lm.shares(200 << 40)
    assert homes * shards < 2**46 and (200 << 40) / homes <= lm.MOST_BYTES * 1.01 and (200 << 40) / shards <= lm.MOST_BYTES * 2
    assert lm.shares(0) == (lm.LEAST_SHARDS, lm.LEAST_SHARDS)


def test_probabilities_sum_to_one():
    """Over all words and one unknown, behind known and unknown contexts."""
    r = random.Random(1)
    docs = [(i, " ".join(r.choice("abcde") for _ in range(30))) for i in range(40)]
    vocabulary = sorted({w for i, t in docs if zlib.crc32(str(i).encode()) % 5 != 1 for w in tokens(t)})
    for context in ("a b", "e e", "zz a"):
        ask = [(None, f"{context} {w}") for w in [*vocabulary, "unknown"] if w != END]
        rows = plain_scores(docs + ask)[len(docs) :] + plain_scores([*docs, (None, context)])[-1:]
        steps = {}
        for (_, text), row in zip(ask + [(None, context)], rows, strict=True):
            steps[text] = row
        # the probability of a word is what the text gains by it, less the ends
        total = 0.0
        one = plain_scores([*docs, (None, context)])[-1]
        p_end = step(docs, context, END)
        for w in [*vocabulary, "unknown"]:
            total += p_end if w == END else step(docs, context, w)
        assert total == pytest.approx(1, abs=1e-9) and one[2] == 3


def step(docs, context, word):
    """p(word | context) by the definition."""
    text = context if word == END else f"{context} {word}"
    whole = plain_scores([*docs, (None, text)])[-1][6]
    if word == END:
        return 10 ** (whole - prefix(docs, context, 2))
    return 10 ** (prefix(docs, text, 3) - prefix(docs, context, 2))


def prefix(docs, text, n):
    """The logarithm of the first n tokens' probability: one more token's text without what follows."""
    one, two, three = Counter(), Counter(), Counter()
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            x = [S, S, *tokens(t)]
            one.update(x[2:])
            two.update(zip(x[1:], x[2:], strict=False))
            two[S, S] += 1
            three.update(zip(x, x[1:], x[2:], strict=False))
    total, left = 0.0, lambda c, ab: ab[0] * c ** -ab[1] if c else 1.0
    x = [S, S, *tokens(text)][: n + 2]
    for u, v, w in zip(x, x[1:], x[2:], strict=False):
        p = (one[w] + 0.5) / (sum(one.values()) + 0.5 * (len(one) + 1))
        c = one[END] if v == S else one[v]
        p = (1 - left(c, lm.LEFT2)) * two[v, w] / max(c, 1) + left(c, lm.LEFT2) * p
        c = two[u, v]
        total += math.log10((1 - left(c, lm.LEFT3)) * three[u, v, w] / max(c, 1) + left(c, lm.LEFT3) * p)
    return total


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**40 - 1) | st.integers(0, 60), max_size=200), st.lists(st.integers(0, 2**40 - 1) | st.integers(0, 61), min_size=1, max_size=30))
def test_elias_fano(values, asked):
    v = np.array(sorted(values), np.uint64)
    seq = ef.EliasFano.of(v, 1 << 40)
    assert not len(v) or (seq.access(np.arange(len(v))) == v).all()
    x = np.array(asked, np.uint64)
    for start, end in ((0, len(v)), (len(v) // 3, 2 * len(v) // 3)):
        at, there = seq.successor(x, np.full(len(x), start), np.full(len(x), end))
        want = np.clip(np.searchsorted(v, x), start, end)
        assert (at == want).all()
        assert there.tolist() == [w < end and v[w] == y for w, y in zip(want, x, strict=True)]


def test_elias_fano_is_compact():
    v = np.sort(np.random.default_rng(1).integers(0, 1 << 40, 100_000)).astype(np.uint64)
    seq = ef.EliasFano.of(v, 1 << 40)
    assert (seq.low.nbytes + seq.high.nbytes + seq.ones.nbytes) * 8 / len(v) < 2 + 40 - math.log2(len(v)) + 2


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 20) | st.integers(0, 2**36 - 1), st.integers(0, 9) | st.integers(0, 2**28 - 1)), st.integers(1, 10**9), max_size=80), st.integers(0, 2**32))
def test_trie_answers_as_a_table(table, seed):
    rows = sorted(table.items())
    where, words, n = (np.array(c, k) for c, k in zip(([r[0][0] for r in rows], [r[0][1] for r in rows], [r[1] for r in rows]), (np.uint64, np.uint32, np.int64), strict=True))
    trie = ef.NgramTrie(lm.shard_trie(where, words, n))
    r = random.Random(seed)
    asked = [k for k, _ in rows] + [(c, r.randrange(2**28)) for (c, _), _ in rows] + [(r.randrange(2**36), 3), (0, 0)]
    counts, odds = trie.query(np.array([c for c, _ in asked], np.uint64), np.array([w for _, w in asked], np.uint32))
    totals = Counter()
    for (c, _), k in rows:
        totals[c] += k
    for (c, w), x, y in zip(asked, ef.dequantise(counts), ef.dequantise(odds), strict=True):
        assert x == pytest.approx(totals[c], rel=5e-3)
        a, b = lm.LEFT3
        assert y == pytest.approx((1 - a * totals[c] ** -b) * table.get((c, w), 0) / totals[c] if totals[c] else 0, rel=5e-3)
