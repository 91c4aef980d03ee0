"""SimHash against brute force over all pairs."""

import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadloom.llm import common, simhash


def plain_fingerprint(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    ids, root = list(prints), {}
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if bin(prints[a] ^ prints[b]).count("1") <= 3 and root[b] < root[a]:
                    root[a], changed = root[b], True
    return root


def test_query_against_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = plain_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op4_simhash(spark, sf).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in texts}
    assert len(set(want.values())) < len(want)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, "É é\x1cx y z"), (6, "É é\x1cx y z"), (None, "One two"), (9, "w " * 70000)]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, fp string")
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect())
    want = sorted(((i is None, i or 0), plain_fingerprint(t), {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, None: 4, 9: 9}[i]) for i, t in rows)
    assert got == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.keep_one_of_each(docs.where("doc_id <> 6")).count() == 3


def test_hot_keys_are_dealt_out(spark):
    """The join back to the documents, with a key of a third of all rows, against the plain join."""
    rows = spark.range(6000).selectExpr("id as doc_id", "if(id % 3 = 0, 0, id % 700) as fp", "id as salt")
    found = rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    got = common.spread_join(rows, found, "fp", size="n", by="doc_id")
    assert got.columns == ["fp", "doc_id", "salt", "first"]
    want = rows.join(found.drop("n"), "fp")
    assert got.count() == 6000 and got.exceptAll(want).isEmpty()
    assert common.spread_join(rows.limit(0), found.limit(0), "fp", size="n", by="doc_id").count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(2, 350))
def test_trie_join_finds_every_pair(seed, n):
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(max(1, n // 40))]
    values = set()
    while len(values) < n:
        x = r.choice(centres) if r.random() < 0.8 else r.getrandbits(64)
        for _ in range(r.randint(0, 6)):
            x ^= 1 << r.randrange(64)
        values.add(x)
    v = sorted(values)
    join = simhash.TrieJoin(v, 3)
    assert len(join.edges) < n and all((v[i] ^ v[j]).bit_count() <= 3 for i, j in join.edges)
    want = plain_components(dict(enumerate(v)))
    assert [join.find(i) for i in range(n)] == [join.find(want[i]) for i in range(n)]
    assert len({join.find(i) for i in range(n)}) == len(set(want.values()))
    bits = np.array(v, np.uint64)
    assert not n > 300 or join.seen < n * n / 3 or np.bitwise_count(bits[:, None] ^ bits[None, :]).mean() < 25


def test_the_trie_is_walked_and_pruned(spark):
    """Of random fingerprints that share a stretch, most pairs are dropped above the leaves; a
    group of near copies costs about its size."""
    r = random.Random(2)
    v = sorted({r.getrandbits(40) for _ in range(4000)})
    assert 4000 < simhash.TrieJoin(v, 3).seen < 4000 * 4000 / 8
    centre = r.getrandbits(64)
    near = sorted({centre ^ sum(1 << b for b in set(r.choices(range(64), k=2))) for _ in range(4000)})
    join = simhash.TrieJoin(near, 3)
    assert len(join.edges) == len(near) - 1 and join.seen < 20 * len(near)
    # the groups of a table are walked down to their leaves
    nodes = simhash.fingerprints(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).select("fp").distinct()
    fps = np.array([x.fp for x in nodes.collect()], np.int64).view(np.uint64)
    by = {}
    for x in fps.tolist():
        by.setdefault(x >> 48, []).append(x)
    assert sum(simhash.TrieJoin(sorted(g), 3).seen for g in by.values()) > len(fps) / 20


def check_links(spark, r, n):
    prints = {}
    for i in range(n):
        x = 0x0123456789ABCDEF if i % 2 else r.getrandbits(64)
        for _ in range(r.randint(0, 5)):
            x ^= 1 << r.randrange(64)
        prints[i] = x
    nodes = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in set(prints.values())], "fp long")
    hooked = {r.child & (2**64 - 1): r.parent & (2**64 - 1) for r in simhash.components(simhash.links(nodes)).collect()}
    want, by = plain_components(prints), {}
    for i, x in prints.items():
        by.setdefault(want[i], set()).add(hooked.get(x, x))
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


def test_links_and_components_with_split_nodes(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 20)
    check_links(spark, random.Random(5), 400)


def test_nodes_lie_deeper_in_larger_tables(spark, monkeypatch):
    for count in (0, 10**6, 10**9, 10**11, 10**13):
        cut = simhash.stretches(3, count)
        assert sum(bits for _, bits in cut) == 64 and cut[0][0] == 0
        assert count / 2 ** sum(sorted(bits for _, bits in cut)[: len(cut) - 3]) <= simhash.GROUP / simhash.LARGE + 1
    assert [len(simhash.stretches(3, n)) for n in (10**6, 10**10, 10**12)] == [4, 5, 6]
    deep = simhash.stretches
    for count in (10**10, 10**12):
        monkeypatch.setattr(simhash, "stretches", lambda budget, _, count=count: deep(budget, count))
        check_links(spark, random.Random(count), 300)
