"""Near-copies against brute-force Jaccard over all pairs, alone and in the pipeline."""

import random
from collections import Counter

import duckdb

import corpus_pipeline
from leadloom.llm import mixing, near_copies
from tests.llm.test_pipeline import SF, low


def plain_shingles(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low(text)) if w]
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_roots(texts):
    sets = {i: plain_shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}
    changed = True
    links = [(i, j) for i in sets for j in sets if i < j and (both := len(sets[i] & sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - both)]
    while changed:
        changed = False
        for i, j in links:
            low_root = min(root[i], root[j])
            if root[i] != low_root or root[j] != low_root:
                root[i] = root[j] = low_root
                changed = True
    return root


def kept(docs):
    return Counter(r.doc_id for r in near_copies.keep_one_of_each(docs).collect())


def test_stage_keeps_one_of_each_component(spark):
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    last = {low(r.text): r.doc_id for r in sorted(rows, key=lambda r: r.doc_id)}
    texts = {i: t for t, i in last.items()}
    want = {i for i, r in plain_roots(texts).items() if i == r}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert len(texts) - len(want) >= 5
    got = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert Counter(r.doc_id for r in got.collect()) == Counter(want)


def test_large_group_and_chains(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    texts = {}
    for i in range(150):  # a group of near-copies, and chains that drift away from their start
        x = list(words)
        for at in r.sample(range(200), r.randint(0, 4)):
            x[at] = f"x{r.randrange(10**6)}"
        texts[i] = " ".join(x)
    for chain in range(10):
        x = [f"c{chain}-{k}" for k in range(100)]
        for i in range(12):
            x[r.randrange(100)] = f"y{r.randrange(10**6)}"
            texts[1000 + 100 * chain + i] = " ".join(x)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert kept(docs) == Counter(i for i, root in plain_roots(texts).items() if i == root)


def test_a_family_without_links_and_one_with_bridges(spark):
    """Buckets larger than the reach, with members that no neighbour links."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(100)]
    texts = {}
    for i in range(60):  # each 0.84 or so from the base, hardly any from one another
        x = list(base)
        x[r.randrange(5, 95)] = f"x{i}"
        x[r.randrange(5, 95)] = f"y{i}"
        texts[i + 1] = " ".join(x)
    assert len(set(plain_roots(texts).values())) > 1
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert kept(docs) == Counter(i for i, root in plain_roots(texts).items() if i == root)
    texts[0] = " ".join(base)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert kept(docs) == Counter(i for i, root in plain_roots(texts).items() if i == root)


def test_small_pieces_find_the_same(spark, monkeypatch):
    """Blocks of a few mates, asked in pieces of a few hashes."""
    monkeypatch.setattr(near_copies, "BLOCK", 7)
    monkeypatch.setattr(near_copies, "HELD", 300)
    test_large_group_and_chains(spark)
    test_a_family_without_links_and_one_with_bridges(spark)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, "É é\x1cx y z"), (6, "É é\x1cx y z"), (None, "One two"), (None, "One two"), (9, "w " * 70000), (10, "one two three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert kept(docs) == {1: 1, 4: 1, 6: 1, 9: 1, 10: 1, None: 2}
    assert near_copies.keep_one_of_each(docs.limit(0)).count() == 0


def test_pipeline_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    last = {}
    for i, r in rows.items():
        last[low(r.text)] = max(i, last.get(low(r.text), i))
    roots = plain_roots({i: rows[i].text for i in last.values()})
    assert any(i != root for i, root in roots.items())
    rows = {i: rows[i] for i, root in roots.items() if i == root}
    got, documents = docs, None
    for name, stage in corpus_pipeline.STAGES:
        documents, got = got, corpus_pipeline.written(stage(spark, got, SF), f"near-{name}")
        assert name == "pack" or got.columns == docs.columns
        if name == "near":
            kept = got.toPandas()
            assert Counter(kept.doc_id) == Counter(list(rows))
    want = duckdb.connect().execute(mixing.ORACLE_SQL.replace("from documents", "from kept")).df()
    copies = Counter(r.doc_id for r in documents.collect())
    assert {i: n * len(rows[i].text.split()) for i, n in copies.items()} == {i: t for i, t in zip(want.doc_id, want.taken) if t}
    covered = Counter()
    for p in got.collect():
        covered[p.doc_id, p.doc_tokens] += p.length
    assert {i: n // size for (i, size), n in covered.items()} == dict(copies)
