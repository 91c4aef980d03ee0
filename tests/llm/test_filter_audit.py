"""The filter audit on edge rows, and the radix trie against a plain table."""

from collections import Counter
from itertools import permutations

from hypothesis import given, settings
from hypothesis import strategies as st

from leadloom.llm import filter_audit as fa


def plain_mask(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
    caps = sum("A" <= c <= "Z" for c in text)
    return (len(words) < 200) + 2 * (100 * len(set(words)) < 50 * len(words)) + 4 * (100 * caps > 2 * len(text)) + 8 * any(c in "#$%&*|" for c in text)


def plain_audit(docs, labels):
    """Every order, document by document."""
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1} for k in (0, 1))
    rows = []
    for doc_id, text, part in docs:
        dup = doc_id is not None and any(t == (text or "") and i is not None and i < doc_id for i, t in ((i, t or "") for i, t, _ in docs))
        rows.append((part or "", plain_mask(text or "") + 16 * dup, doc_id in good, doc_id in toxic))
    found = {}
    for part in {r[0] for r in rows}:
        shapley = Counter()
        for order in permutations("ABCDE"):
            before = 0
            for k, f in enumerate(order):
                bit = 1 << "ABCDE".index(f)
                mine = [r for r in rows if r[0] == part]
                gone = [r for r in mine if r[1] & bit and not r[1] & before]
                shapley[f] += len(gone)
                found[part, "".join(order), k + 1] = [
                    sum(not r[1] & (bit | before) for r in mine), len(gone), sum(bool(r[1] & bit and r[1] & before) for r in mine), sum(r[1] == bit for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)
                ]
                before |= bit
        for (p, order, k), x in found.items():
            if p == part:
                x.append(shapley[order[k - 1]])
    return {k: tuple(v) for k, v in found.items()}


LONG = " ".join(f"w{i}" for i in range(300))
ROWS = [
    (5, LONG, "a"), (2, LONG, "b"), (2, LONG, "b"), (9, LONG, None), (None, LONG, "a"), (1, None, "a"), (3, "", None), (4, "", ""), (6, "A# b", "a"), (7, "A# b", "é"), (8, LONG + " x", "a"),
    (10, LONG[:-1], "a"), (11, "é" * 60 + "AB", "b"), (12, "the cat " * 200, "b"), (13, "the cat " * 200, "b"), (14, "x" * 300_000, "b"), (15, "x" * 300_000 + "y", "b"), (16, "x" * 300_000, "b"),
]
LABELS = [(5, 1, 0), (2, 0, 1), (9, None, None), (9, 1, 1), (None, 1, 1), (13, 1, 0), (16, 1, 1), (99, 1, 1)]


def audited(spark, rows, labels, **options):
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, mask int, cell int")
    marks = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, part string")
    names = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    return {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in fa.audit(docs.repartition(3), marks, **options).collect()}


def test_edge_rows(spark):
    want = plain_audit(ROWS, LABELS)
    assert audited(spark, ROWS, LABELS) == want
    # tiny ranges and tries: prefixes adapt down to the longest, tries are given up and begun again
    assert audited(spark, ROWS, LABELS, range_bytes=1, local_bytes=1) == want
    assert audited(spark, ROWS, [], range_bytes=500, local_bytes=1000) == plain_audit(ROWS, [])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert fa.audit(docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")).count() == 0


def test_prefixes_adapt(spark):
    """Texts behind one long boilerplate are told apart beyond it, and a hot text stays one range."""
    texts = ["b" * 600 + f"{i:05}" * 3 for i in range(400)] + ["hot " * 50] * 3
    docs = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("cast(text as binary) as text")
    heavy = fa.heavy_prefixes(docs, range_bytes=20_000)
    ranges = Counter(fa.range_of(t.encode(), heavy) for t in texts)
    assert len(ranges) > 20 and max(ranges.values()) <= 20 and len(heavy) == 9
    assert len(fa.heavy_prefixes(docs, range_bytes=10**9)) == 0
    assert len({fa.range_of(t.encode(), heavy) for t in texts[-3:]}) == 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=12), st.integers(0, 5), st.sampled_from("xy")), max_size=40))
def test_trie_holds_the_smallest_id(rows):
    trie, out = fa.RadixTrie(), []
    for text, doc_id, part in rows:
        trie.add(text.encode() * 40, doc_id, part, 1, None, out)
    least = {}
    for text, doc_id, _ in rows:
        least[text.encode() * 40] = min(doc_id, least.get(text.encode() * 40, doc_id))
    ends = list(trie.terminals())
    assert {text: doc_id for text, doc_id, _, _ in ends} == least and len(ends) == len(least)
    told = Counter()
    for doc_id, part, mask, n in out:
        assert mask & fa.DUPLICATE
        told[doc_id, part, True] += n
    for _, doc_id, _, parts in ends:
        for part, n in parts.items():
            told[doc_id, part, False] += n
    assert told == Counter((i, p, i > least[t.encode() * 40]) for t, i, p in rows)
