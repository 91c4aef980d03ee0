"""Language identification: exact parse, the query by brute force, and accuracy on the held-out fold."""

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadloom.llm import language_id

SF = "/root/testdata/sf0.01"


def plain_phrases(sample, text):
    """Longest matches by search in the sample."""
    count, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        count, at = count + 1, at + size
    return count


def plain_normal(text):
    runs = re.findall(r"[^\W\d_]+", text or "")
    return " " + " ".join("".join(c.lower()[0] for c in r) for r in runs) + " " if runs else ""


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=40), st.text("abcd", max_size=30))
def test_parse_against_search(sample, text):
    assert language_id.SuffixAutomaton(sample).phrases(text) == plain_phrases(sample, text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB éÉßİ1_-\n漢Σ", max_size=12)), max_size=6))
def test_normal_texts(texts):
    texts = [t if not t or all(c.isalpha() or not re.match(r"[^\W\d_]", c) for c in t) else "" for t in texts]
    points, sizes = language_id.code_points(texts)
    at, found = 0, []
    for n in sizes.tolist():
        found.append(points[at : at + n].tobytes().decode("utf-32-le"))
        at += n
    assert found == [plain_normal(t) for t in texts] and at == len(points)


@settings(max_examples=100, deadline=None)
@given(st.text("abc ", min_size=1, max_size=60), st.lists(st.text("abcd ", max_size=40), max_size=70), st.integers(1, 80))
def test_many_texts_at_once(sample, texts, lanes):
    samples = (("a", sample), ("b", sample[::-1] + "d"))
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    want = [[plain_phrases(s, t) for t in texts] for _, s in samples]
    before = language_id.STRETCH, language_id.TABLE_CELLS
    try:
        for stretch, cells in ((lanes, before[1]), (1, before[1]), before, (lanes, 0), (lanes, 4 * len(sample))):  # the last two as with large alphabets
            language_id.STRETCH, language_id.TABLE_CELLS = stretch, cells
            assert language_id.Parser(samples).counts(points, sizes).tolist() == want
    finally:
        language_id.STRETCH, language_id.TABLE_CELLS = before


def test_query_by_brute_force(spark):
    """Phrases of the whole running text by search; parsing word by word gives other counts."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    samples = language_id.learn(language_id.labelled_rows(docs, "text", "doc_id", "lang"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    by_word = 0
    for r in language_id.op7_language_id(spark, sf).collect():
        text = plain_normal(texts[r.doc_id])
        if not text:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        counts = sorted((plain_phrases(s, text), lang) for lang, s in samples)
        assert r.lang_pred == counts[0][1] and abs(r.score - (1 - counts[0][0] / counts[1][0])) < 1e-12
        words = [f" {w} " for w in text.split()]
        by_word += sum(plain_phrases(samples[0][1], w) for w in words) != plain_phrases(samples[0][1], text)
    assert by_word > 100


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    rows = language_id.op7_language_id(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(truth) and len(rows) == len(truth)
    held = [r for r in rows if r.held_out and any(c.isalpha() for c in truth[r.doc_id][1] or "")]
    assert 0.2 < len(held) / len(rows) < 0.3
    right = sum(r.lang_pred == truth[r.doc_id][0] for r in held)
    assert right / len(held) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    rows = [(1, "the cat and the dog", "en", 1), (5, "the dog is here " * 5000, "en", 1), (6, None, "en", 1), (7, "12 34 --", None, 1), (None, "the cat", "en", 1), (8, "", "en", 1), (9, "the cat", None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out int")
    found = {r.doc_id: r.lang_pred for r in language_id.predict_languages(docs).collect()}
    assert found == {1: "en", 5: "en", 6: "und", 7: "und", None: "en", 8: "und", 9: "en"}
    assert language_id.predict_languages(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.predict_languages(docs.where("doc_id = 7")).collect()} == {"und"}
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id: r.lang for r in kept.collect()} == {1: "en", 5: "en", None: "en", 9: "en"}
    clash = docs.selectExpr("*", "'x' as lang_pred", "1 as score", "map('a', 1) as whole")
    assert language_id.keep_identified(clash).count() == 4
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.keep_identified(unlabelled).count() == 4


def test_many_labels_are_bounded(spark):
    """Of dirty labels the most frequent are learned, ties in code point order."""
    rows = [(i, "the cat and the dog", "en") for i in range(40)] + [(100 + i, "der hund und die katze", "de") for i in range(40)]
    rows += [(1000 + i, f"noise {i}", f"x{i:04d}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labelled = language_id.labelled_rows(docs, "text", "doc_id", "lang")
    assert [name for name, _ in language_id.learn(labelled, labels=2)] == ["de", "en"]
    assert len(language_id.learn(labelled, docs=10**6, all_chars=10**7, labels=50)) == 50
    samples = language_id.learn(labelled)
    assert len(samples) <= language_id.LABELS and {"de", "en"} <= {name for name, _ in samples}
    assert language_id.Parser(samples).code.shape[0] < 100
