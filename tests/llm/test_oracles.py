"""The corpus queries that SQL can express against their DuckDB SQL."""

import random
import re

import pytest
from pyspark.sql import functions as F

from leadloom.llm import chat_format, exact_dedup, mixing, quality_rules, registry
from tests.compare import check, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_its_oracle(spark, con, name):
    check(spark, con, registry.queries()[name], registry.oracle_sql()[name], SF)


def test_exact_dedup_where_digests_collide(spark):
    rows = [(1, "A b"), (2, "a B"), (3, "c"), (3, "c"), (4, None), (5, ""), (None, "C"), (7, "É"), (8, "é"), (None, None)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, digest int")
    for digest in (exact_dedup.sha256, lambda content: b"same"):
        got = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(docs, digest=digest).collect())
        assert got == [(0, 3, 3, False), (0, 5, 3, False), (1, 2, 2, False), (2, 2, 2, True), (3, 3, 3, False), (3, 3, 3, True), (4, 5, 3, False), (5, 5, 3, True), (7, 7, 1, True), (8, 8, 1, True)]
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0
    assert sorted(r.doc_id or 0 for r in exact_dedup.keep_one_of_each(docs).collect()) == [0, 0, 2, 3, 5, 7, 8]


def test_exact_dedup_of_a_hot_and_a_long_text_with_clashing_names(spark):
    assert [exact_dedup.salt_of(t) for t in (0, 1, 3, 4, 99_999)] == [0, 1, 1, 2, 316]
    rows = spark.range(0, 9000, 1, 40).selectExpr(
        "id as doc_id", "case when id = 7 then repeat('Long Text ', 300000) when id % 3 = 0 then 'Hot' else concat('t', id div 2) end as text",
        "1 as content", "2 as digest", "3 as salt", "4 as shares", "5 as keep_id", "6 as rows"
    )
    want = {}
    for r in rows.select("doc_id", "text").collect():
        want.setdefault(r.text.lower(), []).append(r.doc_id)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(rows).collect()}
    assert got == {i: (max(ids), len(ids), i == max(ids)) for ids in want.values() for i in ids}
    kept = exact_dedup.keep_one_of_each(rows)
    assert kept.columns == rows.columns and kept.count() == len(want)


def test_chat_edges(spark):
    rows = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", None), (1, None, None, "late"), (1, 1, "bob smith", "x"), (None, 300, "user", "y"), (2, 0, "system", "only"), (3, 600, "user", "far"), (3, 600, "user", "far")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, speaker int")
    got = {(r.conv_id, r.speaker): r for r in chat_format.perspectives(turns).collect()}
    assert {k[1] for k in got if k[0] == 1} == {"user", "assistant", "bob smith", "unknown"}
    assert not any(k[0] == 2 for k in got) and (None, "user") in got and got[3, "user"].n_turns == 2
    first = got[1, "user"]
    assert first.rendered == (
        "<|im_start|>assistant\nhi <| im_end|><|im_end|>\n<|im_start|>user name=assistant\n<|im_end|>\n<|im_start|>user name=bob_smith\nx<|im_end|>\n"
        "<|im_start|>user name=unknown\nlate<|im_end|>\n"
    )
    start, size = map(int, first.mask.split(":"))
    assert first.rendered[start : start + size] == "hi <| im_end|><|im_end|>\n" and first.n_chars == len(first.rendered)
    assert chat_format.perspectives(turns.limit(0)).count() == 0


def plain_chat(turns, speaker):
    """Rendering and spans of one speaker, turn by turn; turns are (turn, role, text), in order."""
    safe = lambda r: re.sub(r"[^\w-]+", "_", r)
    roles, out, spans = sorted({r for _, r, _ in turns}), "", []
    for _, role, text in turns:
        k = [r for r in roles if safe(r) == safe(role)].index(role) + 1
        name = "assistant" if role == speaker else "system" if role == "system" else "user name=" + safe(role) + (f"#{k}" if k > 1 else "")
        out += f"<|im_start|>{name}\n"
        if role == speaker:
            spans.append(f"{len(out)}:{len(text) + 11}")
        out += f"{text}<|im_end|>\n"
    return out, ",".join(spans)


def test_chat_renders_whole_dialogues_and_tells_names_apart(spark):
    r = random.Random(4)
    said = [(i, r.choice(["a b", "a_b", "a+b", "system", "é", "cleo"]), "w" * r.randint(0, 9)) for i in range(3000)]
    turns = spark.createDataFrame([(7, *x) for x in said], "conv_id long, turn long, role string, text string")
    got = {x.speaker: x for x in chat_format.perspectives(turns).collect()}
    assert set(got) == {"a b", "a_b", "a+b", "é", "cleo"}
    for speaker, x in got.items():
        assert (x.rendered, x.mask) == plain_chat(said, speaker) and x.n_turns == 3000 and x.n_chars == len(x.rendered)


def test_quality_edges(spark):
    rows = [(1, None), (2, ""), (3, "the cat " * 40), (4, " ".join(f"the w{i}" for i in range(50))), (None, "x " * 100_000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in quality_rules.quality(docs).collect()}
    assert (got[1].n_words, got[2].n_words, got[3].n_repeat_words, got[None].n_repeat_words) == (0, 0, 80, 100_000)
    assert [got[i].kept for i in (1, 2, 3, 4, None)] == [False, False, False, True, False]
    assert quality_rules.quality(docs.limit(0)).count() == 0


def test_mixing_is_not_a_sort_by_the_random_number(spark):
    """Inclusion odds are unequal: some documents are taken before others of a smaller u."""
    rows = [(i, "w " * (1 if i % 3 else 200), "s0" if i % 2 else "s1") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs.withColumn("map", F.expr("map(1, 2)")), weights=(5, 1)).join(docs.select("doc_id", mixing.uniform(F.col("doc_id")).alias("u")), "doc_id").toPandas()
    thinned = got[got.source == "s1"]
    assert (thinned.copies == 0).any() and thinned[thinned.copies == 1].u.max() > thinned[thinned.copies == 0].u.min()
    by = thinned.groupby("size").copies.mean()
    assert by[200] > 1.5 * by[1]


def test_repeat_documents_with_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "a b c " * (i + 1), "s") for i in range(5)], "doc_id long, text string, source string")
    odd = docs.selectExpr("*", "1 as _id", "2 as key", "3 as times", "4 as copy", "map('a', 1) as _key")
    assert sorted(r.doc_id for r in mixing.repeat_documents(odd).collect()) == [0, 1, 2, 3, 4]
    assert mixing.repeat_documents(odd).columns == odd.columns
    twice = odd.union(odd)
    assert sorted(r.doc_id for r in exact_dedup.keep_one_of_each(twice).collect()) == [0, 1, 2, 3, 4]
    assert sorted(r.doc_id for r in exact_dedup.keep_one_of_each(twice.selectExpr("*", "1 as _stays", "2 as same")).collect()) == [0, 1, 2, 3, 4]


def test_rows_without_an_id_stay_in_the_mix(spark):
    """A third of the rows has no id, some of them alike: the sources still meet their targets."""
    rows = [(None if i % 3 == 0 else i, "w " * (1 + i % 40), f"s{i % 3 and i % 2}") for i in range(900)] + [(None, "same text", "s0")] * 40
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, source string, key string")
    out = mixing.repeat_documents(docs).collect()
    want = {r.source: r.target for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    for source, target in want.items():
        assert abs(sum(len(r.text.split()) for r in out if r.source == source) - target) <= 40
    assert sum(r.doc_id is None for r in out) > 100 and {r.key for r in out} == {"k"}


def test_mixing_meets_its_targets(spark):
    rows = [(i, "w " * (1 + i % 90), f"s{i % 4}" if i % 9 else None) for i in range(4000)] + [(5000, None, "s0"), (None, "a b", "tiny"), (5001, "", "tiny")]
    docs = spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], "doc_id long, text string, source string, size int")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r.size for r in got)
    by = {}
    for r in got:
        x = by.setdefault(r.source, [r.target, r.source_size, 0])
        x[2] += r.taken
    assert abs(sum(x[0] for x in by.values()) - sum(x[1] for x in by.values())) < 1e-6
    assert all(abs(t - taken) <= 90 and t <= 3 * size for t, size, taken in by.values())
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, got))
    assert mixing.mix(docs.limit(0)).count() == 0
