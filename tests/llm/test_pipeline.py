"""The pipeline against brute force, stage by stage."""

from collections import Counter

import numpy as np

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_stages_with_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "the cat is here", "en", "a", 1), (1, "the cat is here", "en", "a", 1), (2, "THE cat is here", None, None, None), (3, None, "en", "a", 1), (4, "", "en", "b", 1), (None, "without an id", "en", "b", 1), (5, "word " * 30000, "en", "b", 9)]
    odd = spark.createDataFrame(rows, schema)
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.written(stage(spark, docs, SF), f"odd-{name}")
            if name == "exact":
                ids = Counter(r.doc_id for r in docs.collect())
                assert not ids or ids == {2: 1, 5: 1, None: 1}
    assert docs.count() == 0


def test_run_packs_the_ids_and_leaves_only_its_result(spark):
    import glob

    import public_tokenizers
    from tokenizers import Tokenizer

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(glob.glob(f"{folder}/*"))
    got = corpus_pipeline.run(spark, SF)
    made = set(glob.glob(f"{folder}/*")) - before
    assert len(made) == 1 and "pipeline-pack-" in made.pop()
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in got.limit(50).collect():
        ids = plain.encode(texts[r.doc_id], add_special_tokens=False).ids + [2]
        assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.start : r.start + r.length]


def test_operators_leave_only_what_their_results_read(spark):
    import glob

    from leadloom.llm import exact_dedup, mixing, near_copies, simhash

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for made_by, left in ((simhash.near_duplicates, 2), (near_copies.near_copies, 1), (mixing.mix, 1), (exact_dedup.exact_duplicates, 1)):
        before = set(glob.glob(f"{folder}/*"))
        got = made_by(docs)
        assert len(set(glob.glob(f"{folder}/*")) - before) == left
        assert got.count() or made_by is near_copies.near_copies


def test_shuffles_of_a_written_table_go_with_its_query(spark):
    import glob
    import os

    from leadloom.llm.common import _CLEANS, forget, written

    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shuffles = lambda: {p for d in local for p in glob.glob(f"{d}/*/shuffle_*.data")}
    before, setting = shuffles(), spark.conf.get(_CLEANS, None)
    got = written(spark.range(1000).repartition(7), "shuffled")
    assert not shuffles() - before and got.count() == 1000 and spark.conf.get(_CLEANS, None) == setting
    forget(got)
    assert not os.path.exists(got.inputFiles()[0].removeprefix("file:").replace("//", "/"))
