"""From raw documents to packed training sequences, in five stages.

Language identification drops what has no language and fills missing labels, exact
deduplication and near-deduplication (SimHash links and MinHash candidates, all
checked: five-word shingles, Jaccard similarity of 0.8 or more) keep one document
of each group, mixing repeats or thins the sources to their target weights, and
packing cuts the rest into windows of token ids, which its rows hold. Each stage
works on all that its predecessor kept, written as Parquet and read again.

Defined cases: a null or empty text, or one without letters, goes in the language stage;
rows without an id all pass the dedup stages and are named by a hash of their columns in
the mix; rows repeated whole become one in the dedup stages; of equal texts the largest id
stays, of near copies the smallest; without labels the language stage only looks for a
letter; a very long text is read whole by each stage and must fit a task; an empty table
gives no rows; further columns pass all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leadloom.llm import exact_dedup, language_id, mixing, near_copies, packing
from leadloom.llm.common import forget, passing, table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one_of_each(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_words(docs, with_ids=True)


STAGES = [
    ("language", identify_language),
    ("exact", drop_exact_copies),
    ("near", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack_windows),
]

#: SQL expresses neither the components of near-copies nor the tokenizer; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with passing(spark):
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            forget(before)
        before = docs
    return docs
