"""The similarity join of names against all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from leadloom.operators import resolution as R
from leadloom.operators import similarity_join as J
from leadloom.plans import names, registry


def grams(form):
    cuts = [form[i : i + 3] for i in range(len(form) - 2)] if len(form) > 3 else [form]
    return {(g, cuts[:i].count(g)) for i, g in enumerate(cuts)}


def plain(left, right, least):
    a, b = {x: grams(x) for x in left if x}, {x: grams(x) for x in right if x}
    return {(x, y) for x in a for y in b if len(a[x] & b[y]) >= least * len(a[x] | b[y]) - 1e-9}


def table(spark, forms):
    return spark.createDataFrame([(x,) for x in forms], "form string")


@pytest.mark.parametrize("least", [0.51, 0.7, 0.85, 1.0])
def test_all_pairs_are_found(spark, least):
    """5,000 names of few words and letters, so that most grams are held by far more than 50."""
    r = random.Random(7)
    word = lambda n: "".join(r.choice("abc") for _ in range(n))
    words = [word(r.randint(1, 6)) for _ in range(40)]
    some = lambda: " ".join(sorted(r.choice(words) for _ in range(r.randint(1, 4))))
    left, right = {some() for _ in range(1000)} | {"", "a", "ab", "abc"}, {some() for _ in range(4000)} | {"a", "ab", "abc"}
    want = plain(left, right, least)
    for hot in (3, 50, 10**9):
        got = [(x.l_form, x.r_form) for x in J.similar_forms(table(spark, left), table(spark, right), least, hot).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert len(want) > 100


def test_partners_are_found_in_a_list_of_100_000(spark):
    """One edit behind the number of a customer, every 50th checked, however long the list."""
    names = spark.range(100_000).select(F.format_string("customer %09d", "id").alias("name"), "id")
    right = names.select(F.concat("name", F.lit("x")).alias("name"), F.col("id").alias("r")).repartition(8)
    left = names.where("id % 50 = 0").select("name", F.col("id").alias("l"))
    pairs = R.similar_pairs(left, right).cache()
    assert pairs.where("l = r").count() == 2_000
    one = pairs.where("l = 77700").select("r").collect()
    want = [i for i in range(100_000) if len(grams("000077700 customer") & (g := grams(f"{i:09}x customer"))) >= 0.7 * len(grams("000077700 customer") | g) - 1e-9]
    assert sorted(x.r for x in one) == want
    pairs.unpersist()


def test_names_of_one_form_and_none(spark):
    left = spark.createDataFrame([(1, "B a"), (2, "a, b"), (3, None), (4, "!"), (5, "zz")], "l int, name string")
    right = spark.createDataFrame([(7, "A B"), (7, "A B"), (8, ""), (9, "zzz")], "r int, name string")
    assert sorted((x.l, x.r) for x in R.similar_pairs(left, right).collect()) == [(1, 7), (1, 7), (2, 7), (2, 7)]
    assert R.similar_pairs(left.limit(0), right).count() == 0
    with pytest.raises(ValueError):
        R.similar_pairs(left, right, 0.5)


def test_blocks_beyond_the_bound_are_refused(spark, monkeypatch):
    monkeypatch.setattr(R, "MOST_PAIRS", 3)
    left = spark.createDataFrame([(i, "a") for i in range(2)], "id int, name string")
    right = spark.createDataFrame([(i, "ab") for i in range(2)], "right_id int, right_name string")
    with pytest.raises(ValueError):
        R.blocked_pairs(left, right, "name", "right_name", "first")


def test_no_side_that_grows_is_broadcast(spark):
    """The files of names are small and their keys are not: a broadcast of keys filled the driver's memory."""
    names = spark.range(2000).select(F.format_string("customer %09d", "id").alias("name"), F.col("id").alias("l"))
    for pairs in (R.similar_pairs(names, names.withColumnRenamed("l", "r")), J.similar_forms(table(spark, ["a b c", "a c"]), table(spark, ["a b c"]), hot=0)):
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("name", ["er_eval", "er_protect", "er_tier_match", "er_ambiguity", "er_block", "er_fuzzy"])
def test_queries_of_names_broadcast_only_grams_and_sizes(spark, monkeypatch, name):
    """On small tables Spark broadcasts each side that no hint keeps from it, in any step; only the
    table of grams and that of lengths, which do not grow with the lists, may go through the driver."""
    plans = []

    def noted(f):
        def run(df, *rest):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return f(df, *rest)

        return run

    for module, step in ((J, "written"), (R, "checkpointed"), (names, "checkpointed")):
        monkeypatch.setattr(module, step, noted(getattr(module, step)))
    found = registry.queries()[name](spark, "/root/testdata/sf0.001")
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    joins = [x for plan in plans for x in re.findall(r"(\w+Join) \[(\w+)#", plan)]
    assert "SortMergeJoin" in {kind for kind, _ in joins}
    assert {key for kind, key in joins if kind.startswith("Broadcast")} <= {"gram", "side"}
    assert not any("BroadcastNestedLoopJoin" in plan for plan in plans)


def test_bits_leave_few_pairs_to_compare(spark, monkeypatch):
    """Pairs that share a key are many; those whose grams were compared were as many and filled the time."""
    tables = {}
    put = J.written
    monkeypatch.setattr(J, "written", lambda df, name: tables.setdefault(name, put(df, name)))
    forms = spark.range(20_000).select(F.format_string("%09d customer", "id").alias("form"))
    similar = J.similar_forms(forms, forms.select(F.concat("form", F.lit(" llc")).alias("form"))).count()
    compared = [df.count() for name, df in tables.items() if name.startswith("pairs")]
    assert similar >= 20_000 and similar <= sum(compared) <= 1.5 * similar
    assert all({"form", "grams"}.isdisjoint(df.columns) for name, df in tables.items() if name.startswith(("pairs", "met")))


def test_copies_of_a_name_are_scored_once(spark, monkeypatch):
    """With a score at random, copies that are scored apart would differ."""
    monkeypatch.setattr(R, "similarity", lambda a, b, mode: F.rand() + F.length(a) - F.length(a))
    left = spark.createDataFrame([(i, n) for i, n in enumerate(["Ann Bee", "ann  bee.", "ANN BEE"])], "id int, name string")
    right = spark.createDataFrame([(i, n) for i, n in enumerate(["ann bee", "Ann, Bee", "ann bee", "other"])], "right_id int, right_name string")
    rows = R.scored_candidates(left, right).collect()
    assert len(rows) == 9 and len({r.confidence for r in rows}) == 1


@pytest.mark.parametrize(("name", "most"), [("er_tier_match", 8), ("er_override", 11), ("er_ambiguity", 5), ("er_workbench", 5), ("er_fuzzy", 4)])
def test_result_is_made_of_written_scores(spark, name, most):
    """A plan that holds comparison, scores and result at once is planned anew at each of its many shuffles,
    and filled the driver's memory."""
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "array_intersect" not in plan
    assert plan.count("Exchange hashpartitioning") <= most
