"""LIKE by an automaton, fitted bins, backtests, nested samples and the append-only log."""

import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from leadloom.operators import backtest, evaluation, like
from leadloom.plans.adapters import Tables
from leadloom.sources.log import append_run, read_log


def test_random_patterns_are_as_like(spark):
    r = random.Random(3)
    word = lambda n, extra: "".join(r.choice("abAB" + extra) for _ in range(r.randint(0, n)))
    values = [*{word(9, "%_\\\n.") for _ in range(400)}, None]
    patterns = {word(6, "%%_") for _ in range(250)} | {re.sub(r"[%_\\]", lambda m: "\\" + m[0], word(4, "%_\\")) + r.choice(["", "%", "_"]) for _ in range(150)} | {None}
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(values)], "i int, v string, _pattern2 string")
    table = spark.createDataFrame([(p, k) for k, p in enumerate(patterns, 1)] + [("a%", 0)], "p string, k int")
    joined = like.like_join(df, table, "v", "p")
    got = sorted((x.i, x.k) for x in joined.collect())
    plain = df.join(F.broadcast(table), F.expr("upper(v) like upper(p)"))
    assert got == sorted((x.i, x.k) for x in plain.collect()) and len(got) > 1000
    assert "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString()
    hits = {i for i, _ in got}
    assert {x.i for x in like.like_join(df, table, "v", "p", "left_semi").collect()} == hits
    assert {x.i for x in like.like_join(df, table, "v", "p", "left_anti").collect()} == set(range(len(values))) - hits
    assert like.like_join(df, table.limit(0), "v", "p", "left_anti").count() == len(values)


def test_like_refuses_what_is_too_large_or_wrong(spark, monkeypatch):
    df = spark.createDataFrame([("a",)], "v string")
    with pytest.raises(ValueError):
        like.Patterns(["a\\b"])
    monkeypatch.setattr(like, "MOST_PATTERNS", 1)
    with pytest.raises(ValueError):
        like.like_join(df, spark.createDataFrame([("a",), ("b",)], "p string"), "v", "p")


def test_fitted_bins(spark):
    rows = [(x, int(x > 60 or x in (3, 5))) for x in [*range(100), *[50] * 40]] + [(None, 1)]
    df = spark.createDataFrame(rows, "v int, y int")
    edges = evaluation.fit_edges(df, "v", 10)
    assert len(edges) == len(set(edges)) < 9  # the many fifties make cuts that are equal
    found = evaluation.iv_bins(df, "v", "y").collect()
    assert sum(b.n for b in found) == 140 and sum(b.pos for b in found) == 41
    pooled = sorted(evaluation.iv_bins(df, "v", "y", monotone=True).collect())
    rates = [b.pos / b.n for b in pooled]
    assert rates == sorted(rates) and sum(b.n for b in pooled) == 140 and 1 < len(pooled) <= len(found)
    assert evaluation.pooled_edges([1.0, 2.0, 3.0], {0: (10, 8), 1: (10, 5), 2: (10, 6), 3: (10, 1)}) == [1.0, 3.0]
    few = spark.createDataFrame([(x % 3, x % 2) for x in range(30)], "v int, y int")
    assert evaluation.fit_edges(few, "v", 10) == [0.0, 1.0] and evaluation.iv_bins(few, "v", "y").count() == 3
    assert evaluation.information_value(few.where("y = 1"), "v", "y").first().iv == 0 and evaluation.information_value(few.limit(0), "v", "y").first().iv == 0


def test_tiers_differ_between_windows(spark):
    leads = spark.createDataFrame([(1, 7, date(2020, 6, 1), 1), (2, 7, date(2020, 8, 1), 0), (3, None, date(2020, 8, 1), 0)], "lead_id long, person_id long, contacted date, y int")
    history = spark.createDataFrame([(7, 1, 5, date(2010, 1, 1), date(2020, 3, 1)), (7, 2, 6, date(2020, 3, 1), None), (8, 3, 6, date(2015, 1, 1), date(2020, 4, 1))], "person_id long, spell_id long, firm_id long, start_date date, end_date date")
    windows = {"a": (date(2020, 1, 1), date(2020, 12, 31)), "b": (date(2020, 7, 1), date(2020, 12, 31))}
    tier = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("firm_then", "tenure_years", "experience_years", "prior_firms", "net_change")])
    got = {(x.window, x.lead_id): x.tier for x in backtest.tiered(leads, history, windows, lambda df: df.withColumn("tier", tier)).collect()}
    assert got == {("a", 1): "5/10/10/1/0", ("a", 2): "5/10/10/1/0", ("a", 3): "-/-/-/0/0", ("b", 2): "6/0/10/2/0", ("b", 3): "-/-/-/0/0"}


def test_samples_are_nested(spark):
    df = spark.range(300).withColumnRenamed("id", "k")
    got = {x.k: x.sample_size for x in evaluation.nested_samples(df, "k", [10, 50, 1000], 7).collect()}
    assert len(got) == 300
    for n in (10, 50):
        assert {k for k, size in got.items() if size <= n} == {x.k for x in evaluation.sample(df, "k", n, 7).collect()}


def test_a_run_is_in_the_log_once_and_whole(spark, tmp_path):
    rows = Tables(spark, "/root/testdata/sf0.001").raw("nation").select("n_nationkey", "n_name")
    path = str(tmp_path / "log")
    assert read_log(spark, path, rows.schema).count() == 0
    assert append_run(rows, path, "run 1") and not append_run(rows.orderBy(F.desc("n_name")).repartition(3), path, "run 1")
    assert read_log(spark, path, rows.schema).count() == 25
    with pytest.raises(ValueError):
        append_run(rows.limit(3), path, "run 1")

    @F.udf("string")
    def broken(name):
        raise RuntimeError("cut off")

    with pytest.raises(Exception, match="cut off"):
        append_run(rows.withColumn("n_name", broken("n_name")), path, "run 2")
    rows.limit(4).write.parquet(f"{path}/runs/{__import__('hashlib').sha256(b'run 3').hexdigest()[:32]}")  # written, not committed
    assert read_log(spark, path, rows.schema).count() == 25
    assert append_run(rows.limit(5), path, "run 3") and append_run(rows.limit(0), path, "run 4")
    assert read_log(spark, path, rows.schema).count() == 30
