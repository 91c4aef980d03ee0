"""Operators that read a time line once, against plain loops over pairs."""

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.operators import aggregates, features, joins, resampling, running, windows
from leadloom.operators.evaluation import bootstrap_lift

DAY0 = date(2019, 1, 1)
SPELLS = "person_id long, spell_id long, firm_id long, start_date date, end_date date"


def lives(seed, people=25, spells=12):
    """Overlapping, open, empty and repeated spells; some without a person, firm or start."""
    r = random.Random(seed)
    rows = []
    for i in range(people * spells):
        start = DAY0 + timedelta(r.randrange(500))
        end = r.choice([None, start, start + timedelta(r.randrange(300))])
        rows.append((r.choice([None, *range(people)]), i, r.choice([None, 1, 2, 3]), r.choice([start, start, start, None]) if i % 9 == 0 else start, end))
    asks = [(i, r.choice([None, *range(people + 2)]), r.choice([None, DAY0 + timedelta(r.randrange(600))]) if i % 20 == 0 else DAY0 + timedelta(r.randrange(600))) for i in range(600)]
    return rows, asks


def frames(spark, rows, asks):
    return spark.createDataFrame(asks, "lead_id long, person_id long, contacted date"), spark.createDataFrame(rows, SPELLS)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", [{}, {"end_inclusive": False}, {"allow_gap": True}])
def test_intervals_of_overlapping_and_open_spells(spark, how):
    rows, asks = lives(1)
    left, history = frames(spark, rows, asks)
    found = joins.active_interval(left, history, "person_id", "contacted", "lead_id", tiebreak="spell_id", **how)
    want = {}
    for lead, person, at in asks:
        hits = [
            (s, k, f, e) for p, k, f, s, e in rows
            if person is not None and p == person and at and s and s <= at and (how.get("allow_gap") or e is None or e > at or (e == at and how.get("end_inclusive", True)))
        ]
        want[lead] = max(hits, key=lambda x: x[:2], default=(None,) * 4)
    got = {x.lead_id: (x.start_date, x.spell_id, x.firm_id, x.end_date) for x in found.collect()}
    assert got == want and found.columns == ["lead_id", "person_id", "contacted", "spell_id", "firm_id", "start_date", "end_date"]
    assert "Join" not in plan(found)
    assert joins.active_interval(left, history.limit(0), "person_id", "contacted", "lead_id", tiebreak="spell_id", **how).where("spell_id is null").count() == len(asks)


@pytest.mark.parametrize("months", [1, 6, 36])
def test_distinct_firms_of_a_window(spark, months):
    rows, asks = lives(2)
    rows += [(1, 900 + i, i % 3, d, None) for i, d in enumerate([date(2020, 1, 31), date(2020, 2, 29), date(2019, 2, 28), date(2020, 2, 28), date(2019, 11, 30)])]
    asks += [(1000 + i, 1, d) for i, d in enumerate([date(2020, 2, 29), date(2020, 3, 1), date(2020, 3, 31), date(2020, 3, 29), date(2020, 7, 31), date(2020, 8, 29), date(2020, 8, 31)])]
    left, history = frames(spark, rows, asks)
    found = running.distinct_before(left, history, months=months)
    got = {x.lead_id: (x.moves_3y, x.total_firms, x.career_start) for x in found.collect()}
    lows = {x.contacted: x.low for x in left.where("contacted is not null").select("contacted", F.add_months("contacted", -months).alias("low")).collect()}
    for lead, person, at in asks:
        before = [(s, f) for p, _, f, s, _ in rows if person is not None and p == person and at and s and s < at]
        recent = {f for s, f in before if f is not None and s >= lows[at]}
        assert got[lead] == (len(recent), len({f for _, f in before if f is not None}), min((s for s, _ in before), default=None)), (lead, at)
    assert "Join" not in plan(found) and "Join" not in plan(features.mobility(left, history))


def test_sums_and_numbers_before_a_question(spark):
    rows, asks = lives(3)
    left, history = frames(spark, rows, asks)
    months = lambda s, e: (e.year - s.year) * 12 + e.month - s.month
    got = {x.lead_id: (x.prior_months, x.avg_prior_months) for x in aggregates.prior_tenure(left, history).collect()}
    for lead, person, at in asks:
        past = [months(s, e) for p, _, _, s, e in rows if person is not None and p == person and at and e and e < at and s]
        assert got[lead] == (sum(past), round(sum(past) / len(past), 4) if past else None)
    for most in (None, 2):
        seq = {(x.lead_id, x.spell_id): x.job_number for x in windows.job_sequence(left, history, most=most).collect()}
        want = {}
        for lead, person, at in asks:
            jobs = sorted(((s, k) for p, k, _, s, _ in rows if person is not None and p == person and at and s and s <= at), reverse=True)
            want |= {(lead, k): i for i, (_, k) in enumerate(jobs[:most], 1)}
        assert seq == want


def test_ranks_in_groups_with_ties_across_partitions(spark):
    r = random.Random(5)
    rows = [(i, r.choice(["a", "b", None]), r.choice([None, 1.0, 2.0, 2.0, 2.0, r.random()])) for i in range(3000)] + [(9000, "one", 5.0)]
    df = spark.createDataFrame(rows, "i long, g string, v double")
    got = {x.i: (x.p, x.q) for x in windows.rank_pct(windows.pct_rank(df, ["g"], "v", "p"), ["g"], "v", "q").collect()}
    key = lambda v: (v is not None, v or 0)
    for i, g, v in rows:
        mine = [key(x) for _, h, x in rows if h == g]
        rank = sum(x < key(v) for x in mine) + 1
        assert got[i] == (pytest.approx(100 * (rank - 1) / (len(mine) - 1) if len(mine) > 1 else 0, abs=5.1e-5), pytest.approx(rank / len(mine), abs=5.1e-7))


def plain_heads(rows, resamples, top, seed):
    k, y, s = (np.array(c, float) for c in zip(*rows, strict=True))
    w = resampling.weights(k.astype(np.int64), np.arange(1, resamples + 1), seed)
    out = []
    for b in range(resamples):
        n = w[:, b].sum()
        ranked = np.sort(np.repeat(s, w[:, b]))
        cut = ranked[int(np.ceil((n - 1) * (1 - top)))]
        head = s >= cut
        out.append((n, (w[:, b] * y).sum(), w[head, b].sum(), (w[head, b] * y[head]).sum()))
    return out


def test_heads_of_resamples(spark):
    r = random.Random(6)
    for scores in ([r.random() for _ in range(700)], [r.choice([0.1, 0.5, 0.5, 0.9]) for _ in range(300)], [7.0] * 20, [-(10.0**r.randint(-8, 8)) * r.random() for _ in range(400)]):
        rows = [(i * 37, r.randint(0, 1), x) for i, x in enumerate(scores)]
        df = spark.createDataFrame(rows, "k long, y int, s double").withColumn("y", F.col("y").cast("double"))
        assert resampling.weighted_heads(df, 60, 0.1, 7) == [pytest.approx(x) for x in plain_heads(rows, 60, 0.1, 7)]
    assert bootstrap_lift(spark.createDataFrame([(1, 1, None)], "k long, y int, s double"), "y", "s", "k").first().resamples == 0


def test_bootstrap_of_a_million_continuous_scores(spark):
    df = spark.range(1_000_000).select("id", F.rand(3).alias("s")).withColumn("y", (F.rand(4) < F.col("s")).cast("int"))
    got = bootstrap_lift(df, "y", "s", "id", resamples=200).first()
    assert got.resamples == 200 and got.low < got.mid < got.high and 1.88 < got.mid < 1.92 and got.p_value == 0


def _nodes(df, name):
    return df._jdf.queryExecution().executedPlan().toString().count(name)


def test_an_event_is_not_repeated_by_month(spark):
    """Overlapping windows of one person are one; counts, and rows of months that only a person unknown fills."""
    rows = [(1, 7, "2020-01-15", "2020-03-01"), (1, 7, "2020-05-01", None), (1, 8, "2020-01-01", None), (2, None, "2020-01-01", None)]
    hist = spark.createDataFrame(rows, "firm_id int, person_id int, start_date string, end_date string").withColumns({c: F.col(c).cast("date") for c in ("start_date", "end_date")})
    flow = aggregates.rolling_flow(hist, date(2019, 1, 1), date(2022, 1, 1), 6)
    got = {(r.firm_id, str(r.month)): (r.departures, r.arrivals) for r in flow.collect()}
    want = {(1, f"2020-{m:02}-01"): (int(3 <= m <= 8), int(m <= 6) + int(2 <= m <= 10)) for m in range(1, 11)} | {(2, f"2020-{m:02}-01"): (0, 0) for m in range(1, 7)}
    assert got == want
    assert "distinct" not in flow._jdf.queryExecution().optimizedPlan().toString() and _nodes(flow, "Expand") == 0


def test_left_rows_are_read_once(spark):
    left = spark.createDataFrame([(1, 5), (1, None), (None, 5), (None, None), (2, 1)], "k int, t int")
    events = spark.createDataFrame([(1, 4, 2, 9), (1, 5, 1, 8), (2, 3, 1, 7)], "k int, _at int, n int, v int")
    got = running.sums_before(left, events, "k", "t", {"total": "n"}, {"least": "v"})
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, got.collect())) == [(-1, -1, 0, -1), (-1, 5, 0, -1), (1, -1, 0, -1), (1, 5, 2, 9), (2, 1, 0, -1)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Union") == 1


def test_headcount_has_no_table_of_days(spark):
    hist = spark.createDataFrame([(1, 7, date(2020, 1, 1), date(2020, 2, 1)), (1, 7, date(2020, 1, 15), date(2020, 1, 20)), (1, 7, date(2020, 2, 1), date(2020, 2, 9)), (1, 8, date(2020, 2, 1), None)], "firm_id int, person_id int, start_date date, end_date date")
    at = spark.createDataFrame([(1, date(2019, 12, 31)), (1, date(2020, 1, 1)), (1, date(2020, 2, 1)), (1, date(2020, 2, 9)), (1, date(2020, 2, 10))], "firm_id int, at_date date")
    heads = aggregates.headcount_at(hist, at)
    assert [r.headcount for r in heads.orderBy("at_date").collect()] == [0, 1, 2, 2, 1]
    assert "sum(step" not in "".join(line for line in heads._jdf.queryExecution().executedPlan().toString().split("\n") if "HashAggregate" in line)
