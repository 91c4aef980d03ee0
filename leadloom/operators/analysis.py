"""Analyses of moves, events, cohorts, pools and periods."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import has_word


def moved_after_contact(leads: DataFrame, history: DataFrame) -> DataFrame:
    """The first move after contact and its timing class."""
    h = history.select(F.col("person_id").alias("_p"), F.col("start_date").alias("_s"))
    moves = leads.join(h, (F.col("person_id") == F.col("_p")) & (F.col("_s") > F.col("contacted"))).groupBy("lead_id").agg(F.min("_s").alias("moved"))
    days = F.datediff("moved", "contacted")
    kind = F.when(days.isNull(), "stayed").when(days <= 90, "within 90 days").when(days <= 365, "within a year").otherwise("later")
    return leads.join(moves, "lead_id", "left").select("lead_id", "contacted", "moved", days.alias("days"), kind.alias("timing"))


def event_study(events: DataFrame, history: DataFrame) -> DataFrame:
    """Departures 0-30, 31-60 and 61-90 days after a firm's event, and in the 180 days before."""
    h = history.where("end_date is not null").select(F.col("firm_id").alias("_f"), "person_id", "end_date")
    gap = F.datediff("end_date", "event_date")
    rows = events.join(h, (F.col("firm_id") == F.col("_f")) & gap.between(-180, 90), "left")
    n = lambda lo, hi: F.countDistinct(F.when(gap.between(lo, hi), F.col("person_id")))
    return rows.groupBy("firm_id", "event_date").agg(n(0, 30).alias("d0_30"), n(31, 60).alias("d31_60"), n(61, 90).alias("d61_90"), n(-180, -1).alias("baseline_180"))


def classify_text(df: DataFrame, col: str, rules: Mapping[str, Sequence[str]], other: str = "other", out: str = "label") -> DataFrame:
    """The first class one of whose words occurs."""
    label = F.lit(other)
    for name, words in reversed(rules.items()):
        label = F.when(has_word(F.col(col), words), name).otherwise(label)
    return df.withColumn(out, label)


def inflow(history: DataFrame, lo: int = 12, hi: int = 24) -> DataFrame:
    """By month: spells that reach ``lo`` months (enter the zone) and ``hi`` months (leave it)."""
    starts = history.groupBy(F.trunc("start_date", "MM").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    at = lambda k, name: starts.select(F.add_months("m", k).cast("date").alias("month"), F.col("n").alias(name))
    return at(lo, "entries").join(at(hi, "exits"), "month", "full").fillna(0, ["entries", "exits"])


def repeat_flag(df: DataFrame, key: str, date_col: str, tiebreak: str) -> DataFrame:
    """Whether the same person was contacted before."""
    first = df.groupBy(key).agg(F.min(F.struct(date_col, tiebreak)).alias("_f"))
    return df.join(first, key).withColumn("is_repeat", (F.col("_f")[tiebreak] != F.col(tiebreak)).cast("int")).drop("_f")


def depletion(pool: DataFrame, usage: DataFrame, by: str) -> DataFrame:
    """Months that a pool lasts at its mean monthly use, with a status."""
    size = pool.groupBy(by).agg(F.count(F.lit(1)).alias("pool"))
    months = usage.groupBy(by, "month").agg(F.count(F.lit(1)).alias("n")).groupBy(by).agg(F.avg("n").alias("per_month"))
    left = F.round(F.try_divide(F.col("pool").cast("double"), F.col("per_month")), 4)
    status = F.when(left.isNull(), "unused").when(left < 3, "critical").when(left < 12, "watch").otherwise("ok")
    return size.join(months, by, "left").select(by, "pool", F.round("per_month", 4).alias("per_month"), left.alias("months_left"), status.alias("status"))


def disagreement(df: DataFrame, high: Column, score: str, target: str, cut: float = 0.2) -> DataFrame:
    """Rows where rules and model differ, with their rates."""
    kind = F.when(high & (F.col(score) <= cut), "high tier, low score").when(~high & (F.col(score) >= 1 - cut), "low tier, high score").otherwise("agree")
    return df.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(target), 6).alias("rate"))


def compare_periods(df: DataFrame, by: str, date_col: str, cut: date) -> DataFrame:
    """Counts and shares by group before and from a date."""
    late = F.col(date_col) >= F.lit(cut)
    groups = df.groupBy(by).agg(F.count_if(~late).alias("before"), F.count_if(late).alias("after"))
    total = groups.agg(F.sum("before").alias("b"), F.sum("after").alias("a"))
    joined = groups.crossJoin(F.broadcast(total.limit(1)))
    part = lambda x, y: F.round(F.try_divide(100.0 * F.col(x), F.col(y).cast("double")), 4)
    return joined.select(by, "before", "after", part("before", "b").alias("before_pct"), part("after", "a").alias("after_pct"))
