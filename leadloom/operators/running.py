"""Counts and sums before a question, as running sums over events: no pairs of questions and facts.

Facts become events that add to a sum from some day on; questions are put among them in the
order of time, and read the sum of the events before. One shuffle by key and one sort.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sums_before(left: DataFrame, events: DataFrame, by: str, at: str, sums: Mapping[str, str], firsts: Mapping[str, str] = {}) -> DataFrame:
    """Left rows with sums of event columns (null counts nothing, none is 0), and least values of others, over
    the events of the key (``by``, ``_at``) that lie before the left date. Rows without key or date have none:
    they are dealt out by a hash of their columns, where no event is, so the left rows are read once."""
    asked = F.col(by).isNotNull() & F.col(at).isNotNull()
    plain = [c for c, kind in left.dtypes if "map<" not in kind]
    marks = events.where(F.col(by).isNotNull() & F.col("_at").isNotNull()).select(by, "_at", *{*sums.values(), *firsts.values()}, F.lit(None).cast("bigint").alias("_apart"))
    ask = left.select(by, F.col(at).alias("_at"), F.when(~asked, F.xxhash64(*plain)).alias("_apart"), F.struct(*left.columns).alias("_left"))
    both = marks.unionByName(ask, allowMissingColumns=True)
    w = Window.partitionBy(by, "_apart").orderBy("_at", F.when(F.col("_left").isNotNull(), 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    found = {out: F.coalesce(F.sum(c).over(w), F.lit(0)) for out, c in sums.items()} | {out: F.min(c).over(w) for out, c in firsts.items()}
    return both.select("_left", *[c.alias(out) for out, c in found.items()]).where("_left is not null").select("_left.*", *found)


def last_day_in_window(day: Column, months: int) -> Column:
    """The last date whose window, from ``months`` before it on, still holds the day."""
    later = F.add_months(day, months)
    return F.when(day == F.last_day(day), F.last_day(later)).otherwise(later)


def distinct_before(leads: DataFrame, history: DataFrame, *, months: int, by: str = "person_id", at: str = "contacted", value: str = "firm_id", day: str = "start_date") -> DataFrame:
    """Leads with the distinct firms of the ``months`` before (moves_3y), of all time before
    (total_firms), and the first start (career_start).

    A start counts from the day after it to the last date whose window holds it. Of two starts one
    after the other in one firm, one is taken off again as long as the window holds both. So the
    distinct count is a running sum of ones that come and go.
    """
    starts = history.select(by, F.col(day).cast("date").alias("_s"), F.col(value).alias("_v"))
    known = starts.where("_v is not null").withColumn("_p", F.lag("_s").over(Window.partitionBy(by, "_v").orderBy("_s")))
    leaves, leaves_before = last_day_in_window(F.col("_s"), months), last_day_in_window(F.col("_p"), months)
    event = lambda when, window, total: F.struct(when.alias("_at"), F.lit(window).alias("_window"), F.lit(total).alias("_total"), F.lit(None).cast("date").alias("_first"))
    is_first = F.col("_p").isNull()
    both = F.coalesce(leaves_before > F.col("_s"), F.lit(False))
    changes = F.concat(
        F.array(F.when(is_first, event(F.col("_s"), 1, 1)).otherwise(event(F.col("_s"), 1, 0)), event(leaves, -1, 0)),
        F.when(both, F.array(event(F.col("_s"), -1, 0), event(leaves_before, 1, 0))).otherwise(F.array().cast("array<struct<_at:date,_window:int,_total:int,_first:date>>")),
    )
    events = known.select(by, F.explode(changes).alias("e")).select(by, "e.*").unionByName(
        starts.select(by, F.col("_s").alias("_at"), F.lit(0).alias("_window"), F.lit(0).alias("_total"), F.col("_s").alias("_first"))
    )
    return sums_before(leads, events, by, at, {"moves_3y": "_window", "total_firms": "_total"}, {"career_start": "_first"})
