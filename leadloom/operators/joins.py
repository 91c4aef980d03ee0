"""Joins on keys, dates and intervals. All are equi-joins on a key first."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.operators.like import like_join
from leadloom.operators.sweep import newest_open


def assemble(spine: DataFrame, key: str | Sequence[str], *parts: DataFrame) -> DataFrame:
    """Feature tables onto a spine by one key, which all share as their partitioning."""
    return reduce(lambda a, b: a.join(b, key, "left"), parts, spine)


def join_snapshot(df: DataFrame, snapshots: DataFrame, key: str, month: str) -> DataFrame:
    return df.join(snapshots, [key, month], "left")


def prefer(history: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """The history's row where there is one, else the current one; other columns must agree."""
    cols = [c for c in history.columns if c != key]
    old, new = history.withColumn("_in", F.lit(1)).alias("h"), current.alias("c")
    joined = old.join(new, key, "full")
    source = F.when(F.col("h._in").isNotNull(), "history").otherwise("current")
    picked = [F.when(F.col("h._in").isNotNull(), F.col(f"h.{c}")).otherwise(F.col(f"c.{c}")).alias(c) for c in cols]
    return joined.select(key, *picked, source.alias("source"))


def asof_join(left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str, *, strict: bool = False, cols: Sequence[str] | None = None) -> DataFrame:
    """The newest right row at or before (strict: before) each left row, of the same key.

    Both sides are united and sorted once by key and time; a running ``last`` carries
    the newest right row along, so no pairs are formed and one shuffle is enough. Of
    right rows with one time the greatest is taken.
    """
    cols = list(cols or [c for c in right.columns if c not in (by, right_ts)])
    row = F.struct(F.col(right_ts), *[F.col(c) for c in cols])
    facts = right.where(F.col(right_ts).isNotNull()).groupBy(by, F.col(right_ts).alias("_ts")).agg(F.max(row).alias("_right"))
    ask = left.select(F.col(by), F.col(left_ts).alias("_ts"), F.struct(*[F.col(c) for c in left.columns]).alias("_left"))
    both = facts.unionByName(ask, allowMissingColumns=True)
    is_left = F.col("_left").isNotNull()
    turn = F.when(is_left, 0).otherwise(1) if strict else F.when(is_left, 1).otherwise(0)
    w = Window.partitionBy(by).orderBy("_ts", turn).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_right", F.last("_right", ignorenulls=True).over(w)).where("_left is not null")
    return found.select("_left.*", *[F.col("_right")[c].alias(c) for c in [right_ts, *cols]])


def active_interval(left: DataFrame, history: DataFrame, by: str, at: str, row_key: str, *, start: str = "start_date", end: str = "end_date", end_inclusive: bool = True, allow_gap: bool = False, tiebreak: str) -> DataFrame:
    """Each left row with the interval that holds its date; the newest start wins.

    With ``allow_gap`` the latest start at or before the date counts even if the
    interval has ended. An open end is null. Left rows without one keep nulls.

    No pairs are formed: starts and questions of a key are read in the order of time
    (`sweep`), or, with ``allow_gap``, the newest start is carried along (`asof_join`).
    """
    cols = [c for c in history.columns if c != by]
    asked = F.col(by).isNotNull() & F.col(at).isNotNull()
    rest = left.where(~asked).select(*left.columns, *[F.lit(None).cast(history.schema[c].dataType).alias(c) for c in cols])
    if allow_gap:
        found = asof_join(left.where(asked), history, by, at, start, cols=[tiebreak, *[c for c in cols if c not in (start, tiebreak)]])
    else:
        found = newest_open(left.where(asked), history, by, at, start=start, end=end, end_inclusive=end_inclusive, tiebreak=tiebreak)
    return found.select(*left.columns, *cols).unionByName(rest)


def range_join(left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str, lo: int, hi: int, how: str = "inner") -> DataFrame:
    """Right rows from ``lo`` to ``hi`` days after the left row, of the same key."""
    r = right.select(F.col(by).alias("_by"), *[c for c in right.columns if c != by])
    gap = F.datediff(F.col(right_ts), left[left_ts])
    return left.join(r, (left[by] == F.col("_by")) & gap.between(lo, hi), how).drop("_by")


def lookback(left: DataFrame, facts: DataFrame, by: str, left_ts: str, fact_ts: str, months: int) -> DataFrame:
    """Facts of the same key in the ``months`` before the left date, the date itself left out."""
    f = facts.select(F.col(by).alias("_by"), *[c for c in facts.columns if c != by])
    on = (left[by] == F.col("_by")) & (F.col(fact_ts) < left[left_ts]) & (F.col(fact_ts) >= F.add_months(left[left_ts], -months))
    return left.join(f, on).drop("_by")


def join_any_key(df: DataFrame, fks: Sequence[str], other: DataFrame, key: str, row_key: str) -> DataFrame:
    """Match any of several foreign keys: exploded to rows, then one equi-join; each pair once."""
    keys = df.select(row_key, F.explode(F.array_distinct(F.array(*fks))).alias(key)).where(F.col(key).isNotNull())
    return keys.join(other, key)


def with_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """A one-row table of parameters beside every row; the row is cut to one before it is sent out."""
    return df.crossJoin(F.broadcast(one_row.limit(1)))


def spine_product(keys: DataFrame, months: DataFrame) -> DataFrame:
    """Every key with every month: the months, a bounded calendar, travel to the keys."""
    spine = months.agg(F.array_sort(F.collect_set("month")).alias("_months"))
    return with_scalar(keys, spine).select(*keys.columns, F.explode("_months").alias("month"))


def semi(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_semi")


def anti(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def not_exists_like(df: DataFrame, patterns: DataFrame, col: str, pattern: str) -> DataFrame:
    return like_join(df, patterns, col, pattern, "left_anti")


def self_lag_join(snapshots: DataFrame, key: str, month: str, months: int, cols: Sequence[str]) -> DataFrame:
    """The same key ``months`` earlier, by the calendar: missing months give null, not a neighbour."""
    old = snapshots.select(key, F.add_months(month, months).cast("date").alias(month), *[F.col(c).alias(f"{c}_prev") for c in cols])
    return snapshots.join(old, [key, month], "left")


def merge_report(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How many keys both sides, the left or the right alone hold."""
    left, right = a.select(key).distinct().withColumn("_l", F.lit(1)), b.select(key).distinct().withColumn("_r", F.lit(1))
    side = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("both")
    return left.join(right, key, "full").groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


def with_lookup(df: DataFrame, agg: DataFrame, key: str, fill: dict) -> DataFrame:
    """A correlated scalar as an aggregate joined on its key; ``fill`` is its value where nothing matches."""
    return df.join(agg, key, "left").fillna(fill)


def with_overall(df: DataFrame, **aggs: Column) -> DataFrame:
    """Aggregates of all rows beside every row."""
    return with_scalar(df, df.agg(*[c.alias(name) for name, c in aggs.items()]))
