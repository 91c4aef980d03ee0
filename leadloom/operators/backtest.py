"""Backtests that tier every lead as of the start of each historic window.

A lead takes part in every window that holds its contact, once each, with the features of its
person and firm as they were on the window's first day: nothing later is seen. All features
come from time lines that are read once (`sweep`, `running`), for all windows together.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions.dates import month_diff, year_diff
from leadloom.operators.joins import active_interval
from leadloom.operators.running import distinct_before, last_day_in_window, sums_before


def in_windows(leads: DataFrame, windows: Mapping[str, tuple[date, date]], date_col: str) -> DataFrame:
    """A row for each window that holds the date, with ``window`` and its first day as ``as_of``."""
    hits = [F.when(F.col(date_col).between(F.lit(lo), F.lit(hi)), F.struct(F.lit(name).alias("window"), F.lit(lo).alias("as_of"))) for name, (lo, hi) in windows.items()]
    return leads.withColumn("_w", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull()))).select(*leads.columns, "_w.window", "_w.as_of")


def net_change(asks: DataFrame, history: DataFrame, *, firm: str, at: str, months: int = 12) -> DataFrame:
    """Asks with the arrivals less the departures of the firm in the ``months`` before the date."""
    event = lambda when, n: F.struct(when.alias("_at"), F.lit(n).alias("_net"))
    start, end = F.col("start_date"), F.col("end_date")
    changes = F.array(event(start, 1), event(last_day_in_window(start, months), -1), event(end, -1), event(last_day_in_window(end, months), 1))
    events = history.select(F.col("firm_id").alias(firm), F.explode(changes).alias("e")).select(firm, "e.*")
    return sums_before(asks, events, firm, at, {"net_change": "_net"})


def features_as_of(asks: DataFrame, history: DataFrame, *, row_key: str = "lead_id", person: str = "person_id", at: str = "as_of") -> DataFrame:
    """Asks with the firm of the day, years there, years since the first job, firms so far and the firm's net change."""
    spells = history.select(F.col("person_id").alias(person), "spell_id", F.col("firm_id").alias("firm_then"), F.col("start_date").alias("since"), F.col("end_date").alias("until"))
    now = active_interval(asks, spells, person, at, row_key, start="since", end="until", tiebreak="spell_id")
    careers = distinct_before(now, history.withColumnRenamed("person_id", person), months=36, by=person, at=at)
    flows = net_change(careers, history, firm="firm_then", at=at)
    return flows.select(
        *asks.columns, "firm_then", F.floor(month_diff(F.col(at), F.col("since")) / 12).cast("int").alias("tenure_years"),
        year_diff(F.col(at), F.col("career_start")).alias("experience_years"), F.col("total_firms").alias("prior_firms"), "net_change",
    )


def tiered(leads: DataFrame, history: DataFrame, windows: Mapping[str, tuple[date, date]], assign: Callable[[DataFrame], DataFrame], *, date_col: str = "contacted", row_key: str = "lead_id") -> DataFrame:
    """Leads in their windows with the tier that ``assign`` gives them as of the window's start."""
    return assign(features_as_of(in_windows(leads, windows, date_col), history, row_key=row_key))


def backtest(leads: DataFrame, history: DataFrame, windows: Mapping[str, tuple[date, date]], assign: Callable[[DataFrame], DataFrame], y: str, **names: str) -> DataFrame:
    """Rows, rate and lift of each tier in each window; windows may overlap."""
    g = tiered(leads, history, windows, assign, **names).groupBy("window", "tier").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("conversions"))
    w = Window.partitionBy("window")  # of a few tiers
    rate = F.col("conversions") / F.col("n")
    return g.select("*", F.round(rate, 6).alias("rate"), F.round(F.try_divide(rate, F.sum("conversions").over(w) / F.sum("n").over(w)), 4).alias("lift"))
