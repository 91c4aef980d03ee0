"""Aggregates: firm flows, careers, conditional counts, reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions.numbers import clamp, safe_div
from leadloom.operators.running import sums_before
from leadloom.operators.windows import quantile_values


def headcount(people: DataFrame, firm: str, person: str, min_reps: int = 1) -> DataFrame:
    return people.groupBy(firm).agg(F.countDistinct(person).alias("headcount")).where(F.col("headcount") >= min_reps)


def _trailing(history: DataFrame, col: str, as_of: date, months: int, lo_inclusive: bool, hi_inclusive: bool) -> DataFrame:
    lo, d = F.add_months(F.lit(as_of), -months), F.col(col)
    return history.where(((d >= lo) if lo_inclusive else (d > lo)) & ((d <= F.lit(as_of)) if hi_inclusive else (d < F.lit(as_of))))


def departures(history: DataFrame, as_of: date, months: int = 12, *, firm: str = "firm_id", person: str = "person_id", end: str = "end_date", lo_inclusive: bool = False, hi_inclusive: bool = True) -> DataFrame:
    """People who left each firm in the trailing window, by default (as_of - months, as_of]."""
    rows = _trailing(history, end, as_of, months, lo_inclusive, hi_inclusive)
    return rows.groupBy(firm).agg(F.countDistinct(person).alias("departures"))


def arrivals(history: DataFrame, as_of: date, months: int = 12, *, firm: str = "firm_id", person: str = "person_id", start: str = "start_date", lo_inclusive: bool = False, hi_inclusive: bool = True) -> DataFrame:
    rows = _trailing(history, start, as_of, months, lo_inclusive, hi_inclusive)
    return rows.groupBy(firm).agg(F.countDistinct(person).alias("arrivals"))


def rolling_flow(history: DataFrame, lo: date, hi: date, months: int = 12, *, firm: str = "firm_id", person: str = "person_id", start: str = "start_date", end: str = "end_date") -> DataFrame:
    """Departures and arrivals of the trailing ``months`` for every firm and month from lo to hi.

    An event counts for exactly the ``months`` month starts from the first one at or after it. A
    person's windows that overlap count once: each begins where the one before ends. So the counts
    are running sums of ones that come and go; no event is repeated by month, no calendar is
    crossed in, and a firm's sums have a row a month at most.
    """
    number = lambda d: F.year(d) * 12 + F.month(d) - 1
    first = lambda c: number(F.col(c)) + (F.col(c) != F.trunc(c, "MM")).cast("int")
    event = lambda c, gone: F.struct(first(c).alias("m"), F.lit(gone).alias("gone"))
    events = history.select(F.col(firm).alias("f"), F.col(person).alias("p"), F.explode(F.array(event(end, True), event(start, False))).alias("e")).select("f", "p", "e.*").where("m is not null")
    before = F.lag("m").over(Window.partitionBy("f", "p", "gone").orderBy("m"))
    own = events.select("f", "p", "gone", F.greatest("m", before + months).alias("lo"), (F.col("m") + months).alias("hi")).where("lo < hi")
    change = lambda c, n: F.struct(F.col(c).alias("m"), F.lit(n).alias("n"))
    changes = own.select("f", "p", "gone", F.explode(F.array(change("lo", 1), change("hi", -1))).alias("c")).select("f", "c.*", (F.col("p").isNotNull() & F.col("gone")).alias("d"), (F.col("p").isNotNull() & ~F.col("gone")).alias("a"))
    one = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0))
    by_month = changes.groupBy("f", "m").agg(one("d").alias("d"), one("a").alias("a"), F.sum("n").alias("n"))
    w = Window.partitionBy("f").orderBy("m")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    sums = by_month.select("f", "m", F.lead("m").over(w).alias("next"), *[F.sum(c).over(run).alias(c) for c in "dan"]).where("n > 0")  # a window is open
    begin, last = F.greatest("m", number(F.lit(lo))), F.least(F.col("next") - 1, number(F.lit(hi)))
    months_of = sums.withColumns({"_lo": begin, "_hi": last}).where("_lo <= _hi").withColumn("m", F.explode(F.sequence("_lo", "_hi")))
    month = F.make_date((F.floor(F.col("m") / 12)).cast("int"), F.col("m") % 12 + 1, F.lit(1))
    return months_of.select(F.col("f").alias(firm), month.alias("month"), F.col("d").alias("departures"), F.col("a").alias("arrivals"))


def net_flow(heads: DataFrame, gone: DataFrame, come: DataFrame, firm: str = "firm_id") -> DataFrame:
    joined = heads.join(gone, firm, "left").join(come, firm, "left").fillna({"departures": 0, "arrivals": 0})
    net = F.col("arrivals") - F.col("departures")
    return joined.select(
        "*",
        net.alias("net_change"),
        F.round(100 * safe_div(F.col("departures"), F.col("headcount")), 2).alias("turnover_pct"),
        clamp(50 + 3.5 * net, 0.0, 100.0).alias("stability_score"),
    )


def headcount_at(history: DataFrame, at: DataFrame, *, firm: str = "firm_id", date_col: str = "at_date", person: str = "person_id", start: str = "start_date", end: str = "end_date") -> DataFrame:
    """Distinct people active at each firm's date of ``at`` (firm, date).

    A person's overlapping spells at a firm count once: each begins behind the last day reached by
    those before, or not at all. The count at a date is then the starts so far less the ends before
    it: one sorted pass, no pairs of dates and spells, nothing held but the sum.
    """
    never = F.lit("9999-12-31").cast("date")
    h = history.where(F.col(firm).isNotNull() & F.col(start).isNotNull() & F.col(person).isNotNull()).select(F.col(firm).alias("f"), F.col(person).alias("p"), F.col(start).alias("s"), F.coalesce(F.col(end), never).alias("e"))
    reached = F.max("e").over(Window.partitionBy("f", "p").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1))
    own = h.where("e >= s").select("f", "e", F.greatest("s", F.when(reached < never, F.date_add(reached, 1)).otherwise(reached)).alias("s"), reached.alias("r")).where("r is null or e > r")
    event = lambda when, step, asked=False: F.struct(when.alias("d"), F.lit(step).cast("long").alias("step"), F.lit(asked).alias("asked"))
    changes = F.array(event(F.col("s"), 1), F.when(F.col("e") < never, event(F.date_add("e", 1), -1)))
    asked = at.select(F.col(firm).alias("f"), event(F.col(date_col), 0, True).alias("c")).distinct()
    events = own.select("f", F.explode(changes).alias("c")).where("c is not null").unionByName(asked).select("f", "c.*")
    so_far = F.sum("step").over(Window.partitionBy("f").orderBy(F.col("d").asc_nulls_last(), "asked").rowsBetween(Window.unboundedPreceding, 0))
    run = events.withColumn("headcount", so_far)
    return run.where("asked").select(F.col("f").alias(firm), F.col("d").alias(date_col), "headcount")


def count_distinct_if(cond: Column, col: Column) -> Column:
    return F.countDistinct(F.when(cond, col))


def career(history: DataFrame, as_of: date, *, person: str = "person_id", firm: str = "firm_id", start: str = "start_date") -> DataFrame:
    seen = history.where(F.col(start) <= F.lit(as_of))
    recent = F.col(start) >= F.add_months(F.lit(as_of), -36)
    return seen.groupBy(person).agg(
        F.countDistinct(firm).alias("firm_count"), count_distinct_if(recent, F.col(firm)).alias("moves_3y"), F.min(start).alias("career_start")
    )


def prior_tenure(leads: DataFrame, history: DataFrame, *, by: str = "person_id", at: str = "contacted", row_key: str = "lead_id", start: str = "start_date", end: str = "end_date") -> DataFrame:
    """Months in spells that ended before the anchor: sum and mean; none gives 0 and null."""
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    ended = history.select(F.col(by), F.col(end).alias("_at"), months.alias("_months"), months.isNotNull().cast("int").alias("_n"))
    found = sums_before(leads, ended, by, at, {"prior_months": "_months", "_spells": "_n"})
    mean = F.when(F.col("_spells") > 0, F.round(F.col("prior_months") / F.col("_spells"), 4))
    return found.withColumn("avg_prior_months", mean).drop("_spells")


def pivot_by_rank(df: DataFrame, key: str, rank: str, cols: Sequence[str], k: int) -> DataFrame:
    """Values of ranks 1 to k beside one another."""
    return df.groupBy(key).agg(*[F.max(F.when(F.col(rank) == i, F.col(c))).alias(f"{c}_{i}") for c in cols for i in range(1, k + 1)])


def latest(df: DataFrame, key: str, order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """``cols`` of the newest row of each key by ``order``, which must be total."""
    row = F.struct(*dict.fromkeys([*order, *cols]))
    return df.groupBy(key).agg(F.max(row).alias("_r")).select(key, *[F.col("_r")[c].alias(c) for c in cols])


def first_event(df: DataFrame, key: str, order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    names = list(dict.fromkeys([*order, *cols]))
    return df.groupBy(key).agg(F.min(F.struct(*names)).alias("_r")).select(key, *[F.col("_r")[c].alias(c) for c in names])


def last_activity(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """The newest of several dates; nulls are skipped."""
    return df.groupBy(key).agg(F.max(F.greatest(*cols) if len(cols) > 1 else F.col(cols[0])).alias("last_activity"))


def first_contact(df: DataFrame, key: str, col: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(col).alias("first_contact"))


def rollup(df: DataFrame, key: str, numeric: Sequence[str], distinct: Sequence[str], flags: Mapping[str, Column]) -> DataFrame:
    """Sum, mean, extremes and deviation of each measure, distinct counts and shares, in one aggregate."""
    out = [F.count(F.lit(1)).alias("n")]
    for c in numeric:
        out += [F.round(f(c), 4).alias(f"{name}_{c}") for name, f in (("sum", F.sum), ("avg", F.avg), ("min", F.min), ("max", F.max), ("stddev", F.stddev_samp))]
    out += [F.countDistinct(c).alias(f"n_{c}") for c in distinct]
    out += [F.round(F.avg(cond.cast("double")), 6).alias(f"share_{name}") for name, cond in flags.items()]
    return df.groupBy(key).agg(*out)


def mode_value(df: DataFrame, key: str, col: str) -> DataFrame:
    """The most frequent value; of equals the smallest."""
    counts = df.groupBy(key, col).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), F.col(col).asc_nulls_last())
    return counts.withColumn("_k", F.row_number().over(w)).where("_k = 1").select(key, F.col(col).alias(f"top_{col}"), "n")


def ratios(df: DataFrame, parts: Sequence[str], whole: str, focus: float = 0.5) -> DataFrame:
    share = {p: F.round(safe_div(F.col(p), F.col(whole)), 6) for p in parts}
    return df.select(
        "*",
        *[c.alias(f"{p}_ratio") for p, c in share.items()],
        *[F.coalesce(c >= focus, F.lit(False)).cast("int").alias(f"{p}_focus") for p, c in share.items()],
    )


#: Size of a quantile sketch: ranks are off by less than 1 % with a probability of 99 %.
SKETCH_SIZE = 800


def quantile_sketches(df: DataFrame, col: str, groups: Sequence[str], size: int = SKETCH_SIZE) -> DataFrame:
    """A KLL sketch of the values of each group, to be kept (say, by month) and merged later."""
    return df.where(F.col(col).isNotNull()).groupBy(*groups).agg(F.kll_sketch_agg_double(F.col(col).cast("double"), size).alias("sketch"))


def merged_sketches(sketches: DataFrame, groups: Sequence[str] = (), size: int = SKETCH_SIZE) -> DataFrame:
    """Sketches of coarser groups, from those of finer ones, in any order."""
    return sketches.groupBy(*groups).agg(F.kll_merge_agg_double("sketch", size).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, probs: Mapping[str, float]) -> DataFrame:
    """Approximate quantiles under their names, and the number of values; `quantiles` has the exact ones."""
    rest = [c for c in sketches.columns if c != "sketch"]
    return sketches.select(*rest, F.kll_sketch_get_n_double("sketch").alias("n"), *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(name) for name, p in probs.items()])


def quantiles(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = (), *, exact: bool = True) -> DataFrame:
    names = {f"p{round(100 * p)}": p for p in probs}
    if exact:
        return quantile_values(df, col, names, by)
    return df.groupBy(*by).agg(*[F.percentile_approx(col, p).alias(name) for name, p in names.items()])


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Correlations of all pairs, one row a pair, from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"r{i}"), 6).alias("r")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def share(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts and their share of all, in percent. The window spans the groups only."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def rate_report(df: DataFrame, by: Sequence[str], target: str) -> DataFrame:
    """Rows, conversions, rate and lift over the overall rate by group."""
    groups = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("conversions"))
    every = Window.partitionBy()
    rate = F.col("conversions") / F.col("n")
    overall = F.sum("conversions").over(every) / F.sum("n").over(every)
    return groups.select("*", F.round(100 * rate, 4).alias("rate_pct"), F.round(safe_div(rate, overall), 4).alias("lift"))


def rate_crosstab(df: DataFrame, a: str, b: str, target: str, values: Sequence) -> DataFrame:
    """Rates of a by the listed values of b."""
    return df.groupBy(a).agg(*[F.round(F.avg(F.when(F.col(b) == v, F.col(target))), 6).alias(f"rate_{v}") for v in values])


def segment_report(df: DataFrame, segments: Mapping[str, Column], target: str) -> DataFrame:
    """One row for each labelled subset; a row in several subsets counts in each. Read once."""
    labels = F.filter(F.array(*[F.when(cond, F.lit(label)) for label, cond in segments.items()]), lambda x: x.isNotNull())
    return (
        df.withColumn("segment", F.explode(labels))
        .groupBy("segment")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("conversions"), F.round(100 * F.avg(target), 4).alias("rate_pct"))
    )


def extremes(df: DataFrame, cols: Sequence[str], lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Fences, share of zeros and nulls, and rows beyond the fences, one row a column."""
    values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in cols])).alias("x")).select("x.*")
    found = {r["c"]: (r["lo"], r["hi"]) for r in quantile_values(values, "v", {"lo": lo, "hi": hi}, ["c"]).collect()}  # a row a column
    fences = {c: found.get(c, (None, None)) for c in cols}
    stats = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.round(F.lit(fences[c][0]), 4).alias("low"),
                F.round(F.lit(fences[c][1]), 4).alias("high"),
                F.count_if((F.col(c) < fences[c][0]) | (F.col(c) > fences[c][1])).alias("beyond"),
                F.round(F.count_if(F.col(c) == 0) / F.count(F.lit(1)), 6).alias("zero_share"),
                F.round(F.count_if(F.col(c).isNull()) / F.count(F.lit(1)), 6).alias("null_share"),
            ).alias(f"s{i}")
            for i, c in enumerate(cols)
        ],
    )
    return stats.select("n", F.explode(F.array(*[f"s{i}" for i in range(len(cols))])).alias("s")).select("n", "s.*")
