"""Targets and point-in-time features. Every function takes the date it looks from."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.dates import month_diff, year_diff
from leadloom.functions.numbers import AUM_TIERS, TENURE_MONTHS, bucketise, clamp, experience_bucket, log1, safe_div
from leadloom.functions.text import json_list
from leadloom.operators.aggregates import pivot_by_rank
from leadloom.operators.joins import active_interval, asof_join, lookback
from leadloom.operators.running import distinct_before
from leadloom.operators.windows import quantile_values
from leadloom.sources.shared import written

# ---- targets


def target(as_of: date, n: int, late: str = "negative", *, contacted: str = "contacted", converted: str = "converted") -> Column:
    """1 if converted within n days of contact, null while the window is open, else 0.

    A conversion after the window is 0 ('negative') or null ('null'); one before the
    contact is no conversion of it.
    """
    gap = F.datediff(converted, contacted)
    out = F.when(F.datediff(F.lit(as_of), contacted) < n, F.lit(None).cast("int")).when(gap.between(0, n), 1)
    if late == "null":
        out = out.when(gap > n, F.lit(None).cast("int"))
    return out.otherwise(0)


def timing(leads: DataFrame, probs: Sequence[float] = (0.5, 0.9, 0.95)) -> DataFrame:
    """Quantiles of the days to conversion; the p90 serves as the window."""
    gaps = leads.where("converted is not null").select(F.datediff("converted", "contacted").alias("gap"))
    names = {f"p{round(100 * p)}": p for p in probs}
    both = gaps.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("gap"), 4).alias("mean_days")).crossJoin(F.broadcast(quantile_values(gaps, "gap", names).limit(1)))
    return both.select("n", *names, "mean_days")


def censor_report(leads: DataFrame, as_of: date, n: int) -> DataFrame:
    label = F.when(F.datediff(F.lit(as_of), "contacted") < n, "censored").otherwise("mature")
    hit = F.coalesce(F.datediff("converted", "contacted").between(0, n), F.lit(False))
    return leads.groupBy(label.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("conversions"), F.round(100 * F.avg(hit.cast("int")), 4).alias("rate_pct"))


# ---- people


def mobility(leads: DataFrame, history: DataFrame, *, months: int = 36) -> DataFrame:
    """Moves in the months before contact, all moves, a tier and moves over the mean pace."""
    out = distinct_before(leads, history, months=months)
    years = F.greatest(year_diff(F.col("contacted"), F.col("career_start")), F.lit(1))
    return out.select(
        "*",
        F.when(F.col("moves_3y") >= 3, "HIGH").when(F.col("moves_3y") == 2, "MEDIUM").when(F.col("moves_3y") == 1, "LOW").otherwise("STABLE").alias("mobility_tier"),
        F.round(safe_div(F.col("moves_3y") / 3, F.col("total_firms") / years), 6).alias("restlessness"),
    )


def flight_risk(df: DataFrame) -> DataFrame:
    """Clipped restlessness, moves against the firm's net change, and a fresh start."""
    return df.select(
        "*",
        clamp(F.coalesce("restlessness", F.lit(0.0)), 0.0, 3.0).alias("restlessness_clipped"),
        (F.col("moves_3y") * F.greatest(-F.col("net_change"), F.lit(0))).alias("flight_risk"),
        F.coalesce(F.col("tenure_months") < 12, F.lit(False)).cast("int").alias("fresh_start"),
    )


def tenure(leads: DataFrame, history: DataFrame, *, end_inclusive: bool = True) -> DataFrame:
    """The firm at contact, months there with their bucket, and years since the first job."""
    now = active_interval(leads, history.select("person_id", "spell_id", "firm_id", "start_date", "end_date"), "person_id", "contacted", "lead_id", end_inclusive=end_inclusive, tiebreak="spell_id")
    first = history.groupBy("person_id").agg(F.min("start_date").alias("career_start"))
    months = month_diff(F.col("contacted"), F.col("start_date"))
    years = F.greatest(year_diff(F.col("contacted"), F.col("career_start")), F.lit(0))
    return now.join(first, "person_id", "left").select(
        *now.columns, months.alias("tenure_months"), bucketise(months, *TENURE_MONTHS).alias("tenure_bucket"), years.alias("experience_years"), experience_bucket(years).alias("experience_bucket")
    )


def velocity(jobs: DataFrame) -> DataFrame:
    """From numbered jobs: days since the move, days in the job before, their ratio, danger zone."""
    starts = pivot_by_rank(jobs, "lead_id", "job_number", ["start_date"], 2)
    anchor = jobs.groupBy("lead_id").agg(F.max("contacted").alias("contacted"))
    since, before = F.datediff("contacted", "start_date_1"), F.datediff("start_date_1", "start_date_2")
    return anchor.join(starts, "lead_id").select(
        "lead_id",
        since.alias("days_since_move"),
        before.alias("previous_days"),
        F.round(safe_div(since, before), 6).alias("tenure_ratio"),
        F.coalesce(since.between(365, 730), F.lit(False)).cast("int").alias("danger_zone"),
    )


def dated_counts(leads: DataFrame, facts: DataFrame, *, kind: str, kinds: Sequence[str], fact_date: str, months: int, recent_months: int = 12, prefix: str) -> DataFrame:
    """Facts before contact by kind, and whether any is recent. Counts the fact's own key, so none gives 0."""
    rows = lookback(leads.select("lead_id", "person_id", "contacted"), facts.select("person_id", F.col(fact_date).alias("_d"), F.col(kind).alias("_kind")), "person_id", "contacted", "_d", months)
    recent = F.max((F.col("_d") >= F.add_months("contacted", -recent_months)).cast("int"))
    counts = rows.groupBy("lead_id").agg(
        F.count("_d").alias(f"{prefix}_count"), *[F.count_if(F.col("_kind") == k).alias(f"{prefix}_{i}") for i, k in enumerate(kinds)], recent.alias(f"{prefix}_recent")
    )
    names = [f"{prefix}_count", *[f"{prefix}_{i}" for i in range(len(kinds))], f"{prefix}_recent"]
    return leads.select("lead_id").join(counts, "lead_id", "left").fillna(0, names)


def licences(df: DataFrame, col: str = "licences") -> DataFrame:
    items = json_list(F.col(col))
    return df.select(
        "*", F.size(items).alias("licence_count"), F.array_contains(items, "Series 7").cast("int").alias("series_7"), F.array_contains(items, "Series 65").cast("int").alias("series_65")
    )


def states(leads: DataFrame, registrations: DataFrame) -> DataFrame:
    """Distinct states registered in by the date."""
    r = registrations.select(F.col("person_id").alias("_p"), "state", "since")
    rows = leads.join(r, (F.col("person_id") == F.col("_p")) & (F.col("since") <= F.col("contacted")))
    counts = rows.groupBy("lead_id").agg(F.countDistinct("state").alias("states_registered"))
    return leads.select("lead_id").join(counts, "lead_id", "left").fillna({"states_registered": 0})


def maturity_flags(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        F.coalesce(F.col("experience_years") >= 4, F.lit(False)).cast("int").alias("is_veteran"),
        F.coalesce(F.col("tenure_months") < 12, F.lit(False)).cast("int").alias("is_new_to_firm"),
        F.coalesce((F.col("experience_years") >= 4) & (F.col("tenure_months") < 12), F.lit(False)).cast("int").alias("maturity_mismatch"),
    )


# ---- firms


# Priorities and tiers of the stability measure.
def priority(percentile: Column, net: Column) -> Column:
    return F.when(percentile <= 10, "HIGH").when(percentile <= 25, "MEDIUM").when(net < 0, "MONITOR").otherwise("STABLE")


def stability_tier(net: Column) -> Column:
    return F.when(net <= -14, "severe").when(net <= -3, "moderate").when(net < 0, "slight").when(net == 0, "stable").otherwise("growing")


def firm_stability(net: DataFrame, part: Sequence[str]) -> DataFrame:
    """Percentile of the net change among the rows of a part (a month), priority and tier."""
    from leadloom.operators.windows import pct_rank

    ranked = pct_rank(written(net, "net"), part, "net_change", "net_percentile")  # read twice
    return ranked.select("*", priority(F.col("net_percentile"), F.col("net_change")).alias("priority"), stability_tier(F.col("net_change")).alias("stability_tier"))


def firm_pit(df: DataFrame, snapshots: DataFrame, *, month: str = "month") -> DataFrame:
    """Assets at the month and a year before: growth, tier and logarithm."""
    now = snapshots.select("firm_id", month, F.col("aum").alias("firm_aum"))
    old = snapshots.select("firm_id", F.add_months(month, 12).cast("date").alias(month), F.col("aum").alias("aum_12m"))
    out = df.join(now, ["firm_id", month], "left").join(old, ["firm_id", month], "left")
    return out.select(
        "*",
        F.round(100 * safe_div(F.col("firm_aum") - F.col("aum_12m"), F.col("aum_12m")), 4).alias("aum_growth_12m"),
        bucketise(F.col("firm_aum"), *AUM_TIERS).alias("aum_tier"),
        F.round(log1(F.col("firm_aum")), 6).alias("log_aum"),
    )


def custodian(df: DataFrame, holdings: DataFrame, *, at: str) -> DataFrame:
    """The largest custodian of the newest month at or before the date, and whether there are several."""
    best = holdings.groupBy("firm_id", "month").agg(
        F.max(F.struct("value", "custodian")).alias("_b"), F.countDistinct("custodian").alias("custodians")
    )
    rows = best.select("firm_id", "month", F.col("_b.custodian").alias("primary_custodian"), (F.col("custodians") > 1).cast("int").alias("multi_custodial"))
    return asof_join(df, rows, "firm_id", at, "month", cols=["primary_custodian", "multi_custodial"])


def wealth(snapshots: DataFrame) -> DataFrame:
    return snapshots.select(
        "*",
        F.round(safe_div(F.col("high_value"), F.col("aum")), 6).alias("hnw_ratio"),
        F.round(safe_div(F.col("aum"), F.col("accounts")), 4).alias("average_client"),
    )


def entity(df: DataFrame, col: str, out: str) -> DataFrame:
    """The first entry of a JSON list in a string."""
    return df.withColumn(out, F.coalesce(F.get(json_list(F.col(col)), F.lit(0)), F.lit("Unknown")))


def ratio_features(df: DataFrame) -> DataFrame:
    """Assets per client, and a boutique flag: assets per client in the top quarter of small firms."""
    out = df.withColumn("aum_per_client", safe_div(F.col("aum"), F.col("accounts")))
    out = out.crossJoin(F.broadcast(quantile_values(out, "aum_per_client", {"q75": 0.75}).limit(1)))
    boutique = (F.col("aum_per_client") >= F.col("q75")) & (F.col("accounts") <= 5)
    return out.select(*df.columns, F.floor("aum_per_client").alias("aum_per_client"), F.coalesce(boutique, F.lit(False)).cast("int").alias("is_boutique"))


# ---- shaping


def region_flags(df: DataFrame, col: str, values: Sequence[str]) -> DataFrame:
    return df.select("*", *[F.coalesce(F.col(col) == v, F.lit(False)).cast("int").alias(f"{col}_{v.lower().replace(' ', '_')}") for v in values])


def bin_columns(df: DataFrame, spec: Mapping[str, tuple[Sequence[float], Sequence[str]]]) -> DataFrame:
    """Bins in place of raw columns."""
    return df.select("*", *[bucketise(F.col(c), e, names).alias(f"{c}_bin") for c, (e, names) in spec.items()]).drop(*spec)


def hybrid_features(df: DataFrame) -> DataFrame:
    """The rules' conditions as model features."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    t, e, n = F.col("tenure_months"), F.col("experience_years"), F.col("net_change")
    return df.select(
        "*",
        flag(t.between(12, 48) & (e >= 3) & (n < 0)).alias("is_prime_mover"),
        flag(n.between(-10, -1)).alias("is_moderate_bleeder"),
        flag(n < -10).alias("is_heavy_bleeder"),
        flag((e >= 4) & t.between(12, 48)).alias("is_experienced_mover"),
    )


def interactions(df: DataFrame) -> DataFrame:
    mobile, bleeding, short = F.col("moves_3y") >= 2, F.col("net_change") < 0, F.col("tenure_months") < 24
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return df.select("*", flag(mobile & bleeding).alias("mobility_x_bleeding"), flag(short & mobile).alias("short_tenure_x_mobility"))


def null_policy(df: DataFrame, medians: Sequence[str], unknown: Sequence[str], train: Column) -> DataFrame:
    """Numbers take the median of the training rows, labels become 'Unknown'. One aggregate fits."""
    values = df.where(train).select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in medians])).alias("x")).select("x.*")
    fit = {r["c"]: r["mid"] for r in quantile_values(values, "v", {"mid": 0.5}, ["c"]).collect()}  # a row a column
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(fit.get(c)).cast("double")) for c in medians}
    return df.withColumns(filled | {c: F.coalesce(F.col(c), F.lit("Unknown")) for c in unknown})


def fit_categories(df: DataFrame, col: str, most: int = 1000) -> list[str]:
    """The values seen in the training rows, in order; at most ``most``, else it is no category."""
    found = [r[0] for r in df.where(F.col(col).isNotNull()).select(col).distinct().orderBy(col).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{col} has more than {most} values")
    return found


def encode(df: DataFrame, categories: Mapping[str, Sequence[str]]) -> DataFrame:
    """Ordinal codes and one-hot flags of fitted categories; unseen and null values have code -1."""
    out = []
    for c, values in categories.items():
        known = F.array(*[F.lit(v) for v in values])
        out.append(F.coalesce(F.array_position(known, F.col(c)) - 1, F.lit(-1)).cast("int").alias(f"{c}_code"))
        out += [F.coalesce(F.col(c) == v, F.lit(False)).cast("int").alias(f"{c}_is_{i}") for i, v in enumerate(values)]
    return df.select("*", *out)


# ---- whole vectors


def pit_features(leads: DataFrame, history: DataFrame, snapshots: DataFrame, net_by_month: DataFrame) -> DataFrame:
    """The point-in-time vector of each lead: tenure, mobility, firm assets and flow of the month before."""
    base = tenure(leads.select("lead_id", "person_id", "contacted"), history).drop("spell_id", "start_date", "end_date")
    moves = mobility(leads.select("lead_id", "person_id", "contacted"), history).select("lead_id", "moves_3y", "total_firms", "mobility_tier", "restlessness")
    out = base.join(moves, "lead_id", "left").withColumn("month", F.add_months(F.trunc("contacted", "MM"), -1).cast("date"))
    out = firm_pit(out, snapshots)
    return out.join(net_by_month.select("firm_id", "month", "departures", "arrivals"), ["firm_id", "month"], "left").fillna({"departures": 0, "arrivals": 0}).withColumn(
        "net_change", F.col("arrivals") - F.col("departures")
    )


def prospect_features(people: DataFrame, history: DataFrame, net: DataFrame, as_of: date) -> DataFrame:
    """Every person with a job: the newest one, experience, moves, licences and the firm's flow."""
    from leadloom.operators.aggregates import career, latest

    job = latest(history.where(F.col("start_date") <= F.lit(as_of)), "person_id", ["start_date", "spell_id"], ["start_date", "firm_id"])
    out = people.join(job, "person_id").join(career(history, as_of), "person_id", "left").join(net, "firm_id", "left")
    now = F.lit(as_of)
    return licences(out).select(
        "*",
        month_diff(now, F.col("start_date")).alias("tenure_months"),
        year_diff(now, F.col("start_date")).alias("tenure_years"),
        year_diff(now, F.col("career_start")).alias("experience_years"),
        (F.col("firm_count") - 1).alias("prior_firms"),
    )
