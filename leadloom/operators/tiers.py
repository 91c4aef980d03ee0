"""Rule tiers as data, scores, narratives."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tier:
    """A rule: the first whose condition holds gives the tier. Unknown counts as not met."""

    name: str
    rule: Callable[[], Column]
    rank: int
    rate: float
    quota: int = 0
    points: int = 0
    action: str = ""
    text: str = ""


def _c(name: str) -> Column:
    return F.col(name)


def _prime_mover() -> Column:
    ten, exp = _c("tenure_years"), _c("experience_years")
    outside = _c("is_wirehouse") == 0
    return outside & (
        (ten.between(1, 3) & exp.between(5, 15) & (_c("net_change") < 0) & (_c("headcount") <= 50))
        | (ten.between(1, 3) & (_c("headcount") <= 10))
        | (ten.between(1, 4) & exp.between(5, 15) & (_c("net_change") < 0))
    )


# The published tiers of the monthly list (rules, ranks, rates, quotas, points).
HYBRID: tuple[Tier, ...] = (
    Tier("TIER_1A_PRIME_MOVER_CFP", lambda: _c("tenure_years").between(1, 4) & (_c("experience_years") >= 5) & (_c("net_change") < 0) & (_c("is_cfp") == 1) & (_c("is_wirehouse") == 0), 1, 0.087, 50, 35, "call first", "certified, recently moved, firm losing people"),
    Tier("TIER_1B_PRIME_MOVER_SERIES65", lambda: _prime_mover() & (_c("series_65_only") == 1), 2, 0.079, 60, 35, "call first", "fee-only licence, recently moved"),
    Tier("TIER_1_PRIME_MOVER", _prime_mover, 3, 0.071, 300, 30, "call first", "recently moved in mid career"),
    Tier("TIER_1F_HV_WEALTH_BLEEDER", lambda: (_c("is_high_value") == 1) & (_c("net_change") < 0) & (_c("is_wirehouse") == 0), 4, 0.065, 50, 28, "call first", "senior title at a firm losing people"),
    Tier("TIER_2_PROVEN_MOVER", lambda: (_c("prior_firms") >= 3) & (_c("experience_years") >= 5), 5, 0.052, 1500, 20, "call", "has moved often"),
    Tier("TIER_3_MODERATE_BLEEDER", lambda: _c("net_change").between(-10, -1) & (_c("experience_years") >= 5), 6, 0.044, 300, 18, "call", "firm losing some people"),
    Tier("TIER_4_EXPERIENCED_MOVER", lambda: (_c("experience_years") >= 20) & _c("tenure_years").between(1, 4), 7, 0.041, 300, 22, "call", "experienced, moved lately"),
    Tier("TIER_5_HEAVY_BLEEDER", lambda: (_c("net_change") <= -10) & (_c("experience_years") >= 5), 8, 0.038, 1500, 12, "mail", "firm losing many people"),
)
#: A shorter rule set; rules are data, so a version is another tuple.
FOUR_TIERS: tuple[Tier, ...] = (
    Tier("T1", lambda: _c("tenure_years").between(1, 4) & (_c("net_change") < 0), 1, 0.142),
    Tier("T2", lambda: _c("prior_firms") >= 5, 2, 0.0803),
    Tier("T3", lambda: _c("net_change") < 0, 3, 0.1045),
    Tier("T4", lambda: _c("experience_years") >= 6, 4, 0.0816),
)
STANDARD = Tier("STANDARD", lambda: F.lit(True), 99, 0.025, 0, 0, "wait", "no rule applies")
UPGRADE = Tier("V4_UPGRADE", lambda: F.lit(True), 6, 0.046, 500, 0, "call", "high model score")


def tier_table(rules: Sequence[Tier]) -> Column:
    """The columns that hang on the tier, as a map literal."""
    row = lambda r: F.struct(F.lit(r.rank).alias("rank"), F.lit(r.rate).alias("rate"), F.lit(r.points).alias("points"), F.lit(r.action).alias("action"), F.lit(r.text).alias("text"))
    return F.create_map(*[x for r in rules for x in (F.lit(r.name), row(r))])


def assign_tier(df: DataFrame, rules: Sequence[Tier] = HYBRID, standard: Tier = STANDARD, out: str = "tier") -> DataFrame:
    """The first tier whose rule holds, with rank, expected rate, points, action and explanation.

    Lift is the expected rate over that of the standard tier.
    """
    name = F.lit(standard.name)
    for r in reversed(rules):
        name = F.when(F.coalesce(r.rule(), F.lit(False)), r.name).otherwise(name)
    told = tier_table([*rules, standard])[F.col(out)]
    named = df.withColumn(out, name)
    return named.select(
        "*", told["rank"].alias("priority_rank"), told["rate"].alias("expected_rate"), F.round(told["rate"] / standard.rate, 4).alias("expected_lift"),
        told["points"].alias("tier_points"), told["action"].alias("action"), told["text"].alias("explanation"),
    )


def apply_upgrade(df: DataFrame, at: int = 80, upgrade: Tier = UPGRADE, standard: Tier = STANDARD) -> DataFrame:
    """Standard leads with a percentile of ``at`` or more move to the upgrade tier with its rate."""
    up = (F.col("tier") == standard.name) & (F.col("percentile") >= at)
    return df.withColumns(
        {
            "final_tier": F.when(up, upgrade.name).otherwise(F.col("tier")),
            "final_rate": F.when(up, F.lit(upgrade.rate)).otherwise(F.col("expected_rate")),
            "is_upgrade": F.coalesce(up, F.lit(False)).cast("int"),
        }
    )


def narrative(df: DataFrame, templates: Mapping[str, str], cols: Sequence[str], tier: str = "tier", out: str = "narrative") -> DataFrame:
    """A sentence per tier from a printf template over the same columns."""
    text = F.lit(None).cast("string")
    for name, form in templates.items():
        text = F.when(F.col(tier) == name, F.format_string(form, *[F.col(c) for c in cols])).otherwise(text)
    return df.withColumn(out, text)


def recyclable_score(percentile: Column, points: Column, timing: Column, opportunity: Column, days: Column, net: Column) -> Column:
    """Percentile (50 if unknown) and tier points; 15 for a timing reason, 10 for an opportunity,
    10 (180-365 days) or 5 (90-180 days) since contact, 8 at a firm losing people."""
    on = lambda c, n: F.when(c, n).otherwise(0)
    return (
        F.coalesce(percentile, F.lit(50)) + F.coalesce(points, F.lit(0)) + on(timing, 15) + on(opportunity, 10)
        + F.when((days > 180) & (days <= 365), 10).when(days.between(90, 180), 5).otherwise(0) + on(net < 0, 8)
    )


def expected_rate(score: Column) -> Column:
    """Percent: 3.2 to 50, linear to 6.0 at 100 and 10.0 at 135, then 0.05 a point to 12."""
    return (
        F.when(score <= 50, 3.2)
        .when(score <= 100, 3.2 + (score - 50) * (6.0 - 3.2) / 50)
        .when(score <= 135, 6.0 + (score - 100) * 4.0 / 35)
        .otherwise(F.least(10.0 + (score - 135) * 0.05, F.lit(12.0)))
    )


def bucket_action(score: Column) -> tuple[Column, Column]:
    bucket = F.when(score >= 0.9, "hot").when(score >= 0.7, "warm").when(score >= 0.4, "cool").otherwise("cold")
    action = F.when(bucket == "hot", "call today").when(bucket == "warm", "call this week").when(bucket == "cool", "mail").otherwise("wait")
    return bucket, action
