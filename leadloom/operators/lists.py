"""The lists: monthly hybrid, recycled, enterprise, dormant."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.operators.tiers import HYBRID, UPGRADE, Tier, apply_upgrade, assign_tier, recyclable_score
from leadloom.operators.windows import cap_per_group, channel_cap, order_value, tier_quota, top_n

#: The order of the tiers in the list; the upgrade is the sixth of nine.
LIST_ORDER = [r.name for r in HYBRID[:5]] + [UPGRADE.name] + [r.name for r in HYBRID[5:]]


def hybrid_list(
    prospects: DataFrame,
    *,
    rules: Sequence[Tier] = HYBRID,
    per_firm: int = 50,
    without_channel: int = 240,
    size: int = 2400,
    has_channel: Column | None = None,
    quotas: dict[str, int] | None = None,
) -> DataFrame:
    """From enriched prospects to the ranked monthly list.

    Tier, cap per firm, upgrade by percentile, quota per tier, cap of those without a
    profile, limit. The first cut shrinks rows before any rank over all of them.
    """
    tiered = assign_tier(prospects, rules)
    order = [F.col("priority_rank"), F.desc_nulls_last("percentile"), F.col("person_id")]
    capped = cap_per_group(tiered, ["firm_id"], order, per_firm)
    upgraded = apply_upgrade(capped)
    quota = quotas or {r.name: r.quota for r in [*rules, UPGRADE]}
    chosen = tier_quota(upgraded, "final_tier", quota, [F.desc_nulls_last("percentile"), F.col("person_id")])
    placed = chosen.withColumn("_place", order_value(F.col("final_tier"), LIST_ORDER))
    final = [F.col("_place"), F.col("tier_rank"), F.col("person_id")]
    if has_channel is not None:
        placed = channel_cap(placed, has_channel, without_channel, final)
    from pyspark.sql import Window

    listed = top_n(placed, size, final)  # bounded by ``size`` from here on
    return listed.withColumn("list_rank", F.row_number().over(Window.orderBy(*final))).drop("_place")


def recycle_list(records: DataFrame, as_of: date, *, lo: int = 90, hi: int = 730, size: int = 600) -> DataFrame:
    """Old opportunities and leads worth another contact: window, score, rank, limit.

    ``records``: person_id, kind ('opportunity' first), last_contact, percentile,
    tier_points, timing (boolean), net_change, reason. A null reason is dropped, as by NOT IN.
    """
    days = F.datediff(F.lit(as_of), "last_contact")
    opportunities = records.where("kind = 'opportunity'")
    leads = records.where("kind = 'lead'").join(opportunities.select("person_id"), "person_id", "left_anti")
    both = opportunities.unionByName(leads).where(days.between(lo, hi)).where("reason not in ('own decision', 'do not call')")
    score = recyclable_score(F.col("percentile"), F.col("tier_points"), F.col("timing"), F.col("kind") == "opportunity", days, F.col("net_change"))
    return top_n(both.withColumn("recycle_score", score), size, [F.desc("recycle_score"), F.col("person_id")])


def enterprise_targets(firms: DataFrame, owners: DataFrame, *, aum: tuple[float, float], min_reps: int) -> DataFrame:
    """Firms by profile, with their owner candidates and a match score."""
    fit = firms.where(F.col("aum").between(*aum) & (F.col("headcount") >= min_reps))
    score = F.when(F.col("net_change") < 0, 40).otherwise(10) + F.when(F.col("headcount").between(min_reps, 4 * min_reps), 30).otherwise(10) + F.when(F.col("owner_share") >= 0.5, 30).otherwise(0)
    return fit.join(owners, "firm_id").withColumn("match_score", score)


def share_of_text(col: Column) -> Column:
    """'75% or more' or '5% but less than 10%' to the lower bound as a share."""
    return F.regexp_extract(col, r"(\d+(?:\.\d+)?)\s*%", 1).try_cast("double") / 100


def dormant(records: DataFrame, activity: DataFrame, as_of: date, days: int, *, key: str, kinds: Sequence[str]) -> DataFrame:
    """Records without a call or message for ``days``, labelled by whether there ever was one."""
    last = activity.where(F.col("event_type").isin(*kinds)).groupBy(key).agg(F.max("task_date").alias("last_activity"))
    joined = records.join(last, key, "left")
    quiet = F.col("last_activity").isNull() | (F.datediff(F.lit(as_of), "last_activity") >= days)
    return joined.where(quiet).withColumn("label", F.when(F.col("last_activity").isNull(), "never contacted").otherwise("gone quiet"))
