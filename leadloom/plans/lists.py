"""Queries: tiers, scores, the lists and the analyses."""

from datetime import date

from pyspark.sql import functions as F

from leadloom.operators import analysis as Y
from leadloom.operators import lists as L
from leadloom.operators import tiers as T
from leadloom.operators import windows as W
from leadloom.operators.filters import flag_patterns
from leadloom.plans.adapters import AS_OF, EVENTS_AS_OF
from leadloom.plans.aggregates import NET, net
from leadloom.plans.features import PROSPECTS, prospects
from leadloom.plans.registry import query

ENRICHED = PROSPECTS + """, enr0 as (select p.*, (coalesce(firm_name like '%7', false))::int as is_wirehouse, (person_id % 6 = 0)::int as is_cfp,
  (licences like '%Series 65%' and licences not like '%Series 7%')::int as series_65_only, (coalesce(title = 'AUTOMOBILE', false))::int as is_high_value,
  (balance * 7 - floor(balance * 7)) as model_score from pros p left join firms using (firm_id)),
enr as (select *, floor(100 * rank() over (order by balance) / (count(*) over ())::double)::int as percentile from enr0)"""
PRIME = "(is_wirehouse = 0 and ((tenure_years between 1 and 3 and experience_years between 5 and 15 and net_change < 0 and headcount <= 50) or (tenure_years between 1 and 3 and headcount <= 10) or (tenure_years between 1 and 4 and experience_years between 5 and 15 and net_change < 0)))"
TIERED = ENRICHED + f""", tie as (select *, case
  when tenure_years between 1 and 4 and experience_years >= 5 and net_change < 0 and is_cfp = 1 and is_wirehouse = 0 then 'TIER_1A_PRIME_MOVER_CFP'
  when {PRIME} and series_65_only = 1 then 'TIER_1B_PRIME_MOVER_SERIES65'
  when {PRIME} then 'TIER_1_PRIME_MOVER'
  when is_high_value = 1 and net_change < 0 and is_wirehouse = 0 then 'TIER_1F_HV_WEALTH_BLEEDER'
  when prior_firms >= 3 and experience_years >= 5 then 'TIER_2_PROVEN_MOVER'
  when net_change between -10 and -1 and experience_years >= 5 then 'TIER_3_MODERATE_BLEEDER'
  when experience_years >= 20 and tenure_years between 1 and 4 then 'TIER_4_EXPERIENCED_MOVER'
  when net_change <= -10 and experience_years >= 5 then 'TIER_5_HEAVY_BLEEDER' else 'STANDARD' end as tier from enr),
info(tier, priority_rank, expected_rate, tier_points, quota, place) as (values
  ('TIER_1A_PRIME_MOVER_CFP', 1, 0.087::double, 35, 50, 1), ('TIER_1B_PRIME_MOVER_SERIES65', 2, 0.079, 35, 60, 2), ('TIER_1_PRIME_MOVER', 3, 0.071, 30, 300, 3),
  ('TIER_1F_HV_WEALTH_BLEEDER', 4, 0.065, 28, 50, 4), ('TIER_2_PROVEN_MOVER', 5, 0.052, 20, 1500, 5), ('V4_UPGRADE', 6, 0.046, 0, 500, 6),
  ('TIER_3_MODERATE_BLEEDER', 6, 0.044, 18, 300, 7), ('TIER_4_EXPERIENCED_MOVER', 7, 0.041, 22, 300, 8), ('TIER_5_HEAVY_BLEEDER', 8, 0.038, 12, 1500, 9), ('STANDARD', 99, 0.025, 0, 0, 10)),
tir as (select tie.*, priority_rank, expected_rate, tier_points from tie join info using (tier))"""


def described(t):
    p = prospects(t).join(t.firms.select("firm_id", "firm_name"), "firm_id", "left")
    low = F.coalesce(F.col("licences").like("%Series 65%") & ~F.col("licences").like("%Series 7%"), F.lit(False))
    return p.select(
        "*",
        flag_patterns(F.col("firm_name"), ["%7"]).alias("is_wirehouse"),
        (F.col("person_id") % 6 == 0).cast("int").alias("is_cfp"),
        low.cast("int").alias("series_65_only"),
        F.coalesce(F.col("title") == "AUTOMOBILE", F.lit(False)).cast("int").alias("is_high_value"),
        (F.col("balance") * 7 - F.floor(F.col("balance") * 7)).alias("model_score"),
    )


def enriched(t):
    """With the percentile of the balance, for what needs it."""
    return W.score_percentile(described(t), "balance")


@query("tier_rules", TIERED + " select person_id, tier, priority_rank, expected_rate, round(expected_rate / 0.025::double, 4) as expected_lift, tier_points from tir")
def _(t):
    return T.assign_tier(described(t)).select("person_id", "tier", "priority_rank", "expected_rate", "expected_lift", "tier_points")


@query("tier_variants", ENRICHED + " select person_id, case when tenure_years between 1 and 4 and net_change < 0 then 'T1' when prior_firms >= 5 then 'T2' when net_change < 0 then 'T3' when experience_years >= 6 then 'T4' else 'STANDARD' end as tier from enr")
def _(t):
    return T.assign_tier(described(t), T.FOUR_TIERS).select("person_id", "tier")


UPG = TIERED + ", upg as (select *, case when tier = 'STANDARD' and percentile >= 80 then 'V4_UPGRADE' else tier end as final_tier, case when tier = 'STANDARD' and percentile >= 80 then 0.046::double else expected_rate end as final_rate, (tier = 'STANDARD' and percentile >= 80)::int as is_upgrade from tir)"


@query("tier_upgrade", UPG + " select person_id, final_tier, final_rate, is_upgrade from upg")
def _(t):
    return T.apply_upgrade(T.assign_tier(enriched(t))).select("person_id", "final_tier", "final_rate", "is_upgrade")


@query("tier_narrative", TIERED + " select person_id, case tier when 'TIER_2_PROVEN_MOVER' then 'Moved ' || prior_firms || ' times, net change ' || net_change when 'STANDARD' then 'Nothing stands out of ' || prior_firms || ' moves and net change ' || net_change end as narrative from tir")
def _(t):
    forms = {"TIER_2_PROVEN_MOVER": "Moved %d times, net change %d", "STANDARD": "Nothing stands out of %d moves and net change %d"}
    return T.narrative(T.assign_tier(described(t)), forms, ["prior_firms", "net_change"]).select("person_id", "narrative")


RECORDS = TIERED + """, lst as (select person_id, max(contacted) as last_contact, count(converted) as c, max(source) as src from leads group by 1),
opp as (select person_id, 'opportunity' as kind, last_contact, src as reason, c > 3 as timing from lst where c > 2),
led as (select person_id, 'lead' as kind, last_contact, src as reason, c > 3 as timing from lst),
rec as (select x.*, percentile, tier_points, net_change from (select * from opp union all select * from led where person_id not in (select person_id from opp)) x join tir using (person_id)),
sco as (select *, coalesce(percentile, 50) + tier_points + case when timing then 15 else 0 end + case when kind = 'opportunity' then 10 else 0 end
  + case when date '2001-08-01' - last_contact > 180 and date '2001-08-01' - last_contact <= 365 then 10 when date '2001-08-01' - last_contact between 90 and 180 then 5 else 0 end
  + case when net_change < 0 then 8 else 0 end as recycle_score from rec)"""


def records(t):
    last = t.leads.groupBy("person_id").agg(F.max("contacted").alias("last_contact"), F.count("converted").alias("c"), F.max("source").alias("reason"))
    cols = ["person_id", "kind", "last_contact", "reason", (F.col("c") > 3).alias("timing")]
    both = last.where("c > 2").withColumn("kind", F.lit("opportunity")).select(*cols).unionByName(last.withColumn("kind", F.lit("lead")).select(*cols))
    tiers = T.assign_tier(enriched(t)).select("person_id", "percentile", "tier_points", "net_change")
    return both.join(tiers, "person_id")


@query("score_recycle", RECORDS + " select person_id, recycle_score from sco")
def _(t):
    r = records(t)
    opportunities = r.where("kind = 'opportunity'")
    r = opportunities.unionByName(r.where("kind = 'lead'").join(opportunities.select("person_id"), "person_id", "left_anti"))
    days = F.datediff(F.lit(AS_OF), "last_contact")
    return r.select("person_id", T.recyclable_score(F.col("percentile"), F.col("tier_points"), F.col("timing"), F.col("kind") == "opportunity", days, F.col("net_change")).alias("recycle_score"))


@query("score_to_rate", ", s as (select lead_id, lead_id % 190 as score from leads) select lead_id, round(case when score <= 50 then 3.2 when score <= 100 then 3.2 + (score - 50) * 2.8 / 50 when score <= 135 then 6 + (score - 100) * 4.0 / 35 else least(10 + (score - 135) * 0.05, 12) end::double, 6) as rate from s")
def _(t):
    return t.leads.select("lead_id", F.round(T.expected_rate(F.col("lead_id") % 190), 6).alias("rate"))


@query("score_bucket_action", "select lead_id, case when score >= 0.9 then 'hot' when score >= 0.7 then 'warm' when score >= 0.4 then 'cool' else 'cold' end as bucket, case when score >= 0.9 then 'call today' when score >= 0.7 then 'call this week' when score >= 0.4 then 'mail' else 'wait' end as action from outcomes")
def _(t):
    bucket, action = T.bucket_action(F.col("score"))
    return t.outcomes.select("lead_id", bucket.alias("bucket"), action.alias("action"))


@query("list_hybrid", UPG.replace(", upg as (select *, case", ", cap as (select * from (select *, row_number() over (partition by firm_id order by priority_rank, percentile desc nulls last, person_id) as fk from tir) where fk <= 50), upg as (select *, case").replace("as is_upgrade from tir)", "as is_upgrade from cap)") + """,
quo as (select u.*, place, row_number() over (partition by final_tier order by percentile desc nulls last, person_id) as tier_rank, i.quota from upg u join info i on i.tier = u.final_tier),
cho as (select * from quo where tier_rank <= quota),
cha as (select * from cho where title is not null union all (select * from cho where title is null order by place, tier_rank, person_id limit 240)),
lim as (select * from cha order by place, tier_rank, person_id limit 2400)
select person_id, firm_id, final_tier, final_rate, percentile, tier_rank, row_number() over (order by place, tier_rank, person_id) as list_rank from lim""")
def _(t):
    return L.hybrid_list(enriched(t), has_channel=F.col("title").isNotNull()).select("person_id", "firm_id", "final_tier", "final_rate", "percentile", "tier_rank", "list_rank")


@query("list_recycle", RECORDS + " select person_id, kind, recycle_score from sco where date '2001-08-01' - last_contact between 90 and 730 and reason not in ('own decision', 'do not call') order by recycle_score desc, person_id limit 600")
def _(t):
    return L.recycle_list(records(t), AS_OF).select("person_id", "kind", "recycle_score")


@query("list_enterprise", NET + """, aum as (select l_suppkey as firm_id, round(sum(l_extendedprice), 2) as aum from lineitem group by 1),
f as (select firm_id, aum, headcount, net_change, (firm_id % 4) * 0.25::double as owner_share from aum join net using (firm_id) where aum between 1e6 and 1e9 and headcount >= 20),
o as (select firm_id, min(person_id) as owner_id from spells group by 1)
select firm_id, owner_id, case when net_change < 0 then 40 else 10 end + case when headcount between 20 and 80 then 30 else 10 end + case when owner_share >= 0.5 then 30 else 0 end as match_score from f join o using (firm_id)""")
def _(t):
    aum = t.raw("lineitem").groupBy(F.col("l_suppkey").alias("firm_id")).agg(F.round(F.sum("l_extendedprice"), 2).alias("aum"))
    said = F.concat(((F.col("firm_id") % 4) * 25).cast("string"), F.lit("% or more"))
    firms = aum.join(net(t), "firm_id").withColumn("owner_share", L.share_of_text(said))
    owners = t.spells.groupBy("firm_id").agg(F.min("person_id").alias("owner_id"))
    return L.enterprise_targets(firms, owners, aum=(1e6, 1e9), min_reps=20).select("firm_id", "owner_id", "match_score")


@query("list_dormant", ", r as (select person_id as user_id, title from persons), l as (select user_id, max(task_date) as last_activity from tasks where event_type in ('click', 'purchase') group by 1) select user_id, title, last_activity, case when last_activity is null then 'never contacted' else 'gone quiet' end as label from r left join l using (user_id) where last_activity is null or date '2024-01-31' - last_activity >= 3")
def _(t):
    people = t.persons.select(F.col("person_id").alias("user_id"), "title")
    return L.dormant(people, t.tasks, EVENTS_AS_OF, 3, key="user_id", kinds=["click", "purchase"])


@query("an_moved_after", ", m as (select lead_id, min(start_date) as moved from leads l join spells s on l.person_id = s.person_id and start_date > contacted group by 1) select lead_id, contacted, moved, moved - contacted as days, case when moved is null then 'stayed' when moved - contacted <= 90 then 'within 90 days' when moved - contacted <= 365 then 'within a year' else 'later' end as timing from leads left join m using (lead_id)")
def _(t):
    return Y.moved_after_contact(t.leads, t.spells)


@query("an_event_study", """, e as (select firm_id, min(start_date) + 700 as event_date from spells group by 1)
select e.firm_id, event_date, count(distinct case when end_date - event_date between 0 and 30 then person_id end) as d0_30, count(distinct case when end_date - event_date between 31 and 60 then person_id end) as d31_60,
  count(distinct case when end_date - event_date between 61 and 90 then person_id end) as d61_90, count(distinct case when end_date - event_date between -180 and -1 then person_id end) as baseline_180
from e left join spells s on s.firm_id = e.firm_id and end_date - event_date between -180 and 90 group by 1, 2""")
def _(t):
    events = t.spells.groupBy("firm_id").agg(F.date_add(F.min("start_date"), 700).alias("event_date"))
    return Y.event_study(events, t.spells)


@query("an_event_classify", "select doc_id, case when regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])(the)($|[^\\p{L}\\p{N}_])') then 'english' when regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])(und|der)($|[^\\p{L}\\p{N}_])') then 'german' else 'other' end as label from documents")
def _(t):
    return Y.classify_text(t.raw("documents"), "text", {"english": ["the"], "german": ["und", "der"]}).select("doc_id", "label")


@query("an_inflow", ", s as (select date_trunc('month', start_date)::date as m, count(*) as n from spells group by 1), a as (select (m + interval 12 month)::date as month, n as entries from s), b as (select (m + interval 24 month)::date as month, n as exits from s) select coalesce(a.month, b.month) as month, coalesce(entries, 0) as entries, coalesce(exits, 0) as exits from a full join b on a.month = b.month")
def _(t):
    return Y.inflow(t.spells)


@query("an_repeat_contacts", "select lead_id, (row_number() over (partition by person_id order by contacted, lead_id) > 1)::int as is_repeat from leads")
def _(t):
    return Y.repeat_flag(t.leads, "person_id", "contacted", "lead_id").select("lead_id", "is_repeat")


@query("an_pool_depletion", ", p as (select source, count(*) as pool from leads where converted is null group by 1), u as (select source, avg(n) as per_month from (select source, date_trunc('month', contacted) as m, count(*) as n from leads group by 1, 2) group by 1) select source, pool, round(per_month, 4) as per_month, round(pool / per_month, 4) as months_left, case when pool / per_month < 3 then 'critical' when pool / per_month < 12 then 'watch' else 'ok' end as status from p join u using (source)")
def _(t):
    return Y.depletion(t.leads.where("converted is null"), t.leads.withColumn("month", F.trunc("contacted", "MM")), "source")


@query("an_num_employees", NET + ", q as (select *, ntile(4) over (order by headcount, firm_id) as tile from net) select tile, count(*) as n, min(headcount) as low, max(headcount) as high, round(avg(net_change), 4) as mean_net from q group by 1")
def _(t):
    tiled = W.ntile(net(t), 4, "headcount", [F.col("firm_id")])
    return tiled.groupBy("tile").agg(F.count(F.lit(1)).alias("n"), F.min("headcount").alias("low"), F.max("headcount").alias("high"), F.round(F.avg("net_change"), 4).alias("mean_net"))


@query("an_disagreement", ", d as (select case when amount > 400000 and score <= 0.2 then 'high tier, low score' when not amount > 400000 and score >= 0.8 then 'low tier, high score' else 'agree' end as kind, target from outcomes) select kind, count(*) as n, round(avg(target), 6) as rate from d group by 1")
def _(t):
    return Y.disagreement(t.outcomes, F.col("amount") > 400000, "score", "target")


@query("an_period_compare", ", g as (select source, count(*) filter (where contacted < date '2000-07-01') as before, count(*) filter (where contacted >= date '2000-07-01') as after from leads group by 1) select *, round(100.0::double * before / sum(before) over (), 4) as before_pct, round(100.0::double * after / sum(after) over (), 4) as after_pct from g")
def _(t):
    return Y.compare_periods(t.leads, "source", "contacted", date(2000, 7, 1))
