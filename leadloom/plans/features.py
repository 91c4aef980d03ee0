"""Queries: targets and point-in-time features."""

from datetime import date

from pyspark.sql import functions as F

from leadloom.operators import aggregates as A
from leadloom.operators import features as P
from leadloom.operators import windows as W
from leadloom.plans.adapters import AS_OF, FIRST
from leadloom.plans.aggregates import FLOW, NET, SEQ, net
from leadloom.plans.registry import query

TARGET = "select lead_id, case when date '2001-08-01' - contacted < {n} then null when converted - contacted between 0 and {n} then 1 {late} else 0 end as target from leads"


@query("tgt_window", TARGET.format(n=43, late=""))
def _(t):
    return t.leads.select("lead_id", P.target(AS_OF, 43).alias("target"))


@query("tgt_window_late_null", TARGET.format(n=30, late="when converted - contacted > 30 then null"))
def _(t):
    return t.leads.select("lead_id", P.target(AS_OF, 30, "null").alias("target"))


@query("tgt_timing_dist", "select count(*) as n, quantile_cont(converted - contacted, 0.5) as p50, quantile_cont(converted - contacted, 0.9) as p90, quantile_cont(converted - contacted, 0.95) as p95, round(avg(converted - contacted), 4) as mean_days from leads where converted is not null")
def _(t):
    return P.timing(t.leads)


@query("tgt_censor_report", ", r as (select case when date '2001-08-01' - contacted < 43 then 'censored' else 'mature' end as status, coalesce(converted - contacted between 0 and 43, false) as hit from leads) select status, count(*) as n, count(*) filter (where hit) as conversions, round(100 * avg(hit::int), 4) as rate_pct from r group by 1")
def _(t):
    return P.censor_report(t.leads, AS_OF, 43)


MOB = """, rec as (select lead_id, count(distinct firm_id) as moves_3y from leads l join spells s on l.person_id = s.person_id and start_date < contacted and start_date >= contacted - interval 36 month group by 1),
tot as (select lead_id, count(distinct firm_id) as total_firms, min(start_date) as career_start from leads l join spells s on l.person_id = s.person_id and start_date < contacted group by 1),
mob as (select l.lead_id, coalesce(moves_3y, 0) as moves_3y, coalesce(total_firms, 0) as total_firms,
  case when coalesce(moves_3y, 0) >= 3 then 'HIGH' when moves_3y = 2 then 'MEDIUM' when moves_3y = 1 then 'LOW' else 'STABLE' end as mobility_tier,
  round((coalesce(moves_3y, 0) / 3.0::double) / nullif(coalesce(total_firms, 0) / greatest(year(contacted) - year(career_start), 1)::double, 0), 6) as restlessness
  from leads l left join rec using (lead_id) left join tot using (lead_id))"""


@query("ft_mobility", MOB + " select * from mob")
def _(t):
    return P.mobility(t.leads, t.spells).select("lead_id", "moves_3y", "total_firms", "mobility_tier", "restlessness")


ACT = """, aj as (select l.lead_id, l.person_id, contacted, firm_id, start_date, row_number() over (partition by lead_id order by start_date desc nulls last, spell_id desc) as k
  from leads l left join spells s on s.person_id = l.person_id and start_date <= contacted and (end_date is null or end_date >= contacted)),
first_job as (select person_id, min(start_date) as career_start from spells group by 1),
ten as (select lead_id, aj.person_id, contacted, firm_id, date_diff('month', start_date, contacted) as tenure_months,
  greatest(year(contacted) - year(career_start), 0) as experience_years from aj left join first_job using (person_id) where k = 1)"""
BUCKETS = "case when tenure_months is null then 'Unknown' when tenure_months < 12 then '0-12' when tenure_months < 24 then '12-24' when tenure_months < 48 then '24-48' when tenure_months < 120 then '48-120' else '120+' end as tenure_bucket, case when experience_years is null or experience_years <= 0 then 'Unknown' when experience_years < 5 then '0-5' when experience_years < 10 then '5-10' when experience_years < 15 then '10-15' when experience_years < 20 then '15-20' else '20+' end as experience_bucket"


@query("ft_tenure", ACT + f" select lead_id, firm_id, tenure_months, experience_years, {BUCKETS} from ten")
def _(t):
    return tenure(t).select("lead_id", "firm_id", "tenure_months", "experience_years", "tenure_bucket", "experience_bucket")


def tenure(t):
    return P.tenure(t.leads.select("lead_id", "person_id", "contacted"), t.spells)


MIX = MOB + ACT + NET + ", mix as (select lead_id, moves_3y, restlessness, tenure_months, experience_years, coalesce(net_change, 0) as net_change from mob join ten using (lead_id) left join net using (firm_id))"


def mixed(t):
    moves = P.mobility(t.leads, t.spells).select("lead_id", "moves_3y", "restlessness")
    jobs = tenure(t).select("lead_id", "firm_id", "tenure_months", "experience_years")
    return moves.join(jobs, "lead_id").join(net(t).select("firm_id", "net_change"), "firm_id", "left").fillna({"net_change": 0}).drop("firm_id")


@query("ft_engineered3", MIX + " select lead_id, least(greatest(coalesce(restlessness, 0), 0), 3) as restlessness_clipped, moves_3y * greatest(-net_change, 0) as flight_risk, case when tenure_months < 12 then 1 else 0 end as fresh_start from mix")
def _(t):
    return P.flight_risk(mixed(t)).select("lead_id", "restlessness_clipped", "flight_risk", "fresh_start")


@query("ft_maturity_flags", MIX + " select lead_id, (coalesce(experience_years >= 4, false))::int as is_veteran, (coalesce(tenure_months < 12, false))::int as is_new_to_firm, (coalesce(experience_years >= 4 and tenure_months < 12, false))::int as maturity_mismatch from mix")
def _(t):
    return P.maturity_flags(mixed(t)).select("lead_id", "is_veteran", "is_new_to_firm", "maturity_mismatch")


@query("ft_hybrid", MIX + " select lead_id, (coalesce(tenure_months between 12 and 48 and experience_years >= 3 and net_change < 0, false))::int as is_prime_mover, (coalesce(net_change between -10 and -1, false))::int as is_moderate_bleeder, (coalesce(net_change < -10, false))::int as is_heavy_bleeder, (coalesce(experience_years >= 4 and tenure_months between 12 and 48, false))::int as is_experienced_mover from mix")
def _(t):
    return P.hybrid_features(mixed(t)).select("lead_id", "is_prime_mover", "is_moderate_bleeder", "is_heavy_bleeder", "is_experienced_mover")


@query("ft_interactions", MIX + " select lead_id, (coalesce(moves_3y >= 2 and net_change < 0, false))::int as mobility_x_bleeding, (coalesce(tenure_months < 24 and moves_3y >= 2, false))::int as short_tenure_x_mobility from mix")
def _(t):
    return P.interactions(mixed(t)).select("lead_id", "mobility_x_bleeding", "short_tenure_x_mobility")


@query("ft_firm_stability", FLOW + """, nf as (select firm_id, month, arrivals - departures as net_change, departures, arrivals from flow),
pf as (select *, round(100 * percent_rank() over (partition by month order by net_change), 4) as net_percentile from nf)
select *, case when net_percentile <= 10 then 'HIGH' when net_percentile <= 25 then 'MEDIUM' when net_change < 0 then 'MONITOR' else 'STABLE' end as priority,
  case when net_change <= -14 then 'severe' when net_change <= -3 then 'moderate' when net_change < 0 then 'slight' when net_change = 0 then 'stable' else 'growing' end as stability_tier from pf""")
def _(t):
    flow = A.rolling_flow(t.spells, FIRST, AS_OF).withColumn("net_change", F.col("arrivals") - F.col("departures"))
    return P.firm_stability(flow, ["month"])


TIER = "case when firm_aum is null then 'Unknown' when firm_aum < 1000000 then 'UNDER_1M' when firm_aum < 10000000 then '1M_10M' when firm_aum < 100000000 then '10M_100M' when firm_aum < 1000000000 then '100M_1B' else 'OVER_1B' end as aum_tier"


@query("ft_firm_pit", f""", b as (select spell_id, firm_id, date_trunc('month', start_date)::date as month from spells),
j as (select b.*, n.aum as firm_aum, o.aum as aum_12m from b left join snapshots n on n.firm_id = b.firm_id and n.month = b.month left join snapshots o on o.firm_id = b.firm_id and o.month = b.month - interval 12 month)
select *, round(100 * ((firm_aum - aum_12m) / nullif(aum_12m, 0)), 4) as aum_growth_12m, {TIER}, case when firm_aum >= 0 then round(ln(1 + firm_aum), 6) end as log_aum from j""")
def _(t):
    return P.firm_pit(t.spells.select("spell_id", "firm_id", F.trunc("start_date", "MM").alias("month")), t.snapshots)


FACTS = ", c as (select a.lead_id, count(b.lead_id) as n, count(*) filter (where b.source = '1-URGENT') as k0, count(*) filter (where b.source = '5-LOW') as k1, max((b.contacted >= a.contacted - interval 12 month)::int) as r from leads a join leads b on a.person_id = b.person_id and b.contacted < a.contacted and b.contacted >= a.contacted - interval {m} month group by 1) select l.lead_id, coalesce(n, 0) as {p}_count, coalesce(k0, 0) as {p}_0, coalesce(k1, 0) as {p}_1, coalesce(r, 0) as {p}_recent from leads l left join c using (lead_id)"


@query("ft_accolades", FACTS.format(m=36, p="accolade"))
def _(t):
    return P.dated_counts(t.leads, t.leads, kind="source", kinds=["1-URGENT", "5-LOW"], fact_date="contacted", months=36, prefix="accolade")


@query("ft_disclosures", FACTS.format(m=120, p="disclosure"))
def _(t):
    return P.dated_counts(t.leads, t.leads, kind="source", kinds=["1-URGENT", "5-LOW"], fact_date="contacted", months=120, prefix="disclosure")


@query("ft_licences", "select person_id, json_array_length(licences) as licence_count, (licences like '%Series 7\"%')::int as series_7, (licences like '%Series 65%')::int as series_65 from persons")
def _(t):
    return P.licences(t.persons).select("person_id", "licence_count", "series_7", "series_65")


@query("ft_custodian", """, h as (select l_suppkey as firm_id, date_trunc('month', l_shipdate)::date as month, l_returnflag as custodian, round(sum(l_extendedprice), 2) as value from lineitem group by 1, 2, 3),
b as (select firm_id, month, custodian as primary_custodian, (count(*) over (partition by firm_id, month) > 1)::int as multi_custodial, row_number() over (partition by firm_id, month order by value desc, custodian desc) as k from h),
j as (select s.spell_id, s.firm_id, s.start_date, b.month, primary_custodian, multi_custodial, row_number() over (partition by spell_id order by b.month desc nulls last) as r from spells s left join b on b.firm_id = s.firm_id and b.month <= s.start_date and b.k = 1)
select spell_id, firm_id, start_date, month, primary_custodian, multi_custodial from j where r = 1""")
def _(t):
    value = F.round(F.sum("l_extendedprice"), 2).alias("value")
    h = t.raw("lineitem").groupBy(F.col("l_suppkey").alias("firm_id"), F.trunc("l_shipdate", "MM").alias("month"), F.col("l_returnflag").alias("custodian")).agg(value)
    return P.custodian(t.spells.select("spell_id", "firm_id", "start_date"), h, at="start_date")


@query("ft_states", ", r as (select person_id, nation as state, start_date as since from spells join firms using (firm_id)), c as (select lead_id, count(distinct state) as n from leads l join r on l.person_id = r.person_id and since <= contacted group by 1) select lead_id, coalesce(n, 0) as states_registered from leads left join c using (lead_id)")
def _(t):
    r = t.spells.join(t.firms, "firm_id").select("person_id", F.col("nation").alias("state"), F.col("start_date").alias("since"))
    return P.states(t.leads.select("lead_id", "person_id", "contacted"), r)


@query("ft_wealth", ", s as (select l_suppkey as firm_id, round(sum(l_extendedprice), 2) as aum, round(sum(case when l_quantity > 40 then l_extendedprice else 0 end), 2) as high_value, count(distinct l_orderkey) as accounts from lineitem group by 1) select *, round(high_value / nullif(aum, 0), 6) as hnw_ratio, round(aum / nullif(accounts, 0), 4) as average_client from s")
def _(t):
    high = F.round(F.sum(F.when(F.col("l_quantity") > 40, F.col("l_extendedprice")).otherwise(0.0)), 2).alias("high_value")
    s = t.raw("lineitem").groupBy(F.col("l_suppkey").alias("firm_id")).agg(F.round(F.sum("l_extendedprice"), 2).alias("aum"), high, F.countDistinct("l_orderkey").alias("accounts"))
    return P.wealth(s)


@query("ft_entity", "select person_id, coalesce(licences->>'$[0]', 'Unknown') as classification from persons")
def _(t):
    return P.entity(t.persons, "licences", "classification").select("person_id", "classification")


@query("ft_velocity", SEQ + """, p as (select lead_id, contacted, max(case when job_number = 1 then start_date end) as s1, max(case when job_number = 2 then start_date end) as s2 from seq group by 1, 2)
select lead_id, contacted - s1 as days_since_move, s1 - s2 as previous_days, round((contacted - s1) / nullif(s1 - s2, 0)::double, 6) as tenure_ratio, (contacted - s1 between 365 and 730)::int as danger_zone from p""")
def _(t):
    return P.velocity(W.job_sequence(t.leads.select("lead_id", "person_id", "contacted"), t.spells, most=2))


@query("ft_ratios", ", r as (select firm_id, month, aum, accounts, aum / nullif(accounts, 0) as x from snapshots), q as (select quantile_cont(x, 0.75) as q75 from r) select firm_id, month, aum, accounts, floor(x)::bigint as aum_per_client, (x >= q75 and accounts <= 5)::int as is_boutique from r, q")
def _(t):
    return P.ratio_features(t.snapshots)


@query("ft_region_onehot", "select firm_id, region, (region = 'ASIA')::int as region_asia, (region = 'MIDDLE EAST')::int as region_middle_east from firms")
def _(t):
    return P.region_flags(t.firms.select("firm_id", "region"), "region", ["ASIA", "MIDDLE EAST"])


@query("ft_bin_tenure", ACT + f" select lead_id, {BUCKETS.split(', case')[0].replace('as tenure_bucket', 'as tenure_months_bin')}, case when experience_years is null then 'Unknown' when experience_years < 2 then 'new' else 'old' end as experience_years_bin from ten")
def _(t):
    from leadloom.functions.numbers import TENURE_MONTHS

    rows = tenure(t).select("lead_id", "tenure_months", "experience_years")
    return P.bin_columns(rows, {"tenure_months": TENURE_MONTHS, "experience_years": ((2,), ("new", "old"))})


@query("ft_null_policy", ", m as (select quantile_cont(converted - contacted, 0.5) as med from leads where contacted < date '2000-01-01') select lead_id, coalesce(converted - contacted, med)::double as gap, coalesce(case when lead_id % 4 <> 0 then source end, 'Unknown') as source from leads, m")
def _(t):
    rows = t.leads.select("lead_id", "contacted", F.datediff("converted", "contacted").alias("gap"), F.when(F.col("lead_id") % 4 != 0, F.col("source")).alias("source"))
    return P.null_policy(rows, ["gap"], ["source"], F.col("contacted") < F.lit(date(2000, 1, 1))).drop("contacted")


@query("ft_onehot_encode", ", v as (select source, row_number() over (order by source) - 1 as code from (select distinct source from leads where contacted < date '2000-01-01')) select lead_id, source, code::int as source_code, (code = 0)::int as source_is_0, (code = 1)::int as source_is_1, (code = 2)::int as source_is_2, (code = 3)::int as source_is_3, (code = 4)::int as source_is_4 from leads join v using (source)")
def _(t):
    known = P.fit_categories(t.leads.where(F.col("contacted") < F.lit(date(2000, 1, 1))), "source")
    return P.encode(t.leads.select("lead_id", "source"), {"source": known})


@query("ft_full_vector", MOB + ACT + FLOW + f""", b as (select ten.*, (date_trunc('month', contacted) - interval 1 month)::date as month, {BUCKETS} from ten),
j as (select b.*, n.aum as firm_aum, o.aum as aum_12m from b left join snapshots n on n.firm_id = b.firm_id and n.month = b.month left join snapshots o on o.firm_id = b.firm_id and o.month = b.month - interval 12 month)
select j.firm_id, j.month, lead_id, person_id, contacted, tenure_months, tenure_bucket, experience_years, experience_bucket, moves_3y, total_firms, mobility_tier, restlessness, firm_aum, aum_12m,
  round(100 * ((firm_aum - aum_12m) / nullif(aum_12m, 0)), 4) as aum_growth_12m, {TIER}, case when firm_aum >= 0 then round(ln(1 + firm_aum), 6) end as log_aum,
  coalesce(departures, 0) as departures, coalesce(arrivals, 0) as arrivals, coalesce(arrivals, 0) - coalesce(departures, 0) as net_change
from j left join mob using (lead_id) left join flow f on f.firm_id = j.firm_id and f.month = j.month""")
def _(t):
    return P.pit_features(t.leads, t.spells, t.snapshots, A.rolling_flow(t.spells, FIRST, AS_OF))


PROSPECTS = NET + """, job as (select person_id, start_date, firm_id from (select *, row_number() over (partition by person_id order by start_date desc, spell_id desc) as k from spells where start_date <= date '2001-08-01') where k = 1),
car as (select person_id, count(distinct firm_id) as firm_count, count(distinct case when start_date >= date '1998-08-01' then firm_id end) as moves_3y, min(start_date) as career_start from spells where start_date <= date '2001-08-01' group by 1),
pros as (select p.*, firm_id, start_date, firm_count, moves_3y, career_start, headcount, departures, arrivals, net_change, turnover_pct, stability_score,
  json_array_length(licences) as licence_count, (licences like '%Series 7"%')::int as series_7, (licences like '%Series 65%')::int as series_65,
  date_diff('month', start_date, date '2001-08-01') as tenure_months, 2001 - year(start_date) as tenure_years, 2001 - year(career_start) as experience_years, firm_count - 1 as prior_firms
  from persons p join job using (person_id) left join car using (person_id) left join net using (firm_id))"""


def prospects(t):
    return P.prospect_features(t.persons, t.spells, net(t), AS_OF)


@query("ft_batch_prospects", PROSPECTS + " select * from pros")
def _(t):
    return prospects(t)
