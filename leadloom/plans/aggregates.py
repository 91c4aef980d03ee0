"""Queries: aggregates, windows, ranks and quotas."""

from datetime import date

from pyspark.sql import functions as F

from leadloom.operators import aggregates as A
from leadloom.operators import windows as W
from leadloom.plans.adapters import AS_OF, FIRST
from leadloom.plans.registry import query

HEADS = ", h as (select firm_id, count(distinct person_id) as headcount from spells where end_date is null or end_date > date '2001-08-01' group by 1)"
FLOWS = HEADS + """,
dep as (select firm_id, count(distinct person_id) as departures from spells where end_date > date '2000-08-01' and end_date <= date '2001-08-01' group by 1),
arr as (select firm_id, count(distinct person_id) as arrivals from spells where start_date > date '2000-08-01' and start_date <= date '2001-08-01' group by 1)"""
NET = FLOWS + """,
net as (select firm_id, headcount, coalesce(departures, 0) as departures, coalesce(arrivals, 0) as arrivals,
  coalesce(arrivals, 0) - coalesce(departures, 0) as net_change, round(100 * (coalesce(departures, 0)::double / headcount), 2) as turnover_pct,
  least(greatest(50 + 3.5::double * (coalesce(arrivals, 0) - coalesce(departures, 0)), 0), 100)::double as stability_score
  from h left join dep using (firm_id) left join arr using (firm_id))"""


def heads(t):
    return A.headcount(t.spells.where("end_date is null or end_date > '2001-08-01'"), "firm_id", "person_id")


def net(t):
    return A.net_flow(heads(t), A.departures(t.spells, AS_OF), A.arrivals(t.spells, AS_OF))


@query("agg_headcount", HEADS + " select * from h where headcount >= 20")
def _(t):
    return A.headcount(t.spells.where("end_date is null or end_date > '2001-08-01'"), "firm_id", "person_id", 20)


@query("agg_departures_12mo", FLOWS + " select * from dep")
def _(t):
    return A.departures(t.spells, AS_OF)


@query("agg_arrivals_12mo", FLOWS + " select * from arr")
def _(t):
    return A.arrivals(t.spells, AS_OF)


FLOW = """, spine as (select unnest(generate_series(date '1995-01-01', date '2001-08-01', interval 1 month))::date as month),
d as (select firm_id, month, count(distinct person_id) as departures from spells, spine where end_date > month - interval 12 month and end_date <= month group by 1, 2),
a as (select firm_id, month, count(distinct person_id) as arrivals from spells, spine where start_date > month - interval 12 month and start_date <= month group by 1, 2),
flow as (select coalesce(d.firm_id, a.firm_id) as firm_id, coalesce(d.month, a.month) as month, coalesce(departures, 0) as departures, coalesce(arrivals, 0) as arrivals
  from d full join a on d.firm_id = a.firm_id and d.month = a.month)"""


@query("agg_rolling_flow_monthly", FLOW + " select * from flow")
def _(t):
    return A.rolling_flow(t.spells, FIRST, AS_OF)


@query("agg_net_flow", NET + " select * from net")
def _(t):
    return net(t)


@query("agg_pit_headcount", ", q as (select firm_id, month from snapshots) select q.firm_id, q.month, count(distinct person_id) as headcount from q left join spells s on s.firm_id = q.firm_id and start_date <= month and (end_date is null or end_date >= month) group by 1, 2")
def _(t):
    return A.headcount_at(t.spells, t.snapshots.select("firm_id", "month"), date_col="month")


@query("agg_conditional_count", "select source, count(*) filter (where target = 1) as hits, sum(case when amount > 200000 then 1 else 0 end) as large from outcomes group by 1")
def _(t):
    return t.outcomes.groupBy("source").agg(F.count_if(F.col("target") == 1).alias("hits"), F.sum(F.when(F.col("amount") > 200000, 1).otherwise(0)).alias("large"))


@query("agg_conditional_distinct", "select source, count(distinct case when target = 1 then person_id end) as people from outcomes group by 1")
def _(t):
    return t.outcomes.groupBy("source").agg(A.count_distinct_if(F.col("target") == 1, F.col("person_id")).alias("people"))


@query("agg_career_moves", "select person_id, count(distinct firm_id) as firm_count, count(distinct case when start_date >= date '1998-08-01' then firm_id end) as moves_3y, min(start_date) as career_start from spells where start_date <= date '2001-08-01' group by 1")
def _(t):
    return A.career(t.spells, AS_OF)


@query("agg_prior_tenure", ", p as (select lead_id, sum(date_diff('month', start_date, end_date)) as s, avg(date_diff('month', start_date, end_date)) as a from leads l join spells s on s.person_id = l.person_id and end_date < contacted group by 1) select lead_id, coalesce(s, 0)::bigint as prior_months, round(a, 4) as avg_prior_months from leads left join p using (lead_id)")
def _(t):
    return A.prior_tenure(t.leads, t.spells).select("lead_id", "prior_months", "avg_prior_months")


SEQ = ", seq as (select lead_id, l.person_id, contacted, spell_id, firm_id, start_date, end_date, row_number() over (partition by lead_id order by start_date desc, spell_id desc) as job_number from leads l join spells s on s.person_id = l.person_id and start_date <= contacted)"


@query("agg_pivot_rank", SEQ + " select lead_id, max(case when job_number = 1 then firm_id end) as firm_id_1, max(case when job_number = 2 then firm_id end) as firm_id_2, max(case when job_number = 3 then firm_id end) as firm_id_3 from seq group by 1")
def _(t):
    jobs = W.job_sequence(t.leads.select("lead_id", "person_id", "contacted"), t.spells, most=3)
    return A.pivot_by_rank(jobs, "lead_id", "job_number", ["firm_id"], 3)


@query("agg_latest_value", "select person_id, firm_id, end_date from (select *, row_number() over (partition by person_id order by start_date desc, spell_id desc) as k from spells) where k = 1")
def _(t):
    return A.latest(t.spells, "person_id", ["start_date", "spell_id"], ["firm_id", "end_date"])


@query("agg_first_struct", "select firm_id, start_date, spell_id, person_id from (select *, row_number() over (partition by firm_id order by start_date, spell_id) as k from spells) where k = 1")
def _(t):
    return A.first_event(t.spells, "firm_id", ["start_date", "spell_id"], ["person_id"])


@query("agg_last_activity", "select person_id, max(greatest(contacted, coalesce(converted, date '1900-01-01'))) as last_activity from leads group by 1")
def _(t):
    return A.last_activity(t.leads, "person_id", ["contacted", "converted"])


@query("agg_first_contact", "select user_id, min(task_date) as first_contact from tasks group by 1")
def _(t):
    return A.first_contact(t.tasks, "user_id", "task_date")


@query("agg_firm_rollup", """select l_suppkey, count(*) as n, """ + ", ".join(f"round({f}({c}), 4) as {n}_{c}" for c in ("l_quantity", "l_extendedprice") for n, f in (("sum", "sum"), ("avg", "avg"), ("min", "min"), ("max", "max"), ("stddev", "stddev_samp"))) + ", count(distinct l_partkey) as n_l_partkey, round(avg((l_returnflag = 'R')::int), 6) as share_returned from lineitem group by 1")
def _(t):
    return A.rollup(t.raw("lineitem"), "l_suppkey", ["l_quantity", "l_extendedprice"], ["l_partkey"], {"returned": F.col("l_returnflag") == "R"})


@query("agg_top_value", "select source, top_target, n from (select source, target as top_target, count(*) as n, row_number() over (partition by source order by count(*) desc, target) as k from outcomes group by 1, 2) where k = 1")
def _(t):
    return A.mode_value(t.outcomes, "source", "target")


@query("agg_concentration", ", p as (select l_suppkey, sum(case when l_returnflag = 'A' then l_quantity else 0 end) as a, sum(case when l_returnflag = 'N' then l_quantity else 0 end) as n, sum(l_quantity) as q from lineitem group by 1) select *, round(a / nullif(q, 0), 6) as a_ratio, round(n / nullif(q, 0), 6) as n_ratio, case when round(a / nullif(q, 0), 6) >= 0.5 then 1 else 0 end as a_focus, case when round(n / nullif(q, 0), 6) >= 0.5 then 1 else 0 end as n_focus from p")
def _(t):
    flag = lambda x: F.sum(F.when(F.col("l_returnflag") == x, F.col("l_quantity")).otherwise(0.0))
    p = t.raw("lineitem").groupBy("l_suppkey").agg(flag("A").alias("a"), flag("N").alias("n"), F.sum("l_quantity").alias("q"))
    return A.ratios(p, ["a", "n"], "q")


@query("agg_quantiles", "select event_type, quantile_cont(value, 0.25) as p25, quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.75) as p75 from tasks group by 1")
def _(t):
    return A.quantiles(t.tasks, "value", [0.25, 0.5, 0.75], ["event_type"])


@query("agg_correlation", ", v as (select l_quantity as q, l_extendedprice as p, l_discount as d from lineitem) select 'l_quantity' as a, 'l_extendedprice' as b, round(corr(q, p), 6) as r from v union all select 'l_quantity', 'l_discount', round(corr(q, d), 6) from v union all select 'l_extendedprice', 'l_discount', round(corr(p, d), 6) from v")
def _(t):
    return A.corr_matrix(t.raw("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query("agg_distinct_rows", "select distinct person_id, firm_id from spells")
def _(t):
    return t.spells.select("person_id", "firm_id").distinct()


@query("agg_share_of_total", "select source, count(*) as n, round(100 * count(*) / sum(count(*)) over ()::double, 4) as pct from leads group by 1")
def _(t):
    return A.share(t.leads, ["source"])


@query("agg_group_report", "select source, count(*) as n, sum(target)::bigint as conversions, round(100 * avg(target), 4) as rate_pct, round(avg(target) / (select avg(target) from outcomes), 4) as lift from outcomes group by 1")
def _(t):
    return A.rate_report(t.outcomes, ["source"], "target")


@query("agg_crosstab", "select source, round(avg(case when y = 1996 then target end), 6) as rate_1996, round(avg(case when y = 1997 then target end), 6) as rate_1997 from (select *, year(contacted) as y from outcomes) group by 1")
def _(t):
    return A.rate_crosstab(t.outcomes.withColumn("y", F.year("contacted")), "source", "y", "target", [1996, 1997])


@query("agg_variants_stacked", """, s as (select 'large' as segment, target from outcomes where amount > 200000 union all select 'urgent', target from outcomes where source = '1-URGENT' union all select 'all', target from outcomes)
select segment, count(*) as n, sum(target)::bigint as conversions, round(100 * avg(target), 4) as rate_pct from s group by 1""")
def _(t):
    return A.segment_report(t.outcomes, {"large": F.col("amount") > 200000, "urgent": F.col("source") == "1-URGENT", "all": F.lit(True)}, "target")


@query("agg_class_distribution", "select case when isodow(contacted) >= 6 then 'weekend' else 'weekday' end as day_kind, case when amount < 100000 then 'small' when amount < 300000 then 'medium' else 'large' end as size, count(*) as n, sum(target)::bigint as conversions, round(100 * avg(target), 4) as rate_pct, round(avg(target) / (select avg(target) from outcomes), 4) as lift from outcomes group by 1, 2")
def _(t):
    size = F.when(F.col("amount") < 100000, "small").when(F.col("amount") < 300000, "medium").otherwise("large")
    day = F.when(F.weekday("contacted") >= 5, "weekend").otherwise("weekday")
    return A.rate_report(t.outcomes.withColumns({"day_kind": day, "size": size}), ["day_kind", "size"], "target")


_EXT = "select '{c}' as column_name, (select count(*) from lineitem) as n, round(lo, 4) as low, round(hi, 4) as high, (select count(*) from lineitem where {c} < lo or {c} > hi) as beyond, (select round(avg(({c} = 0)::int), 6) from lineitem) as zero_share, 0.0::double as null_share from (select quantile_cont({c}, 0.01) as lo, quantile_cont({c}, 0.99) as hi from lineitem)"


@query("agg_extremes", _EXT.format(c="l_extendedprice") + " union all " + _EXT.format(c="l_discount"))
def _(t):
    return A.extremes(t.raw("lineitem"), ["l_extendedprice", "l_discount"])


@query("win_dedupe_latest", "select * exclude (k) from (select *, row_number() over (partition by person_id order by start_date desc, spell_id desc) as k from spells) where k = 1")
def _(t):
    return W.latest_row(t.spells, ["person_id"], [F.desc("start_date"), F.desc("spell_id")])


@query("win_rank_in_group", "select lead_id, person_id, row_number() over (partition by person_id order by amount desc, lead_id) as firm_rank from leads")
def _(t):
    return W.rank_in(t.leads.select("lead_id", "person_id", "amount"), ["person_id"], [F.desc("amount"), F.col("lead_id")], "firm_rank").drop("amount")


@query("win_rank_global", "select lead_id, row_number() over (order by amount desc, lead_id) as list_rank from leads")
def _(t):
    return W.rank_all(t.leads.select("lead_id", "amount"), "amount", [F.col("lead_id")], descending=True).select("lead_id", "list_rank")


@query("win_rank_subset", "select lead_id, case when converted is null then row_number() over (partition by converted is null, source order by amount desc, lead_id) end as open_rank from leads")
def _(t):
    return W.rank_subset(t.leads, F.col("converted").isNull(), ["source"], [F.desc("amount"), F.col("lead_id")], "open_rank").select("lead_id", "open_rank")


@query("win_percent_rank", "select firm_id, month, round(100 * percent_rank() over (partition by month order by aum), 4) as aum_pct from snapshots")
def _(t):
    return W.pct_rank(t.snapshots, ["month"], "aum", "aum_pct").select("firm_id", "month", "aum_pct")


@query("win_score_percentile", "select lead_id, floor(100 * rank() over (order by score) / (count(*) over ())::double)::int as percentile from outcomes")
def _(t):
    return W.score_percentile(t.outcomes, "score").select("lead_id", "percentile")


@query("win_ntile", "select lead_id, ntile(5) over (order by contacted, lead_id) as tile from leads")
def _(t):
    leads = t.leads.select("lead_id", "contacted", F.datediff("contacted", F.lit(date(1970, 1, 1))).alias("day"))
    return W.ntile(leads, 5, "day", [F.col("lead_id")]).select("lead_id", "tile")


@query("win_lag", "select firm_id, month, aum, accounts, lag(aum, 1) over w as aum_lag1, round(100 * (aum - lag(aum, 1) over w) / nullif(lag(aum, 1) over w, 0), 4) as aum_growth1, lag(aum, 12) over w as aum_lag12, round(100 * (aum - lag(aum, 12) over w) / nullif(lag(aum, 12) over w, 0), 4) as aum_growth12 from snapshots window w as (partition by firm_id order by month)")
def _(t):
    return W.growth(t.snapshots, "firm_id", "month", "aum")


@query("win_lag_aggregate", ", c as (select date_trunc('month', start_date)::date as month, count(*) as entries from spells group by 1) select c.month, c.entries, coalesce(p.entries, 0) as exits from c left join c p on p.month = c.month - interval 12 month")
def _(t):
    return W.cohort_inflow(t.spells, "start_date")


@query("win_first_value", "select firm_id, month, first_value(month) over (partition by firm_id order by aum desc, month) as best_month from snapshots")
def _(t):
    return W.first_by(t.snapshots, "firm_id", [F.desc("aum"), F.col("month")], "month", "best_month").select("firm_id", "month", "best_month")


@query("win_total_count", "select lead_id, row_number() over (order by contacted, lead_id) as row_index, count(*) over () as row_total from leads")
def _(t):
    leads = t.leads.select("lead_id", F.datediff("contacted", F.lit(date(1970, 1, 1))).alias("day"))
    return W.indexed(leads, "day", [F.col("lead_id")]).select("lead_id", "row_index", "row_total")


@query("win_job_sequence", SEQ + " select lead_id, spell_id, firm_id, job_number from seq")
def _(t):
    return W.job_sequence(t.leads.select("lead_id", "person_id", "contacted"), t.spells).select("lead_id", "spell_id", "firm_id", "job_number")


@query("win_spell_end", SEQ + """, p as (select lead_id, contacted, max(case when job_number = 1 then start_date end) as s1, max(case when job_number = 2 then start_date end) as s2 from seq group by 1, 2)
select lead_id, contacted - s1 as days_since_move, s1 - s2 as previous_days, round((contacted - s1) / nullif(s1 - s2, 0)::double, 6) as tenure_ratio from p""")
def _(t):
    jobs = W.job_sequence(t.leads.select("lead_id", "person_id", "contacted"), t.spells)
    return velocity(jobs)


def velocity(jobs):
    from leadloom.operators.features import velocity as v

    return v(jobs).select("lead_id", "days_since_move", "previous_days", "tenure_ratio")


@query("win_rank_pct_in_month", "select lead_id, round(rank() over (partition by date_trunc('month', contacted) order by contacted) / (count(*) over (partition by date_trunc('month', contacted)))::double, 6) as date_pct from leads")
def _(t):
    return W.rank_pct(t.leads.withColumn("m", F.trunc("contacted", "MM")), ["m"], "contacted", "date_pct").select("lead_id", "date_pct")


@query("sort_custom_order", "select source, count(*) as n, case source when '5-LOW' then 1 when '1-URGENT' then 2 else 3 end as place from leads group by 1")
def _(t):
    return t.leads.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("place", W.order_value(F.col("source"), ["5-LOW", "1-URGENT"])).orderBy("place", "source")


@query("topk_global", "select lead_id, amount from leads order by amount desc, lead_id limit 600")
def _(t):
    return W.top_n(t.leads.select("lead_id", "amount"), 600, [F.desc("amount"), F.col("lead_id")])


@query("topk_per_group", "select lead_id, person_id from (select *, row_number() over (partition by person_id order by amount desc, lead_id) as k from leads) where k <= 2")
def _(t):
    return W.cap_per_group(t.leads.select("lead_id", "person_id", "amount"), ["person_id"], [F.desc("amount"), F.col("lead_id")], 2).drop("amount")


@query("topk_tier_quota", "select lead_id, source, k as tier_rank from (select *, row_number() over (partition by source order by amount desc, lead_id) as k from leads) where k <= case source when '1-URGENT' then 50 when '5-LOW' then 5 when '2-HIGH' then 0 else -1 end")
def _(t):
    return W.tier_quota(t.leads, "source", {"1-URGENT": 50, "5-LOW": 5, "2-HIGH": 0}, [F.desc("amount"), F.col("lead_id")]).select("lead_id", "source", "tier_rank")


@query("topk_channel_cap", "select lead_id from leads where converted is not null union all (select lead_id from leads where converted is null order by amount desc, lead_id limit 240)")
def _(t):
    return W.channel_cap(t.leads, F.col("converted").isNotNull(), 240, [F.desc("amount"), F.col("lead_id")]).select("lead_id")


@query("sort_nulls_last", "select lead_id, converted from leads order by converted desc nulls last, lead_id limit 3000")
def _(t):
    return W.top_n(t.leads.select("lead_id", "converted"), 3000, [F.desc_nulls_last("converted"), F.col("lead_id")])


@query("topk_features_per_row", """, v as (select l_orderkey, l_linenumber, l_quantity - 25 as a, (l_discount - 0.05) * 400 as b, (l_tax - 0.04) * 500 as c from lineitem),
u as (select *, [{'o': -abs(a), 'name': 'a', 'value': a}, {'o': -abs(b), 'name': 'b', 'value': b}, {'o': -abs(c), 'name': 'c', 'value': c}] as x from v),
s as (select *, list_sort(x) as y from u)
select l_orderkey, l_linenumber, y[1].name as driver_1, round(y[1].value, 4) as driver_1_value, y[2].name as driver_2, round(y[2].value, 4) as driver_2_value from s""")
def _(t):
    v = t.raw("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 25).alias("a"), ((F.col("l_discount") - 0.05) * 400).alias("b"), ((F.col("l_tax") - 0.04) * 500).alias("c"))
    best = W.top_drivers(v, ["a", "b", "c"], 2)
    return best.select("l_orderkey", "l_linenumber", "driver_1", F.round("driver_1_value", 4).alias("driver_1_value"), "driver_2", F.round("driver_2_value", 4).alias("driver_2_value"))
