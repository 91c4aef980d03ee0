"""Queries: joins and set operations."""

from datetime import date

from pyspark.sql import functions as F

from leadloom.operators import joins as J
from leadloom.operators import sets as S
from leadloom.plans.adapters import AS_OF
from leadloom.plans.registry import query
from leadloom.sources.tables import literal_table, month_spine


@query("join_inner_equi", "select lead_id, title, nation_id from leads join persons using (person_id)")
def _(t):
    return t.leads.join(t.persons, "person_id").select("lead_id", "title", "nation_id")


PARTS = """, a as (select person_id, count(*) as n_spells from spells group by 1),
b as (select person_id, max(start_date) as newest from spells group by 1)"""


@query("join_left_equi", PARTS + " select p.person_id, title, n_spells, newest from persons p left join a using (person_id) left join b using (person_id)")
def _(t):
    a = t.spells.groupBy("person_id").agg(F.count(F.lit(1)).alias("n_spells"))
    b = t.spells.groupBy("person_id").agg(F.max("start_date").alias("newest"))
    return J.assemble(t.persons.select("person_id", "title"), "person_id", a, b)


@query("join_left_composite", "select spell_id, s.firm_id, date_trunc('month', start_date)::date as month, aum, accounts from spells s left join snapshots n on s.firm_id = n.firm_id and n.month = date_trunc('month', start_date)::date")
def _(t):
    left = t.spells.select("spell_id", "firm_id", F.trunc("start_date", "MM").alias("month"))
    return J.join_snapshot(left, t.snapshots, "firm_id", "month")


@query("join_full_outer_prefer", """, h as (select person_id, max(firm_id) as firm_id from spells group by 1), c as (select person_id, nation_id::bigint as firm_id from persons where person_id % 2 = 0)
select coalesce(h.person_id, c.person_id) as person_id, case when h.person_id is not null then h.firm_id else c.firm_id end as firm_id,
       case when h.person_id is not null then 'history' else 'current' end as source from h full join c on h.person_id = c.person_id""")
def _(t):
    h = t.spells.groupBy("person_id").agg(F.max("firm_id").alias("firm_id"))
    c = t.persons.where("person_id % 2 = 0").select("person_id", F.col("nation_id").cast("long").alias("firm_id"))
    return J.prefer(h, c, "person_id")


ASOF = """, f as (select lead_id, contacted, (person_id % 100) as firm_id from leads),
j as (select f.*, month, aum, row_number() over (partition by lead_id order by month desc nulls last) as k
      from f left join snapshots s on s.firm_id = f.firm_id and s.month {} f.contacted)
select lead_id, contacted, firm_id, month, aum from j where k = 1"""


def _asof(t, strict):
    left = t.leads.select("lead_id", "contacted", (F.col("person_id") % 100).alias("firm_id"))
    return J.asof_join(left, t.snapshots, "firm_id", "contacted", "month", strict=strict, cols=["aum"])


@query("join_asof_backward", ASOF.format("<="))
def _(t):
    return _asof(t, False)


@query("join_asof_strict", ASOF.format("<"))
def _(t):
    return _asof(t, True)


ACTIVE = """, j as (select l.lead_id, l.person_id, l.contacted, spell_id, firm_id, start_date, end_date,
         row_number() over (partition by lead_id order by start_date desc nulls last, spell_id desc) as k
  from leads l left join spells s on s.person_id = l.person_id and start_date <= contacted {})
select lead_id, person_id, contacted, spell_id, firm_id, start_date, end_date from j where k = 1"""


def _active(t, **how):
    left = t.leads.select("lead_id", "person_id", "contacted")
    return J.active_interval(left, t.spells, "person_id", "contacted", "lead_id", tiebreak="spell_id", **how)


@query("join_interval_active", ACTIVE.format("and (end_date is null or end_date >= contacted)"))
def _(t):
    return _active(t)


@query("join_interval_active_open", ACTIVE.format("and (end_date is null or end_date > contacted)"))
def _(t):
    return _active(t, end_inclusive=False)


@query("join_interval_gap_tolerant", ACTIVE.format(""))
def _(t):
    return _active(t, allow_gap=True)


@query("join_range_lookback", "select a.lead_id, b.lead_id as later_id, b.contacted - a.contacted as gap from leads a join leads b on a.person_id = b.person_id and b.contacted - a.contacted between 1 and 90")
def _(t):
    right = t.leads.select("person_id", F.col("lead_id").alias("later_id"), F.col("contacted").alias("later"))
    found = J.range_join(t.leads.select("lead_id", "person_id", "contacted"), right, "person_id", "contacted", "later", 1, 90)
    return found.select("lead_id", "later_id", F.datediff("later", "contacted").alias("gap"))


@query("join_range_window", "select lead_id, spell_id, start_date from leads l join spells s on l.person_id = s.person_id and start_date < contacted and start_date >= contacted - interval 12 month")
def _(t):
    return J.lookback(t.leads.select("lead_id", "person_id", "contacted"), t.spells, "person_id", "contacted", "start_date", 12).select("lead_id", "spell_id", "start_date")


@query("join_theta_like", ", p as (select unnest(['%1', '%00002%']) as pattern) select firm_id, firm_name, pattern from firms join p on upper(firm_name) like upper(pattern)")
def _(t):
    return J.like_join(t.firms.select("firm_id", "firm_name"), literal_table(t.spark, ["%1", "%00002%"], "pattern"), "firm_name", "pattern")


@query("join_multi_fk", "select distinct person_id, firm_id, firm_name from persons join firms on firm_id in (person_id % 100, nation_id::bigint, (person_id * 7) % 100)")
def _(t):
    left = t.persons.select("person_id", (F.col("person_id") % 100).alias("a"), F.col("nation_id").cast("long").alias("b"), (F.col("person_id") * 7 % 100).alias("c"))
    return J.join_any_key(left, ["a", "b", "c"], t.firms.select("firm_id", "firm_name"), "firm_id", "person_id")


@query("join_cross_scalar", "select lead_id, contacted - lo as days_in, hi - contacted as days_left from leads, (select min(contacted) as lo, max(contacted) as hi from leads)")
def _(t):
    bounds = t.leads.agg(F.min("contacted").alias("lo"), F.max("contacted").alias("hi"))
    return J.with_scalar(t.leads, bounds).select("lead_id", F.datediff("contacted", "lo").alias("days_in"), F.datediff("hi", "contacted").alias("days_left"))


@query("join_cross_spine", "select firm_id, month::date as month from firms, (select unnest(generate_series(date '2000-01-01', date '2001-08-01', interval 1 month)) as month)")
def _(t):
    return J.spine_product(t.firms.select("firm_id"), month_spine(t.spark, date(2000, 1, 1), AS_OF))


@query("join_semi_in", "select * from persons where person_id in (select person_id from leads where converted is not null)")
def _(t):
    return J.semi(t.persons, t.leads.where("converted is not null"), "person_id")


@query("join_anti_null", "select p.* from persons p left join leads l on p.person_id = l.person_id where l.person_id is null")
def _(t):
    return J.anti(t.persons, t.leads, "person_id")


@query("join_not_exists", ", p as (select unnest(['%1', '%00002%']) as pattern) select firm_id, firm_name from firms where not exists (select 1 from p where upper(firm_name) like upper(pattern))")
def _(t):
    return J.not_exists_like(t.firms.select("firm_id", "firm_name"), literal_table(t.spark, ["%1", "%00002%"], "pattern"), "firm_name", "pattern")


@query("join_self_lag12", "select a.firm_id, a.month, a.aum, a.accounts, b.aum as aum_prev from snapshots a left join snapshots b on a.firm_id = b.firm_id and b.month = a.month - interval 12 month")
def _(t):
    return J.self_lag_join(t.snapshots, "firm_id", "month", 12, ["aum"])


@query("join_coverage_report", """, a as (select distinct person_id from leads where converted is not null), b as (select distinct person_id from spells where person_id % 3 <> 0)
select case when b.person_id is null then 'left_only' when a.person_id is null then 'right_only' else 'both' end as side, count(*) as n from a full join b on a.person_id = b.person_id group by 1""")
def _(t):
    return J.merge_report(t.leads.where("converted is not null"), t.spells.where("person_id % 3 <> 0"), "person_id")


@query("sub_scalar_correlated", "select person_id, (select count(distinct firm_id) from spells s where s.person_id = p.person_id) as n_firms from persons p")
def _(t):
    agg = t.spells.groupBy("person_id").agg(F.countDistinct("firm_id").alias("n_firms"))
    return J.with_lookup(t.persons.select("person_id"), agg, "person_id", {"n_firms": 0})


@query("sub_scalar_uncorrelated", "select person_id, round(balance / (select avg(balance) from persons), 6) as relative from persons")
def _(t):
    return J.with_overall(t.persons, mean=F.avg("balance")).select("person_id", F.round(F.col("balance") / F.col("mean"), 6).alias("relative"))


@query("set_union_all", "select person_id as id, start_date as d, 'spell' as kind from spells union all select person_id, contacted, 'lead' from leads")
def _(t):
    a = t.spells.select(F.col("person_id").alias("id"), F.col("start_date").alias("d"), F.lit("spell").alias("kind"))
    return S.union(a, t.leads.select(F.col("person_id").alias("id"), F.col("contacted").alias("d"), F.lit("lead").alias("kind")))


@query("set_union_dedup_priority", ", a as (select person_id, 'opportunity' as kind from persons where person_id % 3 = 0), b as (select distinct person_id, 'lead' as kind from leads) select * from a union all select * from b where person_id not in (select person_id from a)")
def _(t):
    a = t.persons.where("person_id % 3 = 0").select("person_id", F.lit("opportunity").alias("kind"))
    return S.union_priority(a, t.leads.select("person_id").distinct().withColumn("kind", F.lit("lead")), "person_id")


@query("set_diff_names", "select coalesce(o.key, n.key) as key, case when o.key is null then 'joined' when n.key is null then 'withdrawn' else 'common' end as status from old_list o full join new_list n on o.key = n.key")
def _(t):
    return S.set_diff(t.old_list, t.new_list, "key")


@query("set_intersect_keys", "select person_id from leads where contacted < date '1998-01-01' intersect select person_id from leads where contacted >= date '1998-01-01'")
def _(t):
    return S.intersect_keys(t.leads.where("contacted < '1998-01-01'"), t.leads.where("contacted >= '1998-01-01'"), "person_id")
