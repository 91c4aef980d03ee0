"""Queries: entity resolution, change capture, quality gates."""

from pyspark.sql import functions as F

from leadloom.operators import gates as G
from leadloom.operators import resolution as R
from leadloom.plans.alike import alike, norm, similar
from leadloom.plans.joins import ASOF, _asof
from leadloom.plans.registry import query
from leadloom.sources.log import append_run, read_log
from leadloom.sources.shared import checkpointed, scratch


def _noted(t):
    """Names with former and trading names written into them."""
    n = F.regexp_extract("id", r"(\d+)", 1).cast("long")
    note = F.when(n % 3 == 0, F.concat(F.lit("*"), "name", F.lit(" (f/k/a Old "), "name", F.lit(")"))).when(n % 3 == 1, F.concat("name", F.lit(" d/b/a Shop "), n.cast("string"))).otherwise(F.col("name"))
    return t.names.select("id", note.alias("noted"), "name", n.alias("n"))


NOTED = ", nn as (select id, name, regexp_extract(id, '(\\d+)', 1)::bigint as n from names)"


@query("er_parse_names", NOTED + " select id, name as main_name, case when n % 3 = 0 then 'Old ' || name else '' end as former, case when n % 3 = 1 then 'Shop ' || n else '' end as dba from nn")
def _(t):
    return R.parse_names(_noted(t), "noted").select("id", "main_name", F.array_join("former_names", "|").alias("former"), F.array_join("dbas", "|").alias("dba"))


@query("er_parse_dates", "select lead_id, contacted as joined_on, case when lead_id % 4 = 0 then contacted + 100 end as withdrew_on, lead_id % 4 <> 0 as is_member from leads")
def _(t):
    c = F.col("contacted")
    note = F.concat(F.lit("Joined on "), F.date_format(c, "M/d/yyyy"), F.when(F.col("lead_id") % 4 == 0, F.concat(F.lit("; withdrew: "), F.date_format(F.date_add(c, 100), "yyyy-MM-dd"))).otherwise(""))
    return R.parse_membership(t.leads.select("lead_id", note.alias("note")), "note").select("lead_id", "joined_on", "withdrew_on", "is_member")


@query("er_normalise", "select right_id, trim(regexp_replace(regexp_replace(lower(right_name), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) as norm from edited_names")
def _(t):
    return t.edited_names.select("right_id", R.normalise(F.col("right_name")).alias("norm"))


@query("er_base_name", "select right_id, regexp_replace(trim(regexp_replace(regexp_replace(lower(right_name), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), '\\s+(llc|inc|corp|co|company|ltd)$', '') as base from edited_names")
def _(t):
    return t.edited_names.select("right_id", R.base_name(F.col("right_name")).alias("base"))


@query("er_variants", NOTED + " select id, 'firm' as kind, name as variant from nn union all select id, 'former', 'Old ' || name from nn where n % 3 = 0 union all select id, 'dba', 'Shop ' || n from nn where n % 3 = 1")
def _(t):
    return R.variants(R.parse_names(_noted(t), "noted"), "id")


SIDES = ", ln as (select id as l, name from names), rn0 as (select right_id as r, right_name as name from edited_names)" + similar("ln", "rn0")


@query("er_block", SIDES + " select l as id, r as right_id from close_pairs")
def _(t):
    return R.blocked_pairs(t.names, t.edited_names, "name", "right_name").select("id", "right_id")


CANDS = SIDES + f", pr as (select l as id, r as right_id, {norm('ln.name')} as nrm, {norm('rn0.name')} as rn from close_pairs join ln using (l) join rn0 using (r))" + alike("pr", "p") + """,
k as (select id, right_id, confidence, row_number() over (partition by id order by confidence desc, right_id) as place from p)"""


@query("er_fuzzy", CANDS + " select id, right_id, confidence from p")
def _(t):
    return R.scored_candidates(t.names, t.edited_names)


@query("er_workbench", CANDS + " select * from k where place <= 5")
def _(t):
    return R.ranked_candidates(t.names, t.edited_names, 5)


@query("er_ambiguity", CANDS + ", a as (select id, max(confidence) filter (where place = 1) as first, max(confidence) filter (where place = 2) as second from k where place <= 2 group by 1) select *, round(first - second, 6) as gap, coalesce(round(first - second, 6) < 0.05, false) or first < 0.9 as needs_review from a")
def _(t):
    return R.ambiguity(R.ranked_candidates(t.names, t.edited_names, 2))


LEGAL = r"'\s+(llc|l l c|inc|incorporated|corp|corporation|co|company|ltd|limited|lp|llp|plc)$'"
MATCH = NOTED + f""", vs as (select id, 'firm' as kind, 1 as o, name as variant from nn union all select id, 'former', 2, 'Old ' || name from nn where n % 3 = 0 union all select id, 'dba', 3, 'Shop ' || n from nn where n % 3 = 1),
lf as (select *, {norm('variant')} as nrm from vs), rf as (select right_id as r, right_name as name, {norm('right_name')} as rn from edited_names),
lb as (select *, trim(variant) as ex, regexp_replace(nrm, {LEGAL}, '') as base from lf), rb as (select *, trim(name) as ex, regexp_replace(rn, {LEGAL}, '') as base from rf),
hits as (
  select id, kind, o, r, 'exact' as tier, 0 as t, 1.0::double as confidence from lb join (select ex, min(r) as r from rb where ex <> '' group by 1) using (ex)
  union all select id, kind, o, r, 'normalised', 1, 0.95 from lb join (select rn, min(r) as r from rb where rn <> '' group by 1) x on lb.nrm = x.rn
  union all select id, kind, o, r, 'base', 2, 0.85 from lb join (select base, min(r) as r from rb where base <> '' group by 1) using (base)),
tx as (select id || chr(31) || kind || chr(31) || variant as l, id, kind, o, nrm, variant as name from lf where id not in (select id from hits))""" + similar("tx", "rf") + """,
pr as (select tx.id, tx.kind, tx.o, rf.r, tx.nrm, rf.rn from close_pairs join tx using (l) join rf using (r))""" + alike("pr", "p") + """,
ok as (select * from hits union all select id, kind, o, r, 'fuzzy', 3, confidence from p where confidence >= 0.6),
rk as (select *, row_number() over (partition by id order by confidence desc, t, o, r) as place from ok),
mt as (select n.id, rk.r as right_id, coalesce(tier, 'none') as tier, coalesce(confidence, 0) as confidence, kind as matched_on from names n left join rk on rk.id = n.id and place = 1)"""


def _matched(t):
    return R.tier_match(R.variants(R.parse_names(_noted(t), "noted"), "id"), t.edited_names)


@query("er_tier_match", MATCH + " select * from mt")
def _(t):
    return _matched(t).select("id", "right_id", "tier", "confidence", "matched_on")


@query("er_override", MATCH + ", o as (select id, 'manual' as mr from names where id like 's1%') select mt.id, coalesce(mr, right_id) as right_id, case when mr is not null then 'manual' else tier end as tier, case when mr is not null then 1.0::double else confidence end as confidence, mr is null and (right_id is null or (tier = 'fuzzy' and confidence < 0.9)) as needs_review from mt left join o using (id)")
def _(t):
    return R.with_overrides(_matched(t), t.names.where("id like 's1%'").select("id", F.lit("manual").alias("right_id")))


@query("er_protect", MATCH + ", e as (select id, right_id as er from mt where confidence >= 0.95 or tier in ('exact', 'manual')), o as (select id, 'manual' as mr from names where id like 's1%') select mt.id, coalesce(mr, er, right_id) as right_id, case when mr is not null then 'manual' when er is not null then 'kept' else 'new' end as source from mt left join o using (id) left join e using (id)")
def _(t):
    found = checkpointed(_matched(t))
    overrides = t.names.where("id like 's1%'").select("id", F.lit("manual").alias("right_id"))
    return R.protect(found, found, overrides)


@query("er_eval", MATCH + ", a as (select id, case when tier in ('exact', 'normalised') then right_id end as a from mt), j as (select id, a, right_id as b from a join mt using (id)) select count(*) as n, round(avg((a is not null)::int), 6) as rate_before, round(avg((b is not null)::int), 6) as rate_after, count(*) filter (where b is not null and a is null) as newly_matched, count(*) filter (where a <> b) as changed, count(*) filter (where a is not null and b is null) as lost from j")
def _(t):
    after = checkpointed(_matched(t))
    before = after.withColumn("right_id", F.when(F.col("tier").isin("exact", "normalised"), F.col("right_id")))
    return R.compare_runs(before, after)


DIFF = """, j as (select coalesce(o.key, n.key) as key, o.key is null as is_new, n.key is null as is_gone, o.name as on_, n.name as nn_, o.brand as ob, n.brand as nb, o.size::varchar as os, n.size::varchar as ns from old_list o full join new_list n on o.key = n.key),
ch as (select key, 'JOINED' as change, 'name' as field, null as old_value, nn_ as new_value from j where is_new
 union all select key, 'WITHDREW', 'name', on_, null from j where is_gone
 union all select key, 'NAME_CHANGED', 'name', on_, nn_ from j where not is_new and not is_gone and on_ is distinct from nn_
 union all select key, 'INFO_UPDATED', 'brand', ob, nb from j where not is_new and not is_gone and ob is distinct from nb
 union all select key, 'INFO_UPDATED', 'size', os, ns from j where not is_new and not is_gone and os is distinct from ns
 union all select key, 'MATCHED', 'name', on_, nn_ from j where not is_new and not is_gone and on_ is not distinct from nn_ and ob is not distinct from nb and os is not distinct from ns)"""


@query("cdc_diff", DIFF + " select * from ch")
def _(t):
    return R.diff(t.old_list, t.new_list, "key", "name", ["brand", "size"])


@query("cdc_merge", "select coalesce(n.key, o.key) as key, case when n.key is null then o.name else n.name end as name, case when n.key is null then o.brand else n.brand end as brand, case when n.key is null then o.size else n.size end as size, case when n.key is null then 'WITHDRAWN' else 'ACTIVE' end as status, case when n.key is not null then 'run-2' end as last_seen from old_list o full join new_list n on o.key = n.key")
def _(t):
    return R.apply_changes(t.old_list, t.new_list, "key", "run-2")


@query("cdc_history", DIFF + " select key, change, case when old_value is not null then '{\"' || field || '\":\"' || old_value || '\"}' end as old_json, case when new_value is not null then '{\"' || field || '\":\"' || new_value || '\"}' end as new_json, 'run-2' as run from ch where change <> 'MATCHED'")
def _(t):
    rows = R.history(R.diff(t.old_list, t.new_list, "key", "name", ["brand", "size"]), "key", "run-2")
    path = scratch(t.spark, "cdc-history")
    append_run(rows, path, "run-2")
    append_run(rows, path, "run-2")  # adds nothing
    return read_log(t.spark, path, rows.schema)


METRICS = ", m as (select 'row_count' as metric, count(*)::double as actual from persons union all select 'duplicate_keys', (count(nation_id) - count(distinct nation_id))::double from persons union all select 'forbidden', count(*) filter (where balance < 0)::double from persons union all select 'coverage_title', round(100 * avg((title is not null)::int), 4) from persons)".replace("count(*) filter (where balance < 0)::double", "(count(*) filter (where balance < 0))::double")


def _metrics(t):
    return G.validate_list(t.persons, "nation_id", ["title"], F.col("balance") < 0)


@query("qg_metrics", METRICS + " select * from m")
def _(t):
    return _metrics(t)


@query("qg_gate", METRICS + ", r(id, metric, low, high, blocking) as (values (1, 'row_count', 100.0::double, null::double, true), (2, 'duplicate_keys', null, 0.0, true), (3, 'coverage_title', 75.0, 100.0, false), (4, 'no_such_metric', 0.0, 1.0, false)) select id, r.metric, low, high, actual, coalesce(actual >= coalesce(low, '-inf'::double) and actual <= coalesce(high, 'inf'::double), false) as passed, blocking from r left join m on m.metric = r.metric")
def _(t):
    return G.gate(_metrics(t), [G.Rule("row_count", 100), G.Rule("duplicate_keys", None, 0), G.Rule("coverage_title", 75, 100, False), G.Rule("no_such_metric", 0, 1, False)])


@query("qg_pit_integrity", ASOF.format("<").replace("select lead_id, contacted, firm_id, month, aum from j where k = 1", ", a as (select * from j where k = 1) select count(*) as rows, count(*) filter (where month > contacted) as future_snapshots, count(*) filter (where day(month) <> 1) as odd_dates, count(*) filter (where contacted - month < 0) as negative_days, count(*) filter (where month is null) as no_snapshot from a"))
def _(t):
    return G.pit_checks(_asof(t, True), "contacted", "month")


@query("qg_null_and_rows", "select true as rows_kept, 'title' as column_name, round(avg((title is null)::int), 6) as null_rate, round(avg((title is null)::int), 6) <= 0.1 as passed from persons union all select true, 'balance', round(avg((balance is null)::int), 6), round(avg((balance is null)::int), 6) <= 0.1 from persons")
def _(t):
    return G.feature_checks(t.raw("customer"), t.persons, ["title", "balance"], 0.1)


@query("qg_leakage", "select 'amount' as feature, round(abs(corr(amount, target)), 6) as abs_corr, round(abs(corr(amount, target)), 6) <= 0.7 as passed from outcomes union all select 'converted_at_all', round(abs(corr((converted is not null)::int, target)), 6), round(abs(corr((converted is not null)::int, target)), 6) <= 0.7 from outcomes")
def _(t):
    rows = t.outcomes.withColumn("converted_at_all", F.col("converted").isNotNull().cast("int"))
    return G.leakage_checks(rows, ["amount", "converted_at_all"], "target")


@query("qg_recompute", "select 'n_chars' as column_name, count(*) filter (where n_chars is distinct from length(text)) as differs from documents")
def _(t):
    docs = t.raw("documents")
    return G.recomputed(docs.select("doc_id", "n_chars"), docs.select("doc_id", F.length("text").cast("long").alias("again")), "doc_id", {"n_chars": "again"})


@query("qg_duplicates", "select p_name, count(*) as n from part group by 1 having count(*) > 1")
def _(t):
    return G.duplicates(t.raw("part"), ["p_name"])
