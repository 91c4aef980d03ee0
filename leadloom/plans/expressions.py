"""Queries: cleaning, predicates, flags and scalar functions."""

from datetime import date

from pyspark.sql import functions as F

from leadloom.functions import dates as D
from leadloom.functions import numbers as N
from leadloom.functions import text as X
from leadloom.functions.alike import similarity
from leadloom.operators import filters as O
from leadloom.plans.adapters import AS_OF
from leadloom.plans.alike import alike
from leadloom.plans.registry import query


@query("clean_external_id", "select c_custkey as id, try_cast(regexp_replace(c_name || case when c_custkey % 9 = 0 then '99999999999999' else '' end, '[^0-9]', '', 'g') as bigint) as clean from customer")
def _(t):
    dirty = F.concat("c_name", F.when(F.col("c_custkey") % 9 == 0, "99999999999999").otherwise(""))
    return t.raw("customer").select(F.col("c_custkey").alias("id"), X.digits_id(dirty).alias("clean"))


@query("clean_money", "select c_custkey as id, try_cast(regexp_replace('$ ' || c_acctbal::varchar || ' %', '[$,% ]', '', 'g') as double) as clean from customer")
def _(t):
    return t.raw("customer").select(F.col("c_custkey").alias("id"), X.money(F.concat(F.lit("$ "), F.col("c_acctbal").cast("string"), F.lit(" %"))).alias("clean"))


@query("clean_bucketed_count", "select p_partkey as id, case when p_size < 5 then 2 when p_size % 10 = 0 then null else p_size end as clean from part")
def _(t):
    raw = F.when(F.col("p_size") < 5, "< 5").when(F.col("p_size") % 10 == 0, "").otherwise(F.col("p_size").cast("string"))
    return t.raw("part").select(F.col("p_partkey").alias("id"), X.count_or_midpoint(raw).alias("clean"))


@query("clean_yes_no", "select event_id as id, case when event_id % 3 = 0 then 1 when event_id % 3 = 1 then 0 end as clean from events")
def _(t):
    raw = F.when(F.col("event_id") % 3 == 0, " Yes").when(F.col("event_id") % 3 == 1, "NO")
    return t.raw("events").select(F.col("event_id").alias("id"), X.yes_no(raw).alias("clean"))


@query("cast_numeric_if_majority", "select l_orderkey, l_linenumber, try_cast(l_quantity::varchar as double) as qty, l_returnflag as flag from lineitem")
def _(t):
    raw = t.raw("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("string").alias("qty"), F.col("l_returnflag").alias("flag"))
    return O.auto_numeric(raw, ["qty", "flag"])


@query("proj_except", "select * exclude (balance, licences) from persons")
def _(t):
    return O.drop_cols(t.persons, ["balance", "licences"])


@query("proj_pii_drop", "select person_id, nation_id, title from persons")
def _(t):
    return O.drop_pii(t.persons, {"names": ["name"], "money": ["balance"], "licences": ["licences"]})


@query("proj_coalesce_dupes", "select c_custkey as id, c_acctbal as bal, c_nationkey as nat_x, c_custkey % 7 as nat_y from customer")
def _(t):
    doubled = t.raw("customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal_x"), (F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal") * 2)).alias("bal_y"),
        F.col("c_nationkey").alias("nat_x"), (F.col("c_custkey") % 7).alias("nat_y"),
    )
    return O.dedupe_columns(doubled)


@query("flt_valid_lead", "select * from leads where contacted between date '1996-01-01' and date '2000-12-31' and not coalesce(upper(source) like '%LOW%', false)")
def _(t):
    return O.valid_leads(t.leads, date(1996, 1, 1), date(2000, 12, 31), company="source", own="low")


@query("flt_firm_pattern", "select * from firms where not (upper(firm_name) like '%1' or upper(firm_name) like '%00003%')")
def _(t):
    return O.exclude_patterns(t.firms, "firm_name", ["%1", "%00003%"])


@query("flt_firm_key", "select * from firms where firm_id not in (select l_suppkey from lineitem where l_quantity > 49.5)")
def _(t):
    return O.exclude_keys(t.firms, t.raw("lineitem").where("l_quantity > 49.5").select(F.col("l_suppkey").alias("firm_id")), "firm_id")


@query("flt_title", "select * from persons where title is null or not regexp_matches(lower(title), '(^|[^\\p{L}\\p{N}_])(household|machinery)($|[^\\p{L}\\p{N}_])')")
def _(t):
    return O.exclude_titles(t.persons, ["household", "machinery"])


@query("flt_title_null_dropped", "select * from persons where title is not null and not regexp_matches(lower(title), '(^|[^\\p{L}\\p{N}_])(household|machinery)($|[^\\p{L}\\p{N}_])')")
def _(t):
    return O.exclude_titles(t.persons, ["household", "machinery"], keep_null_title=False)


@query("flt_producing_override", "select person_id from persons where balance > 5000 or coalesce(title = 'BUILDING', false)")
def _(t):
    return t.persons.where(O.passes_producing(F.col("balance") > 5000, F.col("title"), ["building"])).select("person_id")


@query("flt_right_censored", "select * from leads where date '2001-08-01' - contacted >= 43")
def _(t):
    return O.mature(t.leads, AS_OF, 43)


@query("flt_contact_window", ", l as (select person_id, max(contacted) as last_contact from leads group by 1) select * from l where date '2001-08-01' - last_contact between 90 and 730")
def _(t):
    return O.contact_window(t.leads.groupBy("person_id").agg(F.max("contacted").alias("last_contact")), AS_OF)


MOVES = ", m as (select person_id, max(start_date) as moved from spells group by 1), c as (select person_id, max(converted) as closed from leads group by 1), j as (select * from c left join m using (person_id))"


@query("flt_recent_mover", MOVES + " select * from j where not coalesce(moved > closed and date '2001-08-01' - moved < 730, false)")
def _(t):
    moved = t.spells.groupBy("person_id").agg(F.max("start_date").alias("moved"))
    closed = t.leads.groupBy("person_id").agg(F.max("converted").alias("closed"))
    return O.exclude_recent_movers(closed.join(moved, "person_id", "left"), AS_OF, start="moved", closed="closed")


@query("flt_turnover_cap", "select firm_id, count(end_date) * 100.0::double / count(*) as turnover_pct from spells group by 1 having count(end_date) * 100.0::double / count(*) < 77")
def _(t):
    rate = t.spells.groupBy("firm_id").agg((F.count("end_date") * 100.0 / F.count(F.lit(1))).alias("turnover_pct"))
    return O.turnover_below(rate, 77.0)


@query("flg_wirehouse", "select firm_id, case when upper(firm_name) like '%7' or upper(firm_name) like '%SUPPLIER#00000001%' then 1 else 0 end as is_wirehouse from firms")
def _(t):
    return t.firms.select("firm_id", O.flag_patterns(F.col("firm_name"), ["%7", "%supplier#00000001%"]).alias("is_wirehouse"))


@query("flg_certifications", "select person_id, 0 as is_cfp, 0 as is_cfa, case when licences like '%Series 7%' then 1 else 0 end as has_series_7, case when licences like '%Series 65%' then 1 else 0 end as has_series_65, case when licences like '%Series 65%' and licences not like '%Series 7%' then 1 else 0 end as series_65_only from persons")
def _(t):
    return t.persons.select("person_id", *[c.alias(n) for n, c in O.cert_flags(F.col("licences"), F.col("name"), F.col("title")).items()])


@query("flg_title_class", "select person_id, case when title is null then 'none' when title = 'MACHINERY' then 'excluded' when title = 'AUTOMOBILE' then 'high_value' when title = 'BUILDING' then 'owner' else 'other' end as title_class from persons")
def _(t):
    return t.persons.select("person_id", O.title_class(F.col("title"), ["automobile"], ["building"], ["machinery"]).alias("title_class"))


@query("flg_contactability", "select person_id, case when title <> '' then 1 else 0 end as has_email, case when licences <> '[]' then 1 else 0 end as has_profile, 1 as has_firm_data from persons")
def _(t):
    profile = F.when(F.col("licences") != "[]", F.col("licences")).otherwise(F.lit(" "))
    return t.persons.select("person_id", *[c.alias(n) for n, c in O.contact_flags(F.col("title"), profile, F.col("nation_id")).items()])


@query("flg_missingness", "select lead_id, converted, source, (converted is null)::int as converted_is_missing, (source is null)::int as source_is_missing, (converted is null)::int + (source is null)::int as missing_count from leads")
def _(t):
    return O.missing_flags(t.leads.select("lead_id", "converted", "source"), ["converted", "source"])


@query("fn_date_diff_month", "select lead_id, date_diff('month', contacted, converted) as months from leads")
def _(t):
    return t.leads.select("lead_id", D.month_diff(F.col("converted"), F.col("contacted")).alias("months"))


@query("fn_date_diff_day_year", "select lead_id, converted - contacted as days, year(date '2001-08-01') - year(contacted) as years, round((date '2001-08-01' - contacted) / 365.0::double, 6) as fractional from leads")
def _(t):
    now = F.lit(AS_OF)
    return t.leads.select("lead_id", D.day_diff(F.col("converted"), F.col("contacted")).alias("days"), D.year_diff(now, F.col("contacted")).alias("years"), F.round(D.years_between(now, F.col("contacted")), 6).alias("fractional"))


@query("fn_date_arith", "select lead_id, contacted - 90 as d, (contacted - interval 1 month)::date as m, (contacted + interval 2 year)::date as y from leads")
def _(t):
    c = F.col("contacted")
    return t.leads.select("lead_id", D.shift(c, -90, "day").alias("d"), D.shift(c, -1, "month").alias("m"), D.shift(c, 2, "year").alias("y"))


@query("fn_date_trunc", "select lead_id, date_trunc('month', contacted)::date as m0, (date_trunc('month', contacted) - interval 1 month)::date as m1 from leads")
def _(t):
    return t.leads.select("lead_id", D.month_start(F.col("contacted")).alias("m0"), D.month_start(F.col("contacted"), 1).alias("m1"))


@query("fn_date_parts", "select lead_id, year(contacted) as y, month(contacted) as m, isodow(contacted) as dow, isodow(contacted) >= 6 as weekend from leads")
def _(t):
    c = F.col("contacted")
    return t.leads.select("lead_id", F.year(c).alias("y"), F.month(c).alias("m"), D.iso_dow(c).alias("dow"), D.is_weekend(c).alias("weekend"))


@query("fn_date_parse_format", "select lead_id, strftime(contacted, '%Y-%m') as p, case when lead_id % 5 <> 0 then date_trunc('month', contacted)::date end as d from leads")
def _(t):
    p = D.period(F.col("contacted"))
    return t.leads.select("lead_id", p.alias("p"), D.parse_period(F.when(F.col("lead_id") % 5 == 0, "n/a").otherwise(p)).alias("d"))


@query("fn_regex_replace", "select c_custkey as id, regexp_replace(c_name, '[^0-9]', '', 'g') as digits from customer")
def _(t):
    return t.raw("customer").select(F.col("c_custkey").alias("id"), X.strip(F.col("c_name"), "[^0-9]").alias("digits"))


@query("fn_regex_contains", "select doc_id, regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])(the|und)($|[^\\p{L}\\p{N}_])') as hit from documents")
def _(t):
    return t.raw("documents").select("doc_id", X.has_word(F.col("text"), ["the", "und"]).alias("hit"))


@query("fn_regex_extract_all", "select page_id, len(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1)) as n, array_to_string(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1), '|') as links from pages")
def _(t):
    found = X.extract_all(F.col("html"), 'href="/([^"]*)"')
    return t.raw("pages").select("page_id", F.size(found).alias("n"), F.array_join(found, "|").alias("links"))


@query("fn_like_upper", "select firm_id, upper(firm_name) like '%1' or upper(firm_name) like '%22%' as hit from firms")
def _(t):
    return t.firms.select("firm_id", X.ilike_any(F.col("firm_name"), ["%1", "%22%"]).alias("hit"))


@query("fn_concat_format", "select firm_id, firm_name || ' of ' || nation || ' (' || (firm_id % 100)::varchar || '%)' as label from firms")
def _(t):
    return t.firms.select("firm_id", X.template("%s of %s (%d%%)", F.col("firm_name"), F.col("nation"), F.col("firm_id") % 100).alias("label"))


@query("fn_replace_trim_substr", "select firm_id, trim(replace(firm_name, 'Supplier#', '  ')) as tail, substr(trim('  ' || nation), 1, 3) as zip3 from firms")
def _(t):
    return t.firms.select("firm_id", F.trim(F.replace("firm_name", F.lit("Supplier#"), F.lit("  "))).alias("tail"), X.zip3(F.concat(F.lit("  "), "nation")).alias("zip3"))


@query("fn_split", ", p as (select distinct p_name from part), u as (select p_name, unnest(string_split(replace(p_name, ' ', ' , '), ',')) as x from p) select p_name, trim(x) as token, string_split(p_name, ' ')[1] as first from u")
def _(t):
    p = t.raw("part").select("p_name").distinct()
    return p.select("p_name", F.explode(X.split_list(F.replace("p_name", F.lit(" "), F.lit(" , ")))).alias("token"), X.first_token(F.col("p_name")).alias("first"))


@query("fn_math", "select person_id, abs(balance) as a, least(greatest(balance, 0), 5000) as c, case when balance >= 0 then round(ln(1 + balance), 6) end as l, round(sqrt(abs(balance)), 6) as s from persons")
def _(t):
    b = F.col("balance")
    return t.persons.select("person_id", F.abs(b).alias("a"), N.clamp(b, 0.0, 5000.0).alias("c"), F.round(N.log1(b), 6).alias("l"), F.round(F.sqrt(F.abs(b)), 6).alias("s"))


@query("fn_null", "select person_id, coalesce(title, 'Unknown') as title, nullif(nation_id, 3) as nation, round(balance / nullif(nation_id, 0), 6) as ratio from persons")
def _(t):
    return t.persons.select("person_id", F.coalesce("title", F.lit("Unknown")).alias("title"), F.nullif(F.col("nation_id"), F.lit(3)).alias("nation"), F.round(N.safe_div(F.col("balance"), F.col("nation_id")), 6).alias("ratio"))


@query("fn_json_array", "select person_id, json_array_length(licences) as n, licences->>'$[0]' as first from persons")
def _(t):
    found = X.json_list(F.col("licences"))
    return t.persons.select("person_id", F.size(found).alias("n"), F.get(found, F.lit(0)).alias("first"))


@query("fn_json_build", "select key, '{\"brand\":\"' || brand || '\"}' as change from new_list")
def _(t):
    return t.new_list.select("key", X.change_json(F.lit("brand"), F.col("brand")).alias("change"))


@query("fn_array", "select person_id, array_to_string(list(spell_id order by start_date desc, spell_id desc)[1:3], ',') as newest from spells group by 1")
def _(t):
    # a person's spells are few, so the list of one person is small
    best = F.slice(F.sort_array(F.collect_list(F.struct("start_date", "spell_id")), asc=False), 1, 3)
    return t.spells.groupBy("person_id").agg(best.alias("b")).select("person_id", F.array_join(F.transform("b", lambda x: x["spell_id"].cast("string")), ",").alias("newest"))


@query("fn_bucketise", "select lead_id, case when m < 12 then '0-12' when m < 24 then '12-24' when m < 48 then '24-48' when m < 120 then '48-120' else '120+' end as bucket from (select lead_id, date_diff('month', contacted, date '2001-08-01') as m from leads)")
def _(t):
    return t.leads.select("lead_id", N.bucketise(D.month_diff(F.lit(AS_OF), F.col("contacted")), *N.TENURE_MONTHS).alias("bucket"))


@query("fn_days_bucket", "select lead_id, case when g is null then 'none' when g <= 30 then '0-30 days' when g <= 90 then '31-90 days' when g <= 180 then '91-180 days' when g <= 365 then '181-365 days' else 'over a year' end as label from (select lead_id, converted - contacted as g from leads)")
def _(t):
    return t.leads.select("lead_id", D.gap_label(D.day_diff(F.col("converted"), F.col("contacted"))).alias("label"))


MODES = ("ratio", "token_sort", "token_set", "partial")


@query("fn_string_similarity", ", pr as (select distinct lower(p_name) as nrm, lower(p_type || ' ' || split_part(p_name, ' ', 1)) as rn from part)" + alike("pr", "p") + f" select nrm as a, rn as b, {', '.join(f'round({m}, 6) as {m}' for m in MODES)}, confidence as most from p")
def _(t):
    p = t.raw("part").select(F.lower("p_name").alias("a"), F.lower(F.concat_ws(" ", "p_type", F.split_part("p_name", F.lit(" "), F.lit(1)))).alias("b")).distinct()
    a, b = F.col("a"), F.col("b")
    return p.select("a", "b", *[F.round(similarity(a, b, m), 6).alias(m) for m in MODES], F.round(similarity(a, b, "max"), 6).alias("most"))
