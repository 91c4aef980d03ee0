"""Queries: splits, models and evaluation."""

from datetime import date

from pyspark.sql import functions as F

from leadloom.operators import backtest as B
from leadloom.operators import evaluation as E
from leadloom.operators import models as M
from leadloom.operators import tiers as T
from leadloom.plans.registry import query
from leadloom.sources.shared import checkpointed


@query("sp_date_split", "select lead_id, case when contacted <= date '1999-12-31' then 'TRAIN' when contacted < date '2000-02-01' then 'GAP' when contacted <= date '2000-12-31' then 'TEST' else 'LATER' end as split from leads")
def _(t):
    return t.leads.select("lead_id", E.date_split(F.col("contacted"), date(1999, 12, 31), date(2000, 2, 1), date(2000, 12, 31)).alias("split"))


PCT = """, d as (select contacted as d, count(*) as c from leads group by 1), u as (select d, sum(c) over (order by d) as cum, sum(c) over () as tot from d),
b as (select min(d) filter (where cum >= tot * 0.6::double) as b1, min(d) filter (where cum >= tot * 0.8::double) as b2 from u)"""


@query("sp_pct_split_gap", PCT + " select lead_id, case when contacted <= b1 then 'TRAIN' when contacted <= b1 + 30 then 'GAP' when contacted <= b2 then 'VALIDATION' when contacted <= b2 + 30 then 'GAP' else 'TEST' end as split from leads, b")
def _(t):
    return E.pct_split(t.leads.select("lead_id", "contacted"), "contacted", (0.6, 0.8), 30).select("lead_id", "split")


FOLDS = ", fo as (select lead_id, contacted, ntile(5) over (order by contacted, lead_id) as fold from leads)"


@query("sp_time_folds", FOLDS + " select lead_id, fold from fo")
def _(t):
    return E.time_folds(t.leads.select("lead_id", "contacted"), "contacted", "lead_id", 5).select("lead_id", "fold")


@query("sp_blocked_folds", FOLDS + ", st as (select fold as test_fold, min(contacted) as s from fo where fold > 1 group by 1), r as (select lead_id, test_fold, case when fold = test_fold then 'test' when s - contacted >= 30 then 'train' end as role from fo, st) select * from r where role is not null")
def _(t):
    return E.blocked_folds(t.leads.select("lead_id", "contacted"), "contacted", "lead_id", 5, 30).select("lead_id", "test_fold", "role")


@query("sp_sample", ", r as (select lead_id, row_number() over (order by md5(lead_id::varchar || ':7'), lead_id) as k from leads) select lead_id, case when k <= 100 then 100 when k <= 500 then 500 else 2500 end::bigint as sample_size from r where k <= 2500")
def _(t):
    return E.nested_samples(t.leads.select("lead_id"), "lead_id", [100, 500, 2500], 7)


@query("sp_split_checks", ", s as (select *, case when contacted < date '2000-01-01' then 'TRAIN' else 'TEST' end as split from outcomes) select split, count(*) as n, min(contacted) as first, max(contacted) as last, round(avg(target), 6) as rate from s group by 1")
def _(t):
    return E.check_split(t.outcomes.withColumn("split", F.when(F.col("contacted") < F.lit(date(2000, 1, 1)), "TRAIN").otherwise("TEST")), "split", "contacted", "target")


AUC = """, p as (select sum(target) as p, count(*) - sum(target) as n from {0}), r as (select target, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0::double as r from {0}),
roc as (select (sum(r) filter (where target = 1) - max(p.p) * (max(p.p) + 1) / 2) / (max(p.p) * max(p.n))::double as a from r, p),
c as (select score, sum(target) as pos, count(*) as k from {0} group by 1), cc as (select pos, sum(pos) over (order by score desc) as tp, sum(k) over (order by score desc) as seen from c),
ap as (select sum(pos * tp / seen::double) / sum(pos) as ap from cc)"""


@query("ev_auc", AUC.format("outcomes") + " select round(a, 6) as auc_roc, round(ap, 6) as auc_pr, (select count(*) from outcomes) as n, (select sum(target) from outcomes)::bigint as positives from roc, ap")
def _(t):
    return E.auc(t.outcomes, "target", "score")


UNI = "select '{f}' as feature, round(greatest(a, 1 - a), 6) as auc from (select (sum(r) filter (where target = 1) - max(p) * (max(p) + 1) / 2) / (max(p) * max(n))::double as a from (select target, rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0::double as r, sum(target) over () as p, count(*) over () - sum(target) over () as n from outcomes))"


@query("ev_univariate_auc", UNI.format(f="amount", c="amount") + " union all " + UNI.format(f="person_id", c="person_id"))
def _(t):
    return E.univariate_auc(t.outcomes, "target", ["amount", "person_id"])


@query("ev_deciles", ", d as (select *, ntile(10) over (order by score desc, lead_id) as decile from outcomes) select decile, count(*) as n, sum(target)::bigint as conversions, round(avg(score), 6) as mean_score, round(avg(target), 6) as rate, round(avg(target) / (select avg(target) from outcomes), 4) as lift from d group by 1")
def _(t):
    return E.deciles(t.outcomes, "target", "score", "lead_id")


@query("ev_top_pct_lift", ", q as (select quantile_cont(score, 0.9) as cut from outcomes) select count(*) filter (where score >= cut) as n_top, round(avg(target) filter (where score >= cut), 6) as top_rate, round(avg(target), 6) as base_rate, round(avg(target) filter (where score >= cut) / avg(target), 6) as lift from outcomes, q")
def _(t):
    return E.top_lift(t.outcomes, "target", "score")


BOOT = """, e as (select doc_id as k, target as y, score as s, b from scored, (select unnest(generate_series(1, 1000)) as b)),
x1 as (select *, (k % 2147483647 * 48271 + b * 69621 + 7) % 2147483647 as x from e),
x2 as (select * exclude (x), ((x * x) % 2147483647 * 48271 + k % 2147483647) % 2147483647 as x from x1),
x3 as (select * exclude (x), (x * x + b) % 2147483647 as x from x2), x4 as (select * exclude (x), (x * x + 7) % 2147483647 as x from x3),
w as (select *, len(list_filter([0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119], lambda p: floor(p::double * 2147483647) <= x)) as w from x4),
c as (select b, s, sum(w) as n, sum(w * y) as pos from w group by 1, 2 having sum(w) > 0),
r as (select *, sum(n) over (partition by b order by s) as upto, (sum(n) over (partition by b) - 1) * 0.9::double as place from c),
g as (select b, min(place) as place, min(s) filter (where upto > floor(place)) as lo, min(s) filter (where upto > ceil(place)) as hi from r group by 1),
l as (select r.b, (sum(pos) filter (where s >= cut) / (sum(n) filter (where s >= cut))::double) / (sum(pos) / sum(n)::double) as lift
  from r join (select b, lo + (hi - lo) * (place - floor(place)) as cut from g) g on r.b = g.b group by 1)"""


@query("ev_bootstrap", BOOT + " select count(lift) as resamples, round(quantile_cont(lift, 0.025), 6) as low, round(quantile_cont(lift, 0.5), 6) as mid, round(quantile_cont(lift, 0.975), 6) as high, round(avg((lift <= 1)::int), 6) as p_value from l")
def _(t):
    return E.bootstrap_lift(t.scored, "target", "score", "doc_id")


QUANTILES = ", ".join(f"quantile_cont(amount, {i / 10})" for i in range(1, 10))
IV = f""", q as (select list_sort(list_distinct([{QUANTILES}])) as cuts from outcomes),
b as (select len(list_filter(cuts, lambda e: e < amount)) as bin, count(*) as n, sum(target)::bigint as pos from outcomes, q group by 1),
w as (select bin, n, pos, greatest(pos / (sum(pos) over ())::double, 0.0001::double) as g, greatest((n - pos) / (sum(n - pos) over ())::double, 0.0001::double) as h from b)"""


@query("ev_iv_woe", IV + " select bin, n, pos, round(ln(g / h), 6) as woe, round((g - h) * ln(g / h), 6) as iv_part from w")
def _(t):
    return E.iv_bins(t.outcomes, "amount", "target")


@query("ev_iv_class", IV + ", i as (select round(sum(round((g - h) * ln(g / h), 6)), 4) as iv from w) select 'amount' as feature, iv, case when iv < 0.02 then 'none' when iv < 0.1 then 'weak' when iv < 0.3 then 'medium' when iv < 0.5 then 'strong' else 'suspicious' end as iv_class from i")
def _(t):
    return E.information_value(t.outcomes, "amount", "target")


@query("ev_vif_corr", ", c as (select corr(l_quantity, l_extendedprice) as a, corr(l_quantity, l_discount) as b, corr(l_extendedprice, l_discount) as c from lineitem), d as (select *, 1 + 2 * a * b * c - a * a - b * b - c * c as det from c) select unnest(['l_quantity', 'l_extendedprice', 'l_discount']) as feature, unnest([round((1 - c * c) / det, 4), round((1 - b * b) / det, 4), round((1 - a * a) / det, 4)]) as vif from d")
def _(t):
    return E.vif(t.raw("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query("ev_ece_brier", ", b as (select least(floor(score * 10), 9) as b, count(*) as n, sum(score) as sp, sum(target) as sy, sum((score - target) * (score - target)) as sq, sum(-(target * ln(least(greatest(score, 1e-15), 1 - 1e-15)) + (1 - target) * ln(1 - least(greatest(score, 1e-15), 1 - 1e-15)))) as sl from outcomes group by 1) select round(sum(abs(sp - sy)) / sum(n), 6) as ece, round(sum(sq) / sum(n), 6) as brier, round(sum(sl) / sum(n), 6) as log_loss from b")
def _(t):
    return E.calibration_error(t.outcomes, "target", "score")


@query("ev_ks", ", c as (select score, sum(target) as pos, count(*) as k from outcomes group by 1), cc as (select sum(pos) over (order by score desc) as tp, sum(k - pos) over (order by score desc) as fp, sum(pos) over () as p, sum(k - pos) over () as n from c) select round(max(abs(tp / p::double - fp / n::double)), 6) as ks from cc")
def _(t):
    return E.ks(t.outcomes, "target", "score")


@query("ev_confusion", ", c as (select count(*) filter (where score >= 0.5 and target = 1) as tp, count(*) filter (where score >= 0.5 and target = 0) as fp, count(*) filter (where score < 0.5 and target = 1) as fn from outcomes) select *, round(tp / (tp + fp)::double, 6) as precision, round(tp / (tp + fn)::double, 6) as recall, round(2 * tp / (2 * tp + fp + fn)::double, 6) as f1 from c")
def _(t):
    return E.prf(t.outcomes, "target", "score")


@query("ev_threshold_table", ", h as (select unnest([0.25::double, 0.5, 0.75]) as threshold) select threshold, count(*) filter (where score >= threshold) as leads, (sum(target) filter (where score >= threshold))::bigint as conversions, round(100.0::double * sum(target) filter (where score >= threshold) / count(*) filter (where score >= threshold), 4) as per_100 from outcomes, h group by 1")
def _(t):
    return E.threshold_table(t.outcomes, "target", "score", [0.25, 0.5, 0.75])


@query("ev_wilson", ", g as (select source, count(*) as n, sum(target) as k from outcomes group by 1 having count(*) >= 50), p as (select *, k / n::double as p from g) select source, n, k::bigint as k, round(p, 6) as rate, round((p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0::double * n * n)) / (1 + 1.96 * 1.96 / n), 6) as low, round((p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0::double * n * n)) / (1 + 1.96 * 1.96 / n), 6) as high from p")
def _(t):
    return E.wilson(t.outcomes, "source", "target")


@query("ev_fisher", """, c as (select count(*) filter (where source = '1-URGENT' and target = 1) as a1, count(*) filter (where source = '1-URGENT' and target = 0) as a0, count(*) filter (where source = '5-LOW' and target = 1) as b1, count(*) filter (where source = '5-LOW' and target = 0) as b0 from outcomes),
k as (select unnest(generate_series(a1, least(a1 + a0, a1 + b1))) as k, a1 + a0 as r, a1 + b1 as h, a1 + a0 + b1 + b0 as n from c),
q as (select sum(exp(lgamma(h + 1) - lgamma(k + 1) - lgamma(h - k + 1) + lgamma(n - h + 1) - lgamma(r - k + 1) - lgamma(n - h - r + k + 1) - lgamma(n + 1) + lgamma(r + 1) + lgamma(n - r + 1))) as p from k where r - k <= n - h)
select c.*, round((a1 * b0) / (a0 * b1)::double, 6) as odds_ratio, round(least(p, 1), 6) as p_value from c, q""")
def _(t):
    return E.fisher(t.outcomes, "source", "target", "1-URGENT", "5-LOW")


@query("ev_segments", ", r as (select source, target, rank() over (partition by source order by score) + (count(*) over (partition by source, score) - 1) / 2.0::double as r from outcomes) select source, count(*) as rows, round(avg(target), 6) as rate, round((sum(r) filter (where target = 1) - sum(target) * (sum(target) + 1) / 2) / (sum(target) * (count(*) - sum(target)))::double, 6) as auc from r group by 1")
def _(t):
    return E.segment_metrics(t.outcomes, ["source"], "target", "score")


BACKTEST = """, w(win, lo, hi) as (values ('h1_1996', date '1996-01-01', date '1996-06-30'), ('h2_1996', date '1996-07-01', date '1996-12-31'), ('y_1996', date '1996-01-01', date '1996-12-31'), ('y_1998', date '1998-01-01', date '1998-12-31')),
a as (select win, lo, lead_id, person_id, target from outcomes join w on contacted between lo and hi),
now as (select * from (select win, lead_id, firm_id, start_date, row_number() over (partition by win, lead_id order by start_date desc, spell_id desc) as k from a join spells s using (person_id) where start_date <= lo and (end_date is null or end_date >= lo)) where k = 1),
career as (select win, lead_id, min(start_date) as since, count(distinct firm_id) as firms from a join spells s using (person_id) where start_date < lo group by 1, 2),
net as (select w.win, firm_id, count(*) filter (where start_date >= lo - interval 12 month and start_date < lo) - count(*) filter (where end_date >= lo - interval 12 month and end_date < lo) as net from spells, w group by 1, 2),
f as (select a.win, a.target, floor(((year(lo) - year(start_date)) * 12 + month(lo) - month(start_date)) / 12.0) as ten, year(lo) - year(since) as exper, coalesce(firms, 0) as firms, coalesce(net, 0) as net
  from a left join now using (win, lead_id) left join career c using (win, lead_id) left join net on net.win = a.win and net.firm_id = now.firm_id),
g as (select win as "window", case when ten between 1 and 4 and net < 0 then 'T1' when firms >= 5 then 'T2' when net < 0 then 'T3' when exper >= 6 then 'T4' else 'STANDARD' end as tier, count(*) as n, sum(target)::bigint as conversions from f group by 1, 2)"""
BACK_WINDOWS = {"h1_1996": (date(1996, 1, 1), date(1996, 6, 30)), "h2_1996": (date(1996, 7, 1), date(1996, 12, 31)), "y_1996": (date(1996, 1, 1), date(1996, 12, 31)), "y_1998": (date(1998, 1, 1), date(1998, 12, 31))}


@query("ev_backtest", BACKTEST + ' select *, round(conversions / n::double, 6) as rate, round((conversions / n::double) / (sum(conversions) over (partition by "window") / sum(n) over (partition by "window")), 4) as lift from g')
def _(t):
    leads = t.outcomes.select("lead_id", "person_id", "contacted", "target")
    return B.backtest(leads, t.spells, BACK_WINDOWS, lambda df: T.assign_tier(df, T.FOUR_TIERS), "target")


@query("ev_signal_combos", ", s as (select (amount > 200000)::int as large, (isodow(contacted) >= 6)::int as weekend, (person_id % 3 = 0)::int as third, target from outcomes) select large, weekend, third, count(*) as n, sum(target)::bigint as conversions, round(avg(target), 6) as rate, round(avg(target) / (select avg(target) from outcomes), 4) as lift from s group by 1, 2, 3 having count(*) >= 100")
def _(t):
    s = t.outcomes.select((F.col("amount") > 200000).cast("int").alias("large"), (F.weekday("contacted") >= 5).cast("int").alias("weekend"), (F.col("person_id") % 3 == 0).cast("int").alias("third"), "target")
    return E.signal_combos(s, ["large", "weekend", "third"], "target", 100)


@query("ev_importance_rank", ", a as (select source as feature, row_number() over (order by avg(target) desc, source) as r from outcomes group by source), b as (select source as feature, row_number() over (order by count(*) desc, source) as r from outcomes group by source) select feature, round(avg(r), 4) as mean_rank, count(*) as lists from (select * from a union all select * from b) group by 1")
def _(t):
    a = t.outcomes.groupBy(F.col("source").alias("feature")).agg(F.avg("target").alias("importance"))
    b = t.outcomes.groupBy(F.col("source").alias("feature")).agg(F.count(F.lit(1)).cast("double").alias("importance"))
    return E.combine_ranks(a, b)


@query("ev_signal_decay", "select date_trunc('month', contacted)::date as month, count(*) filter (where amount > 200000) as n_on, round(avg(target) filter (where amount > 200000), 6) as rate_on, round(avg(target) filter (where not amount > 200000), 6) as rate_off, round((avg(target) filter (where amount > 200000)) / nullif(avg(target) filter (where not amount > 200000), 0), 4) as lift from outcomes group by 1")
def _(t):
    return E.signal_decay(t.outcomes, "contacted", F.col("amount") > 200000, "target")


SIG = "select source, '{n}' as signal, count(*) filter (where {c}) as n_on, count(*) filter (where not ({c})) as n_off, round(avg(target) filter (where {c}), 6) as rate_on, round(avg(target) filter (where not ({c})), 6) as rate_off, round((avg(target) filter (where {c})) / nullif(avg(target) filter (where not ({c})), 0), 4) as lift from outcomes group by 1"


@query("ev_signal_test", SIG.format(n="large", c="amount > 200000") + " union all " + SIG.format(n="third", c="person_id % 3 = 0"))
def _(t):
    return E.signal_test(t.outcomes, {"large": F.col("amount") > 200000, "third": F.col("person_id") % 3 == 0}, "source", "target")


def _training(t):
    docs = t.scored.withColumn("length_log", F.log1p("n_chars")).withColumn("lang_n", F.length("lang"))
    text = t.raw("documents").select("doc_id", (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>!]", ""))).alias("symbols"), F.size(F.split("text", r"\s+")).alias("words"))
    rows = docs.join(text, "doc_id").withColumn("symbol_rate", F.col("symbols") / F.col("words"))
    return rows.withColumn("split", F.when(F.col("doc_id") % 5 == 0, "TEST").when(F.col("doc_id") % 5 == 1, "VALIDATION").otherwise("TRAIN"))


FEATURES = ["length_log", "lang_n", "symbol_rate", "words"]


@query("ml_train")
def _(t):
    rows = _training(t)
    model = M.train(rows.where("split = 'TRAIN'"), FEATURES, "target", validation=rows.where("split = 'VALIDATION'"))
    return E.auc(M.score(model, rows.where("split = 'TEST'"), FEATURES), "target", "model_score")


@query("ml_baseline")
def _(t):
    rows = _training(t)
    model = M.train_lr(rows.where("split = 'TRAIN'"), FEATURES, "target")
    return E.auc(M.score(model, rows.where("split = 'TEST'"), FEATURES), "target", "model_score")


@query("ml_tune")
def _(t):
    grid = [{"maxDepth": 2, "maxIter": 5}, {"maxDepth": 4, "maxIter": 5}]
    return M.tune(checkpointed(_training(t)).withColumn("fold", F.col("doc_id") % 3), FEATURES, "target", "fold", grid, key="doc_id", shares=(0.5, 1.0))


@query("ml_learning_curve")
def _(t):
    rows = checkpointed(_training(t))
    return M.learning_curve(rows.where("split = 'TRAIN'"), rows.where("split = 'VALIDATION'"), FEATURES, "target", "doc_id", (0.25, 0.5, 1.0), maxDepth=2, maxIter=5)


@query("ml_score_batch")
def _(t):
    rows = _training(t)
    model = M.train_lr(rows.where("split = 'TRAIN'"), FEATURES, "target")
    return M.score_batch(model, rows, FEATURES).select("doc_id", "model_score", "percentile", "is_bottom", "is_top")


@query("ml_drivers", """, s as (select avg(l_quantity) as mq, stddev_samp(l_quantity) as sq, avg(l_discount) as md, stddev_samp(l_discount) as sd, avg(l_tax) as mt, stddev_samp(l_tax) as st from lineitem),
v as (select l_orderkey, l_linenumber, (l_quantity - mq) / sq * 0.5 as q, (l_discount - md) / sd * 0.3 as d, (l_tax - mt) / st * 0.2 as x from lineitem, s),
u as (select *, list_sort([{'o': -abs(q), 'name': 'l_quantity'}, {'o': -abs(d), 'name': 'l_discount'}, {'o': -abs(x), 'name': 'l_tax'}]) as y from v)
select l_orderkey, l_linenumber, y[1].name as driver_1, y[2].name as driver_2 from u""")
def _(t):
    rows = t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return M.drivers(rows, {"l_quantity": 0.5, "l_discount": 0.3, "l_tax": 0.2}, 2).select("l_orderkey", "l_linenumber", "driver_1", "driver_2")


@query("ml_calibrate")
def _(t):
    return M.calibrate(t.outcomes.select("score", "target")).select("method", "brier")


@query("ml_lookup", ", b as (select least(floor(score * 100), 99)::int as bin, avg(target) as rate, count(*) as n from outcomes where lead_id % 2 = 0 group by 1) select lead_id, bin, round(rate, 6) as calibrated from outcomes join b on b.bin = least(floor(score * 100), 99)::int where lead_id % 2 = 1")
def _(t):
    table = M.lookup(t.outcomes.where("lead_id % 2 = 0"), "score", "target", 100)
    return M.apply_lookup(t.outcomes.where("lead_id % 2 = 1").select("lead_id", "score"), table, "score", 100).select("lead_id", "bin", F.round("calibrated", 6).alias("calibrated"))
