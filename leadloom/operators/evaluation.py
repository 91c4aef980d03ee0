"""Splits and evaluation: ranks, lifts, calibration, tests.

Curves over all rows are first summed by distinct score, then run over in ranges
(see `windows.cumulative`), so no task sees all rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.operators.resampling import weighted_heads
from leadloom.operators.windows import cumulative, ntile, numbered, quantile_values

# ---- splits


def date_split(col: Column, train_end: date, test_start: date, test_end: date) -> Column:
    return F.when(col <= F.lit(train_end), "TRAIN").when(col < F.lit(test_start), "GAP").when(col <= F.lit(test_end), "TEST").otherwise("LATER")


def pct_split(df: DataFrame, by: str, shares: tuple[float, float], gap: int) -> DataFrame:
    """Boundary dates at the shares of the rows; rows within ``gap`` days after one are GAP."""
    day = F.datediff(by, F.lit(date(1970, 1, 1)))
    counts = df.groupBy(F.col(by).alias("_d")).agg(F.count(F.lit(1)).alias("_c")).withColumn("_day", F.datediff("_d", F.lit(date(1970, 1, 1))))
    cum = cumulative(counts, "_day", ["_c"]).withColumnsRenamed({"_c_cum": "_cum", "_c_total": "_total"})
    cut = lambda share: F.min(F.when(F.col("_cum") >= F.col("_total") * share, F.col("_day")))
    bounds = cum.agg(cut(shares[0]).alias("_b1"), cut(shares[1]).alias("_b2"))
    joined = df.crossJoin(F.broadcast(bounds.limit(1)))
    split = (
        F.when(day <= F.col("_b1"), "TRAIN").when(day <= F.col("_b1") + gap, "GAP").when(day <= F.col("_b2"), "VALIDATION").when(day <= F.col("_b2") + gap, "GAP").otherwise("TEST")
    )
    return joined.withColumn("split", split).drop("_b1", "_b2")


def time_folds(df: DataFrame, by: str, key: str, k: int) -> DataFrame:
    """k folds of equal size in time."""
    days = df.withColumn("_day", F.datediff(by, F.lit(date(1970, 1, 1))))
    return ntile(days, k, "_day", [F.col(key)], "fold").drop("_day")


def blocked_folds(df: DataFrame, by: str, key: str, k: int, gap: int) -> DataFrame:
    """For each fold after the first: its rows to test, and those at least ``gap`` days before it to train."""
    folds = time_folds(df, by, key, k)
    starts = folds.groupBy(F.col("fold").alias("test_fold")).agg(F.min(by).alias("_start")).where("test_fold > 1")
    table = starts.agg(F.array_sort(F.collect_list(F.struct("test_fold", "_start"))).alias("_all"))  # k - 1 entries
    rows = folds.crossJoin(F.broadcast(table.limit(1))).select(*folds.columns, F.explode("_all").alias("_t"))
    role = F.when(F.col("fold") == F.col("_t.test_fold"), "test").when(F.datediff("_t._start", by) >= gap, "train")
    return rows.select(*folds.columns, F.col("_t.test_fold").alias("test_fold"), role.alias("role")).where("role is not null")


def _hash_order(key: str, seed: int) -> list[Column]:
    return [F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), F.col(key)]


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in the order of a hash of the key."""
    return df.orderBy(*_hash_order(key, seed)).limit(n)


def nested_samples(df: DataFrame, key: str, sizes: Sequence[int], seed: int) -> DataFrame:
    """The rows of the largest sample with ``sample_size``, the smallest of the sizes whose sample
    holds them: rows are put in the order of a hash of the key, so each sample lies in the next."""
    placed = numbered(df, _hash_order(key, seed), "_place")
    size = F.lit(None).cast("long")
    for n in sorted(sizes, reverse=True):
        size = F.when(F.col("_place") <= n, F.lit(n).cast("long")).otherwise(size)
    return placed.withColumn("sample_size", size).drop("_place").where("sample_size is not null")


def check_split(df: DataFrame, split: str, by: str, target: str) -> DataFrame:
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n"), F.min(by).alias("first"), F.max(by).alias("last"), F.round(F.avg(target), 6).alias("rate"))


# ---- ranking quality


def _curve(df: DataFrame, y: str, s: str) -> DataFrame:
    """By distinct score, highest first: positives and rows so far, and in all."""
    by = df.where(F.col(s).isNotNull()).groupBy(F.col(s).alias("s")).agg(F.sum(y).alias("pos"), F.count(F.lit(1)).alias("n"))
    return cumulative(by, "s", ["pos", "n"], descending=True).withColumnsRenamed({"pos_cum": "tp", "pos_total": "p", "n_cum": "seen", "n_total": "total"})


def auc(df: DataFrame, y: str, s: str) -> DataFrame:
    """AUC-ROC with ties as halves, and average precision; null if a class is missing."""
    c = _curve(df, y, s)
    neg = F.col("n") - F.col("pos")
    higher = F.col("tp") - F.col("pos")
    roc = F.sum(neg * (higher + F.col("pos") / 2)) / F.max(F.col("p") * (F.col("total") - F.col("p")))
    ap = F.sum(F.col("pos") * F.col("tp") / F.col("seen")) / F.max("p")
    both = (F.max("p") > 0) & (F.max("p") < F.max("total"))
    return c.agg(F.when(both, F.round(roc, 6)).alias("auc_roc"), F.when(F.max("p") > 0, F.round(ap, 6)).alias("auc_pr"), F.max("total").alias("n"), F.max("p").alias("positives"))


def univariate_auc(df: DataFrame, y: str, features: Sequence[str]) -> DataFrame:
    """max(auc, 1 - auc) of each feature from rank sums by distinct value."""
    long = df.select(y, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("x")).select(y, "x.*")
    by = long.where("v is not null").groupBy("feature", "v").agg(F.sum(y).alias("pos"), F.count(F.lit(1)).alias("n"))
    sides = by.withColumn("neg", F.col("n") - F.col("pos"))
    run = cumulative(sides, "v", ["neg"], groups=["feature"]).withColumnRenamed("neg_cum", "below")
    a = F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))
    return run.groupBy("feature").agg(F.round(F.greatest(a, 1 - a), 6).alias("auc"))


def deciles(df: DataFrame, y: str, s: str, key: str, n: int = 10) -> DataFrame:
    """Decile 1 holds the highest scores."""
    tiles = ntile(df, n, s, [F.col(key)], "decile", descending=True)
    groups = tiles.groupBy("decile").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("conversions"), F.round(F.avg(s), 6).alias("mean_score"))
    every = Window.partitionBy()
    rate, overall = F.col("conversions") / F.col("n"), F.sum("conversions").over(every) / F.sum("n").over(every)
    return groups.select("*", F.round(rate, 6).alias("rate"), F.round(F.try_divide(rate, overall), 4).alias("lift"))


def top_lift(df: DataFrame, y: str, s: str, top: float = 0.1) -> DataFrame:
    """Rate of the scores at or above the (1 - top) quantile over the overall rate."""
    cut = quantile_values(df, s, {"_cut": 1 - top})
    j = df.crossJoin(F.broadcast(cut.limit(1)))
    head = F.avg(F.when(F.col(s) >= F.col("_cut"), F.col(y)))
    return j.agg(F.count_if(F.col(s) >= F.col("_cut")).alias("n_top"), F.round(head, 6).alias("top_rate"), F.round(F.avg(y), 6).alias("base_rate"), F.round(F.try_divide(head, F.avg(y)), 6).alias("lift"))


def bootstrap_lift(df: DataFrame, y: str, s: str, key: str, *, resamples: int = 1000, top: float = 0.1, seed: int = 7) -> DataFrame:
    """95 % interval of the top lift by Poisson resampling, each resample with its own cut.

    Weights come from (key, resample), so no rows are drawn or moved, and a row is never repeated:
    tasks add up vectors of weights, one entry a resample, by ranges of the score. The head of a
    resample begins at the score of the rank (1 - top) of its own weights, so after each pass only
    the range that holds this rank is cut further, until it is one score; `resampling` has the
    passes. Rows without a key or score are left out.
    """
    rates = weighted_heads(df.select(F.col(key).cast("long").alias("k"), F.col(y).cast("double").alias("y"), F.col(s).cast("double").alias("s")).where("k is not null and s is not null and not isnan(s)"), resamples, top, seed)
    per = df.sparkSession.createDataFrame(rates, "n double, pos double, head_n double, head_pos double")
    rate = lambda pos, n: F.try_divide(F.col(pos), F.col(n))
    lifts = per.select(F.try_divide(rate("head_pos", "head_n"), rate("pos", "n")).alias("lift"))
    q = lambda p: F.round(F.percentile("lift", F.lit(p)), 6)  # noqa: E731  over the resamples
    return lifts.agg(F.count("lift").alias("resamples"), q(0.025).alias("low"), q(0.5).alias("mid"), q(0.975).alias("high"), F.round(F.avg((F.col("lift") <= 1).cast("int")), 6).alias("p_value"))


# Classes of the information value.
def iv_class(iv: Column) -> Column:
    return F.when(iv < 0.02, "none").when(iv < 0.1, "weak").when(iv < 0.3, "medium").when(iv < 0.5, "strong").otherwise("suspicious")


def fit_edges(df: DataFrame, feature: str, bins: int = 10) -> list[float]:
    """Upper edges of the bins but the last, fitted on the rows: exact quantiles with equal cuts
    merged, or the values themselves where there are no more of them than bins."""
    known = df.where(F.col(feature).isNotNull()).select(F.col(feature).cast("double").alias(feature))
    values = sorted(r[0] for r in known.distinct().limit(bins + 1).collect())
    if len(values) <= bins:
        return values[:-1]
    cuts = quantile_values(known, feature, {f"q{i}": i / bins for i in range(1, bins)}).crossJoin(known.agg(F.max(feature).alias("top"), F.min(feature).alias("low"))).first()
    return sorted({cuts[f"q{i}"] for i in range(1, bins)} - {cuts["top"], cuts["low"]})


def bin_of(feature: str, edges: Sequence[float]) -> Column:
    """How many edges lie below the value: bins are open below and closed above; null for null."""
    below = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]) if edges else F.array().cast("array<double>"), lambda e: e < F.col(feature)))
    return F.when(F.col(feature).isNotNull(), below)


def _woe(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Weight of evidence and its part of the information value; shares are 0.0001 at least."""
    every = Window.partitionBy()  # of a row a bin
    bad = F.col("n") - F.col("pos")
    good_share = F.greatest(F.try_divide(F.col("pos"), F.sum("pos").over(every)), F.lit(0.0001))
    bad_share = F.greatest(F.try_divide(bad, F.sum(bad).over(every)), F.lit(0.0001))
    return rows.select(*keep, "n", "pos", F.round(F.log(good_share / bad_share), 6).alias("woe"), F.round((good_share - bad_share) * F.log(good_share / bad_share), 6).alias("iv_part"))


def iv_bins(df: DataFrame, feature: str, y: str, edges: Sequence[float] | None = None, *, bins: int = 10, monotone: bool = False) -> DataFrame:
    """Weight of evidence of each bin of a feature; rows without the feature are left out.

    Without ``edges`` the bins are fitted (`fit_edges`). ``monotone`` then merges neighbours whose
    rates go against the feature's direction, by pooling, until the rates rise or fall throughout.
    """
    edges = list(fit_edges(df, feature, bins) if edges is None else edges)
    by = df.where(F.col(feature).isNotNull()).groupBy(bin_of(feature, edges).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(y).cast("long").alias("pos"))
    if monotone:  # on a row a bin
        return iv_bins(df, feature, y, pooled_edges(edges, {r.bin: (r.n, r.pos) for r in by.collect()}))
    return _woe(by, ["bin"])


def pooled_edges(edges: Sequence[float], counts: Mapping[int, tuple[int, int]]) -> list[float]:
    """The edges left when neighbouring bins (rows, positives) are pooled until their rates rise, or fall."""
    some = sorted(counts)
    n = sum(counts[b][0] for b in some)
    mean_bin, mean_rate = sum(b * counts[b][0] for b in some) / n if n else 0, sum(counts[b][1] for b in some) / n if n else 0
    rising = sum((b - mean_bin) * (counts[b][1] - mean_rate * counts[b][0]) for b in some) >= 0
    pools: list[list] = []  # last bin, rows, positives
    for b in some:
        pools.append([b, *counts[b]])
        while len(pools) > 1:
            fall = pools[-2][2] * pools[-1][1] - pools[-1][2] * pools[-2][1]  # over 0 where the rate falls
            if fall <= 0 if rising else fall >= 0:
                break
            last = pools.pop()
            pools[-1] = [last[0], pools[-1][1] + last[1], pools[-1][2] + last[2]]
    return [edges[b] for b, _, _ in pools[:-1]]


def information_value(df: DataFrame, feature: str, y: str, edges: Sequence[float] | None = None, **options) -> DataFrame:
    """0 where there are no rows, or a class is missing."""
    iv = F.coalesce(F.round(F.sum("iv_part"), 4), F.lit(0.0))
    both = (F.sum("pos") > 0) & (F.sum("pos") < F.sum("n"))
    value = F.when(F.coalesce(both, F.lit(False)), iv).otherwise(0.0)
    return iv_bins(df, feature, y, edges, **options).agg(value.alias("iv")).select(F.lit(feature).alias("feature"), "iv", iv_class(F.col("iv")).alias("iv_class"))


def vif(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Variance inflation: the diagonal of the inverse of the k x k correlation matrix."""
    import numpy as np

    pairs = [(i, j) for i in range(len(features)) for j in range(i)]
    r = df.agg(*[F.corr(features[i], features[j]).alias(f"r{i}_{j}") for i, j in pairs]).first()
    m = np.eye(len(features))
    for i, j in pairs:
        m[i, j] = m[j, i] = r[f"r{i}_{j}"] or 0.0
    inverse = np.linalg.pinv(m)
    return df.sparkSession.createDataFrame([(f, round(float(inverse[i, i]), 4)) for i, f in enumerate(features)], "feature string, vif double")


def calibration_error(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Expected calibration error, Brier score and log loss."""
    eps = 1e-15
    q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    loss = -(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))
    by = df.groupBy(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(p).alias("sp"), F.sum(y).alias("sy"), F.sum((F.col(p) - F.col(y)) ** 2).alias("sq"), F.sum(loss).alias("sl")
    )
    n = F.sum("n")
    return by.agg(F.round(F.sum(F.abs(F.col("sp") - F.col("sy"))) / n, 6).alias("ece"), F.round(F.sum("sq") / n, 6).alias("brier"), F.round(F.sum("sl") / n, 6).alias("log_loss"))


def ks(df: DataFrame, y: str, s: str) -> DataFrame:
    """The greatest gap between the score distributions of the classes."""
    fp = F.col("seen") - F.col("tp")
    gap = F.abs(F.col("tp") / F.col("p") - fp / (F.col("total") - F.col("p")))
    return _curve(df, y, s).agg(F.round(F.max(gap), 6).alias("ks"))


def prf(df: DataFrame, y: str, s: str, t: float = 0.5) -> DataFrame:
    hit = F.col(s) >= t
    tp, fp, fn = F.count_if(hit & (F.col(y) == 1)), F.count_if(hit & (F.col(y) == 0)), F.count_if(~hit & (F.col(y) == 1))
    return df.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn")).select(
        "*",
        F.round(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), 6).alias("precision"),
        F.round(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), 6).alias("recall"),
        F.round(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6).alias("f1"),
    )


def threshold_table(df: DataFrame, y: str, s: str, thresholds: Sequence[float]) -> DataFrame:
    """Leads and conversions at or above each threshold, from one aggregate."""
    one = df.agg(*[F.struct(F.lit(t).alias("threshold"), F.count_if(F.col(s) >= t).alias("leads"), F.coalesce(F.sum(F.when(F.col(s) >= t, F.col(y))), F.lit(0)).alias("conversions")).alias(f"t{i}") for i, t in enumerate(thresholds)])
    rows = one.select(F.explode(F.array(*[f"t{i}" for i in range(len(thresholds))])).alias("r")).select("r.*")
    return rows.withColumn("per_100", F.round(F.try_divide(100.0 * F.col("conversions"), F.col("leads")), 4))


def wilson(df: DataFrame, by: str, y: str, *, least: int = 50, z: float = 1.96) -> DataFrame:
    """Rate with its Wilson interval for groups of at least ``least`` rows."""
    g = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("k")).where(F.col("n") >= least)
    n, p = F.col("n"), F.col("k") / F.col("n")
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return g.select(by, "n", "k", F.round(p, 6).alias("rate"), F.round(mid - half, 6).alias("low"), F.round(mid + half, 6).alias("high"))


def fisher(df: DataFrame, by: str, y: str, a, b) -> DataFrame:
    """2 x 2 counts, odds ratio and the one-sided exact p (a converts more than b).

    The counts are made in Spark; the hypergeometric tail is summed over its terms
    with log factorials, on the four numbers of the one row that is left.
    """
    import math

    both = df.where(F.col(by).isin(a, b))
    t = both.agg(
        F.count_if((F.col(by) == a) & (F.col(y) == 1)).alias("a1"), F.count_if((F.col(by) == a) & (F.col(y) == 0)).alias("a0"),
        F.count_if((F.col(by) == b) & (F.col(y) == 1)).alias("b1"), F.count_if((F.col(by) == b) & (F.col(y) == 0)).alias("b0"),
    )
    one = t.first()
    a1, a0, b1, b0 = (one[x] for x in ("a1", "a0", "b1", "b0"))
    lf = lambda n: math.lgamma(n + 1)
    choose = lambda n, k: lf(n) - lf(k) - lf(n - k)
    rows, hits, everyone = a1 + a0, a1 + b1, a1 + a0 + b1 + b0
    least, most = max(0, rows + hits - everyone), min(rows, hits)
    term = lambda k: math.exp(choose(hits, k) + choose(everyone - hits, rows - k) - choose(everyone, rows))

    def outwards(ks) -> float:
        """Terms away from the mean shrink at every step, so the sum ends where they no longer count."""
        total = 0.0
        for k in ks:
            total += (now := term(k))
            if now < 1e-18 * total or now == 0.0:
                break
        return total

    above = everyone == 0 or a1 * everyone >= rows * hits
    tail = outwards(range(a1, most + 1)) if above else 1.0 - outwards(range(a1 - 1, least - 1, -1))
    odds = F.try_divide((F.col("a1") * F.col("b0")).cast("double"), F.col("a0") * F.col("b1"))
    return t.select("*", F.round(odds, 6).alias("odds_ratio"), F.lit(round(min(1.0, tail), 6)).alias("p_value"))


def segment_metrics(df: DataFrame, by: Sequence[str], y: str, s: str) -> DataFrame:
    """Rows, rate and rank-sum AUC by segment."""
    counts = df.groupBy(*by, F.col(s).alias("s")).agg(F.sum(y).alias("pos"), F.count(F.lit(1)).alias("n"))
    sides = counts.withColumn("neg", F.col("n") - F.col("pos"))
    run = cumulative(sides, "s", ["neg"], groups=by).withColumnRenamed("neg_cum", "below")
    a = F.try_divide(F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2)), (F.sum("pos") * F.sum("neg")).cast("double"))
    return run.groupBy(*by).agg(F.sum("n").alias("rows"), F.round(F.sum("pos") / F.sum("n"), 6).alias("rate"), F.round(a, 6).alias("auc"))


def signal_combos(df: DataFrame, signals: Sequence[str], y: str, least: int) -> DataFrame:
    """Every on/off combination with at least ``least`` rows: count, rate, lift."""
    g = df.groupBy(*signals).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("conversions"))
    every = Window.partitionBy()
    rate, overall = F.col("conversions") / F.col("n"), F.sum("conversions").over(every) / F.sum("n").over(every)
    return g.select("*", F.round(rate, 6).alias("rate"), F.round(F.try_divide(rate, overall), 4).alias("lift")).where(F.col("n") >= least)


def combine_ranks(*lists: DataFrame) -> DataFrame:
    """Mean rank of each feature over lists of (feature, importance): one row a feature."""
    w = Window.partitionBy("_l").orderBy(F.desc("importance"), "feature")
    ranked = [x.withColumn("_l", F.lit(i)) for i, x in enumerate(lists)]
    both = ranked[0]
    for x in ranked[1:]:
        both = both.unionByName(x)
    return both.withColumn("_r", F.row_number().over(w)).groupBy("feature").agg(F.round(F.avg("_r"), 4).alias("mean_rank"), F.count(F.lit(1)).alias("lists"))


def signal_decay(df: DataFrame, date_col: str, signal: Column, y: str) -> DataFrame:
    """By month: the rate with the signal, without it, and the ratio."""
    on, off = F.avg(F.when(signal, F.col(y))), F.avg(F.when(~signal, F.col(y)))
    return df.groupBy(F.trunc(date_col, "MM").alias("month")).agg(F.count_if(signal).alias("n_on"), F.round(on, 6).alias("rate_on"), F.round(off, 6).alias("rate_off"), F.round(F.try_divide(on, off), 4).alias("lift"))


def signal_test(df: DataFrame, signals: Mapping[str, Column], by: str, y: str, least: int = 10) -> DataFrame:
    """With and without each signal by source; both sides need ``least`` rows."""
    items = F.array(*[F.struct(F.lit(n).alias("signal"), F.coalesce(c, F.lit(False)).alias("on")) for n, c in signals.items()])
    long = df.select(by, y, F.explode(items).alias("x")).select(by, y, "x.*")
    on, off = F.avg(F.when(F.col("on"), F.col(y))), F.avg(F.when(~F.col("on"), F.col(y)))
    g = long.groupBy(by, "signal").agg(F.count_if("on").alias("n_on"), F.count_if(~F.col("on")).alias("n_off"), F.round(on, 6).alias("rate_on"), F.round(off, 6).alias("rate_off"), F.round(F.try_divide(on, off), 4).alias("lift"))
    return g.where((F.col("n_on") >= least) & (F.col("n_off") >= least))
