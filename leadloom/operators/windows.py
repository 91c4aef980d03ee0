"""Windows, ranks and quotas.

Ranks and running sums over all rows are not one window in one task: the rows are
dealt to Spark's shuffle partitions by ranges of the whole order (ties are split by
the later keys), sorted and written once to the shared folder; the partitions are
counted, and each goes on from the count of those before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.operators.running import sums_before
from leadloom.sources.shared import checkpointed


def latest_row(df: DataFrame, part: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each partition by a total order."""
    return rank_in(df, part, order, "_k").where("_k = 1").drop("_k")


def rank_in(df: DataFrame, part: Sequence[str], order: Sequence[Column], col: str) -> DataFrame:
    return df.withColumn(col, F.row_number().over(Window.partitionBy(*part).orderBy(*order)))


def numbered(df: DataFrame, order: Sequence[Column], out: str, *, groups: Sequence[str] = (), total: str | None = None) -> DataFrame:
    """Adds the row's number from 1 in the order within its group, and the group's rows as ``total``."""
    laid = df.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order)
    laid = checkpointed(laid.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    each = laid.groupBy(*groups, "_part").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_c"))
    starts = each.select(
        F.col("_part").alias("_p"),
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
        (F.coalesce(F.sum("_c").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
        F.sum("_c").over(Window.partitionBy(*groups)).alias("_rows"),
    )
    on = F.col("_part") == F.col("_p")
    for i, g in enumerate(groups):
        on &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    # without groups a row for each shuffle partition
    joined = laid.join(starts if groups else F.broadcast(starts), on).withColumn(out, F.col("_id") + F.col("_shift"))
    if total:
        joined = joined.withColumn(total, F.col("_rows"))
    return joined.drop("_id", "_part", "_p", "_shift", "_rows", *[f"_g{i}" for i in range(len(groups))])


def positioned(df: DataFrame, by: str, order: Sequence[Column], *, descending: bool = False) -> DataFrame:
    """Adds _pos, the row's number from 1 in the order (by, *order), and _n, the number of rows.

    Null values of ``by`` come last.
    """
    first = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    return numbered(df, [first, *order], "_pos", total="_n")


def rank_all(df: DataFrame, by: str, order: Sequence[Column], col: str = "list_rank", *, descending: bool = False) -> DataFrame:
    return positioned(df, by, order, descending=descending).withColumnRenamed("_pos", col).drop("_n")


def rank_subset(df: DataFrame, flag: Column, part: Sequence[str], order: Sequence[Column], col: str) -> DataFrame:
    """Ranks among the rows with the flag only; the others have null."""
    marked = df.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    ranked = numbered(marked.where("_flag"), order, col, groups=part)
    return ranked.unionByName(marked.where("not _flag").withColumn(col, F.lit(None).cast("long"))).drop("_flag")


def group_ranks(df: DataFrame, part: Sequence[str], col: str) -> DataFrame:
    """Adds _rank, the rank of the value within the partition (ties share the smallest, nulls come
    first), and _n, the partition's rows. Rows are counted by distinct value and the counts run up
    over ranges of values, so a partition of any size is many tasks' and no tie is cut in two."""
    value = F.struct(F.col(col).isNotNull().alias("known"), F.col(col).alias("v"))
    counts = df.groupBy(*part, value.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    sums = cumulative(counts, "_v", ["_c"], groups=part)
    ranks = sums.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(part)], "_v", (F.col("_c_cum") - F.col("_c") + 1).alias("_rank"), F.col("_c_total").alias("_n"))
    on = F.col(col).eqNullSafe(F.col("_v.v"))
    for i, p in enumerate(part):
        on &= F.col(p).eqNullSafe(F.col(f"_p{i}"))
    return df.join(ranks, on).drop("_v", *[f"_p{i}" for i in range(len(part))])


def pct_rank(df: DataFrame, part: Sequence[str], col: str, out: str) -> DataFrame:
    """PERCENT_RANK times 100 within the partitions."""
    share = F.when(F.col("_n") > 1, 100 * ((F.col("_rank") - 1) / (F.col("_n") - 1))).otherwise(0.0)
    return group_ranks(df, part, col).withColumn(out, F.round(share, 4)).drop("_rank", "_n")


def score_percentile(df: DataFrame, col: str, out: str = "percentile") -> DataFrame:
    """100 * rank / rows, cut to an integer; equal scores share the smallest rank."""
    values = df.groupBy(col).agg(F.count(F.lit(1)).alias("_c"))
    sums = cumulative(values, col, ["_c"]).select(F.col(col).alias("_v"), (F.col("_c_cum") - F.col("_c") + 1).alias("_rank"), F.col("_c_total").alias("_total"))
    joined = df.join(sums, F.col(col).eqNullSafe(F.col("_v")), "left")
    return joined.withColumn(out, F.when(F.col(col).isNotNull(), F.floor(100 * F.col("_rank") / F.col("_total")).cast("int"))).drop("_v", "_rank", "_total")


def cumulative(df: DataFrame, by: str, values: Sequence[str], *, groups: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """Adds, for each of the values, its running sum in the order of ``by`` (unique in a group,
    nulls last) as <value>_cum, and the group's sum as <value>_total."""
    first = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    laid = checkpointed(df.repartitionByRange(*groups, first).withColumn("_part", F.spark_partition_id()))
    each = laid.groupBy(*groups, "_part").agg(*[F.sum(v).alias(f"_s{i}") for i, v in enumerate(values)])
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = each.select(
        F.col("_part").alias("_p"),
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
        *[F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0)).alias(f"_b{i}") for i in range(len(values))],
        *[F.sum(f"_s{i}").over(Window.partitionBy(*groups)).alias(f"{v}_total") for i, v in enumerate(values)],
    )
    on = F.col("_part") == F.col("_p")
    for i, g in enumerate(groups):
        on &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    w = Window.partitionBy(*groups, "_part").orderBy(first).rowsBetween(Window.unboundedPreceding, 0)
    joined = laid.join(starts if groups else F.broadcast(starts), on)
    sums = {f"{v}_cum": F.sum(v).over(w) + F.col(f"_b{i}") for i, v in enumerate(values)}
    return joined.withColumns(sums).drop("_part", "_p", *[f"_g{i}" for i in range(len(groups))], *[f"_b{i}" for i in range(len(values))])


def quantile_values(df: DataFrame, col: str, probs: Mapping[str, float], groups: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with interpolation under their names, one row a group, from counts of
    distinct values."""
    counts = df.where(F.col(col).isNotNull()).groupBy(*groups, F.col(col).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    run = cumulative(counts, "_v", ["_c"], groups=groups)

    def at(p: float) -> Column:
        place = (F.max("_c_total") - 1) * F.lit(float(p))
        low = F.min(F.when(F.col("_c_cum") > F.floor((F.col("_c_total") - 1) * F.lit(float(p))), F.col("_v")))
        high = F.min(F.when(F.col("_c_cum") > F.ceil((F.col("_c_total") - 1) * F.lit(float(p))), F.col("_v")))
        return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    return run.groupBy(*groups).agg(*[at(p).alias(name) for name, p in probs.items()])


def ntile(df: DataFrame, n: int, by: str, order: Sequence[Column], out: str = "tile", *, descending: bool = False) -> DataFrame:
    """NTILE over all rows from their positions: the first (rows mod n) tiles have one row more."""
    base, extra = F.floor(F.col("_n") / n), F.col("_n") % n
    head = extra * (base + 1)
    tile = F.when(F.col("_pos") <= head, F.floor((F.col("_pos") - 1) / (base + 1)) + 1).otherwise(
        extra + F.floor((F.col("_pos") - 1 - head) / F.greatest(base, F.lit(1))) + 1
    )
    return positioned(df, by, order, descending=descending).withColumn(out, tile.cast("int")).drop("_pos", "_n")


def growth(df: DataFrame, key: str, order: str, col: str, lags: Sequence[int] = (1, 12)) -> DataFrame:
    """Earlier values by rows and the change in percent."""
    w = Window.partitionBy(key).orderBy(order)
    for k in lags:
        df = df.withColumn(f"{col}_lag{k}", F.lag(col, k).over(w))
        df = df.withColumn(f"{col}_growth{k}", F.round(100 * F.try_divide(F.col(col) - F.col(f"{col}_lag{k}"), F.col(f"{col}_lag{k}")), 4))
    return df


def cohort_inflow(df: DataFrame, col: str, months: int = 12) -> DataFrame:
    """Starts by month, and those of the month ``months`` earlier, by the calendar."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.trunc(col, "MM").alias("month")).agg(F.count(F.lit(1)).alias("entries"))
    old = counts.select(F.add_months("month", months).cast("date").alias("month"), F.col("entries").alias("exits"))
    return counts.join(old, "month", "left").fillna({"exits": 0})


def first_by(df: DataFrame, part: str, order: Sequence[Column], col: str, out: str) -> DataFrame:
    return df.withColumn(out, F.first(col).over(Window.partitionBy(part).orderBy(*order)))


def indexed(df: DataFrame, by: str, order: Sequence[Column]) -> DataFrame:
    """row_index from 1 and row_total."""
    return positioned(df, by, order).withColumnsRenamed({"_pos": "row_index", "_n": "row_total"})


def job_sequence(left: DataFrame, history: DataFrame, *, by: str = "person_id", at: str = "contacted", row_key: str = "lead_id", start: str = "start_date", tiebreak: str = "spell_id", most: int | None = None) -> DataFrame:
    """Jobs started by the date, numbered from the newest; the ``most`` newest, or all.

    Jobs are numbered once a person, from the oldest. A left row learns how many began by its
    date from a running count, and so which numbers it asks for: an equi-join gives them.
    """
    jobs = rank_in(history.where(F.col(start).isNotNull()), [by], [F.col(start), F.col(tiebreak)], "_k").withColumnRenamed(by, "_by")
    begun = history.select(by, F.date_add(start, -1).alias("_at"), F.lit(1).alias("_one"))  # counts from its own day on
    counted = sums_before(left, begun, by, at, {"_jobs": "_one"}).where("_jobs > 0")
    oldest = F.lit(1) if most is None else F.greatest(F.col("_jobs") - most + 1, F.lit(1))
    asked = counted.select(*left.columns, "_jobs", F.explode(F.sequence(oldest.cast("int"), F.col("_jobs").cast("int"))).alias("_ask"))
    found = asked.join(jobs, (F.col(by) == F.col("_by")) & (F.col("_ask") == F.col("_k")))
    return found.withColumn("job_number", (F.col("_jobs") - F.col("_k") + 1).cast("int")).drop("_by", "_k", "_jobs", "_ask")


def rank_pct(df: DataFrame, part: Sequence[str], col: str, out: str) -> DataFrame:
    """rank / rows within the partitions."""
    return group_ranks(df, part, col).withColumn(out, F.round(F.col("_rank") / F.col("_n"), 6)).drop("_rank", "_n")


def order_value(col: Column, order: Sequence[str]) -> Column:
    """The place of a label in a list; others last."""
    out = F.lit(len(order) + 1)
    for i, label in reversed(list(enumerate(order, 1))):
        out = F.when(col == label, i).otherwise(out)
    return out


def top_n(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def cap_per_group(df: DataFrame, part: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    return rank_in(df, part, order, "_k").where(F.col("_k") <= k).drop("_k")


def tier_quota(df: DataFrame, tier: str, quotas: Mapping[str, int], order: Sequence[Column]) -> DataFrame:
    """At most the quota of each tier; an unknown tier has none. The largest quota is a literal,
    so tasks cut their rows to it before the tiers meet."""
    quota = F.create_map(*[x for t, q in quotas.items() for x in (F.lit(t), F.lit(q))])
    ranked = rank_in(df.where(F.col(tier).isin(*quotas)), [tier], order, "tier_rank").where(F.col("tier_rank") <= max(quotas.values(), default=0))
    return ranked.where(F.col("tier_rank") <= quota[F.col(tier)])


def channel_cap(df: DataFrame, has_channel: Column, k: int, order: Sequence[Column]) -> DataFrame:
    """All rows with the channel and the first k without; those are cut before they are ranked."""
    without = df.where(~F.coalesce(has_channel, F.lit(False))).orderBy(*order).limit(k)
    return df.where(has_channel).unionByName(without)


def top_drivers(df: DataFrame, cols: Sequence[str], k: int = 3) -> DataFrame:
    """The names and values of the k largest absolute contributions of each row."""
    items = F.array(*[F.struct((-F.abs(c)).alias("o"), F.lit(c).alias("name"), F.col(c).alias("value")) for c in cols])
    best = F.slice(F.array_sort(items), 1, k)
    out = df.withColumn("_best", best)
    for i in range(k):
        out = out.withColumns({f"driver_{i + 1}": F.get("_best", F.lit(i))["name"], f"driver_{i + 1}_value": F.get("_best", F.lit(i))["value"]})
    return out.drop("_best")
