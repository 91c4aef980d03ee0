"""Mixing sources to target weights by Pareto order sampling.

The target of a source is its share, by weight, of all words, but at most
``cap`` times its own size; what is cut off there is shared again by weight.
With r = target / size, every document is certain of floor(r) whole copies.

The words still wanted come from a Pareto order sample with unequal inclusion
probabilities. A document's weight is its size class, the number of binary digits
of its size, so a text of a thousand words has twice the chance of one of thirty.
Its inclusion probability p is c times its class, at most 1, and c is such that
the expected words are those wanted; documents whose p reaches 1 are all taken
and c is found again for the rest. The others are ranked by the odds u / (1 - u)
of a random number divided by the odds p / (1 - p), and taken in that order to
the fixed size in words (a document is taken while its middle lies within). u
comes from a hash of the id, so reruns agree.

c needs one row for each source and class only. The running size is kept in two
levels: a source's ranks are cut into ``buckets`` ranges, evenly by the rank's odds
against those of the source as a whole; their sizes are summed first, then each
(source, range) is ranked alone. A source with a third of all rows is spread over
all its ranges.

Defined cases: null text has size 0; a null source is a source of its own, last
in order; equal odds are ordered by doc_id, null first, so rows repeated with their id
are neighbours and each counts; rows with null ids have one random number and are
neighbours too (`repeat_documents` tells them apart by their other columns); a text's size
is counted where it is read, however long; an empty table gives none; further columns are
not read, and `repeat_documents` keeps them whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.common import WORD, fresh, passing, table, written

BUCKETS = 4096
SEED = "mix-1"
#: Rows of the plan, one a source and class, up to which it is broadcast.
SMALL_PLAN = 100_000


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5 of the id."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":" + seed))
    bits = F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: Sequence[int], cap: float) -> DataFrame:
    """Per source of (source, source_size): its target. One row a source, so one window is enough."""
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    ranked = sizes.withColumn("weight", F.get(cycle, F.pmod(F.row_number().over(everything) - 1, F.lit(len(weights)))))
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    whole = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ranked.select(
        "*",
        F.row_number().over(by_cap).alias("k"),
        (F.sum("source_size").over(whole) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("left"),
        F.sum("weight").over(after).alias("heavy"),
    ).withColumn("rate", F.col("left") / F.col("heavy"))
    free = level.withColumn(
        "open_k", F.min(F.when(cap * F.col("source_size") > F.col("weight") * F.col("rate"), F.col("k"))).over(whole)
    )
    rate = free.withColumn("rate", F.max(F.when(F.col("k") == F.col("open_k"), F.col("rate"))).over(whole))
    capped = F.col("open_k").isNull() | (F.col("k") < F.col("open_k"))
    return rate.select(
        "source",
        "source_size",
        F.when(capped, (cap * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.col("rate")).alias("target"),
    )


def size_class(size: Column) -> Column:
    """Binary digits of the size: 0 for none, at most 63."""
    return F.when(size > 0, F.length(F.regexp_replace(F.conv(size.cast("string"), 10, 2), "^0+", ""))).otherwise(0).cast("long")


def inclusion(classes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source and class: whole copies, the inclusion probability p, and the words (need)
    that its source wants of documents that are not certain."""
    planned = (
        targets.withColumn("r", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))
        .withColumn("whole", F.floor("r"))
        .withColumn("share", F.col("r") - F.col("whole"))
        .withColumn("want", F.col("share") * F.col("source_size"))
        .select(F.col("source").alias("s"), "source_size", "target", "whole", "share", "want")
    )
    joined = classes.select("source", F.col("class").alias("k"), "class_size").join(planned, F.col("source").eqNullSafe(F.col("s")))
    # from the largest class down; a source has at most 64
    larger = Window.partitionBy("s").orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy("s").orderBy(F.col("k").desc()).rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy("s").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heavy = F.sum(F.col("k").cast("decimal(20,0)") * F.col("class_size")).over(rest).cast("double")
    solved = joined.withColumn("left", F.col("want") - F.coalesce(F.sum("class_size").over(larger), F.lit(0))).withColumn("c", F.try_divide("left", heavy))
    # the first class, from the top, that c does not lift to 1: all above it are certain
    first = F.max(F.when(F.col("c") * F.col("k") < 1, F.col("k"))).over(every)
    found = solved.withColumn("first", F.coalesce(first, F.lit(-1))).withColumn("at", F.col("k") == F.col("first"))
    held = found.withColumn("c", F.max(F.when(F.col("at"), F.col("c"))).over(every)).withColumn("need", F.max(F.when(F.col("at"), F.col("left"))).over(every))
    p = F.when(F.col("k") > F.col("first"), F.lit(1.0)).otherwise(F.col("c") * F.col("k"))
    even = F.when((F.col("share") > 0) & (F.col("share") < 1), F.col("share") / (1 - F.col("share"))).otherwise(1.0)
    return held.select("s", "k", "source_size", "target", "whole", p.alias("p"), "need", even.alias("even"))


def mix(
    docs: DataFrame,
    *,
    weights: Sequence[int] = (5, 2, 1),
    cap: int = 3,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
    buckets: int = BUCKETS,
    seed: str = SEED,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    with passing(docs.sparkSession):
        sized = written(
            docs.select(
                F.col(doc_id).alias("doc_id"),
                F.col(source).alias("source"),
                F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                uniform(F.col(doc_id), seed).alias("u"),
            ).withColumn("class", size_class(F.col("size"))),
            "mix-sized",
        )
        classes = written(sized.groupBy("source", "class").agg(F.sum("size").alias("class_size")), "mix-classes")
        targets = source_targets(classes.groupBy("source").agg(F.sum("class_size").alias("source_size")), weights, cap)
        plan = written(inclusion(classes, targets), "mix-plan")
        drawn = sized.join(F.broadcast(plan) if plan.count() <= SMALL_PLAN else plan, sized["source"].eqNullSafe(plan["s"]) & (sized["class"] == plan["k"]))
        odds = F.try_divide(F.col("u") / (1 - F.col("u")), F.col("p") / (1 - F.col("p")))
        even = odds * F.col("even")
        ranked = written(
            drawn.withColumn("odds", F.when((F.col("p") > 0) & (F.col("p") < 1), odds))
            .withColumn("bucket", F.when(F.col("odds").isNotNull(), F.floor(F.lit(buckets) * (even / (1 + even))).cast("int")))
            .select("doc_id", "source", "size", "source_size", "target", "whole", "p", "need", "odds", "bucket"),
            "mix-ranked",
        )
    ranges = ranked.where("bucket is not null").groupBy("source", "bucket").agg(F.sum("size").alias("range_size"))
    # a source has at most `buckets` ranges
    order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.select(
        F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("range_size").over(order), F.lit(0)).alias("before")
    )
    rest = ranked.where("bucket is not null").join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    within = Window.partitionBy("s", "b").orderBy("odds", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)) + F.col("size") / 2
    columns = ["doc_id", "source", "size", "source_size", "target"]
    found = rest.select(*columns, (F.col("whole") + F.when(reached <= F.col("need"), 1).otherwise(0)).alias("copies")).unionByName(
        ranked.where("bucket is null").select(*columns, (F.col("whole") + F.when(F.col("p") >= 1, 1).otherwise(0)).alias("copies"))
    )
    return found.withColumn("taken", F.col("copies") * F.col("size"))


def repeat_documents(docs: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them. The id names a row: of rows
    repeated whole each is taken as often. A row without an id is named by a hash of all its
    columns: such rows that are alike come as often as the mix takes them together."""
    key, times, copy = fresh(docs.columns, "key", "times", "copy")
    named, row = F.col(doc_id).isNotNull(), F.concat(F.lit("row:"), F.md5(F.to_json(F.struct(*docs.columns)).cast("binary")))
    keyed = docs.withColumn(key, F.when(named, F.col(doc_id).cast("string")).otherwise(row))
    taken = mix(keyed, doc_id=key, **options).groupBy(F.col("doc_id").alias(key)).agg(F.max("copies").alias("_most"), F.sum("copies").alias("_all"))
    alike = F.col(key).startswith("row:")
    copies = taken.select(key, F.when(alike, F.col("_all")).otherwise(F.col("_most")).alias(times)).where(F.col(times) > 0)
    rows = keyed.where(named).unionByName(keyed.where(~named).dropDuplicates([key]))
    joined = rows.join(copies, key)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), times))).select(*docs.columns)


def op9_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         (('0x' || substr(md5(cast(doc_id as varchar) || ':mix-1'), 1, 13))::bigint + 0.5::double) / 4503599627370496.0::double as u
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, ([5, 2, 1])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight from s),
k as (
  select *, row_number() over (order by source_size::double / weight, source nulls last) as k,
         sum(source_size) over () - 3 * coalesce(sum(source_size) over (
           order by source_size::double / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as rest,
         sum(weight) over (
           order by source_size::double / weight, source nulls last rows between current row and unbounded following) as heavy
  from w),
l as (select *, rest::double / heavy as rate from k),
f as (select *, min(case when 3 * source_size > weight * rate then k end) over () as open_k from l),
t as (
  select source, source_size,
         case when open_k is null or k < open_k then (3 * source_size)::double
              else weight * max(case when k = open_k then rate end) over () end as target
  from f),
r as (select *, coalesce(target / nullif(source_size, 0)::double, 0.0::double) as r from t),
g as (
  select d.*, t.source_size, t.target, r, floor(r) as whole, (r - floor(r)) * t.source_size as want,
         case when size = 0 then 0 else length(bin(size)) end as k
  from d join (select *, coalesce(target / nullif(source_size, 0)::double, 0.0::double) as r from t) t on d.source is not distinct from t.source),
b as (select source, k, any_value(want) as want, sum(size)::bigint as class_size from g group by source, k),
v as (
  select *, want - coalesce(sum(class_size) over (partition by source order by k desc rows between unbounded preceding and 1 preceding), 0) as rest,
         (sum(k::hugeint * class_size) over (partition by source order by k desc rows between current row and unbounded following))::double as heavy
  from b),
y as (select *, rest / nullif(heavy, 0) as c from v),
x as (select source, max(k) as k from y where c * k < 1 group by source),
z as (select y.source, y.k as first, y.c, y.rest as need from y join x on y.source is not distinct from x.source and y.k = x.k),
q as (
  select g.*, z.need, case when z.first is null or g.k > z.first then 1.0::double else z.c * g.k end as p
  from g left join z on g.source is not distinct from z.source),
o as (select *, case when p > 0 and p < 1 then (u / (1 - u)) / (p / (1 - p)) end as odds from q),
c as (
  select *, coalesce(sum(size) over (partition by source, odds is null order by odds, doc_id, size
                     rows between unbounded preceding and 1 preceding), 0) + size / 2.0::double as reached
  from o)
select doc_id, size, source_size, target,
       ((whole + case when odds is null then (case when p >= 1 then 1 else 0 end) when reached <= need then 1 else 0 end) * size)::bigint as taken
from c
"""
