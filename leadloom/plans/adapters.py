"""The domain's tables, derived from the driver's tables: in Spark, and as SQL for the oracle."""

from __future__ import annotations

from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.sources.tables import load

AS_OF = date(2001, 8, 1)
EVENTS_AS_OF = date(2024, 1, 31)
FIRST = date(1995, 1, 1)

# Licence lists by customer key mod 4.
LICENCES = ("[]", '["Series 65"]', '["Series 7"]', '["Series 7","Series 65"]')


class Tables:
    """Lazily derived tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return load(self.spark, self.sf_dir, name)

    @cached_property
    def spells(self) -> DataFrame:
        """Employment spells: one per order that has lines."""
        firm = self.raw("lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("firm_id"))
        orders = self.raw("orders").join(firm, F.col("o_orderkey") == F.col("l_orderkey"))
        w = Window.partitionBy("o_custkey").orderBy(F.to_date("o_orderdate"), "o_orderkey")
        end = F.when(F.col("o_orderkey") % 7 != 0, F.lead(F.to_date("o_orderdate")).over(w))
        return orders.select(
            F.col("o_orderkey").alias("spell_id"),
            F.col("o_custkey").alias("person_id"),
            "firm_id",
            F.to_date("o_orderdate").alias("start_date"),
            end.alias("end_date"),
        )

    @cached_property
    def persons(self) -> DataFrame:
        key = F.col("c_custkey")
        licence = F.element_at(F.array(*[F.lit(x) for x in LICENCES]), (key % 4 + 1).cast("int"))
        return self.raw("customer").select(
            key.alias("person_id"),
            F.col("c_name").alias("name"),
            F.col("c_nationkey").alias("nation_id"),
            F.col("c_acctbal").alias("balance"),
            F.when(key % 5 != 0, F.col("c_mktsegment")).alias("title"),
            licence.alias("licences"),
        )

    @cached_property
    def firms(self) -> DataFrame:
        return (
            self.raw("supplier")
            .join(self.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("s_suppkey").alias("firm_id"), F.col("s_name").alias("firm_name"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.col("s_acctbal").alias("firm_balance"))
        )

    @cached_property
    def snapshots(self) -> DataFrame:
        return (
            self.raw("lineitem")
            .groupBy(F.col("l_suppkey").alias("firm_id"), F.trunc("l_shipdate", "MM").alias("month"))
            .agg(F.round(F.sum("l_extendedprice"), 2).alias("aum"), F.countDistinct("l_orderkey").alias("accounts"))
        )

    @cached_property
    def leads(self) -> DataFrame:
        d, k = F.to_date("o_orderdate"), F.col("o_orderkey")
        return self.raw("orders").where("o_orderstatus <> 'P'").select(
            k.alias("lead_id"),
            F.col("o_custkey").alias("person_id"),
            d.alias("contacted"),
            F.col("o_orderpriority").alias("source"),
            F.when(k % 11 < 3, F.date_add(d, (k * 13 % 90).cast("int"))).alias("converted"),
            F.col("o_totalprice").alias("amount"),
        )

    @cached_property
    def outcomes(self) -> DataFrame:
        """Leads with a 0/1 target: converted within 43 days."""
        hit = F.coalesce(F.datediff("converted", "contacted") <= 43, F.lit(False))
        return self.leads.withColumn("target", hit.cast("int")).withColumn("score", F.col("lead_id") * 37 % 1000 / 1000.0)

    @cached_property
    def tasks(self) -> DataFrame:
        return self.raw("events").select(F.col("event_id").alias("task_id"), "user_id", F.to_date("ts").alias("task_date"), "ts", "event_type", "value", "props")

    @cached_property
    def scored(self) -> DataFrame:
        docs = self.raw("documents").select("doc_id", "source", "lang", "n_chars")
        top = docs.agg(F.max("n_chars").alias("top"))
        return (
            self.raw("labels")
            .join(docs, "doc_id")
            .crossJoin(F.broadcast(top.limit(1)))
            .select("doc_id", "source", "lang", "n_chars", F.col("quality").alias("target"), "toxic", (F.col("n_chars") / F.col("top")).alias("score"))
        )

    @cached_property
    def names(self) -> DataFrame:
        """Left names for entity resolution: firms, customers and part names."""
        people = self.raw("customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"))
        firms = self.raw("supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"))
        parts = self.raw("part").groupBy(F.col("p_name").alias("name")).agg(F.concat(F.lit("p"), F.min("p_partkey").cast("string")).alias("id"))
        return firms.unionByName(people).unionByName(parts)

    @cached_property
    def edited_names(self) -> DataFrame:
        """The same names with edits that the digits of the id pick."""
        kind = F.regexp_extract("id", r"(\d+)", 1).cast("long") % 5
        swapped = F.array_join(F.reverse(F.split("name", " ")), " ")
        edit = (
            F.when(kind == 0, F.col("name"))
            .when(kind == 1, F.concat(F.upper("name"), F.lit(".")))
            .when(kind == 2, F.concat("name", F.lit(" LLC")))
            .when(kind == 3, swapped)
            .otherwise(F.concat("name", F.lit("x")))
        )
        return self.names.select(F.concat(F.lit("r"), "id").alias("right_id"), edit.alias("right_name"))

    @cached_property
    def old_list(self) -> DataFrame:
        return self.raw("part").where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))

    @cached_property
    def new_list(self) -> DataFrame:
        brand = F.when(F.col("p_partkey") % 7 == 0, F.concat("p_brand", F.lit("X"))).otherwise(F.col("p_brand"))
        return self.raw("part").where("p_partkey % 13 <> 0").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), brand.alias("brand"), F.col("p_size").alias("size"))


SQL = """
spells as (
  select o_orderkey as spell_id, o_custkey as person_id, firm_id, o_orderdate::date as start_date,
         case when o_orderkey % 7 <> 0 then lead(o_orderdate::date) over (partition by o_custkey order by o_orderdate::date, o_orderkey) end as end_date
  from orders join (select l_orderkey, min(l_suppkey) as firm_id from lineitem group by 1) on o_orderkey = l_orderkey),
persons as (
  select c_custkey as person_id, c_name as name, c_nationkey as nation_id, c_acctbal as balance,
         case when c_custkey % 5 <> 0 then c_mktsegment end as title,
         (['[]', '["Series 65"]', '["Series 7"]', '["Series 7","Series 65"]'])[(c_custkey % 4 + 1)::int] as licences
  from customer),
firms as (
  select s_suppkey as firm_id, s_name as firm_name, n_name as nation, r_name as region, s_acctbal as firm_balance
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
snapshots as (
  select l_suppkey as firm_id, date_trunc('month', l_shipdate)::date as month, round(sum(l_extendedprice), 2) as aum,
         count(distinct l_orderkey) as accounts
  from lineitem group by 1, 2),
leads as (
  select o_orderkey as lead_id, o_custkey as person_id, o_orderdate::date as contacted, o_orderpriority as source,
         case when o_orderkey % 11 < 3 then o_orderdate::date + (o_orderkey * 13 % 90)::int end as converted, o_totalprice as amount
  from orders where o_orderstatus <> 'P'),
outcomes as (
  select *, case when converted - contacted <= 43 then 1 else 0 end as target, (lead_id * 37 % 1000)::double / 1000.0::double as score from leads),
tasks as (select event_id as task_id, user_id, ts::date as task_date, ts, event_type, value, props from events),
scored as (
  select doc_id, source, lang, n_chars, quality as target, toxic, n_chars::double / (select max(n_chars) from documents) as score
  from labels join documents using (doc_id)),
names as (
  select 's' || s_suppkey as id, s_name as name from supplier
  union all select 'c' || c_custkey, c_name from customer
  union all select 'p' || min(p_partkey) as id, p_name as name from part group by p_name),
edited_names as (
  select 'r' || id as right_id,
         case regexp_extract(id, '(\\d+)', 1)::bigint % 5 when 0 then name when 1 then upper(name) || '.' when 2 then name || ' LLC'
              when 3 then array_to_string(list_reverse(string_split(name, ' ')), ' ') else name || 'x' end as right_name
  from names),
old_list as (select p_partkey as key, p_name as name, p_brand as brand, p_size as size from part where p_partkey % 10 <> 0),
new_list as (
  select p_partkey as key, p_name as name, case when p_partkey % 7 = 0 then p_brand || 'X' else p_brand end as brand, p_size as size
  from part where p_partkey % 13 <> 0)
"""
