"""Queries: sources and sinks. Sinks write into the shared folder and are read back."""

import uuid

from pyspark.sql import functions as F

from leadloom.plans.adapters import AS_OF, FIRST
from leadloom.plans.registry import query
from leadloom.sources import tables as S
from leadloom.sources.shared import shared_dir


def place(t, name: str) -> str:
    """A fresh folder that all executors share."""
    return f"{shared_dir(t.spark)}/leadloom-{name}-{uuid.uuid4().hex}"


@query("src_table", "select * from supplier")
def _(t):
    return S.load(t.spark, t.sf_dir, "supplier")


@query("src_csv_typed", "select c_custkey as id, c_name as name, case when c_nationkey <> 3 then c_nationkey end as nation, c_acctbal as balance from customer")
def _(t):
    path = place(t, "csv")
    raw = t.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_nationkey") == 3, "N/A").otherwise(F.col("c_nationkey").cast("string")).alias("nation"), F.col("c_acctbal").alias("balance"))
    raw.write.csv(path, header=True)
    return S.load_csv_typed(t.spark, path, {"id": "bigint", "name": "string", "nation": "int", "balance": "double"})


@query("src_literal", ", p as (select unnest(['BUILDING', 'MACHINERY', 'OTHER']) as title) select title, count(person_id) as n from p left join persons using (title) group by 1")
def _(t):
    return S.literal_table(t.spark, ["BUILDING", "MACHINERY", "OTHER"], "title").join(t.persons, "title", "left").groupBy("title").agg(F.count("person_id").alias("n"))


@query("src_date_spine", ", m as (select unnest(generate_series(date '1995-01-01', date '2001-08-01', interval 1 month))::date as month) select month, count(lead_id) as n from m left join leads on date_trunc('month', contacted)::date = month group by 1")
def _(t):
    spine = S.month_spine(t.spark, FIRST, AS_OF)
    return spine.join(t.leads.withColumn("month", F.trunc("contacted", "MM")), "month", "left").groupBy("month").agg(F.count("lead_id").alias("n"))


@query("src_catalog", "select 'persons' as table_name, unnest(['person_id', 'nation_id', 'title']) as column_name, unnest(['bigint', 'int', 'string']) as type, count(*) as row_count, unnest([0, 0, count(*) - count(title)]) as nulls from persons")
def _(t):
    return S.profile(t.persons.select("person_id", "nation_id", "title"), "persons")


@query("snk_ctas", "select firm_id, month, aum, accounts from snapshots")
def _(t):
    path = place(t, "ctas")
    S.save(t.snapshots, path)
    return t.spark.read.parquet(path)


@query("snk_partitioned", "select firm_id, aum, accounts, month from snapshots where month >= date '2001-01-01'")
def _(t):
    path = place(t, "partitioned")
    S.save_partitioned(t.snapshots.withColumn("year", F.year("month")), path, ["year"], ["firm_id"])
    return t.spark.read.parquet(path).where("year >= 2001").drop("year")


@query("snk_append", "select person_id, title from persons")
def _(t):
    path = place(t, "append")
    S.save(t.persons.where("person_id % 2 = 0").select("person_id", "title"), path)
    S.append(t.persons.where("person_id % 2 = 1").select("person_id", "title"), path)
    return t.spark.read.parquet(path)


@query("snk_replace_month", "select firm_id, case when month = date '2000-05-01' then accounts + 1000 else accounts end as accounts, strftime(month, '%Y-%m') as period from snapshots")
def _(t):
    path = place(t, "replace")
    rows = t.snapshots.select("firm_id", "accounts", F.date_format("month", "yyyy-MM").alias("period"))
    rows.write.partitionBy("period").parquet(path)
    for _ in range(2):  # running it twice changes nothing
        S.replace_partition(rows.where("period = '2000-05'").withColumn("accounts", F.col("accounts") + 1000), path, "period")
    return t.spark.read.option("inferSchema", "false").schema("firm_id long, accounts long, period string").parquet(path)


@query("snk_view", "select region, count(*) as n from firms group by 1")
def _(t):
    name = f"leadloom_firms_{uuid.uuid4().hex}"  # views are session-wide
    S.register_view(t.firms, name)
    return t.spark.sql(f"select region, count(*) as n from {name} group by region")


@query("snk_csv", "select lead_id, amount from leads order by amount desc, lead_id limit 100")
def _(t):
    path = place(t, "export")
    best = t.leads.orderBy(F.desc("amount"), "lead_id").limit(100)
    S.export_csv(best, ["lead_id", "amount"], path, ["lead_id"])
    return S.load_csv_typed(t.spark, path, {"lead_id": "bigint", "amount": "double"})


@query("snk_payload", "select lead_id::varchar as record_id, '{\"Lead_Score__c\":' || (score * 1000)::bigint || ',\"Source__c\":\"' || source || '\"}' as payload from outcomes order by score desc, lead_id limit 50")
def _(t):
    rows = t.outcomes.withColumn("record", F.col("lead_id").cast("string"))
    mapping = {"Lead_Score__c": F.round(F.col("score") * 1000).cast("long"), "Source__c": F.col("source")}
    return S.crm_payload(rows, mapping, "record", [F.desc("score"), F.col("lead_id")], 50)
