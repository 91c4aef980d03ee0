"""Reading and writing tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def load_csv_typed(spark: SparkSession, path: str, schema: Mapping[str, str], na: Sequence[str] = ("", "NA", "N/A", "null")) -> DataFrame:
    """A CSV with a header, all read as text; NA marks become null, the rest is cast where it can be."""
    raw = spark.read.csv(path, header=True, inferSchema=False, escape='"', multiLine=True)
    return raw.select(*[F.when(~F.trim(F.col(c)).isin(*na), F.trim(F.col(c))).try_cast(t).alias(c) for c, t in schema.items()])


def literal_table(spark: SparkSession, values: Sequence, col: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{col} string")


def month_spine(spark: SparkSession, start: date, end: date, col: str = "month") -> DataFrame:
    return spark.range(1).select(
        F.explode(F.sequence(F.trunc(F.lit(start), "MM"), F.trunc(F.lit(end), "MM"), F.expr("interval 1 month"))).alias(col)
    )


def profile(df: DataFrame, name: str) -> DataFrame:
    """One row per column: type, rows and nulls, in one pass."""
    stats = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)],
    )
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.lit(t).alias("type"), F.col("n").alias("row_count"), F.col(f"n{i}").alias("nulls"))
            for i, (c, t) in enumerate(df.dtypes)
        ]
    )
    return stats.select(F.explode(rows).alias("r")).select("r.*")


def save(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def save_partitioned(df: DataFrame, path: str, by: Sequence[str], cluster: Sequence[str], mode: str = "overwrite") -> None:
    """Files by partition value, sorted inside by the cluster key. The rows of a
    partition are dealt by the cluster key too, so a large one has many files."""
    df.repartition(*by, *cluster).sortWithinPartitions(*by, *cluster).write.mode(mode).partitionBy(*by).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_partition(df: DataFrame, path: str, by: str) -> None:
    """Overwrite only the partitions that ``df`` holds; running it twice changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def register_view(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def export_csv(df: DataFrame, cols: Sequence[str], path: str, order: Sequence[str], *, most: int = 1_000_000) -> None:
    """Ordered CSV with headers: one file of up to ``most`` rows, else a file a range, in the order of their names."""
    rows = df.select(*cols).orderBy(*order)
    one = df.limit(most + 1).count() <= most
    (rows.coalesce(1) if one else rows).write.mode("overwrite").csv(path, header=True)


def crm_payload(df: DataFrame, mapping: Mapping[str, Column], id_col: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first n records as JSON documents under the CRM's own field names."""
    return df.orderBy(*order).limit(n).select(F.col(id_col).alias("record_id"), F.to_json(F.struct(*[c.alias(k) for k, c in mapping.items()])).alias("payload"))
