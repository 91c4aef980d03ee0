"""Quality gates: metrics of a list, thresholds, point-in-time and leakage checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    metric: str
    low: float | None = None
    high: float | None = None
    blocking: bool = True


def validate_list(df: DataFrame, key: str, coverage: Sequence[str], forbidden: Column) -> DataFrame:
    """Row count, duplicate keys, coverage in percent and forbidden rows, as metric rows from one aggregate."""
    stats = {
        "row_count": F.count(F.lit(1)).cast("double"),
        "duplicate_keys": (F.count(key) - F.countDistinct(key)).cast("double"),
        "forbidden": F.count_if(F.coalesce(forbidden, F.lit(False))).cast("double"),
    } | {f"coverage_{c}": F.round(100 * F.avg(F.col(c).isNotNull().cast("int")), 4) for c in coverage}
    one = df.agg(*[c.alias(n) for n, c in stats.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("actual")) for n in stats])).alias("m")).select("m.*")


def gate(metrics: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """A row per rule: bounds, value, passed, blocking. A metric that is missing does not pass."""
    table = metrics.sparkSession.createDataFrame([(i, r.metric, *(None if x is None else float(x) for x in (r.low, r.high)), r.blocking) for i, r in enumerate(rules, 1)], "id int, metric string, low double, high double, blocking boolean")
    inside = F.coalesce(F.col("actual") >= F.coalesce("low", F.lit(float("-inf"))), F.lit(False)) & F.coalesce(F.col("actual") <= F.coalesce("high", F.lit(float("inf"))), F.lit(False))
    return table.join(metrics, "metric", "left").select("id", "metric", "low", "high", "actual", inside.alias("passed"), "blocking")


def pit_checks(df: DataFrame, contact: str, snapshot: str) -> DataFrame:
    """Snapshots after the contact, snapshots that are no month start, negative ages, rows."""
    age = F.datediff(contact, snapshot)
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(snapshot) > F.col(contact)).alias("future_snapshots"),
        F.count_if(F.dayofmonth(snapshot) != 1).alias("odd_dates"), F.count_if(age < 0).alias("negative_days"), F.count_if(F.col(snapshot).isNull()).alias("no_snapshot"),
    )


def feature_checks(before: DataFrame, after: DataFrame, cols: Sequence[str], limit: float) -> DataFrame:
    """Null rate of each column against a limit, and whether the rows are all there."""
    n = before.agg(F.count(F.lit(1)).alias("rows_before"))
    one = after.agg(F.count(F.lit(1)).alias("rows_after"), *[F.round(F.avg(F.col(c).isNull().cast("int")), 6).alias(f"n_{c}") for c in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n_{c}").alias("null_rate")) for c in cols])
    return one.crossJoin(F.broadcast(n.limit(1))).select((F.col("rows_before") == F.col("rows_after")).alias("rows_kept"), F.explode(rows).alias("x")).select(
        "rows_kept", "x.*", (F.col("x.null_rate") <= limit).alias("passed")
    )


def leakage_checks(df: DataFrame, features: Sequence[str], y: str, most: float = 0.7) -> DataFrame:
    """Absolute correlation with the target; above ``most`` a feature is suspected to know the answer."""
    one = df.agg(*[F.round(F.abs(F.corr(F.col(f).cast("double"), F.col(y).cast("double"))), 6).alias(f"r_{f}") for f in features])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"r_{f}").alias("abs_corr")) for f in features])
    return one.select(F.explode(rows).alias("x")).select("x.*", F.coalesce(F.col("x.abs_corr") <= most, F.lit(True)).alias("passed"))


def recomputed(df: DataFrame, again: DataFrame, key: str, cols: Mapping[str, str]) -> DataFrame:
    """Rows whose stored value differs from its recomputation, by column."""
    j = df.join(again.select(key, *[F.col(b).alias(f"_{a}") for a, b in cols.items()]), key, "left")
    one = j.agg(*[F.count_if(~F.col(a).eqNullSafe(F.col(f"_{a}"))).alias(a) for a in cols])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("column_name"), F.col(a).alias("differs")) for a in cols])).alias("x")).select("x.*")


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
