"""Unions and set comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def union_priority(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """All of a, and of b only what a has not by key."""
    return a.unionByName(b.join(a.select(key), key, "left_anti"))


def set_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Each key with its status: joined, withdrawn or common."""
    left, right = old.select(key).distinct().withColumn("_o", F.lit(1)), new.select(key).distinct().withColumn("_n", F.lit(1))
    status = F.when(F.col("_o").isNull(), "joined").when(F.col("_n").isNull(), "withdrawn").otherwise("common")
    return left.join(right, key, "full").select(key, status.alias("status"))


def intersect_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))
