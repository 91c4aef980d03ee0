"""Null-safe arithmetic, buckets and flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def log1(x: Column) -> Column:
    """ln(1 + x) of what is not negative, null otherwise."""
    return F.when(x >= 0, F.log1p(x))


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def bucketise(col: Column, edges: Sequence[float], labels: Sequence[str], missing: str = "Unknown") -> Column:
    """The label of the first edge that the value lies below; the last label is above all."""
    out = F.when(col.isNull(), missing)
    for edge, label in zip(edges, labels, strict=False):
        out = out.when(col < edge, label)
    return out.otherwise(labels[-1])


# Edges and labels of the rule book.
TENURE_MONTHS = ((12, 24, 48, 120), ("0-12", "12-24", "24-48", "48-120", "120+"))
EXPERIENCE_YEARS = ((5, 10, 15, 20), ("0-5", "5-10", "10-15", "15-20", "20+"))
AUM_TIERS = ((1e6, 1e7, 1e8, 1e9), ("UNDER_1M", "1M_10M", "10M_100M", "100M_1B", "OVER_1B"))


def experience_bucket(years: Column) -> Column:
    """0 and null are unknown."""
    return bucketise(F.when(years > 0, years), *EXPERIENCE_YEARS)
