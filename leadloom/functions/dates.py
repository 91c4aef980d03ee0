"""Date semantics. Differences count boundaries; nothing reads the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_diff(a: Column, b: Column) -> Column:
    """Month boundaries from b to a."""
    return (F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)


def day_diff(a: Column, b: Column) -> Column:
    return F.datediff(a, b)


def year_diff(a: Column, b: Column) -> Column:
    """Year boundaries from b to a."""
    return F.year(a) - F.year(b)


def years_between(a: Column, b: Column) -> Column:
    """Fractional years of 365 days."""
    return F.datediff(a, b) / F.lit(365.0)


def shift(d: Column, n: int, unit: str) -> Column:
    """d plus n days, months or years; the end of a month is kept within the month."""
    if unit == "day":
        return F.date_add(d, n)
    return F.add_months(d, n * {"month": 1, "year": 12}[unit])


def month_start(d: Column, back: int = 0) -> Column:
    return F.add_months(F.trunc(d, "MM"), -back).cast("date")


def iso_dow(d: Column) -> Column:
    """Monday 1 to Sunday 7."""
    return F.weekday(d) + 1


def is_weekend(d: Column) -> Column:
    return iso_dow(d) >= 6


def parse_period(s: Column) -> Column:
    """'YYYY-MM' to the first of the month; null if it is none."""
    return F.try_to_timestamp(F.concat(s, F.lit("-01")), F.lit("yyyy-MM-dd")).cast("date")


def period(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def gap_label(days: Column) -> Column:
    """A gap in days as a label."""
    return (
        F.when(days.isNull(), "none")
        .when(days <= 30, "0-30 days")
        .when(days <= 90, "31-90 days")
        .when(days <= 180, "91-180 days")
        .when(days <= 365, "181-365 days")
        .otherwise("over a year")
    )
