"""Text and number cleaning as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(col: Column, pattern: str) -> Column:
    return F.regexp_replace(col, pattern, "")


def digits_id(col: Column) -> Column:
    """The digits of a free-text id as a number; null if there are none or too many."""
    return strip(col, "[^0-9]").try_cast("bigint")


def money(col: Column) -> Column:
    return strip(col, "[$,% ]").try_cast("double")


def count_or_midpoint(col: Column) -> Column:
    """'< 5' is 2, an empty string is null, else the integer."""
    return F.when(F.trim(col) == "< 5", F.lit(2)).when(F.trim(col) == "", F.lit(None)).otherwise(F.trim(col).try_cast("int"))


def yes_no(col: Column) -> Column:
    low = F.lower(F.trim(col))
    return F.when(low.isin("yes", "y", "true"), 1).when(low.isin("no", "n", "false"), 0)


def has_word(col: Column, words: Sequence[str]) -> Column:
    """Any of the words, as whole words of any script, in any case."""
    found = "|".join(re.escape(w.lower()) for w in words)
    return F.lower(col).rlike(rf"(^|[^\p{{L}}\p{{N}}_])({found})($|[^\p{{L}}\p{{N}}_])")


def ilike_any(col: Column, patterns: Sequence[str]) -> Column:
    """UPPER(col) LIKE any pattern."""
    found = F.lit(False)
    for p in patterns:
        found = found | F.upper(col).like(p.upper())
    return found


def extract_all(col: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), group)


def template(form: str, *cols: Column) -> Column:
    return F.format_string(form, *cols)


def split_list(col: Column, sep: str = ",") -> Column:
    """Trimmed, non-empty items of a separated list."""
    return F.filter(F.transform(F.split(col, re.escape(sep)), lambda x: F.trim(x)), lambda x: x != "")


def first_token(col: Column, sep: str = " ") -> Column:
    return F.get(split_list(col, sep), 0)


def zip3(col: Column) -> Column:
    return F.substring(F.trim(col), 1, 3)


def json_list(col: Column) -> Column:
    """A JSON array in a string; an empty array if it is none."""
    return F.coalesce(F.from_json(col, "array<string>"), F.array().cast("array<string>"))


def change_json(field: Column, value: Column) -> Column:
    return F.to_json(F.map_from_arrays(F.array(field), F.array(value)))
