"""Predicates, flags and column selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import has_word, ilike_any


def drop_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def drop_pii(df: DataFrame, contract: Mapping[str, Sequence[str]]) -> DataFrame:
    """Drop what the contract lists under any of its headings."""
    return df.drop(*[c for group in contract.values() for c in group])


def auto_numeric(df: DataFrame, cols: Sequence[str], share: float = 0.5) -> DataFrame:
    """Cast the text columns of which more than ``share`` of the values parse. One aggregate decides."""
    got = df.agg(
        *[F.count(F.col(c).try_cast("double")).alias(f"ok_{c}") for c in cols], *[F.count(c).alias(f"n_{c}") for c in cols]
    ).first()
    numeric = {c for c in cols if got[f"n_{c}"] and got[f"ok_{c}"] > share * got[f"n_{c}"]}
    return df.select(*[F.col(c).try_cast("double").alias(c) if c in numeric else F.col(c) for c in df.columns])


def dedupe_columns(df: DataFrame, suffixes: tuple[str, str] = ("_x", "_y"), r: float = 0.98) -> DataFrame:
    """After a merge: of two columns that are equal, or correlate by r or more, keep the fuller."""
    names = [c.removesuffix(suffixes[0]) for c in df.columns if c.endswith(suffixes[0]) and c.removesuffix(suffixes[0]) + suffixes[1] in df.columns]
    if not names:
        return df
    kinds, stats = dict(df.dtypes), [F.count(F.lit(1)).alias("n")]
    for name in names:
        a, b = name + suffixes[0], name + suffixes[1]
        stats += [F.count_if(F.col(a).eqNullSafe(F.col(b))).alias(f"same_{name}"), F.count(a).alias(f"a_{name}"), F.count(b).alias(f"b_{name}")]
        numeric = kinds[a] != "string" and kinds[b] != "string"
        stats.append((F.corr(F.col(a).cast("double"), F.col(b).cast("double")) if numeric else F.lit(None)).alias(f"r_{name}"))
    got, out = df.agg(*stats).first(), df
    for name in names:
        a, b = name + suffixes[0], name + suffixes[1]
        if got[f"same_{name}"] == got["n"] or (got[f"r_{name}"] or 0) >= r:
            keep, drop = (a, b) if got[f"a_{name}"] >= got[f"b_{name}"] else (b, a)
            out = out.drop(drop).withColumnRenamed(keep, name)
    return out


def valid_leads(leads: DataFrame, lo: date, hi: date, *, anchor: str = "contacted", key: str = "person_id", deleted: str | None = None, company: str | None = None, own: str = "") -> DataFrame:
    kept = leads.where(F.col(anchor).isNotNull() & F.col(key).isNotNull() & F.col(anchor).between(F.lit(lo), F.lit(hi)))
    if deleted:
        kept = kept.where(~F.coalesce(F.col(deleted), F.lit(False)))
    if company:
        kept = kept.where(~F.coalesce(F.upper(company).like(f"%{own.upper()}%"), F.lit(False)))
    return kept


def exclude_patterns(df: DataFrame, col: str, patterns: Sequence[str]) -> DataFrame:
    """A null value matches no pattern and stays."""
    return df.where(~F.coalesce(ilike_any(F.col(col), patterns), F.lit(False)))


def exclude_keys(df: DataFrame, keys: DataFrame, key: str, *, null_aware: bool = True) -> DataFrame:
    """Rows whose key is not listed; like NOT IN, a null key goes too."""
    kept = df.join(keys.select(key).distinct(), key, "left_anti")
    return kept.where(F.col(key).isNotNull()) if null_aware else kept


def exclude_titles(df: DataFrame, words: Sequence[str], col: str = "title", *, keep_null_title: bool = True) -> DataFrame:
    return df.where(F.coalesce(~has_word(F.col(col), words), F.lit(keep_null_title)))


def passes_producing(producing: Column, title: Column, words: Sequence[str]) -> Column:
    """Producing, or a title that says owner."""
    return F.coalesce(producing, F.lit(False)) | F.coalesce(has_word(title, words), F.lit(False))


def mature(leads: DataFrame, as_of: date, days: int, anchor: str = "contacted") -> DataFrame:
    return leads.where(F.datediff(F.lit(as_of), F.col(anchor)) >= days)


def contact_window(df: DataFrame, as_of: date, lo: int = 90, hi: int = 730, col: str = "last_contact") -> DataFrame:
    return df.where(F.datediff(F.lit(as_of), F.col(col)).between(lo, hi))


def exclude_recent_movers(df: DataFrame, as_of: date, *, start: str, closed: str, days: int = 730) -> DataFrame:
    """Drop those who moved after the record was closed, less than ``days`` ago; unknown dates stay."""
    recent = (F.col(start) > F.col(closed)) & (F.datediff(F.lit(as_of), F.col(start)) < days)
    return df.where(~F.coalesce(recent, F.lit(False)))


def turnover_below(df: DataFrame, cap: float = 100.0, col: str = "turnover_pct") -> DataFrame:
    return df.where(F.col(col).isNull() | (F.col(col) < cap))


def flag_patterns(col: Column, patterns: Sequence[str]) -> Column:
    return F.coalesce(ilike_any(col, patterns), F.lit(False)).cast("int")


def cert_flags(licences: Column, bio: Column, title: Column) -> dict[str, Column]:
    """Certification flags from the licence list, the biography and the title."""
    said = F.concat_ws(" ", bio, title)
    s7, s65 = F.coalesce(licences.like("%Series 7%"), F.lit(False)), F.coalesce(licences.like("%Series 65%"), F.lit(False))
    return {
        "is_cfp": (F.coalesce(has_word(said, ["cfp"]), F.lit(False)) | F.coalesce(licences.like("%CFP%"), F.lit(False))).cast("int"),
        "is_cfa": (F.coalesce(has_word(said, ["cfa"]), F.lit(False)) | F.coalesce(licences.like("%CFA%"), F.lit(False))).cast("int"),
        "has_series_7": s7.cast("int"),
        "has_series_65": s65.cast("int"),
        "series_65_only": (s65 & ~s7).cast("int"),
    }


def title_class(title: Column, high: Sequence[str], owner: Sequence[str], excluded: Sequence[str]) -> Column:
    return (
        F.when(title.isNull(), "none")
        .when(has_word(title, excluded), "excluded")
        .when(has_word(title, high), "high_value")
        .when(has_word(title, owner), "owner")
        .otherwise("other")
    )


def contact_flags(email: Column, profile: Column, firm: Column) -> dict[str, Column]:
    filled = lambda c: (c.isNotNull() & (F.trim(c.cast("string")) != "")).cast("int")
    return {"has_email": filled(email), "has_profile": filled(profile), "has_firm_data": filled(firm)}


def missing_flags(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    flags = [F.col(c).isNull().cast("int").alias(f"{c}_is_missing") for c in cols]
    total = sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0))
    return df.select("*", *flags, total.alias("missing_count"))
