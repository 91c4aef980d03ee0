"""Entity resolution of names and change capture between list versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions.alike import similarity
from leadloom.functions.text import extract_all
from leadloom.operators.similarity_join import LEAST, form, similar_forms
from leadloom.sources.shared import checkpointed, shuffled, written

# Confidence of each match tier and the review margins.
EXACT, NORMALISED, BASE, FUZZY_LEAST, REVIEW_BELOW, MARGIN = 1.0, 0.95, 0.85, 0.60, 0.90, 0.05
#: Pairs that a block key may make in all; beyond, names are compared by 'similar'.
MOST_PAIRS = 50_000_000
LEGAL = r"\s+(llc|l l c|inc|incorporated|corp|corporation|co|company|ltd|limited|lp|llp|plc)$"
FORMER = r"(?i)\(?\b(?:f/k/a|fka|formerly)\s+([^;,()]+)"
TRADING = r"(?i)\(?\b(?:d/b/a|dba)\s+([^;,()]+)"


def parse_names(df: DataFrame, col: str) -> DataFrame:
    """Main name, former names and trading names out of one string."""
    strip = lambda a: F.transform(a, lambda x: F.trim(x))
    main = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(col), FORMER, ""), TRADING, ""), r"^[*†‡\d.)\s]+|[\s(),;]+$", ""))
    return df.select("*", main.alias("main_name"), strip(extract_all(F.col(col), FORMER)).alias("former_names"), strip(extract_all(F.col(col), TRADING)).alias("dbas"))


def parse_membership(df: DataFrame, col: str) -> DataFrame:
    """Dates of joining and leaving in a note, and whether the member is current."""
    day = r"(\d{1,2}/\d{1,2}/\d{4}|\d{4}-\d{2}-\d{2})"

    def found(word: str) -> Column:
        text = F.regexp_extract(F.col(col), rf"(?i){word}\D{{0,20}}?{day}", 1)
        return F.coalesce(F.try_to_timestamp(text, F.lit("M/d/yyyy")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).cast("date")

    joined, left = found("joined"), found("(?:withdrew|withdrawn)")
    return df.select("*", joined.alias("joined_on"), left.alias("withdrew_on"), (left.isNull() | F.coalesce(joined > left, F.lit(False))).alias("is_member"))


def normalise(col: Column, *, cleanup: bool = False) -> Column:
    """Lower case without punctuation, blanks squeezed; ``cleanup`` also drops notes and reads & as and."""
    if cleanup:
        col = F.regexp_replace(F.regexp_replace(F.regexp_replace(col, r"^[*†‡]+|^\d+\)", ""), r"(?i)\s*\(?see\s.*$", ""), "&", " and ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col), r"[^a-z0-9\s]", " "), r"\s+", " "))


def base_name(col: Column) -> Column:
    return F.regexp_replace(normalise(col), LEGAL, "")


def variants(df: DataFrame, key: str) -> DataFrame:
    """One row for the main, each former and each trading name."""
    kind = lambda label: lambda x: F.struct(F.lit(label).alias("kind"), x.alias("variant"))
    items = F.concat(F.array(F.struct(F.lit("firm").alias("kind"), F.col("main_name").alias("variant"))), F.transform("former_names", kind("former")), F.transform("dbas", kind("dba")))
    return df.select(key, F.explode(items).alias("v")).select(key, "v.*").where("variant <> ''")


def column_variants(df: DataFrame, key: str, name: str, former: str, dba: str) -> DataFrame:
    """As `variants`, where former and trading names are lists in a string, parted by commas."""
    listed = lambda c: F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    split = df.select(key, F.trim(name).alias("main_name"), listed(former).alias("former_names"), listed(dba).alias("dbas"))
    return variants(split, key)


def block(col: Column, strategy: str = "first") -> Column:
    name = normalise(col)
    return {"first": F.substring(name, 1, 1), "first2": F.substring(name, 1, 2), "token": F.split_part(name, F.lit(" "), F.lit(1))}[strategy]


def similar_rows(left: DataFrame, right: DataFrame, name: str, right_name: str, least: float = LEAST) -> DataFrame:
    """Rows of both tables side by side whose names' forms are similar; see `similarity_join`.
    Names of one form are compared once and put in for it at the end. The similar forms are written,
    so that no plan holds both the comparison and what is made of it."""
    a, b = (x.withColumn(f"{c}_form", form(normalise(F.col(n)))) for x, n, c in ((left, name, "l"), (right, right_name, "r")))
    forms = lambda x, c: x.select(F.col(f"{c}_form").alias("form")).distinct()
    pairs = written(similar_forms(forms(a, "l"), forms(b, "r"), least).drop("shared"), "similar-forms")
    return shuffled(shuffled(a).join(pairs, "l_form")).join(b, "r_form").drop("l_form", "r_form")


def similar_pairs(left: DataFrame, right: DataFrame, least: float = LEAST) -> DataFrame:
    """Pairs (l, r) of (l, name) and (r, name) whose forms are similar."""
    return similar_rows(left.select("l", "name"), right.select("r", F.col("name").alias("r_name")), "name", "r_name", least).select("l", "r")


def blocked_pairs(left: DataFrame, right: DataFrame, name: str, right_name: str, strategy: str = "similar", *, key: str = "id", right_key: str = "right_id", least: float = LEAST) -> DataFrame:
    """Candidates: all names of similar grams ('similar', for lists of any length), an equi-join on
    one block key ('first', 'first2', 'token'), or 'hybrid': by first character, those left by
    first token, and those left by similar grams. A block key pairs all its rows, so lists whose
    blocks make over `MOST_PAIRS` pairs are refused."""
    if strategy == "similar":
        return similar_rows(left, right, name, right_name, least)
    if strategy == "hybrid":
        first = blocked_pairs(left, right, name, right_name, "first")
        rest = left.join(first.select(key).distinct(), key, "left_anti")
        second = blocked_pairs(rest, right, name, right_name, "token")
        rest = rest.join(second.select(key).distinct(), key, "left_anti")
        third = blocked_pairs(rest, right, name, right_name, key=key, right_key=right_key, least=least)
        columns = [*left.columns, *right.columns]
        return first.select(columns).unionByName(second.select(columns)).unionByName(third.select(columns))
    a = left.withColumn("_block", block(F.col(name), strategy))
    b = right.withColumn("_block", block(F.col(right_name), strategy))
    sizes = a.groupBy("_block").agg(F.count(F.lit(1)).alias("n")).join(b.groupBy("_block").agg(F.count(F.lit(1)).alias("m")), "_block")
    made = sizes.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    if made > MOST_PAIRS:
        raise ValueError(f"blocks of '{strategy}' make {made} pairs; use 'similar'")
    return a.join(b, "_block").drop("_block")


KINDS = ("firm", "former", "dba")


def tier_match(names: DataFrame, right: DataFrame, *, key: str = "id", right_key: str = "right_id", right_name: str = "right_name", threshold: float = FUZZY_LEAST, least: float = LEAST) -> DataFrame:
    """The best match of each key over its names (key, kind, variant; see `variants`): exact,
    normalised, base name, else fuzzy among all `similar_pairs`.

    Fuzzy matching takes the keys that no earlier tier matched. The highest confidence wins;
    of equals the earlier tier, then the firm's name before a former before a trading name,
    then the smaller right key. Keys without a match keep nulls and confidence 0.
    """
    normal = lambda c: [F.trim(c).alias("exact"), normalise(F.col(c)).alias("normalised"), base_name(F.col(c)).alias("base")]
    left = checkpointed(names.select(F.col(key).alias("_id"), "kind", "variant").distinct().select("_id", "kind", *normal("variant")))
    told = checkpointed(right.select(F.col(right_key).alias("_r"), F.col(right_name).alias("_n"), *normal(right_name)))
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    place = F.struct((-F.col("confidence")).alias("c"), F.col("_t").alias("t"), order.alias("o"), F.col("_r").alias("r"))
    tiers = enumerate((("exact", EXACT), ("normalised", NORMALISED), ("base", BASE)))
    keys = F.inline(F.array(*[F.struct(F.lit(t).alias("_t"), F.lit(c).alias("tier"), F.lit(x).alias("confidence"), F.col(c).alias("_k")) for t, (c, x) in tiers]))
    # one join for the three tiers: a row a tier and name
    by = told.select("_r", keys).where("_k <> ''").groupBy("_t", "_k").agg(F.min("_r").alias("_r"))
    found = shuffled(left.select("_id", "kind", keys)).join(by, ["_t", "_k"]).select("_id", "kind", "_r", "tier", "confidence", place.alias("_o"))
    found = checkpointed(found)
    rest = written(shuffled(left).join(found.select("_id").distinct(), "_id", "left_anti").select("_id", "kind", F.col("normalised").alias("l")), "unmatched")
    rights = written(told.groupBy(F.col("normalised").alias("r")).agg(F.min("_r").alias("_r")), "right-names")
    # equal names score alike, so each is compared once, and only its best goes on
    pairs = similar_pairs(rest.select("l", F.col("l").alias("name")).distinct(), rights.select("r", F.col("r").alias("name")), least)
    scored = written(pairs.select("l", "r", F.round(similarity(F.col("l"), F.col("r"), "max", threshold), 6).alias("confidence")).where(F.col("confidence") >= threshold), "scored")
    closest = shuffled(scored).join(rights, "r").groupBy("l").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "_r")).alias("m")).select("l", F.col("m._r").alias("_r"), (-F.col("m.c")).alias("confidence"))
    fuzzy = shuffled(rest).join(closest, "l").select("_id", "kind", "_r", F.lit("fuzzy").alias("tier"), "confidence", F.lit(3).alias("_t")).withColumn("_o", place).drop("_t")
    best = found.unionByName(fuzzy).groupBy("_id").agg(F.min_by(F.struct("_r", "tier", "confidence", "kind"), "_o").alias("m"))
    every = shuffled(shuffled(left.select("_id").distinct()).join(best, "_id", "left")).join(told.select("_r", "_n"), F.col("m._r") == F.col("_r"), "left")
    return every.select(
        F.col("_id").alias(key), F.col("m._r").alias(right_key), F.col("_n").alias(right_name), F.coalesce("m.tier", F.lit("none")).alias("tier"),
        F.coalesce("m.confidence", F.lit(0.0)).alias("confidence"), F.col("m.kind").alias("matched_on"),
    )


def with_overrides(matches: DataFrame, overrides: DataFrame, key: str = "id") -> DataFrame:
    """Manual matches (key, right_id) come first, with confidence 1; whether a person must look:
    at no match, and at a fuzzy one below the review margin."""
    o = overrides.select(key, F.col("right_id").alias("_o"))
    manual = F.col("_o").isNotNull()
    tier = F.when(manual, "manual").otherwise(F.col("tier"))
    look = ~manual & (F.col("right_id").isNull() | ((F.col("tier") == "fuzzy") & (F.col("confidence") < REVIEW_BELOW)))
    return shuffled(matches).join(o, key, "left").select(
        key, F.coalesce("_o", "right_id").alias("right_id"), tier.alias("tier"), F.when(manual, F.lit(1.0)).otherwise(F.col("confidence")).alias("confidence"), look.alias("needs_review")
    )


def scored_candidates(left: DataFrame, right: DataFrame, *, key: str = "id", name: str = "name", right_key: str = "right_id", right_name: str = "right_name", strategy: str = "similar", least: float = LEAST) -> DataFrame:
    """All candidates of each name with their similarity. Equal names score alike, so of the
    candidates by 'similar' each is compared once, and the scores are written."""
    score = lambda a, b: F.round(similarity(a, b, "max"), 6).alias("confidence")
    if strategy != "similar":
        pairs = blocked_pairs(left.select(key, name), right.select(right_key, right_name), name, right_name, strategy, key=key, right_key=right_key, least=least)
        return pairs.select(key, right_key, score(normalise(F.col(name)), normalise(F.col(right_name))))
    a = written(left.select(key, normalise(F.col(name)).alias("_l")), "left-names")
    b = written(right.select(right_key, normalise(F.col(right_name)).alias("_r")), "right-names")
    pairs = similar_rows(a.select("_l").distinct(), b.select("_r").distinct(), "_l", "_r", least)
    scored = written(pairs.select("_l", "_r", score(F.col("_l"), F.col("_r"))), "scored")
    return shuffled(shuffled(a).join(scored, "_l")).join(b, "_r").select(key, right_key, "confidence")


def ranked_candidates(left: DataFrame, right: DataFrame, k: int, *, key: str = "id", right_key: str = "right_id", **options) -> DataFrame:
    """The k closest candidates of each name."""
    w = Window.partitionBy(key).orderBy(F.desc("confidence"), right_key)
    pairs = scored_candidates(left, right, key=key, right_key=right_key, **options)
    return pairs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def ambiguity(candidates: DataFrame, key: str = "id", margin: float = MARGIN) -> DataFrame:
    """First minus second confidence; a gap below the margin calls for review."""
    top = candidates.where("place <= 2").groupBy(key).agg(F.max(F.when(F.col("place") == 1, F.col("confidence"))).alias("first"), F.max(F.when(F.col("place") == 2, F.col("confidence"))).alias("second"))
    gap = F.round(F.col("first") - F.col("second"), 6)
    return top.select(key, "first", "second", gap.alias("gap"), (F.coalesce(gap < margin, F.lit(False)) | (F.col("first") < REVIEW_BELOW)).alias("needs_review"))


def protect(new: DataFrame, existing: DataFrame, overrides: DataFrame, key: str = "id") -> DataFrame:
    """Manual overrides first, then known-good matches, then the new ones."""
    e = existing.where((F.col("confidence") >= NORMALISED) | F.col("tier").isin("exact", "manual")).select(key, F.col("right_id").alias("_e"))
    o = overrides.select(key, F.col("right_id").alias("_o"))
    source = F.when(F.col("_o").isNotNull(), "manual").when(F.col("_e").isNotNull(), "kept").otherwise("new")
    return shuffled(shuffled(new).join(o, key, "left")).join(e, key, "left").select(key, F.coalesce("_o", "_e", "right_id").alias("right_id"), source.alias("source"))


def compare_runs(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Match rates of two runs, newly matched, changed and lost."""
    x, y = a.select(key, F.col("right_id").alias("_a")), b.select(key, F.col("right_id").alias("_b"))
    j = x.join(y, key, "full")
    has, had = F.col("_b").isNotNull(), F.col("_a").isNotNull()
    return j.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(had.cast("int")), 6).alias("rate_before"), F.round(F.avg(has.cast("int")), 6).alias("rate_after"),
        F.count_if(has & ~had).alias("newly_matched"), F.count_if(has & had & (F.col("_a") != F.col("_b"))).alias("changed"), F.count_if(had & ~has).alias("lost"),
    )


# ---- change capture


def diff(old: DataFrame, new: DataFrame, key: str, name: str, fields: Sequence[str]) -> DataFrame:
    """One row per change: JOINED, WITHDREW, NAME_CHANGED or INFO_UPDATED (with the field), else MATCHED.

    Null and the empty string are the same.
    """
    clean = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    cols = [name, *fields]
    o = old.select(F.col(key), F.struct(*[clean(c).alias(c) for c in cols]).alias("_o"))
    n = new.select(F.col(key), F.struct(*[clean(c).alias(c) for c in cols]).alias("_n"))
    j = o.join(n, key, "full")
    event = lambda kind, field, a, b: F.struct(F.lit(kind).alias("change"), F.lit(field).alias("field"), a.alias("old_value"), b.alias("new_value"))
    null = F.lit(None).cast("string")
    changed = [F.when(~F.col(f"_o.{c}").eqNullSafe(F.col(f"_n.{c}")), event("NAME_CHANGED" if c == name else "INFO_UPDATED", c, F.col(f"_o.{c}"), F.col(f"_n.{c}"))) for c in cols]
    seen = F.filter(F.array(*changed), lambda x: x.isNotNull())
    events = (
        F.when(F.col("_o").isNull(), F.array(event("JOINED", name, null, F.col(f"_n.{name}"))))
        .when(F.col("_n").isNull(), F.array(event("WITHDREW", name, F.col(f"_o.{name}"), null)))
        .when(F.size(seen) == 0, F.array(event("MATCHED", name, F.col(f"_o.{name}"), F.col(f"_n.{name}"))))
        .otherwise(seen)
    )
    return j.select(key, F.explode(events).alias("e")).select(key, "e.*")


def apply_changes(old: DataFrame, new: DataFrame, key: str, run: str) -> DataFrame:
    """The merged list: new values where present, rows that left kept as withdrawn."""
    cols = [c for c in new.columns if c != key]
    o, n = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in cols]), new.withColumn("_in", F.lit(1))
    status = F.when(F.col("_in").isNull(), "WITHDRAWN").otherwise("ACTIVE")
    return o.join(n, key, "full").select(key, *[F.when(F.col("_in").isNull(), F.col(f"_o_{c}")).otherwise(F.col(c)).alias(c) for c in cols], status.alias("status"), F.when(F.col("_in") == 1, run).alias("last_seen"))


def history(changes: DataFrame, key: str, run: str) -> DataFrame:
    """Rows for the append-only log, values as JSON."""
    js = lambda c: F.when(F.col(c).isNotNull(), F.to_json(F.create_map(F.col("field"), F.col(c))))
    return changes.where("change <> 'MATCHED'").select(key, "change", js("old_value").alias("old_json"), js("new_value").alias("new_json"), F.lit(run).alias("run"))
