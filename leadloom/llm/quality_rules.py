r"""Quality rules: a threshold table compiled into one Spark projection.

``RULES`` is data: a measure, a lower and an upper bound. ``measures`` turns a
text into its counts with built-in array and string functions, and ``verdict``
folds the table into one boolean expression. No user function runs and nothing
is shuffled: each text is judged where it is read.

Repeated words: the 3-word windows of a text are sorted with their positions, so
equal windows are neighbours; the positions they cover are counted once each.

Defined cases: a null or empty text has no words and fails the base rules;
the ratios of a text without words are null and pass, which never saves it; each row is
judged by itself, so rows repeated or without an id are judged each; an empty table gives
no rows; kept columns may have any name but those of the counts. A text's windows are
sorted in one row and take some twenty times its bytes, so the longest text must be that
much smaller than a task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import fresh, table, words

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a and are as at be by for from in is it of on or that the this to was with "
    "an auf das dem den der des die ein eine für im ist mit nicht sich und von zu "
    "au aux ce dans de des du elle en est et la le les ne pas pour que qui sur un une "
    "como con del el es esta las lo los más no para por se su una y"
).split()
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A measure must lie within [low, high]; None leaves a side open."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The table. Ratios are per word or per line; see `ratios`.
RULES: tuple[Rule, ...] = (
    Rule("mean_word_chars", 2.0, 12.0),
    Rule("symbols_per_word", None, 0.1),
    Rule("pipe_words_share", None, 0.1),
    Rule("upper_words_share", None, 0.5),
    Rule("letter_words_share", 0.6, None),
    Rule("stop_words_share", 0.02, None),
    Rule("dup_lines_share", None, 0.5),
    Rule("bullet_lines_share", None, 0.9),
    Rule("ellipsis_lines_share", None, 0.3),
)


def _share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def repeated_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more, as a count of positions."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("w"), i.alias("p")),
    )
    repeats = F.transform(
        F.array(F.sort_array(windows)),  # binds the sorted array to a name
        lambda s: F.filter(
            s,
            lambda x, i: F.coalesce(F.get(s, i - 1)["w"] == x["w"], F.lit(False))
            | F.coalesce(F.get(s, i + 1)["w"] == x["w"], F.lit(False)),
        ),
    )[0]
    covered = F.flatten(F.transform(repeats, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))
    return F.when(F.size(w) < 3, F.lit(0)).otherwise(F.size(F.array_distinct(covered)))


def measures(docs: DataFrame, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """The columns of ``keep`` and the counts of each text."""
    t, w, l = fresh(list(keep), "_t", "_w", "_l")  # noqa: E741
    split = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(t), words(F.col(text)).alias(w))
    lined = split.withColumn(l, F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    any_of = lambda test: F.size(F.filter(w, test))
    lines_of = lambda test: F.size(F.filter(l, test))
    return lined.select(
        *keep,
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(F.col(t), F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(l) - F.size(F.array_distinct(l))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col(w)).cast("long").alias("n_repeat_words"),
        F.size(l).cast("long").alias("n_lines"),
        any_of(lambda x: x == "|").cast("long").alias("n_pipe_words"),
        F.regexp_count(F.col(t), F.lit(r"(?<!\p{L})\p{Lu}{2,}(?!\p{L})")).cast("long").alias("n_upper_words"),
        any_of(lambda x: F.upper(x) != F.lower(x)).cast("long").alias("n_letter_words"),
        F.regexp_count(F.lower(t), F.lit(r"(?<!\p{L})(" + "|".join(dict.fromkeys(STOP_WORDS)) + r")(?!\p{L})")).cast("long").alias("n_stop_words"),
        lines_of(lambda x: x.rlike(r"^\s*[-*•]")).cast("long").alias("n_bullet_lines"),
        lines_of(lambda x: x.rlike(r"(\.\.\.|…)\s*$")).cast("long").alias("n_ellipsis_lines"),
    )


def ratios() -> dict[str, Column]:
    n, lines = F.col("n_words"), F.col("n_lines")
    return {
        "mean_word_chars": _share(F.col("word_chars"), n),
        "symbols_per_word": _share(F.col("n_symbols"), n),
        "pipe_words_share": _share(F.col("n_pipe_words"), n),
        "upper_words_share": _share(F.col("n_upper_words"), n),
        "letter_words_share": _share(F.col("n_letter_words"), n),
        "stop_words_share": _share(F.col("n_stop_words"), n),
        "dup_lines_share": _share(F.col("n_dup_lines"), lines),
        "bullet_lines_share": _share(F.col("n_bullet_lines"), lines),
        "ellipsis_lines_share": _share(F.col("n_ellipsis_lines"), lines),
    }


def verdict(rules: Sequence[Rule] = RULES) -> Column:
    """All rules as one boolean expression over the counts."""
    passed, by_name = F.lit(True), ratios()
    for rule in rules:
        value = by_name[rule.measure]
        if rule.low is not None:
            passed &= F.coalesce(value >= rule.low, F.lit(True))
        if rule.high is not None:
            passed &= F.coalesce(value <= rule.high, F.lit(True))
    return passed


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality(docs: DataFrame, *, text: str = "text", keep: Sequence[str] = ("doc_id",), rules: Sequence[Rule] = RULES) -> DataFrame:
    """``keep``, the counts, ``base_failed`` and ``kept`` of every document."""
    counted = measures(docs, text, keep).withColumn("base_failed", base_failed())
    return counted.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op8_quality_rules(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_STOP = "|".join(dict.fromkeys(STOP_WORDS))
ORACLE_SQL = rf"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from documents),
x as (
  select r, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] as win
  from (select r, w, unnest(range(1, len(w) - 1)) as p from d)),
y as (select r, p, count(*) over (partition by r, win) as c from x),
z as (select r, count(distinct q) as n from (select r, unnest([p, p + 1, p + 2]) as q from y where c > 1) group by r),
m as (
  select d.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(z.n, 0)::bigint as n_repeat_words,
         len(l) as n_lines, len(list_filter(w, lambda v: v = '|')) as n_pipe,
         len(list_filter(w, lambda v: upper(v) <> lower(v))) as n_letter,
         len(list_filter(regexp_extract_all(t, '\p{{L}}+'), lambda v: regexp_matches(v, '^\p{{Lu}}{{2,}}$'))) as n_upper,
         len(list_filter(regexp_extract_all(lower(t), '\p{{L}}+'), lambda v: regexp_matches(v, '^({_STOP})$'))) as n_stop,
         len(list_filter(l, lambda v: regexp_matches(v, '^[\s\x0B]*[-*•]'))) as n_bullet,
         len(list_filter(l, lambda v: regexp_matches(v, '(\.\.\.|…)[\s\x0B]*$'))) as n_dots
  from d left join z using (r)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed
       and word_chars / n_words between 2 and 12 and n_symbols / n_words <= 0.1::double and n_pipe / n_words <= 0.1::double
       and n_upper / n_words <= 0.5::double and n_letter / n_words >= 0.6::double and n_stop / n_words >= 0.02::double
       and n_dup_lines / n_lines <= 0.5::double and n_bullet / n_lines <= 0.9::double and n_dots / n_lines <= 0.3::double as kept
from b
"""
