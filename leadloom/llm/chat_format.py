"""Chat formatting: one rendering of a whole dialogue for every participant.

In the rendering of a participant, that speaker's turns are the assistant's, all
other speakers are users under their own names, and system turns stay system
turns. The mask lists the spans (start:length, in code points of the rendering)
that count for the loss: the speaker's own words with their closing mark.

A turn has the same length in all renderings but its speaker's own, so its place
is a running sum over the dialogue plus the speaker's earlier turns times one
difference: windows give both, and nothing grows with the square of a dialogue.
The dialogue is the unit of the output and lies in one row for each participant;
turns are shuffled once, by conversation. Built-in functions only.

Defined cases: a null text is empty; a null role speaks as ``unknown``; null
turns follow all others; equal turns are ordered by role, then text; repeated
rows all stay; null conversation ids form one conversation; other characters than
letters, digits, - and _ of a name become _, and names that agree then are told
apart by #2, #3 ... in the order of their roles; a dialogue of system turns alone
has no participant and gives no row; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.common import table

LAST = 9_223_372_036_854_775_807
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
OWN = f"{OPEN}assistant\n"


def _safe(text: Column) -> Column:
    """Texts cannot forge the marks."""
    return F.replace(text, F.lit("<|im_"), F.lit("<| im_"))


def _name(role: Column) -> Column:
    return F.regexp_replace(role, r"[^\p{L}\p{N}_-]+", "_")


def perspectives(
    turns: DataFrame,
    *,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    system: str = "system",
) -> DataFrame:
    """One row per conversation and participant: rendering, mask and counts."""
    said = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.coalesce(F.col(turn), F.lit(LAST)).alias("turn"),
        F.coalesce(F.col(role), F.lit("unknown")).alias("role"),
        _safe(F.coalesce(F.col(text), F.lit(""))).alias("body"),
    ).withColumn("name", _name(F.col("role")))
    alike = Window.partitionBy("conv_id", "name").orderBy("role")
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "body").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("conv_id", "role").orderBy("turn", "body")
    k = F.dense_rank().over(alike)
    named = said.repartition("conv_id").withColumn("name", F.when(k > 1, F.concat("name", F.lit("#"), k)).otherwise(F.col("name")))
    others = F.when(F.col("role") == system, F.lit(f"{OPEN}system\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), "name", F.lit("\n")))
    placed = (
        named.withColumn("head", others)
        .withColumn("at", F.coalesce(F.sum(F.length("head") + F.length("body") + len(CLOSE)).over(before), F.lit(0)))
        .withColumn("earlier", F.row_number().over(own) - 1)
    )
    message = F.struct("turn", "role", "body", "head", "at", "earlier")
    whole = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(message)).alias("ms"),
        F.sort_array(F.collect_set(F.when(F.col("role") != system, F.struct("role", "head")))).alias("speakers"),
    )
    seen = whole.select("conv_id", "ms", F.explode("speakers").alias("s")).select("conv_id", "ms", F.col("s.role").alias("speaker"), F.col("s.head").alias("as_user"))
    mine = F.filter("ms", lambda m: m["role"] == F.col("speaker"))
    shorter = F.length("as_user") - len(OWN)
    span = lambda m: F.concat_ws(":", m["at"] - m["earlier"] * shorter + len(OWN), F.length(m["body"]) + len(CLOSE))
    head = lambda m: F.when(m["role"] == F.col("speaker"), F.lit(OWN)).otherwise(m["head"])
    return seen.select(
        "conv_id",
        "speaker",
        F.size("ms").cast("long").alias("n_turns"),
        F.size(mine).cast("long").alias("n_own_turns"),
        F.array_join(F.transform(mine, span), ",").alias("mask"),
        F.array_join(F.transform("ms", lambda m: F.concat(head(m), m["body"], F.lit(CLOSE))), "").alias("rendered"),
    ).withColumn("n_chars", F.length("rendered").cast("long"))


def op1_chat_format(spark, sf_dir):
    return perspectives(table(spark, sf_dir, "conversations"))


ORACLE_SQL = r"""
with r as (
  select conv_id, coalesce(turn, 9223372036854775807) as turn, coalesce(role, 'unknown') as role,
         replace(coalesce(text, ''), '<|im_', '<| im_') as body
  from conversations),
n as (select *, regexp_replace(role, '[^\p{L}\p{N}_-]+', '_', 'g') as name from r),
t as (select *, dense_rank() over (partition by conv_id, name order by role) as k from n),
s as (select distinct conv_id, role as speaker from t where role <> 'system'),
h as (
  select t.conv_id, speaker, turn, role, body, role = speaker as own,
         '<|im_start|>' || case when role = speaker then 'assistant' when role = 'system' then 'system'
           else 'user name=' || name || case when k > 1 then '#' || cast(k as varchar) else '' end end || chr(10) as head
  from t join s on t.conv_id is not distinct from s.conv_id),
o as (
  select *, length(head) + length(body) + 11 as n,
         coalesce(sum(length(head) + length(body) + 11) over (
           partition by conv_id, speaker order by turn, role, body
           rows between unbounded preceding and 1 preceding), 0) as pos
  from h)
select conv_id, speaker, count(*)::bigint as n_turns, cast(count(*) filter (where own) as bigint) as n_own_turns,
       coalesce(string_agg(cast(cast(pos + length(head) as bigint) as varchar) || ':' || cast(length(body) + 11 as varchar), ','
           order by turn, role, body) filter (where own), '') as mask,
       string_agg(head || body || '<|im_end|>' || chr(10), '' order by turn, role, body) as rendered,
       sum(n)::bigint as n_chars
from o group by conv_id, speaker
"""
