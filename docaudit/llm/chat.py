"""Chat formatting by perspective rotation: a dialogue rendered once for each participant. DataFrame functions only.

For each participant the dialogue is written with that speaker as the assistant, every other speaker as a named
user, and the system's turns as they are. `spans` says which characters of `rendered` are trained on: the
assistant's words with their end mark, as start:end pairs in code points from the row's start.

A dialogue is cut into parts of TURNS turns, one row a part, so that no row and no task grows with a dialogue:
turns are ranked in two steps (counts by block of turn numbers, then within a block).

Cases: turns are in order of turn, role and text, nulls first; repeated turns stay, each in its place; a null or
blank role speaks as `unknown` and takes no perspective of its own; `system` takes none either, so a dialogue
without participants has no row; null text is empty; a mark's opening in a text, and openings, ends and line breaks in
a role are broken up as they are rendered so that a speaker can't forge a turn (`perspective` is the role itself);
null conversation ids are one conversation. Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURNS = 256
END = "<|end|>\n"


def ranked(turns: DataFrame) -> DataFrame:
    """conv_id, who, body, rank: turns with their place in the dialogue, from 0."""
    who = F.coalesce(F.nullif(F.trim("role"), F.lit("")), F.lit("unknown"))
    body = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |"))
    rows = turns.select("conv_id", "turn", "role", "text", who.alias("who"), body.alias("body"), F.floor(F.col("turn") / TURNS).alias("block"))
    before = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first())
    before = before.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), (F.sum("n").over(w) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(*(F.col(c).asc_nulls_first() for c in ("turn", "role", "text"))))
    rows = rows.withColumn("inside", inside)
    return rows.join(before, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b"))).select("conv_id", "who", "body", (F.col("before") + F.col("inside") - 1).alias("rank"))


def _name(who: Column) -> Column:
    """A role as it is rendered: no mark can open or end in it."""
    return F.translate(F.replace(F.replace(who, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >")), "\n\r", "  ")


def _head(who: Column, perspective: Column) -> Column:
    return F.when(who == perspective, "<|assistant|>\n").when(who == "system", "<|system|>\n").otherwise(F.concat(F.lit("<|user name="), _name(who), F.lit("|>\n")))


def _spans(turns: Column, perspective: Column) -> Column:
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(s: Column, t: Column) -> Column:
        begin = s.at + F.length(_head(t.who, perspective))
        end = begin + F.length(t.body) + len(END)
        return F.struct(end.alias("at"), F.when(t.who == perspective, F.array_append(s.out, F.concat(begin.cast("string"), F.lit(":"), end.cast("string")))).otherwise(s.out).alias("out"))

    return F.aggregate(turns, start, add, lambda s: F.array_join(s.out, ","))


def rotate(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, part, n_turns, n_own, n_chars, rendered, spans: one row a part and participant."""
    rows = ranked(turns)
    parts = rows.withColumn("part", F.floor(F.col("rank") / TURNS).cast("long")).groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("rank", "who", "body"))).alias("turns"))
    speakers = rows.where(~F.col("who").isin("system", "unknown")).select(F.col("conv_id").alias("c"), F.col("who").alias("perspective")).distinct()
    p, t = F.col("perspective"), F.col("turns")
    rendered = F.array_join(F.transform(t, lambda x: F.concat(_head(x.who, p), x.body, F.lit(END))), "")
    out = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("c")))
    out = out.select("conv_id", "perspective", "part", F.size(t).cast("long").alias("n_turns"), F.size(F.filter(t, lambda x: x.who == p)).cast("long").alias("n_own"), rendered.alias("rendered"), _spans(t, p).alias("spans"))
    return out.withColumn("n_chars", F.length("rendered").cast("long"))


ORACLE_SQL = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS rank,
    coalesce(nullif(trim(role), ''), 'unknown') AS who, replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) AS body
  FROM conversations),
p AS (SELECT DISTINCT conv_id, who AS perspective FROM t WHERE who NOT IN ('system', 'unknown')),
r AS (
  SELECT t.conv_id, perspective, rank // {TURNS} AS part, rank, who = perspective AS own, body,
    CASE WHEN who = perspective THEN '<|assistant|>' WHEN who = 'system' THEN '<|system|>' ELSE '<|user name=' || translate(replace(replace(who, '<|', '< |'), '|>', '| >'), chr(10) || chr(13), '  ') || '|>' END || chr(10) AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, part ORDER BY rank) AS stop FROM r)
SELECT conv_id, perspective, CAST(part AS BIGINT) AS part, count(*) AS n_turns, count(*) FILTER (own) AS n_own,
  string_agg(head || body, '' ORDER BY rank) AS rendered,
  coalesce(string_agg(CAST(stop - length(body) AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY rank) FILTER (own), '') AS spans,
  CAST(sum(length(head) + length(body)) AS BIGINT) AS n_chars
FROM o GROUP BY conv_id, perspective, part
"""
