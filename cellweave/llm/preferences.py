"""Preference pairs: one prompt for the turns that chosen and rejected share, and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

END = "<|end|>\n"


def header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("unknown")), F.lit("|>\n"))


def body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(header(t), body(t))), "")


def trained_spans(turns: Column) -> Column:
    """Begin and end, in characters of the rendered turns, of what a loss counts: the assistant's words and end marks."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("spans"))

    def step(done: Column, turn: Column) -> Column:
        begin = done["at"] + F.length(header(turn))
        end = begin + F.length(body(turn))
        own = F.array(F.struct(begin.alias("begin"), end.alias("end")))
        spans = F.when(turn["role"] == "assistant", F.concat(done["spans"], own)).otherwise(done["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda done: done["spans"])


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns with equal roles and texts."""
    shorter = F.least(F.size(a), F.size(b))
    differs = lambda i: ~(F.get(a, i)["role"].eqNullSafe(F.get(b, i)["role"]) & F.get(a, i)["text"].eqNullSafe(F.get(b, i)["text"]))
    return F.array_min(F.filter(F.sequence(F.lit(0), shorter), lambda i: (i == shorter) | differs(i)))


def format_preferences(pairs: DataFrame) -> DataFrame:
    """Rows (pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans).

    `pairs` has pair_id and the arrays chosen and rejected of turns with role and text. The
    longest common prefix of turns is rendered once, as the prompt; what follows on each side is
    its completion, with the spans that a loss counts. The prompt is masked whole. A null array
    is an empty conversation; two equal conversations give empty completions. A null role is
    rendered as `unknown`, a null text as nothing. Repeated pairs each give a row.
    """
    no_turns = F.array().cast("array<struct<role:string,text:string>>")
    plain = lambda name: F.coalesce(F.transform(name, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))), no_turns)
    turns = pairs.select("pair_id", plain("chosen").alias("c"), plain("rejected").alias("r")).withColumn("n", common_prefix(F.col("c"), F.col("r")))
    rest = lambda name: F.slice(name, F.col("n") + 1, F.greatest(F.size(name) - F.col("n"), F.lit(0)))
    split = turns.select("pair_id", "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return split.select(
        "pair_id",
        F.col("n").cast("long").alias("n_prompt_turns"),
        render(F.col("p")).alias("prompt"),
        render(F.col("c")).alias("chosen"),
        render(F.col("r")).alias("rejected"),
        trained_spans(F.col("c")).alias("chosen_spans"),
        trained_spans(F.col("r")).alias("rejected_spans"),
    )


def conversations_as_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (pair_id, chosen, rejected) from (conv_id, turn, role, text) rows.

    Each conversation is chosen as it is. In its rejected twin the last reply of the assistant,
    and what follows, gives way to the last reply of the neighbour, conversation 2k+1 for 2k and
    2k for 2k+1; without such a neighbour the twin ends before the reply, and without a reply of
    its own a conversation is its own twin. Turns are in the order of turn, role and text; rows
    without a conv_id belong to no conversation. A conversation is one row and so must fit a task.
    """
    turn = F.struct("turn", "role", "text")
    talks = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    places = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: F.get("turns", i)["role"].eqNullSafe("assistant"))
    talks = talks.withColumn("last", F.array_max(places))
    replies = talks.where("last is not null").select(F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("neighbour"), F.get("turns", F.col("last")).alias("reply"))
    both = talks.join(replies, talks.conv_id == replies.neighbour, "left")
    other = F.when(F.col("reply").isNull(), F.array().cast("array<struct<turn:bigint,role:string,text:string>>")).otherwise(F.array("reply"))
    twin = F.when(F.col("last").isNull(), F.col("turns")).otherwise(F.concat(F.slice("turns", F.lit(1), F.col("last")), other))
    return both.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), twin.alias("rejected"))


def op4_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = format_preferences(conversations_as_pairs(read_table(spark, sf_dir, "conversations")))
    text = lambda name: F.array_join(F.transform(name, lambda s: F.concat_ws("-", s["begin"].cast("string"), s["end"].cast("string"))), ";")
    return made.withColumns({name: text(name) for name in ("chosen_spans", "rejected_spans")})


OP4_SQL = r"""
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, max(k) FILTER (WHERE role = 'assistant') AS la FROM t GROUP BY 1),
reply AS (SELECT t.conv_id, t.role, t.text FROM t JOIN l ON t.conv_id = l.conv_id AND t.k = l.la),
r AS (
  SELECT t.conv_id, k, role, text FROM t JOIN l USING (conv_id) WHERE la IS NULL OR k < la
  UNION ALL SELECT l.conv_id, l.la, reply.role, reply.text FROM l JOIN reply ON reply.conv_id = xor(l.conv_id, 1::BIGINT) WHERE la IS NOT NULL),
m AS (
  SELECT coalesce(t.conv_id, r.conv_id) AS conv_id, coalesce(t.k, r.k) AS k,
    t.k IS NULL OR r.k IS NULL OR t.role IS DISTINCT FROM r.role OR t.text IS DISTINCT FROM r.text AS differs
  FROM t FULL JOIN r ON t.conv_id = r.conv_id AND t.k = r.k),
p AS (SELECT conv_id, coalesce(min(k) FILTER (WHERE differs) - 1, count(*)) AS n FROM m GROUP BY 1),
b AS (
  SELECT side, x.conv_id, k, n, role, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) AS h, coalesce(text, '') || '<|end|>' || chr(10) AS c
  FROM (SELECT 'c' AS side, * FROM t UNION ALL BY NAME SELECT 'r' AS side, * FROM r) x JOIN p USING (conv_id)),
s AS (SELECT *, sum(CASE WHEN k > n THEN length(h) + length(c) ELSE 0 END) OVER (PARTITION BY side, conv_id ORDER BY k) - length(c) AS pos FROM b)
SELECT conv_id AS pair_id, any_value(n)::BIGINT AS n_prompt_turns,
  coalesce(string_agg(h || c, '' ORDER BY k) FILTER (WHERE side = 'c' AND k <= n), '') AS prompt,
  coalesce(string_agg(h || c, '' ORDER BY k) FILTER (WHERE side = 'c' AND k > n), '') AS chosen,
  coalesce(string_agg(h || c, '' ORDER BY k) FILTER (WHERE side = 'r' AND k > n), '') AS rejected,
  coalesce(string_agg(pos::BIGINT || '-' || (pos + length(c))::BIGINT, ';' ORDER BY k) FILTER (WHERE side = 'c' AND k > n AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg(pos::BIGINT || '-' || (pos + length(c))::BIGINT, ';' ORDER BY k) FILTER (WHERE side = 'r' AND k > n AND role = 'assistant'), '') AS rejected_spans
FROM s GROUP BY conv_id
"""
