"""Preference formatting of conversations, in DataFrame functions only.

Two conversations of a pair (chosen, rejected) share their first turns. The longest common turn prefix is
rendered once, as the prompt; what follows is rendered for each side as a completion whose trained
characters (the assistant's own words and end marks) are given as spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The ChatML marks.
START, END = "<|im_start|>", "<|im_end|>\n"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(START), F.coalesce(turn["role"], F.lit("")), F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(END))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def _spans(turns: Column, trained_role: str) -> Column:
    """[start, end) in characters of the rendered turns, for each turn of ``trained_role``: its text and end mark."""
    empty = F.struct(F.lit(0).cast("long").alias("at"),
                     F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc, t):
        start = acc["at"] + F.length(_head(t))
        end = start + F.length(_body(t))
        own = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct(end.cast("long").alias("at"),
                        F.when(t["role"] == trained_role, F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, empty, step)["spans"]


def format_preferences(chosen: DataFrame, rejected: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
                       text: str = "text", trained_role: str = "assistant") -> DataFrame:
    """One row per key: key, prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans.

    ``chosen`` and ``rejected`` have one row per turn. Turns are taken in the order of (turn, role, text),
    so ties and repeated rows have a fixed place. Turns agree when role and text do (null agrees with null
    and renders as empty). A key on one side only has an empty prompt and an empty other completion; equal
    conversations are all prompt; a null key is a key of its own; empty tables give an empty result; other
    columns are not read. One shuffle by key brings both sides together; the conversation, which is one cell of the result,
    is the largest thing that a task holds.
    """
    def side(df, n):
        return df.select(F.col(key).alias("key"), F.lit(n).alias("side"),
                         F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).alias("t"))

    both = side(chosen, 0).unionByName(side(rejected, 1)).groupBy("key").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("side") == n, F.col("t")))).alias(name) for n, name in ((0, "c"), (1, "r"))])
    shorter = F.least(F.size("c"), F.size("r"))
    unlike = F.array_position(F.zip_with("c", "r", lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"])), False)
    cut = F.when(unlike > 0, F.least((unlike - 1).cast("int"), shorter)).otherwise(shorter)
    split = both.withColumn("prompt_turns", cut).select(
        "key", "prompt_turns", F.slice("c", F.lit(1), F.col("prompt_turns")).alias("p"),
        *[F.slice(x, F.col("prompt_turns") + 1, F.greatest(F.lit(0), F.size(x) - F.col("prompt_turns"))).alias(x) for x in ("c", "r")])
    return split.select(F.col("key").alias(key), "prompt_turns", _rendered(F.col("p")).alias("prompt"),
                        _rendered(F.col("c")).alias("chosen"), _rendered(F.col("r")).alias("rejected"),
                        _spans(F.col("c"), trained_role).alias("chosen_spans"), _spans(F.col("r"), trained_role).alias("rejected_spans"))


def swapped_replies(conversations: DataFrame) -> DataFrame:
    """Rejected sides for conversations that have none: each conversation with its last assistant reply replaced
    by that of its neighbour (ids 2n and 2n + 1 are neighbours); an empty text where the neighbour has none."""
    said = conversations.where(F.col("role") == "assistant")
    last = said.groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    reply = (said.join(last, "conv_id").where(F.col("turn") == F.col("last_turn")).groupBy("conv_id").agg(F.min("text").alias("reply"))
             .select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), "reply"))
    own = last.join(reply, "conv_id", "left")
    swap = (F.col("role") == "assistant") & (F.col("turn") == F.col("last_turn"))
    return conversations.select("conv_id", "turn", "role", "text").join(own, "conv_id", "left").select(
        "conv_id", "turn", "role", F.when(swap, F.coalesce("reply", F.lit(""))).otherwise(F.col("text")).alias("text"))


def span_text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")


ORACLE = r"""
WITH last AS (SELECT conv_id, max(turn) AS last_turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
reply AS (SELECT c.conv_id, min(c.text) AS reply FROM conversations c JOIN last l ON c.conv_id = l.conv_id AND c.turn = l.last_turn
          WHERE c.role = 'assistant' GROUP BY c.conv_id),
sides AS (
  SELECT conv_id, 0 AS side, turn, role, text FROM conversations
  UNION ALL
  SELECT c.conv_id, 1, c.turn, c.role, CASE WHEN c.role = 'assistant' AND c.turn = l.last_turn THEN coalesce(r.reply, '') ELSE c.text END
  FROM conversations c LEFT JOIN last l ON c.conv_id = l.conv_id LEFT JOIN reply r ON l.conv_id = xor(r.conv_id, 1)),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id, side ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i,
             '<|im_start|>' || coalesce(role, '') || chr(10) AS head, coalesce(text, '') || '<|im_end|>' || chr(10) AS body FROM sides),
cut AS (SELECT c.conv_id, coalesce(min(CASE WHEN r.conv_id IS NULL OR c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text
                                            THEN c.i END) - 1, count(*)) AS n
        FROM (SELECT * FROM t WHERE side = 0) c LEFT JOIN (SELECT * FROM t WHERE side = 1) r ON c.conv_id = r.conv_id AND c.i = r.i
        GROUP BY c.conv_id),
u AS (SELECT t.*, cut.n, t.i > cut.n AS done,
             sum(CASE WHEN t.i > cut.n THEN length(head) + length(body) ELSE 0 END) OVER (PARTITION BY t.conv_id, side ORDER BY t.i) AS upto
      FROM t JOIN cut ON t.conv_id = cut.conv_id)
SELECT conv_id, CAST(any_value(n) AS INTEGER) AS prompt_turns,
  coalesce(string_agg(CASE WHEN side = 0 AND NOT done THEN head || body END, '' ORDER BY i), '') AS prompt,
  coalesce(string_agg(CASE WHEN side = 0 AND done THEN head || body END, '' ORDER BY i), '') AS chosen,
  coalesce(string_agg(CASE WHEN side = 1 AND done THEN head || body END, '' ORDER BY i), '') AS rejected,
  coalesce(string_agg(CASE WHEN side = 0 AND done AND role = 'assistant' THEN (upto - length(body)) || '-' || upto END, ',' ORDER BY i), '') AS chosen_spans,
  coalesce(string_agg(CASE WHEN side = 1 AND done AND role = 'assistant' THEN (upto - length(body)) || '-' || upto END, ',' ORDER BY i), '') AS rejected_spans
FROM u GROUP BY conv_id
"""
