"""Operator 8, preference formatting, in DataFrame functions only.

A pair of conversations (chosen, rejected) shares its longest common prefix of turns. The prefix is rendered once as the
prompt; what follows in either conversation is rendered as a completion, with a mask over its pieces that is true where
the assistant speaks (what a model learns from) and false for the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def render_turn(role: Column | str, text: Column | str) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: render_turn(t["role"], t["text"])), "")


def preference_pairs(conversations: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected) arrays of turns: conversation 2k is the chosen one of pair k, 2k + 1 the rejected.

    A turn is (place, at, role, text): its place in the conversation from 1 on and the code points rendered before it.
    Null roles read as `user`, null texts as empty, and null turns come last. Rows without a conv_id are left out, and so
    are pairs of which one side is missing. Repeated rows are repeated turns. Any conv_id of 64 bits is right, negative
    ones included. One shuffle brings a pair together; a pair is a bounded group, two sequences that a model reads at once.
    """
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce("turn", F.lit(2**31 - 1)).alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # An arithmetic shift halves towards minus infinity, in integers.
    rows = rows.select(F.shiftright("conv_id", 1).alias("pair_id"), F.pmod("conv_id", F.lit(2)).alias("side"), "turn", "role", "text").repartition("pair_id")
    order = Window.partitionBy("pair_id", "side").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("place", F.row_number().over(order)).withColumn("at", F.coalesce(F.sum(F.length(render_turn("role", "text")).cast("long")).over(before), F.lit(0).cast("long")))
    turn = F.struct("place", "at", "role", "text")
    side = lambda k: F.array_sort(F.collect_list(F.when(F.col("side") == k, turn)))
    return placed.groupBy("pair_id").agg(side(0).alias("chosen"), side(1).alias("rejected")).where("size(chosen) > 0 AND size(rejected) > 0")


def format_preferences(pairs: DataFrame) -> DataFrame:
    """One row per pair: n_prefix turns, prompt, chosen and rejected completions, and their masks.

    A mask has one entry a turn of its completion: whether it counts, and the start and end of the turn's text in the
    completion (code points). Equal conversations have empty completions and masks.
    """
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    said = lambda side, i: F.struct(F.get(side, i - 1)["role"], F.get(side, i - 1)["text"])
    differs = F.filter(F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))), lambda i: (i > shorter) | (said("chosen", i) != said("rejected", i)))
    prefix = F.when(F.size(differs) > 0, F.array_min(differs) - 1).otherwise(shorter)
    out = pairs.withColumn("n_prefix", prefix.cast("int")).withColumns({f"{s}_from": F.get(s, F.col("n_prefix"))["at"] for s in ("chosen", "rejected")})
    rest = lambda side: F.slice(F.col(side), F.col("n_prefix") + 1, F.greatest(F.size(side) - F.col("n_prefix"), F.lit(0)))

    def masks(side: str) -> Column:
        def entry(turn: Column) -> Column:
            start = (turn["at"] - F.col(f"{side}_from") + F.length(turn["role"]) + 5).cast("int")
            return F.struct((turn["role"] == "assistant").alias("learned"), start.alias("start"), (start + F.length(turn["text"])).alias("stop"))

        return F.transform(rest(side), entry)

    return out.select("pair_id", "n_prefix", _render(F.slice("chosen", F.lit(1), F.col("n_prefix"))).alias("prompt"), _render(rest("chosen")).alias("chosen"), _render(rest("rejected")).alias("rejected"), masks("chosen").alias("chosen_mask"), masks("rejected").alias("rejected_mask"))


def preference_digests(conversations: DataFrame) -> DataFrame:
    """One row per pair with flat columns, for comparison."""
    made = format_preferences(preference_pairs(conversations))
    flat = lambda side: F.array_join(F.transform(f"{side}_mask", lambda m: F.concat_ws(":", m["learned"].cast("int"), m["start"], m["stop"])), ",")
    return made.select("pair_id", "n_prefix", F.sha2("prompt", 256).alias("prompt_sha256"), F.sha2("chosen", 256).alias("chosen_sha256"), F.sha2("rejected", 256).alias("rejected_sha256"), flat("chosen").alias("chosen_mask"), flat("rejected").alias("rejected_mask"))


SQL = """
WITH rows AS (
  SELECT conv_id, coalesce(turn, 2147483647) AS turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, (conv_id - ((conv_id % 2) + 2) % 2) // 2 AS pair_id, ((conv_id % 2) + 2) % 2 AS side FROM rows
), sizes AS (
  SELECT pair_id, count(*) FILTER (side = 0) AS n0, count(*) FILTER (side = 1) AS n1 FROM numbered GROUP BY pair_id HAVING n0 > 0 AND n1 > 0
), breaks AS (
  SELECT s.pair_id, coalesce(min(a.i) - 1, least(any_value(n0), any_value(n1))) AS n_prefix
  FROM sizes s LEFT JOIN (SELECT a.pair_id, a.i FROM numbered a JOIN numbered b ON a.pair_id = b.pair_id AND a.i = b.i AND a.side = 0 AND b.side = 1 AND (a.role <> b.role OR a.text <> b.text)) a
  ON s.pair_id = a.pair_id GROUP BY s.pair_id
), pieces AS (
  SELECT n.*, b.n_prefix, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS piece FROM numbered n JOIN breaks b USING (pair_id)
), placed AS (
  SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY pair_id, side, i > n_prefix ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(role) + 5 AS start FROM pieces
), masked AS (
  SELECT *, (role = 'assistant')::INT || ':' || start || ':' || (start + length(text)) AS mask FROM placed
)
SELECT pair_id::BIGINT AS pair_id, any_value(n_prefix)::INT AS n_prefix,
       sha256(coalesce(string_agg(piece, '' ORDER BY i) FILTER (side = 0 AND i <= n_prefix), '')) AS prompt_sha256,
       sha256(coalesce(string_agg(piece, '' ORDER BY i) FILTER (side = 0 AND i > n_prefix), '')) AS chosen_sha256,
       sha256(coalesce(string_agg(piece, '' ORDER BY i) FILTER (side = 1 AND i > n_prefix), '')) AS rejected_sha256,
       coalesce(string_agg(mask, ',' ORDER BY i) FILTER (side = 0 AND i > n_prefix), '') AS chosen_mask,
       coalesce(string_agg(mask, ',' ORDER BY i) FILTER (side = 1 AND i > n_prefix), '') AS rejected_mask
FROM masked GROUP BY pair_id
"""
