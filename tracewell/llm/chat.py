"""Conversations whose snapshots are collapsed, rendered for training.

A service that logs the whole conversation at each turn leaves many snapshots, each
the beginning of the next. A rolling hash over the turns identifies every beginning:
turns are hashed with their number, and the running exclusive-or of two such hashes
names a prefix in 128 bits. A conversation whose own hash is a proper prefix of another
is dropped by an anti-join, and of equal ones the smallest id stays.

DataFrame functions only. Prefixes are made distinct before they are shuffled, so
that a first turn which many conversations share is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewell.scratch import cut


def _turn_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "i", F.col("role").isNull(), "role", F.col("text").isNull(), "text")


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """``(conv_id, n_turns)`` of the conversations that begin no other one."""
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("i", F.row_number().over(by).cast("long"))
    rows = rows.withColumns({"a": _turn_hash(1), "b": _turn_hash(2)}).select("conv_id", "i", "a", "b")
    run = Window.partitionBy("conv_id").orderBy("i")
    upto = run.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(
        "conv_id", "i", F.bit_xor("a").over(upto).alias("a"), F.bit_xor("b").over(upto).alias("b"), F.lead("i").over(run).isNull().alias("last")
    )
    rows = cut(rows, "chat-prefixes")
    begun = rows.filter("not last").select("i", "a", "b").distinct()
    whole = rows.filter("last").groupBy("i", "a", "b").agg(F.min("conv_id").alias("conv_id"))
    return whole.join(begun, ["i", "a", "b"], "left_anti").select("conv_id", F.col("i").alias("n_turns"))


def format_conversations(
    turns: DataFrame, before: str = "<|im_start|>", between: str = "\n", after: str = "<|im_end|>\n"
) -> DataFrame:
    """``(conv_id, n_turns, rendered)`` of the maximal conversations of ``(conv_id, turn, role, text)``.

    Turns stand in order of turn, then role, then text, nulls first; null roles and texts are
    told from empty ones, and render as nothing. Rows with a null ``conv_id`` are one
    conversation. A turn that is logged twice counts twice. Turns may have any length; a conversation is one
    row, so it has to fit in memory as a whole. Other columns are ignored; an empty table gives none.
    """
    kept = cut(maximal_conversations(turns), "chat-kept").withColumnRenamed("conv_id", "_kept")
    rows = turns.select("conv_id", "turn", "role", "text").join(kept, F.col("conv_id").eqNullSafe(F.col("_kept")))
    empty = lambda c: F.coalesce(c, F.lit(""))
    # one conversation is one row of the result
    one = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    text = F.transform(
        "all", lambda t: F.concat(F.lit(before), empty(t["role"]), F.lit(between), empty(t["text"]), F.lit(after))
    )
    out = rows.groupBy("conv_id", "n_turns").agg(one.alias("all"))
    return out.select("conv_id", "n_turns", F.array_join(text, "").alias("rendered"))


def op6_chat_formatting(spark, sf_dir):
    """All maximal conversations, rendered."""
    return format_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP6_SQL = """
WITH c AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns
           FROM conversations GROUP BY conv_id),
k AS (SELECT turns, unnest(range(1, len(turns))) AS n FROM c),
p AS (SELECT DISTINCT turns[1:n] AS turns FROM k),
m AS (SELECT turns, min(conv_id) AS conv_id FROM c GROUP BY turns)
SELECT conv_id, CAST(len(turns) AS BIGINT) AS n_turns,
  array_to_string(list_transform(turns, lambda t: '<|im_start|>' || coalesce(t.role, '') || chr(10) || coalesce(t.text, '') || '<|im_end|>' || chr(10)), '') AS rendered
FROM m WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.turns = m.turns)
"""
