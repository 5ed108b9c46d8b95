"""Chat formatting with cumulative-snapshot collapse, with DataFrame operations only.

A log often holds a conversation again each time it grows. Every prefix of every conversation gets a rolling hash
(exclusive or of two 64-bit hashes of position, role and text); a conversation whose whole hash is a proper prefix of
another is dropped by an anti-join, of equal ones the smallest conv_id stays, and the rest are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import pick, staged


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_logged (conversations with exactly these turns) of the conversations that stay.

    Turns go by turn number (null first), then by a hash of role and text; null role or text reads as empty. Rows
    repeated exactly count once. Rows without conv_id belong to no conversation and are left out.
    """
    rows = pick(turns, "conv_id", "turn", "role", "text").where("conv_id is not null")
    rows = rows.withColumn("role", F.coalesce("role", F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))
    slim = rows.select("conv_id", "turn", F.md5(F.concat_ws("\x1f", "role", "text").cast("binary")).alias("tie"), *[F.xxhash64(F.lit(k), "role", "text").alias(f"h{k}") for k in (1, 2)]).distinct()
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "tie")
    placed = slim.withColumn("pos", F.row_number().over(order))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolled = placed.select("conv_id", "pos", *[F.expr(f"bit_xor(xxhash64(pos, h{k}))").over(so_far).alias(f"p{k}") for k in (1, 2)], F.count("*").over(Window.partitionBy("conv_id")).alias("n"))
    rolled, _ = staged(rolled, "chat-prefixes")
    whole = rolled.where("pos = n").groupBy("n", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_logged"))
    proper = rolled.where("pos < n").select(F.col("pos").alias("n"), "p1", "p2").distinct()
    return whole.join(proper, ["n", "p1", "p2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_logged")


def render_chat(turns: DataFrame, *, before: str = "<|", after: str = "|>\n", end: str = "\n") -> DataFrame:
    """conv_id, n_turns, n_logged and chat (``before role after text end`` for each turn) of maximal conversations."""
    kept = maximal_conversations(turns)
    rows = pick(turns, "conv_id", "turn", "role", "text").where("conv_id is not null")
    rows = rows.withColumn("role", F.coalesce("role", F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.join(kept.select("conv_id"), "conv_id", "left_semi").distinct()
    said = F.struct(F.col("turn").isNotNull().alias("known"), "turn", F.md5(F.concat_ws("\x1f", "role", "text").cast("binary")).alias("tie"), F.concat(F.lit(before), "role", F.lit(after), "text", F.lit(end)).alias("said"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(said)).alias("turns"))
    chats = chats.select("conv_id", F.array_join(F.transform("turns", lambda t: t["said"]), "").alias("chat"))
    return kept.join(chats, "conv_id").select("conv_id", "n_turns", "n_logged", "chat")
