"""Chat log: E6 (user turn with the assistant answer that follows) and F5 (ordered replay)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import ordered_concat, ordered_offsets


def chat_pairs(log: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer); answer NULL when the next message of the
    conversation, whatever its turn number, is not the assistant's.

    Messages are numbered in turn order first (two-level, no window over a whole conversation);
    "next" is then an equi-join on the unique (conv_id, number + 1).
    """
    n = ordered_offsets(log.select("conv_id", "turn", "role", "text", F.lit(1).alias("_one")), "conv_id", "turn", "_one")
    users = n.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("question"), (F.col("offset") + 1).alias("_next"))
    nxt = n.select(F.col("conv_id").alias("_conv"), F.col("offset").alias("_at"), F.col("role").alias("_role"),
                   F.col("text").alias("_text"))
    return (users.join(nxt, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_next") == F.col("_at")), "left")
                 .select("conv_id", "turn", "question",
                         F.when(F.col("_role") == "assistant", F.col("_text")).alias("answer")))


def chat_transcript(log: DataFrame) -> DataFrame:
    """one "role: text" line per message, in turn order, per conversation."""
    lines = log.select("conv_id", "turn", F.concat_ws(": ", "role", "text").alias("line"))
    return ordered_concat(lines, "conv_id", "turn", "line", "\n", out="transcript")
