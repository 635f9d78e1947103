"""Order-preserving gathers and global numbering without a single-task window.

A group (episode, conversation) can be huge, so neither the numbering nor the ordered
concatenation sorts a whole group in one task: items are first handled in blocks of
consecutive positions, then the (few) block results are combined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024


def ordered_offsets(parts: DataFrame, group: str, order: str, size: str,
                    block: int = BLOCK) -> DataFrame:
    """Exclusive prefix sum of ``size`` per ``group`` in ``order``: adds column ``offset``.

    Two levels: sums per block of ``block`` consecutive order values, a prefix over blocks,
    then a prefix inside each block. Order values should be dense (turns, parts, positions): then
    no window holds more than ``block`` rows of a group at the first level, nor more than
    (#parts / block) at the second. With sparse ones (timestamps) the second level is as long as
    the group.
    """
    p = parts.withColumn("_blk", F.floor(F.col(order) / block))
    blocks = p.groupBy(group, "_blk").agg(F.sum(size).alias("_bs"))
    wb = Window.partitionBy(group).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_boff", F.coalesce(F.sum("_bs").over(wb), F.lit(0)))
    wi = Window.partitionBy(group, "_blk").orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1)
    p = p.withColumn("_ioff", F.coalesce(F.sum(size).over(wi), F.lit(0)))
    b = blocks.select(F.col(group).alias("_g"), F.col("_blk").alias("_b"), "_boff")
    # null-safe: rows without a group or an order (first in their group) are numbered too
    return (p.join(b, p[group].eqNullSafe(b["_g"]) & p["_blk"].eqNullSafe(b["_b"]))
             .withColumn("offset", (F.col("_boff") + F.col("_ioff")).cast("bigint"))
             .drop("_blk", "_boff", "_ioff", "_g", "_b"))


def ordered_concat(df: DataFrame, group: str, order: str, text: str, sep: str,
                   out: str = "text", block: int = BLOCK) -> DataFrame:
    """(group, out): texts joined by ``sep`` in ``order``; NULL texts are skipped."""
    x = df.where(F.col(text).isNotNull()).withColumn("_blk", F.floor(F.col(order) / block))
    inner = (x.groupBy(group, "_blk")
              .agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"),
                                                        F.col(text).alias("t")))).alias("_l"))
              .select(group, "_blk", F.array_join(F.transform("_l", lambda s: s["t"]), sep)
                      .alias("_bt")))
    return (inner.groupBy(group)
                 .agg(F.array_sort(F.collect_list(F.struct(F.col("_blk").alias("o"),
                                                           F.col("_bt").alias("t")))).alias("_l"))
                 .select(group, F.array_join(F.transform("_l", lambda s: s["t"]), sep).alias(out)))
