"""op9_sharding: all documents in 40 shards by the law `rows`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .sharding import shard_rows

SHARDS = 40


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of documents.

    Counts of the shards are at most one apart. Equal texts are no reason to share a shard: the
    shuffle is uniform over rows. The text itself isn't shuffled, only its size and checksum.
    """
    d = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long").alias("text_crc32"))
    out = shard_rows(d, ["doc_id", "text_crc32", "size"], SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
                      F.col("_shard").alias("shard"), F.col("_slot").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"))
