"""Readers for the driver-provided parquet tables (column pruning is left to Catalyst)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Session setting: number of partitions that scanned tables are dealt to; unset or 0 leaves the scan
# as it is. Only a harness on files of one row group sets it: a corpus has splits enough, and
# dealing it out anew would shuffle all its texts.
SCAN_PARTITIONS = "spark.talkframe.scanPartitions"
TEXT_TABLES = {"documents", "pages", "conversations"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    n = int(spark.conf.get(SCAN_PARTITIONS, "0"))
    return df.repartition(n) if n and name in TEXT_TABLES else df
