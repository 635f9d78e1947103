"""op8_warc: pages written to WARC archives and read back by the salvage reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, table
from .warc import page_of, read_archives, write_pages


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to for every row of pages."""
    path = scratch_path(spark, "warc")
    write_pages(table(spark, sf_dir, "pages"), path, least_bytes=0)
    found = read_archives(spark, path).filter("record_type in ('response', 'revisit')")
    return found.select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest",
                        "record_type", page_of("refers_to").alias("refers_to"))
