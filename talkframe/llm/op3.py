"""op3_near_dedup: SimHash classes of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .near_dedup import near_dedup
from .simhash import hex16

SHINGLE = 3


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of documents."""
    found = near_dedup(table(spark, sf_dir, "documents"), shingle=SHINGLE)
    return found.select(F.col("id").alias("doc_id"), hex16(F.col("fp")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each SimHash class stays, the one with the smallest id.

    Rows whose doc_id is null stay too: they can't be told apart. Repeated rows of one id stay
    or go together with their id.
    """
    found = near_dedup(docs, shingle=SHINGLE)
    gone = found.filter("id is not null and component < id").select(F.col("id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
