"""op12_whitening: whitened embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .whitening import whiten


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: 32 rows per sound vector of embeddings.

    Unsound vectors, null ids, repeated rows and empty tables as in ``whiten``.
    """
    return whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
