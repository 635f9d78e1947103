"""op1_toxicity: a toxicity score for every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .toxicity import THRESHOLD, fit, held_out, scorer


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of documents.

    Nulls: a null or empty text scores 0; a null doc_id is not held out. Repeated rows are scored
    alike. Without labels every score is 0.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    score = scorer(spark, *fit(docs, table(spark, sf_dir, "labels")))
    out = docs.select("doc_id", held_out("doc_id").alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that score THRESHOLD or more go, all others stay as they are."""
    score = scorer(spark, *fit(docs, table(spark, sf_dir, "labels")))
    return docs.withColumn("_score", score(docs["text"])).filter(F.col("_score") < THRESHOLD).select(*docs.columns)
