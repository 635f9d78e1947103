"""op13_language: the language of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .language import fit, held_out, identifier


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of documents.

    A null text, or one without a letter, is ``und`` with score 0; a null doc_id is not held out; repeated
    rows are answered alike. Without a learnt language every row is ``und``.
    """
    docs = table(spark, sf_dir, "documents")
    profiles = fit(docs.filter(~held_out("doc_id")))
    answer = identifier(spark, profiles)(F.col("text"))
    return docs.select("doc_id", held_out("doc_id").alias("held_out"), answer.alias("a")).select(
        "doc_id", "held_out", F.col("a.lang").alias("lang_pred"), F.col("a.score").alias("score"))
