"""op11_spelling: variant spellings of the documents' words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .spelling import variants


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word that documents hold five times or more.

    Null and empty texts hold no words, repeated rows count again, other columns are not read; a
    table without such words gives no rows.
    """
    return variants(table(spark, sf_dir, "documents"))
