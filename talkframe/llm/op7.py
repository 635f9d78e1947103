"""op7_html_text: the main text of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .wrappers import extract


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""
    return extract(table(spark, sf_dir, "pages"))
