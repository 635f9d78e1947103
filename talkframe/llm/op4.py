"""op4_mixing: all documents mixed to the sources' targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .mixing import mix


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken (words) and copies for every row of documents."""
    m = mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target",
                    (F.col("size") * F.col("copies")).alias("taken"), "copies")


def take_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it, so twice taken is two rows.

    Rows are known by the hash of all their columns; rows that are equal in all of them share the
    copies that they were given together.
    """
    ident = F.xxhash64(*[F.col(c) for c in docs.columns])
    given = (mix(docs, doc_id=ident).groupBy(F.col("doc_id").alias("_row"))
             .agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")).filter("_copies > 0"))
    nth = F.row_number().over(Window.partitionBy("_row").orderBy("_row"))
    times = (F.floor(F.col("_copies") / F.col("_rows"))
             + F.when(nth <= F.col("_copies") % F.col("_rows"), 1).otherwise(0)).cast("int")
    return (docs.withColumn("_row", ident).join(given, "_row").withColumn("_times", times)
            .filter("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
            .select(*docs.columns))
