"""op2_simhash: fingerprints of every document and of its edited text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .simhash import fingerprints, hex16, likeness, neighbours

RADIUS = 3
ROWS_PER_BUCKET = 16_384


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text) in ascending doc_id, the first document after the last.

    Nulls: a null text is empty; rows with a null doc_id come first. Rows of one doc_id follow
    each other by text. A single row is its own next one. Ids are cut into runs of equal width
    so that a window sorts a run, never the table; only the first row of each run crosses to
    the run before it.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lo, hi, n = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    width = max(1, -(-((hi or 0) - (lo or 0) + 1) * ROWS_PER_BUCKET // max(1, n)))
    run = F.coalesce(F.floor((F.col("doc_id") - F.lit(lo or 0)) / F.lit(width)), F.lit(-1)).cast("long")
    d = docs.withColumn("run", run)
    order = ["doc_id", "text"]
    heads = (d.groupBy("run").agg(F.min(F.struct(*order)).alias("head")))
    by_run = Window.orderBy("run")  # one row per run
    nexts = heads.select(
        "run", F.coalesce(F.lead("head").over(by_run), F.first("head").over(by_run)).alias("head"))
    w = Window.partitionBy("run").orderBy(*order)
    return (d.withColumn("ahead", F.lead("text").over(w))
            .join(nexts.select("run", F.col("head.text").alias("over")), "run")
            .select("doc_id", "text", F.coalesce("ahead", "over").alias("next_text")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    and n_within: how many other fingerprints of the corpus lie within RADIUS bits."""
    d = with_next(table(spark, sf_dir, "documents"))
    n = F.char_length("text")
    part = F.floor(n / 4).cast("int")
    d = d.select(
        "doc_id", n.cast("long").alias("n_chars"), "text",
        F.concat(F.substring("text", F.lit(1), n - part), F.substring("next_text", F.lit(1), part)).alias("edited"),
        F.xxhash64("text").alias("th"), F.xxhash64("next_text").alias("nh"))
    # one row per text and edited text; the row number tells repeated rows apart
    both = (d.withColumn("row", F.monotonically_increasing_id())
            .withColumn("t", F.explode(F.array(
                F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")),
                F.struct(F.lit(1).alias("kind"), F.col("edited").alias("body")))))
            .select("doc_id", "n_chars", F.unhex(F.sha2("edited", 256)).alias("sha"), "th", "nh", "row",
                    "t.kind", "t.body"))
    keys = ["row", "kind", "doc_id", "n_chars", "sha", "th", "nh"]
    fps = written(fingerprints(both, keys, "body"), "fingerprints")
    rows = (fps.filter("kind = 0").drop("kind")
            .join(fps.filter("kind = 1").select("row", F.col("fp").alias("efp")), "row"))
    near = neighbours(fps.filter("kind = 0"), "fp", RADIUS)
    within = (near.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp")
              .agg(F.count("*").alias("n_within")))
    by_text = (fps.filter("kind = 0").groupBy(F.col("th").alias("nh")).agg(F.min("fp").alias("nfp")))
    out = rows.join(by_text, "nh").join(within, "fp", "left")
    return out.select(
        "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"),
        hex16(F.col("fp")).alias("fingerprint"), hex16(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("nfp")).alias("near_next"),
        F.coalesce("n_within", F.lit(0)).cast("long").alias("n_within"))
