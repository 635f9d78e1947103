"""I1-I4 with Structured Streaming.

Top-k retrieval is not a streaming aggregation, so arriving questions are answered per
micro-batch with ``foreachBatch`` against a fixed index; each batch's output is written to its
own ``batch_id=`` directory with overwrite, so a replayed batch (after a failure) replaces its
earlier attempt instead of duplicating it. Topic counts are a true streaming aggregation.
TF-IDF is not streamed: every new document changes N and df for all weights; refit instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import topics
from ..plans import backends
from ..sources.index_io import populate_vectors, write_versions


def answer_questions(spark: SparkSession, source_dir: str, index: backends.Index,
                     out_dir: str, checkpoint: str, k: int = 5, schema: str = "qid long, query string",
                     available_now: bool = True, generate=None, encode=None):
    """Questions landing as Parquet files -> per micro-batch the hits (``hits/``), the answers
    (``answers/``: qid, query, prompt, answer) and their words (``words/``).

    ``generate`` is the J3 hook and ``encode`` the J1 hook (questions -> questions with vector)
    of ``plans.rag.answer``. The index should be saved or materialised once before.
    """
    from ..plans import rag as plan
    from ..session import cut_lineage
    stream = spark.readStream.schema(schema).parquet(source_dir)

    def handle(batch: DataFrame, batch_id: int):
        asked = encode(batch) if encode else batch
        hits = cut_lineage(backends.search(index, asked, k))
        hits.write.mode("overwrite").parquet(f"{out_dir}/hits/batch_id={batch_id}")
        answers = cut_lineage(plan.answer(index, asked, k, generate, hits=hits))
        answers.write.mode("overwrite").parquet(f"{out_dir}/answers/batch_id={batch_id}")
        plan.answer_words(answers).write.mode("overwrite").parquet(f"{out_dir}/words/batch_id={batch_id}")

    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def index_documents(spark: SparkSession, source_dir: str, root: str, checkpoint: str, dims: int,
                    schema: str = schemas.DOCUMENT.replace("text_vector", "vector"),
                    available_now: bool = True):
    """Arriving documents -> valid vectors appended to ``vectors/``, others to
    ``rejects/`` with their reason (per micro-batch, idempotent by batch id)."""
    stream = spark.readStream.schema(schema).parquet(source_dir)

    def handle(batch: DataFrame, batch_id: int):
        populate_vectors(batch, root, dims, batch_id=f"stream-{batch_id}")

    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def upsert_documents(spark: SparkSession, source_dir: str, root: str, checkpoint: str, dims: int,
                     schema: str = schemas.VERSIONED, available_now: bool = True):
    """I2, keyed: arriving versions and deletions of documents -> ``versions/`` (idempotent by batch id);
    ``index_io.open_current`` reads the last version of each. A replayed or reordered stream ends in the same
    documents."""
    stream = spark.readStream.schema(schema).parquet(source_dir)

    def handle(batch: DataFrame, batch_id: int):
        write_versions(batch, root, dims, f"stream-{batch_id}")

    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def topic_counts(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str,
                 schema: str = schemas.ENTITY, available_now: bool = True):
    """Running (label, text) -> total_score, count over arriving mentions; the state after each
    micro-batch goes to ``batch_id=<n>/`` (rank it with ``topics.rank_in_label`` when read)."""
    stream = spark.readStream.schema(schema).parquet(source_dir)

    def handle(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    w = (topics.topic_stats(stream).writeStream.outputMode("complete").foreachBatch(handle)
            .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def topic_summary(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str, capacity: int = 1000,
                  schema: str = schemas.ENTITY, available_now: bool = True):
    """I3 with bounded state: after each micro-batch ``batch_id=<n>/`` holds at most ``capacity`` texts of each
    label with their counts and the label's error (``topics.merge_summaries``); ``topics.rank_by_summary`` makes
    the exact ranking of it and the landed mentions.

    A batch merges its counts with the summary of the batch before it, so a batch that is repeated after a failure
    writes the same rows again.
    """
    stream = spark.readStream.schema(schema).parquet(source_dir)
    path = f"{out_dir}/batch_id="

    def handle(batch: DataFrame, batch_id: int):
        counts = batch.groupBy("label", "text").agg(F.count(F.lit(1)).alias("count")).withColumns(
            {"error": F.lit(0).cast("bigint"), "part": F.lit(1)})
        if batch_id:
            before = spark.read.schema(SUMMARY).parquet(f"{path}{batch_id - 1}").withColumn("part", F.lit(0))
            counts = counts.unionByName(before)
        topics.merge_summaries(counts, capacity).write.mode("overwrite").parquet(f"{path}{batch_id}")

    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


SUMMARY = "label string, text string, count bigint, error bigint"


def chat_log(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str,
             schema: str = "conv_id long, turn long, role string, text string",
             available_now: bool = True):
    """I4: append-only chat log; E6 / F5 read it back in batch."""
    stream = spark.readStream.schema(schema).parquet(source_dir)
    w = (stream.writeStream.format("parquet").outputMode("append").option("path", out_dir)
               .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def topic_ranking(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str,
                  top_n: int = topics.TOP_N, schema: str = schemas.ENTITY,
                  available_now: bool = True):
    """I3 with the ranking: the running (label, text) counts (complete mode) are ranked in
    each micro-batch (E2) and written to ``batch_id=<n>/``, replacing a replayed batch."""
    stream = spark.readStream.schema(schema).parquet(source_dir)
    agg = topics.topic_stats(stream)

    def handle(batch: DataFrame, batch_id: int):
        ranked = topics.rank_in_label(batch, top_n)
        ranked.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    w = (agg.writeStream.outputMode("complete").foreachBatch(handle)
            .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()
