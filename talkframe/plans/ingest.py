"""K3 and K5: the ingest path (episode -> chunks -> vectors -> index) and the ground-truth
build (chunks -> prompts -> answers -> questions -> CSV), as restartable stages with Parquet
or CSV between them."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import with_hash_vector
from ..operators import rag, transcript
from ..sources import files, index_io


def add_vectors(df: DataFrame, text: str, dims: int, encoder: Callable | None,
                keep: list | None = None) -> DataFrame:
    """J1 for every ingest path: the encoder hook when given, else the hashed default."""
    keep = list(keep if keep is not None else df.columns)
    if encoder is None:
        return with_hash_vector(df, text, "vector", dims, keep=keep)
    from ..operators.inference import encode
    return encode(df, text, "vector", encoder, dims).select(*keep, "vector")


def episode_documents(episodes: DataFrame, dims: int = 768,
                      encoder: Callable | None = None) -> DataFrame:
    """K3 (sample path): chunks of landed episodes -> (episode_id, id, text, vector).

    Vectors come from the J1 hook when given, else from the hashed default encoder."""
    ch = files.episode_chunks(episodes)
    # the sample file carries chunk ids; a chunk without one gets its 1-based position
    docs = ch.select("episode_id", F.coalesce(F.col("id"), (F.col("pos") + 1).cast("string"))
                     .alias("id"), "text")
    return add_vectors(docs, "text", dims, encoder)


def transcript_documents(parts: DataFrame, dims: int = 768,
                         encoder: Callable | None = None) -> DataFrame:
    """K3 (transcription path): transcribed parts (media_id, part, text) -> sentence chunks
    numbered across parts (G1 + E3) -> vectors by the J1 hook or the hashed default."""
    ch = transcript.renumber_chunks(parts, "media_id", "part", "text")
    return add_vectors(ch.select("media_id", "id", "text"), "text", dims, encoder)


def index_documents(docs: DataFrame, root: str, dims: int) -> None:
    """K3 last stage: valid vectors to the index, invalid ones to rejects."""
    index_io.populate_vectors(docs, root, dims, mode="overwrite")


def build_ground_truth(chunks: DataFrame, done: DataFrame | None, out_path: str | None = None,
                       generate: Callable[[list], list] | None = None) -> tuple:
    """K5: resumable question generation. ``chunks``: (id, text); ``done``: (id) already
    processed. Returns (ground truth (id, question), quarantine (id, raw))."""
    todo = rag.resume(chunks, done, "id") if done is not None else chunks
    if generate is None:
        raw = rag.default_question_answer(todo)
    else:
        prompts = rag.question_prompts(todo).withColumnRenamed("id", "qid")
        raw = (rag.generate(prompts, generate, out="raw")
                  .select(F.col("qid").alias("id"), "raw"))
    gt, bad = rag.parse_questions(raw)
    gt = gt.select(F.col("id").cast("string").alias("id"), "question")
    if out_path:
        files.write_ground_truth(gt, out_path)
    return gt, bad


def episodes_from_urls(urls: DataFrame, catalogue: DataFrame, entries: DataFrame,
                       dims: int = 768, threshold: float = 0.95,
                       encoder: Callable | None = None) -> DataFrame:
    """K3, URL path, for a table of episode URLs.

    H3 (podcast id, title from the URL) -> B12 (catalogue lookup) -> the podcast's feed
    entries -> H2 + J1 (normalised titles, encoder hook or default) -> C3 (nearest entry of that feed,
    ties to the earlier feed position) -> B3/B9 (0.95 gate, status) -> A13 (target path).

    ``catalogue``: (collection_id, collection_name, artist_name, feed_url);
    ``entries``: (feed_url, pos, title, summary, published_date, audio_url), e.g. from
    ``sources.files.read_feeds`` with ``feed_url`` set to the feed's address.
    """
    from ..functions.text import title_normalize
    from ..functions.urls import episode_from_url
    from ..operators.catalog import lookup
    from ..operators.dense import nearest_in_feed
    from ..operators.media import download_manifest

    pid, title = episode_from_url(F.col("url"))
    u = urls.select("url", pid.alias("podcast_id"), title.alias("episode_title"))
    pods = lookup(u.select("podcast_id"), catalogue)
    q = (u.join(pods.where(F.col("status") == "Success")
                    .select("podcast_id", "collection_name", "feed_url"), "podcast_id")
          .select(F.col("url").alias("qid"), "feed_url",
                  title_normalize("episode_title").alias("norm")))
    q = add_vectors(q, "norm", dims, encoder, ["qid", "feed_url"])
    # zero-padded position: the string tie-break then follows the feed order
    e = entries.select("feed_url", F.lpad(F.col("pos").cast("string"), 12, "0").alias("doc_id"),
                       title_normalize("title").alias("norm"))
    e = add_vectors(e, "norm", dims, encoder, ["doc_id", "feed_url"])
    best = nearest_in_feed(q, e, "feed_url", threshold=threshold)
    chosen = (best.withColumnRenamed("qid", "url")
                  .withColumn("pos", F.col("doc_id").cast("bigint")).drop("doc_id"))
    out = (u.join(pods.select("podcast_id", "collection_name", "feed_url",
                              F.col("status").alias("lookup_status")), "podcast_id", "left")
            .join(chosen, "url", "left")
            .join(entries.select("feed_url", "pos", "title", "audio_url"), ["feed_url", "pos"],
                  "left"))
    ok = (F.col("lookup_status") == "Success") & (F.col("status") == "Success")
    manifest = download_manifest(out.where(ok).select("url", "collection_name"), "url",
                                 "collection_name")
    return (out.join(manifest.select("url", "path"), "url", "left")
               .select("url", "podcast_id", "episode_title", "pos", "title", "audio_url",
                       "cos_sim", F.when(ok, F.lit("Success")).otherwise(F.lit("Fail"))
                       .alias("status"),
                       F.when(ok, F.concat(F.lit("Podcast "), F.col("collection_name"),
                                           F.lit(" downloaded successfully.")))
                        .otherwise(F.lit("Failed to download the podcast. Please try again."))
                        .alias("status_message"),
                       "path"))
