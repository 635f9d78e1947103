"""Transcripts: G1 (ordered union of parts), E3 (global renumbering), D9 + F2 (ordered
concatenation with the reference's leading space), H4 (sentence chunks)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentences
from .ordered import ordered_concat, ordered_offsets


def sentence_chunks(df: DataFrame, key: str, text: str, abbreviations: list | None = None) -> DataFrame:
    """H4: (key, pos, text) one row per sentence, pos from 0 within the row's text."""
    s = df.select(key, sentences(F.col(text), abbreviations).alias("_s"))
    return (s.select(key, F.posexplode_outer("_s").alias("pos", "text"))
             .where(F.col("text").isNotNull())
             .withColumn("pos", F.col("pos").cast("bigint")))


def renumber_chunks(parts: DataFrame, episode: str, part: str, text: str,
                    abbreviations: list | None = None) -> DataFrame:
    """G1 + E3: chunks of all parts of an episode, numbered "1".."N" in (part, pos) order.

    ``parts`` has one row per (episode, part) with the part's text; its chunks are the
    sentences. Part sizes are known in-row, so ids come from a prefix sum over part sizes:
    no window over all chunks of an episode.
    """
    # only the sizes travel to be summed; the sentences stay with their part
    p = parts.select(episode, part, text, F.size(sentences(F.col(text), abbreviations)).alias("_n"))
    off = ordered_offsets(p.select(episode, part, "_n"), episode, part, "_n").select(
        F.col(episode).alias("_e"), F.col(part).alias("_p"), "offset")
    ch = (p.join(off, F.col(episode).eqNullSafe(F.col("_e")) & F.col(part).eqNullSafe(F.col("_p")))
             .select(episode, part, "offset", F.posexplode_outer(sentences(F.col(text), abbreviations)).alias("pos", "_t"))
             .where(F.col("_t").isNotNull()))
    return ch.select(episode, part, F.col("pos").cast("bigint").alias("pos"),
                     (F.col("offset") + F.col("pos") + 1).cast("string").alias("id"), F.col("_t").alias("text"))


def concat_transcript(parts: DataFrame, episode: str, part: str, text: str) -> DataFrame:
    """D9 + F2: part texts in part order, joined by one space, with one leading space."""
    c = ordered_concat(parts, episode, part, text, " ", out="_t")
    return c.select(episode, F.concat(F.lit(" "), F.col("_t")).alias("text"))
