"""Catalogue and feeds: B11 (term search, limit 3), B12 (lookup by id), B13 (display label),
E5 (latest episode = first feed entry), B3/B9 status columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .substring import first_matches, term_matches

FAIL = "Fail"
SUCCESS = "Success"


def display_label(name, artist):
    """B13: '{collection} by {artist}'."""
    return F.concat(name, F.lit(" by "), artist)


def term_search(terms: DataFrame, catalogue: DataFrame, limit: int = 3, **bounds) -> DataFrame:
    """Every catalogue entry whose name contains the term, letters' case aside; the first ``limit``
    by collection id; a term without results gets one Fail row.

    ``terms``: (term); ``catalogue``: (collection_id, collection_name, artist_name), ids unique. NULL and
    empty terms have no results. The names are found through an index of their trigrams
    (``substring.term_matches``, which also takes ``bounds``), so no term is compared with the whole catalogue.
    """
    t = terms.select("term").distinct()
    found = term_matches(t, catalogue, "collection_id", "collection_name", **bounds)
    top = first_matches(found, "term", "collection_id", limit).withColumnRenamed("term", "_term").join(
        catalogue.select("collection_id", "collection_name", "artist_name"), "collection_id")
    return (t.join(top, F.col("term") == F.col("_term"), "left")
             .select("term", "rank", "collection_id", "collection_name", "artist_name",
                     display_label(F.col("collection_name"), F.col("artist_name")).alias("label"),
                     F.when(F.col("rank").isNull(), F.lit(FAIL)).otherwise(F.lit(SUCCESS))
                      .alias("status")))


def select_option(results: DataFrame, position: int) -> DataFrame:
    """The row chosen by its 1-based position in each term's result list."""
    return results.where(F.col("rank") == position)


def lookup(ids: DataFrame, catalogue: DataFrame, pos: str = "pos") -> DataFrame:
    """First catalogue entry per requested id; unknown id -> status Fail.

    ``ids``: (podcast_id); ``catalogue``: (collection_id, [pos], ...). First is the smallest
    ``pos`` (position in the answer, dropped from the result); equal positions, or a catalogue
    without positions, fall back on the smallest entry. An entry with NULL columns is still a
    match.
    """
    cols = [c for c in catalogue.columns if c not in ("collection_id", pos)]
    order = F.struct(*([pos] if pos in catalogue.columns else []), *cols)
    first = (catalogue.groupBy("collection_id").agg(F.min_by(F.struct(*cols), order).alias("_e"))
                      .select(F.col("collection_id").alias("podcast_id"), "_e.*", F.lit(True).alias("_found")))
    return (ids.select("podcast_id").distinct().join(first, "podcast_id", "left")
               .withColumn("status", F.when(F.col("_found"), F.lit(SUCCESS)).otherwise(F.lit(FAIL)))
               .drop("_found"))


def latest_entry(podcasts: DataFrame, entries: DataFrame, key: str, pos: str) -> DataFrame:
    """E5: the entry at the first feed position per podcast (not the latest date); a
    podcast without entries gets status Fail. ``min_by`` aggregates partially, so a podcast
    with a huge feed costs one row per map partition in the shuffle."""
    cols = [c for c in entries.columns if c != key]
    first = (entries.groupBy(key).agg(F.min_by(F.struct(*cols), F.col(pos)).alias("_e"))
                    .select(key, "_e.*"))
    return (podcasts.select(key).distinct().join(first, key, "left")
                    .withColumn("status", F.when(F.col(pos).isNull(), F.lit(FAIL))
                                .otherwise(F.lit(SUCCESS))))
