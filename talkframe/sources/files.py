"""File sources and sinks with explicit schemas; bad rows become NULLs, not failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def _episodes(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.schema(f"{schemas.EPISODE}, _corrupt string").option("multiLine", True)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
            .withColumn("file", F.input_file_name()))


def read_episodes(spark: SparkSession, path: str) -> DataFrame:
    """A1: episode detail files (one JSON object per file, possibly multi-line). Files that don't parse
    are left out here and found by ``episode_rejects``."""
    columns = [c for c in spark.createDataFrame([], schemas.EPISODE).columns]
    return (_episodes(spark, path).where("_corrupt is null").withColumn("episode_id", F.sha2("file", 256))
            .select(*columns, "episode_id"))


def episode_rejects(spark: SparkSession, path: str) -> DataFrame:
    """A1 quarantine: (file, raw) of the episode files that don't parse."""
    # the reader refuses a plan that needs the corrupt column alone: a parsed column is read too
    raw = F.when(F.coalesce(F.size("chunks"), F.lit(0)) >= -1, F.col("_corrupt"))
    return _episodes(spark, path).select("file", raw.alias("raw")).where("raw is not null")


def episode_chunks(episodes: DataFrame) -> DataFrame:
    """Chunks of every episode: (episode_id, pos, id, text); pos keeps the file order."""
    return (episodes.select("episode_id", F.posexplode_outer("chunks").alias("pos", "c"))
                    .where(F.col("c").isNotNull())
                    .select("episode_id", F.col("pos").cast("bigint").alias("pos"),
                            F.col("c.id").alias("id"), F.col("c.text").alias("text")))


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """A2: RSS and Atom feeds, one file per podcast, read whole (rowTag channel or feed) so that the
    entry position survives: (feed_path, pos, title, summary, published_date, audio_url).

    The first enclosure is the audio URL; an entry without one gets NULL (the reference
    fails the whole request). An Atom entry's summary is its content if it has no summary, its date the
    last update if it wasn't published. Files that are neither feed are found by ``feed_rejects``.
    """
    def entries(tag: str, schema: str, name: str) -> DataFrame:
        feed = (spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
                .withColumn("feed_path", F.input_file_name()))
        return feed.select("feed_path", F.posexplode_outer(name).alias("pos", "e")).where("e is not null")

    e = F.col("e")
    rss = entries("channel", schemas.FEED_CHANNEL, "item").select(
        "feed_path", "pos", e["title"].alias("title"), e["description"].alias("summary"), e["pubDate"].alias("published_date"),
        F.try_element_at(e["enclosure"], F.lit(1))["_url"].alias("audio_url"))
    enclosures = F.filter(e["link"], lambda x: x["_rel"] == "enclosure")
    atom = entries("feed", schemas.ATOM_FEED, "entry").select(
        "feed_path", "pos", e["title"].alias("title"), F.coalesce(e["summary"], e["content"]).alias("summary"),
        F.coalesce(e["published"], e["updated"]).alias("published_date"),
        F.try_element_at(enclosures, F.lit(1))["_href"].alias("audio_url"))
    return rss.unionByName(atom).withColumn("pos", F.col("pos").cast("bigint"))


def feed_rejects(spark: SparkSession, path: str) -> DataFrame:
    """A2 quarantine: (file) of the files in which neither reader finds a feed (empty files are none to Spark)."""
    files = spark.read.format("binaryFile").load(path).select(F.input_file_name().alias("file"))
    found = None
    for tag in ("channel", "feed"):
        part = (spark.read.format("xml").option("rowTag", tag).schema("title string").load(path)
                .select("title", F.input_file_name().alias("file")))
        found = part if found is None else found.unionByName(part)
    return files.join(found.select("file").distinct(), "file", "left_anti")


def published_ts(published_date) -> "F.Column":
    """H16 (optional): RFC-822 or ISO date string -> timestamp; the reference keeps the string."""
    s = F.regexp_replace(published_date, r"^\s*[A-Za-z]{3},\s*", "")
    a = F.try_to_timestamp(s, F.lit("dd MMM yyyy HH:mm:ss Z"))
    b = F.try_to_timestamp(s, F.lit("dd MMM yyyy HH:mm:ss z"))
    iso = F.when(s.rlike(r"^\d{4}-"), F.try_to_timestamp(s))       # Atom
    return F.coalesce(a, b, iso)


def _catalogue(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    schema = f"{schemas.CATALOGUE}, _corrupt string"
    return (spark.read.schema(schema).option("multiLine", multi_line).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt").json(path)
            .withColumn("file", F.input_file_name()))


def read_catalogue(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A3: landed lookup/search answers -> (pos, collection_id, collection_name, artist_name,
    feed_url); ``pos`` is the position in the answer ("first result", "option k").

    One JSON document per line, or with ``multi_line`` one per file. Documents that don't parse
    are left out here and found by ``catalogue_rejects``.
    """
    return (_catalogue(spark, path, multi_line).select(F.posexplode_outer("results").alias("pos", "r"))
            .where(F.col("r.collectionId").isNotNull())
            .select(F.col("pos").cast("bigint").alias("pos"),
                    F.col("r.collectionId").alias("collection_id"),
                    F.col("r.collectionName").alias("collection_name"),
                    F.col("r.artistName").alias("artist_name"),
                    F.col("r.feedUrl").alias("feed_url")))


def catalogue_rejects(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A3 quarantine: (file, raw) of the documents that don't parse."""
    # the reader refuses a plan that needs the corrupt column alone: the parsed columns are read too
    raw = _catalogue(spark, path, multi_line).select(
        "file", F.when(F.col("results").isNull() & F.col("resultCount").isNull(), F.col("_corrupt")).alias("raw"))
    return raw.where(F.col("raw").isNotNull())


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """A4: ground-truth CSV with header; ids stay strings."""
    return (spark.read.schema(schemas.GROUND_TRUTH).option("header", True)
            .option("multiLine", True).option("escape", '"').csv(path))


def write_ground_truth(df: DataFrame, path: str) -> None:
    """A5: CSV with header, quotes escaped by doubling."""
    (df.select(F.col("id").cast("string").alias("id"), "question").write.mode("overwrite")
       .option("header", True).option("escape", '"').csv(path))


def write_transcripts(df: DataFrame, path: str) -> None:
    """One JSON object per line, directory replaced."""
    df.write.mode("overwrite").json(path)
