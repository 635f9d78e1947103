"""Topics: J2 (entity extraction hook), D4 (stats), E2 (rank in label), D12 (ordered list),
D13 (pad and pivot), K6 (report)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .topk import SCORE_DIGITS

TOP_N = 15

# Default rules of the model-free extractor: label -> pattern; every match scores 1.0.
DEFAULT_RULES = {
    "Number": r"\p{N}+",
    "Capitalized": r"\p{Lu}\p{Ll}+",
}


def extract_entities(chunks: DataFrame, key: str, text: str,
                     rules: dict | None = None) -> DataFrame:
    """J2 default + G2: (key, label, text, score) for every rule match in the whole text."""
    rules = rules or DEFAULT_RULES
    per_label = F.array(*[
        F.struct(F.lit(lbl).alias("label"),
                 F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pat), 0)
                 .alias("m"))
        for lbl, pat in rules.items()])
    x = chunks.select(key, F.inline_outer(per_label))
    return (x.select(key, "label", F.explode_outer("m").alias("text"))
             .where(F.col("text").isNotNull())
             .select(key, "label", "text", F.lit(1.0).alias("score")))


def topic_stats(mentions: DataFrame) -> DataFrame:
    """(label, text, total_score, count); partial aggregation absorbs hot labels."""
    return mentions.groupBy("label", "text").agg(
        F.sum("score").alias("total_score"), F.count(F.lit(1)).alias("count"))


def rank_in_label(stats: DataFrame, top_n: int = TOP_N) -> DataFrame:
    """Rank by count desc, total score desc, then text asc; keep ``top_n``."""
    w = Window.partitionBy("label").orderBy(
        F.col("count").desc(), F.round("total_score", SCORE_DIGITS).desc(), F.col("text").asc())
    r = stats.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= top_n)
    return r.withColumn("rank", F.col("_rn").cast("bigint")).drop("_rn")


def merge_summaries(parts: DataFrame, capacity: int) -> DataFrame:
    """(label, text, count, error): one summary of the largest counts of each label from several.

    ``parts`` are summaries or plain counts (error 0), one row a (label, text) in each, with ``part`` telling them
    apart. Counts are added; of each label the ``capacity`` largest stay, less the next one
    (Misra and Gries). A true count is then at least ``count`` and at most ``count + error``, a text that isn't
    there has at most ``error``, and ``error`` is at most all mentions / (capacity + 1).
    """
    # the errors of one label's parts add up, whichever texts they hold
    errors = parts.groupBy("label", "part").agg(F.max("error").alias("_e")).groupBy("label").agg(F.sum("_e").alias("_error"))
    added = parts.groupBy("label", "text").agg(F.sum("count").alias("count")).where(F.col("count") > 0)
    w = Window.partitionBy("label").orderBy(F.col("count").desc(), F.col("text").asc())
    top = added.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= capacity + 1)
    cut = top.where(F.col("_rn") == capacity + 1).select(F.col("label").alias("_l"), F.col("count").alias("_cut"))
    # a row of its own (text NULL, count 0) keeps a label's error if no text is left
    kept = (top.where(F.col("_rn") <= capacity).join(cut, F.col("label").eqNullSafe(F.col("_l")), "left")
            .select("label", "text", (F.col("count") - F.coalesce("_cut", F.lit(0))).alias("count")).where(F.col("count") > 0))
    total = errors.join(cut, F.col("label").eqNullSafe(F.col("_l")), "left").select(
        "label", (F.col("_error") + F.coalesce("_cut", F.lit(0))).alias("error"))
    marks = total.select("label", F.lit(None).cast("string").alias("text"), F.lit(0).cast("bigint").alias("count"))
    total = total.withColumnRenamed("label", "_t")
    return kept.unionByName(marks).join(total, F.col("label").eqNullSafe(F.col("_t"))).drop("_t")


def rank_by_summary(mentions: DataFrame, summary: DataFrame, top_n: int = TOP_N) -> DataFrame:
    """E2 with a summary: the ranking of ``rank_in_label`` over all ``mentions``, counting only the texts that the
    summary can't rule out. A label whose error doesn't tell its texts apart is counted in full."""
    w = Window.partitionBy("label").orderBy(F.col("count").desc(), F.col("text").asc())
    nth = (summary.where("count > 0").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == top_n)
           .select(F.col("label").alias("_l"), F.col("count").alias("_least")))
    seen = summary.join(nth, F.col("label").eqNullSafe(F.col("_l")), "left").withColumn("_sure", F.coalesce(F.col("error") < F.col("_least"), F.col("error") == 0))
    some = seen.where(F.col("_sure") & (F.col("count") > 0) & (F.col("count") + F.col("error") >= F.coalesce("_least", F.lit(0))))
    whole = seen.where(~F.col("_sure")).select(F.col("label").alias("_wl")).distinct()
    some = some.select(F.col("label").alias("_sl"), F.col("text").alias("_st"))
    by_text = mentions.join(some, F.col("label").eqNullSafe(F.col("_sl")) & F.col("text").eqNullSafe(F.col("_st")), "left_semi")
    by_label = mentions.join(whole, F.col("label").eqNullSafe(F.col("_wl")), "left_semi")
    return rank_in_label(topic_stats(by_text.unionByName(by_label)), top_n)


def top_words(ranked: DataFrame) -> DataFrame:
    """(label, words) in rank order (at most ``top_n`` per label)."""
    return (ranked.groupBy("label")
                  .agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("_w"))
                  .select("label", F.transform("_w", lambda x: x["text"]).alias("words")))


def pivot(ranked: DataFrame, labels: list | None = None) -> DataFrame:
    """One row per rank, one column per label, '' where a label has fewer words.

    ``labels`` is the user's selection; without one every label found gets a column (one small
    job; a label holds at most ``top_n`` rows).
    """
    if labels is None:
        found = ranked.select("label").where(F.col("label").isNotNull()).distinct().orderBy("label")
        labels = [r.label for r in found.collect()]
    p = ranked.groupBy("rank").pivot("label", labels).agg(F.first("text"))
    return p.na.fill("", subset=list(labels)) if labels else p


def report(chunks: DataFrame, key: str, text: str, labels_rules: dict,
           top_n: int = TOP_N) -> DataFrame:
    """K6: extraction -> stats -> rank -> pivot; no entities gives an empty frame."""
    ranked = rank_in_label(topic_stats(extract_entities(chunks, key, text, labels_rules)), top_n)
    return pivot(ranked, list(labels_rules))
