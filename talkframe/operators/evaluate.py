"""Retrieval evaluation, set-at-a-time: C5 D5 D6 D7 J6, and a containment ground truth.

The reference loops over ground-truth rows, searches one question at a time and keeps a list
of booleans per row. Here every question is searched in one job, the relevance is one left
join and hit rate / MRR are two aggregates.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .substring import text_matches

def containment_ground_truth(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, question, qid): every document whose whole text contains the item's whole text.

    ``items``: (qid bigint, question), one row a qid; ``docs``: (doc_id, text). Null and empty items are
    contained in nothing. Candidates are found by a join on character grams (``text_matches``).
    """
    items = items.select("qid", "question").where("question <> ''")
    found = text_matches(items, docs.select(F.col("doc_id").cast("string").alias("id"), "text"))
    return found.join(items, "qid").select("id", "question", "qid")


def relevance(ground_truth: DataFrame, hits: DataFrame) -> DataFrame:
    """C5 + H15: per ground-truth row and hit, is the hit's id the expected one (as strings).

    A left join: a question without hits keeps one row with NULL rank and is_rel false, and
    still counts in the denominators.
    """
    h = hits.select("qid", F.col("doc_id").cast("string").alias("doc_id"), "rank")
    gt = ground_truth.select("qid", F.col("id").cast("string").alias("id"))
    return (gt.join(h, "qid", "left")
              .select("qid", "id", "rank", "doc_id",
                      F.coalesce(F.col("doc_id") == F.col("id"), F.lit(False)).alias("is_rel")))


def per_question(rel: DataFrame) -> DataFrame:
    """Hit (any relevant) and the sum of 1/rank over all relevant positions (no break)."""
    return rel.groupBy("qid", "id").agg(
        F.max(F.col("is_rel").cast("int")).alias("hit"),
        F.sum(F.when(F.col("is_rel"), F.lit(1.0) / F.col("rank")).otherwise(F.lit(0.0)))
         .alias("rr"))


def hit_rate(rel: DataFrame) -> DataFrame:
    """Share of ground-truth rows with at least one relevant hit (NULL when empty)."""
    return per_question(rel).agg(F.avg(F.col("hit").cast("double")).alias("hit_rate"))


def mrr(rel: DataFrame) -> DataFrame:
    """Mean over ground-truth rows of the summed reciprocal ranks (NULL when empty)."""
    return per_question(rel).agg(F.avg("rr").alias("mrr"))


def evaluate(ground_truth: DataFrame, search_function: Callable[[DataFrame], DataFrame],
             backend: str | None = None) -> DataFrame:
    """J6 + D7: run ``search_function(questions) -> hits`` once over all distinct questions.

    ``ground_truth``: (qid, id, question). Returns (hit_rate, mrr) [+ backend].
    """
    questions = ground_truth.select("qid", "question").dropDuplicates(["qid"])
    rel = relevance(ground_truth, search_function(questions))
    out = per_question(rel).agg(F.avg(F.col("hit").cast("double")).alias("hit_rate"),
                                F.avg("rr").alias("mrr"))
    if backend is not None:
        out = out.select(F.lit(backend).alias("backend"), "hit_rate", "mrr")
    return out


def report(ground_truth: DataFrame, backends: dict) -> DataFrame:
    """One row per backend (union of the evaluations)."""
    out = None
    for name, fn in backends.items():
        part = evaluate(ground_truth, fn, name)
        out = part if out is None else out.unionByName(part)
    return out
