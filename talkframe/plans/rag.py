"""K1: batch RAG over a table of questions: search -> context -> prompt -> answer -> words."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rag
from ..operators.sparse import join_payload
from . import backends


def hits_with_text(index: backends.Index, hits: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Attach the hit text after top-k, without moving the texts."""
    if index.backend == "tfidf":
        docs = index.sparse.docs.select("doc_id", "text")
    else:
        docs = index.vectors.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return join_payload(hits, docs, max_rows)


def answer(index: backends.Index, questions: DataFrame, k: int = 5,
           generate: Callable[[list], list] | None = None,
           encode: Callable[[DataFrame], DataFrame] | None = None,
           hits: DataFrame | None = None) -> DataFrame:
    """(qid, query, prompt, answer): ``generate(prompts) -> answers`` is the J3 hook; without
    it the answer is the best hit's text (deterministic default). ``encode`` is the J1 hook of
    a dense index: it adds the question's ``vector``."""
    if hits is None:
        hits = backends.search(index, encode(questions) if encode else questions, k)
    found = hits_with_text(index, hits, max_rows=k * questions.count())
    prompts = rag.render_prompts(questions, found)
    if generate is None:
        return (prompts.join(rag.extractive_answer(found), "qid", "left")
                       .withColumn("answer", F.coalesce(F.col("answer"), F.lit(""))))
    return rag.generate(prompts, generate).drop("answer_error")


def answer_words(answers: DataFrame) -> DataFrame:
    """The streamed form of the answers."""
    return rag.word_stream(answers, ["qid"], "answer")
