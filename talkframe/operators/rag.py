"""RAG pieces: D10 (context in rank order), H8 render, J3 answer hook, H14/I5 word stream,
and the ground-truth side: H9 render, H10 parse with quarantine, G3 flatten, C6 resume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import CONTEXT_SEPARATOR, question_prompt, rag_prompt
from ..functions.text import sentences, words

QUESTIONS_SCHEMA = "questions array<string>"


def contexts(hits_with_text: DataFrame) -> DataFrame:
    """(qid, context): hit texts in rank order, each followed by a blank line.

    Hits are at most k per query, so the list per query is bounded.
    """
    return (hits_with_text.groupBy("qid")
            .agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("_h"))
            .select("qid", F.array_join(F.transform(
                "_h", lambda h: F.concat(F.coalesce(h["text"], F.lit("")),
                                         F.lit(CONTEXT_SEPARATOR))), "").alias("context")))


def render_prompts(queries: DataFrame, hits_with_text: DataFrame) -> DataFrame:
    """H8 over a table: (qid, query, prompt); a query without hits gets an empty context."""
    return (queries.select("qid", "query")
                   .join(contexts(hits_with_text), "qid", "left")
                   .select("qid", "query", rag_prompt(F.col("query"), F.col("context"))
                           .alias("prompt")))


def extractive_answer(hits_with_text: DataFrame) -> DataFrame:
    """J3 default (deterministic, no model): the text of the best hit, '' without hits."""
    best = hits_with_text.where(F.col("rank") == 1).select("qid", F.col("text").alias("answer"))
    return best


def generate(prompts: DataFrame, fn, out: str = "answer", batch_size: int = 32,
             deterministic: bool = False) -> DataFrame:
    """J3 hook: ``fn(list[str]) -> list[str]`` called on Arrow batches of prompts.

    A batch that fails or returns another number of answers than prompts yields NULL answers and the error text instead of failing the job or shifting answers. A sampling model is
    not deterministic, so unless the caller says otherwise the answers are computed once and
    checkpointed: a retried task or a second consumer then sees the same answers.
    """
    import pandas as pd

    schema = prompts.schema.simpleString()[len("struct<"):-1]

    def run(batches):
        for pdf in batches:
            answers, errors = [], []
            for i in range(0, len(pdf), batch_size):
                chunk = pdf["prompt"].iloc[i:i + batch_size].tolist()
                try:
                    res = list(fn(chunk))
                    if len(res) != len(chunk):
                        raise ValueError(f"{len(res)} answers to {len(chunk)} prompts")
                    answers += res
                    errors += [None] * len(res)
                except Exception as e:  # noqa: BLE001 - reported per row
                    answers += [None] * len(chunk)
                    errors += [repr(e)] * len(chunk)
            yield pdf.assign(**{out: pd.Series(answers, dtype=object),
                                f"{out}_error": pd.Series(errors, dtype=object)})

    answers = prompts.mapInPandas(run, f"{schema}, {out} string, {out}_error string")
    if deterministic:
        return answers
    from ..session import cut_lineage
    return cut_lineage(answers)


def word_stream(df: DataFrame, key: list, text: str) -> DataFrame:
    """One row per whitespace-separated word, each followed by one space."""
    return (df.select(*key, F.posexplode_outer(words(F.col(text))).alias("pos", "w"))
              .where(F.col("w").isNotNull())
              .select(*key, F.col("pos").cast("bigint").alias("pos"),
                      F.concat(F.col("w"), F.lit(" ")).alias("word")))


def question_prompts(chunks: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """H9 over a table: (key, prompt)."""
    return chunks.select(key, question_prompt(F.col(text)).alias("prompt"))


def default_question_answer(chunks: DataFrame, key: str = "id", text: str = "text",
                            n: int = 5) -> DataFrame:
    """J3 default for question generation: JSON {"questions": [...]} holding ``n`` sentences
    of the whole record spread evenly over it (sentence floor(j*N/n) for j < n), or all of
    them when it has at most ``n``.

    No lambda refers to the sentence column: Catalyst may inline a column into a lambda,
    which would split the text again for every element.
    """
    s = chunks.select(key, sentences(F.col(text)).alias("_s"))
    s = s.select(key, "_s", F.size("_s").alias("_n"))
    size = F.col("_n")
    spread_ = F.array(*[F.element_at("_s", (F.floor(F.lit(j) * size / n) + 1).cast("int"))
                        for j in range(n)])
    qs = F.when(size <= n, F.col("_s")).otherwise(spread_)
    return s.select(key, F.to_json(F.struct(qs.alias("questions"))).alias("raw"))


def parse_questions(raw: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """H10 + G3: (key, question) rows, and the quarantine (key, raw) of unparsable answers
    (the reference raises on the first bad answer)."""
    p = raw.select(key, "raw", F.from_json("raw", QUESTIONS_SCHEMA).alias("_j"))
    rows = (p.select(key, F.explode_outer("_j.questions").alias("question"))
             .where(F.col("question").isNotNull()))
    bad = p.where(F.col("_j.questions").isNull()).select(key, "raw")
    return rows, bad


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of ``todo`` whose key is not in ``done`` (left anti join)."""
    return todo.join(done.select(key).distinct(), key, "left_anti")
