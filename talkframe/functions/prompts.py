"""Prompt templates (H8, H9) as Column expressions.

Fixed values: the two templates below reproduce the reference's prompts byte for byte
(inner lines of the RAG template are indented by four spaces; the line after QUESTION holds
four spaces; "CONTEXT: " keeps its trailing space; the question template keeps the trailing
space after "from the record."). The question template names the calling application; that
name is a parameter here (``APP_NAME`` by default).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_all

RAG_PROMPT_HEAD = (
    "You're a podcast chat bot. Answer the QUESTION based on the CONTEXT from the RESULTS "
    "database.\n"
    "    Use only the facts from the CONTEXT when answering the QUESTION.\n"
    "\n"
    "    QUESTION: "
)
RAG_PROMPT_MID = "\n    \n    CONTEXT: \n    "

APP_NAME = "podcast"

QUESTION_PROMPT_HEAD = (
    "You emulate a user of our {app} application.\n"
    "Formulate 5 questions this user might ask based on a provided text.\n"
    "Make the questions specific to this text.\n"
    "The record should contain the answer to the questions, and the questions should\n"
    "be complete and not too short. Use as few words as possible from the record. \n"
    "\n"
    "The record:\n"
    "\n"
    "text: "
)
QUESTION_PROMPT_TAIL = (
    "\n"
    "\n"
    "Provide the output in parsable JSON without using code blocks:\n"
    "\n"
    '{"questions": ["question1", "question2", ..., "question5"]}'
)

CONTEXT_SEPARATOR = "\n\n"


def rag_prompt(question: Column, context: Column) -> Column:
    """H8: template filled with question and context, then stripped of outer whitespace."""
    return strip_all(F.concat(F.lit(RAG_PROMPT_HEAD), F.coalesce(question, F.lit("")),
                              F.lit(RAG_PROMPT_MID), F.coalesce(context, F.lit(""))))


def question_prompt_head(app: str = APP_NAME) -> str:
    return QUESTION_PROMPT_HEAD.replace("{app}", app)


def question_prompt(text: Column, app: str = APP_NAME) -> Column:
    """H9: question-generation prompt for one record (the text itself is not stripped)."""
    return F.concat(F.lit(question_prompt_head(app)), F.coalesce(text, F.lit("")),
                    F.lit(QUESTION_PROMPT_TAIL))
