"""Text expressions: tokenising, title normalising, sentence split, HTML to text, word stream.

Every function maps Columns to a Column and stays inside the JVM (whole-stage codegen for the
scalar parts, higher-order functions for the array parts), but for ``unescape``: the character
references of HTML are decoded on Arrow batches.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Fixed values that must equal the reference's behaviour.
# Word runs of two or more letters, digits or underscores (the vectoriser's default pattern
# "(?u)\b\w\w+\b" written with Unicode classes so that Java and RE2 agree with Python).
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
# White space, the same for every regular-expression engine.
BLANK = r"[ \t\n\x0B\f\r]"
# A sentence may end after a terminator, further terminators and closing marks, and white space.
SENTENCE_END = r"""([.!?][.!?"')\]}”’»]*""" + BLANK + r"+)"
# The word before a single period at the end of a piece; whether it is an abbreviation is learnt.
WORD_BEFORE_PERIOD = r"([\p{L}\p{N}](?:[^ \t\n\x0B\f\r]*[\p{L}\p{N}])?)\." + BLANK + r"+\z"
# Stands where a sentence ends; no character of any text (a text that holds it is cut there).
END_MARK = "\uffff"
# Leading / trailing whitespace (Python str.strip without arguments).
EDGE_WHITESPACE = r"^\s+|\s+$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_all(col) -> Column:
    """Remove leading and trailing whitespace of every kind (``trim`` only removes spaces)."""
    return F.regexp_replace(_c(col), EDGE_WHITESPACE, "")


def tokenize(col, pattern: str = TOKEN_PATTERN, lowercase: bool = True) -> Column:
    """H1: array of tokens of a text; NULL text behaves as ''."""
    c = F.coalesce(_c(col), F.lit(""))
    if lowercase:
        c = F.lower(c)
    return F.regexp_extract_all(c, F.lit(pattern), 0)


def title_normalize(col) -> Column:
    """H2: delete '.', other punctuation becomes a space, lowercase, squeeze spaces."""
    c = F.regexp_replace(_c(col), r"\.", "")
    c = F.regexp_replace(c, r"\p{P}", " ")
    c = F.lower(c)
    c = F.regexp_replace(c, r"\s+", " ")
    return F.trim(c)


def sentences(col, abbreviations: list | None = None) -> Column:
    """H4: array of sentences (stripped, empty ones dropped).

    A sentence ends at '.', '!' or '?' (with what closes quotes and brackets) before white space, so
    decimals and addresses stay whole. A period after one of the ``abbreviations`` (lower case, without
    their period; see ``operators.sentences.learn_abbreviations``) ends none.
    """
    pieces = F.split(F.regexp_replace(F.coalesce(_c(col), F.lit("")), SENTENCE_END, f"$1{END_MARK}"), END_MARK)
    if abbreviations:
        def glued(p):
            return F.lower(F.regexp_extract(p, WORD_BEFORE_PERIOD, 1)).isin(abbreviations)
        whole = F.transform(pieces, lambda p: F.when(glued(p), p).otherwise(F.concat(p, F.lit(END_MARK))))
        pieces = F.split(F.array_join(whole, ""), END_MARK)
    return F.filter(F.transform(pieces, strip_all), lambda x: x != "")


# Removal steps, in order (comments, doctype, script/style with their content,
# line breaks, any other tag).
HTML_STEPS = [
    (r"(?s)<!--.*?-->", ""),
    (r"(?i)<!DOCTYPE[^>]*>", ""),
    (r"(?is)<script\b[^>]*>.*?</script\s*>", ""),
    (r"(?is)<style\b[^>]*>.*?</style\s*>", ""),
    (r"(?i)<br\s*/?>", "\n"),
    (r"<[^>]*>", ""),
]


@pandas_udf(StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """All named and numeric character references of HTML, decoded once, on Arrow batches."""
    return texts.map(lambda t: html.unescape(t) if "&" in t else t)


def html_to_text(col) -> Column:
    """H5: HTML summary to plain text, <br> as newline, character references decoded."""
    c = F.coalesce(_c(col), F.lit(""))
    for pattern, repl in HTML_STEPS:
        c = F.regexp_replace(c, pattern, repl)
    return unescape(c)


def words(col) -> Column:
    """Whitespace-separated words of a text (empty text -> empty array)."""
    s = strip_all(F.coalesce(_c(col), F.lit("")))
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, r"\s+"))
