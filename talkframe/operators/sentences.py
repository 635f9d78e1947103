"""H4: abbreviations learnt from the corpus itself, for sentence borders.

Whether a word is an abbreviation follows from how it is used everywhere: it stands nearly always
before a period (log-likelihood ratio of that against chance), it is short, it may hold further periods, and it
hardly ever stands without one. Published as the first stage of an unsupervised sentence
splitter (Kiss and Strunk, 2006).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import BLANK

# Fixed values of the published method: the least score of an abbreviation and the probability
# of a period after one.
LEAST_SCORE = 0.3
PERIOD_AFTER = 0.99
# Abbreviations travel as a literal set; a vocabulary with more is an error, not cut.
MAX_ABBREVIATIONS = 100_000
WORD_START = r"^[^\p{L}\p{N}]+"
WORD_END = r"[^\p{L}\p{N}]+\z"
DOTTED = r"[\p{L}\p{N}]\.\z"


def word_uses(docs: DataFrame, text: str) -> DataFrame:
    """(word, n, dotted): every word of the corpus in lower case, its occurrences, and those before a period.

    Words are parted by white space and cut to their first and last letter or digit; what is directly
    followed by a period and nothing else is dotted. Partial counts are summed before the
    shuffle, so a word of every text costs a row per task.
    """
    each = docs.select(F.explode(F.split(F.coalesce(F.col(text), F.lit("")), BLANK + "+")).alias("w"))
    core = F.lower(F.regexp_replace("w", WORD_START, ""))
    each = each.select(core.alias("core")).select(
        F.regexp_replace("core", WORD_END, "").alias("word"), F.col("core").rlike(DOTTED).alias("dot"))
    return (each.where("word <> ''").groupBy("word")
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("dot").cast("bigint")).alias("dotted")))


def abbreviation_scores(uses: DataFrame) -> DataFrame:
    """(word, n, dotted, score) of the words with a letter that stand before a period somewhere."""
    total = uses.agg(F.sum("n").alias("n"), F.sum("dotted").alias("dotted")).first()
    if not total.dotted:
        return uses.limit(0).withColumn("score", F.lit(0.0))
    chance = min(total.dotted / total.n, 1 - 1e-12)
    bare = F.col("n") - F.col("dotted")

    def fit(p):
        return F.col("dotted") * F.log(F.lit(p)) + bare * F.log(F.lit(1 - p))
    ratio = -2.0 * (fit(chance) - fit(PERIOD_AFTER))
    signs = F.char_length(F.replace("word", F.lit("."), F.lit(""))).cast("double")
    periods = F.char_length("word") - signs + 1
    score = ratio * F.exp(-signs) * periods * F.pow(signs, -bare.cast("double"))
    return uses.where((F.col("dotted") > 0) & F.col("word").rlike(r"\p{L}")).select("word", "n", "dotted", score.alias("score"))


def learn_abbreviations(docs: DataFrame, text: str) -> list:
    """The corpus's abbreviations (lower case, without the last period), at most MAX_ABBREVIATIONS."""
    from ..session import stored
    found = abbreviation_scores(stored(word_uses(docs, text), "word-uses")).where(F.col("score") >= LEAST_SCORE)
    rows = found.select("word").orderBy("word").limit(MAX_ABBREVIATIONS + 1).collect()
    if len(rows) > MAX_ABBREVIATIONS:
        raise ValueError(f"more than {MAX_ABBREVIATIONS} abbreviations: raise LEAST_SCORE")
    return [r.word for r in rows]
