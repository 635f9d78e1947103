"""J2 + G2 without a model: entities of the user's labels, given as a table of phrases.

Word n-grams of the texts meet the phrases in an equi-join. Matches of one text may overlap; of all
sets of matches that don't, the one with the largest sum of squared lengths stays, so long phrases
go before short ones (weighted interval choice, by dynamic programming over the text's matches).
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType

from ..functions.text import tokenize

WORD = r"[\p{L}\p{N}]+"
# Phrases broadcast to the texts (about 100 bytes each); beyond it both sides are shuffled by n-gram.
MAX_BROADCAST_PHRASES = 1_000_000


def phrase_table(phrases: DataFrame) -> DataFrame:
    """(label, gram, n), distinct: the phrases as lower-case words joined by one space, and how many. NULL
    labels and phrases without a word are left out."""
    words = phrases.select("label", tokenize("phrase", WORD).alias("_w")).where("label is not null and size(_w) > 0")
    return words.select("label", F.array_join("_w", " ").alias("gram"), F.size("_w").alias("n")).distinct()


def chosen(starts: list, ends: list) -> list:
    """Places of the matches that stay; matches come by (end, start) and cover words start..end-1.

    best[i] is the largest sum among the first i matches; equal sums prefer to leave the later match out.
    """
    best, before = [0], []
    for s, e in zip(starts, ends):
        p = bisect_right(ends, s)            # matches that end where this one starts, or earlier
        before.append(p)
        best.append(max(best[-1], best[p] + (e - s) ** 2))
    out, i = [], len(before)
    while i:
        if best[i] == best[i - 1]:
            i -= 1
        else:
            out.append(i - 1)
            i = before[i - 1]
    return out[::-1]


@pandas_udf(ArrayType(IntegerType()))
def _chosen(starts: pd.Series, ends: pd.Series) -> pd.Series:
    return pd.Series([chosen(list(s), list(e)) for s, e in zip(starts, ends)])


def tag_phrases(chunks: DataFrame, key: str, text: str, phrases: DataFrame,
                max_broadcast: int = MAX_BROADCAST_PHRASES) -> DataFrame:
    """(key, start, label, text, score): the phrases that a text holds, word for word, without overlaps.

    ``chunks``: one row a key; ``phrases``: (label, phrase). ``start`` counts words from 0, ``text`` is the phrase in
    lower case, the score 1. A phrase of several labels gives a row for each. NULL and empty texts have none.
    """
    table = phrase_table(phrases)
    seen = table.agg(F.count(F.lit(1)).alias("n"), F.collect_set("n").alias("sizes")).first()
    sizes = F.array(*[F.lit(n) for n in sorted(seen.sizes)]).cast("array<int>")
    words = chunks.select(F.col(key), tokenize(F.col(text), WORD).alias("_w")).withColumn("_size", F.size("_w"))
    each = words.select(key, "_w", "_size", F.explode(sizes).alias("_n")).where(F.col("_n") <= F.col("_size"))
    each = each.select(key, "_w", "_n", F.explode(F.sequence(F.lit(0), F.col("_size") - F.col("_n"))).alias("start"))
    grams = each.select(key, "start", "_n", F.array_join(F.slice("_w", F.col("start") + 1, F.col("_n")), " ").alias("gram"))
    known = table.select("gram").distinct()
    met = grams.join(F.broadcast(known) if seen.n <= max_broadcast else known, "gram")
    # the matches of one text, no more than its words times the phrases' sizes
    match = F.struct((F.col("start") + F.col("_n")).alias("end"), "start", "gram")
    spans = met.groupBy(key).agg(F.sort_array(F.collect_list(match)).alias("_m"))
    kept = spans.select(key, F.transform(_chosen(F.col("_m.start"), F.col("_m.end")), lambda i: F.get("_m", i)).alias("_k"))
    rows = kept.select(key, F.explode("_k").alias("k")).select(key, F.col("k.start").cast("bigint").alias("start"), F.col("k.gram").alias("gram"))
    labels = table.select("label", "gram")
    return (rows.join(F.broadcast(labels) if seen.n <= max_broadcast else labels, "gram")
            .select(key, "start", "label", F.col("gram").alias("text"), F.lit(1.0).alias("score")))
