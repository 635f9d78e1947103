"""Spelling variants: words of a corpus at edit distance one, found by pivotal bigrams.

Bigrams are ordered by how many words hold them, the rarest first. The *prefix* of a word are its
three first bigrams in that order (with all places of the third). Of the prefix, two disjoint
bigrams of least total frequency are the word's *pivots* (dynamic programming). One edit touches
one place, so one of two disjoint pivots survives it, and a pivot of the word whose prefix ends
first in the order is always in the other word's prefix.

Position limits: the edit lies to the right of the first pivot or to the left of the second, so the
text from the pivot to the word's other end is untouched and the pivot's place is known exactly.
Of the side that holds the edit, one half is untouched as well. An entry of the index is therefore
a prefix bigram with its untouched side and one half of the other, and a probe asks for
exactly that, once for each length the partner may have.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
TYPO_EVERY = 199
LEAST_CHARS = 6
LEAST_COUNT = 5
FORM_RATIO = 5
PIVOTS = 2        # edits + 1
PREFIX = 3        # bigram size * edits + 1
# words counted in a task before the counts go on to the shuffle
COUNTED_WORDS = 100_000
# a text is cut into runs at once up to this length, beyond it run by run
WHOLE_CHARS = 1 << 20
# index rows of one key that one part of the join holds
KEY_ROWS = 2048


def damaged(run: str, crc: int) -> str:
    """The run as it counts: where TYPO_EVERY divides its checksum, one code point is gone."""
    if crc % TYPO_EVERY:
        return run
    at = crc % len(run)
    return run[:at] + run[at + 1:]


def _words_of(doc_id, text: str, into: Counter) -> None:
    text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z only
    runs = RUN.findall(text) if len(text) <= WHOLE_CHARS else (m.group() for m in RUN.finditer(text))
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(runs).items():
        word = damaged(run, zlib.crc32(run.encode(), start))
        if len(word) >= LEAST_CHARS:
            into[word] += n


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
    for b in batches:
        for doc_id, text in zip(b.column(0), b.column(1)):
            if text.is_valid:
                _words_of(doc_id.as_py(), text.as_py(), found)
            if len(found) >= COUNTED_WORDS:
                yield out()
                found.clear()
    yield out()


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the corpus's words of LEAST_CHARS code points and LEAST_COUNT occurrences or more.

    Null and empty texts have no words; a null id stands as the empty text in the checksum;
    repeated rows count again; other columns are ignored. Counts are summed in each task first, so a
    word that fills the corpus is one row of a task.
    """
    each = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(_counts, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def bigram_order(words: DataFrame) -> dict[str, int]:
    """Bigram -> number of words' places that hold it.

    The words' letters are a-z and U+00C0-U+00FF, so there are at most 90 * 90 bigrams whatever
    the corpus: the table is small enough for the driver and for every task.
    """
    pairs = words.select(F.explode(F.transform(
        F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("gram"))
    return {r.gram: r["count"] for r in pairs.groupBy("gram").count().collect()}


def pivots(places: list[int], cost: list[int]) -> list[int]:
    """PIVOTS of the ascending bigram places, two or more apart, with the least total cost.

    Dynamic programming: row[i] is the cheapest choice (cost, places) among the first i places, or None;
    a place is taken on top of the row before, as far as that ends two places ahead.
    """
    row: list = [(0, ())] * (len(places) + 1)
    for _ in range(PIVOTS):
        above, row, ahead = row, [None], 0
        for place, c in zip(places, cost):
            while places[ahead] + 2 <= place:
                ahead += 1
            taken = above[ahead] and (above[ahead][0] + c, above[ahead][1] + (place,))
            row.append(min(filter(None, (row[-1], taken)), default=None))
    return list(row[-1][1])


def signature(word: str, order: dict[str, tuple[int, int]]) -> tuple[int, list[int], list[int]]:
    """(order of the prefix's last bigram, places of the prefix, places of the pivots)."""
    grams = sorted((order[word[i:i + 2]][0], i) for i in range(len(word) - 1))
    last = grams[PREFIX - 1][0]
    places = sorted(i for r, i in grams if r <= last)
    return last, places, pivots(places, [order[word[i:i + 2]][1] for i in places])


def left_keys(word: str, place: int, length: int) -> list[str]:
    """Keys of an edit to the right of the bigram at ``place``, in a partner of ``length``."""
    end = place + 2
    half = max(0, length - end) // 2
    rest = max(0, length - end) - half
    return [f"l{length}:{place}:{word[:end + half]}", f"r{length}:{place}:{word[:end]}:{word[len(word) - rest:]}"]


def right_keys(word: str, place: int, length: int) -> list[str]:
    """Keys of an edit to the left of the bigram at ``place``, which is counted from the end."""
    back = len(word) - place
    half = max(0, length - back) // 2
    rest = max(0, length - back) - half
    return [f"L{length}:{back}:{word[len(word) - back - half:] if back + half < len(word) else word}",
            f"R{length}:{back}:{word[place:]}:{word[:rest]}"]


def _entries(order: dict[str, tuple[int, int]], probe: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys: list[str] = []
            lasts: list[int] = []
            rows: list[int] = []
            for at, word in enumerate(b.column(0).to_pylist()):
                last, places, (first, second) = signature(word, order)
                n = len(word)
                if probe:
                    mine = [k for d in (-1, 0, 1) for k in left_keys(word, first, n + d) + right_keys(word, second, n + d)]
                else:
                    mine = [k for p in places for k in left_keys(word, p, n) + right_keys(word, p, n)]
                keys += mine
                lasts += [last] * len(mine)
                rows += [at] * len(mine)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(lasts, pa.int32()), *[c.take(pa.array(rows, pa.int32())) for c in b.columns]],
                names=["key", "last", "word", "n"])
    return run


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, an, b, bn), a < b: all pairs of words that differ by exactly one edit, with their counts.

    ``words`` is a written (word, n) table of distinct words of at least PREFIX + 1 code points.
    Keys are hashed to 64 bits; every meeting is verified, so a collision costs a check only. A key
    of more than KEY_ROWS index rows is dealt to parts, to each of which its probes go. Both sides are
    shuffled: Spark sizes them by the words, of which each has a dozen rows, and would broadcast them.
    """
    counts = bigram_order(words)
    order = {g: (i, c) for i, (g, c) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0])))}
    schema = "key string, last int, word string, n long"
    both = [words.select("word", "n").mapInArrow(_entries(order, probe), schema)
            .withColumn("key", F.xxhash64("key")) for probe in (False, True)]
    index, probes = both
    hot = written(index.groupBy("key").count().filter(F.col("count") > KEY_ROWS)
                  .select("key", F.ceil(F.col("count") / KEY_ROWS).cast("int").alias("parts")), "hot-keys")
    i = index.select("key", F.col("last").alias("il"), F.col("word").alias("iw"), F.col("n").alias("inn"))
    p = probes.select("key", F.col("last").alias("pl"), F.col("word").alias("pw"), F.col("n").alias("pn"))
    near = (F.col("pl") <= F.col("il")) & (F.col("iw") != F.col("pw")) & (F.levenshtein("iw", "pw", 1) == 1)
    if hot.isEmpty():
        met = p.join(i.hint("merge"), "key").filter(near)
    else:
        i = i.join(hot, "key", "left").withColumn("part", F.pmod(F.xxhash64("iw"), F.coalesce("parts", F.lit(1))).cast("int"))
        p = p.join(hot, "key", "left").withColumn(
            "part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        met = p.join(i.hint("merge"), ["key", "part"]).filter(near)
    up = F.col("iw") < F.col("pw")
    return met.select(F.least("iw", "pw").alias("a"), F.when(up, F.col("inn")).otherwise(F.col("pn")).alias("an"),
                      F.greatest("iw", "pw").alias("b"), F.when(up, F.col("pn")).otherwise(F.col("inn")).alias("bn")).distinct()


def roots(links: DataFrame) -> DataFrame:
    """(word, root) for every row (word, form): forms followed to the last.

    A form's count is at least FORM_RATIO times the word's, so there are no circles and a chain has
    at most log(largest count) links. Each round doubles the stretch; it is a written table.
    """
    now = written(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(now.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return now


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the corpus's vocabulary.

    A word's form is its near word of largest count (ties: smallest in code-point order) if that
    is FORM_RATIO times its own or more. Nulls, empty and repeated rows as in ``vocabulary``; without
    words the result is empty.
    """
    words = written(vocabulary(docs, doc_id, text), "words")
    pairs = near_pairs(words)
    # of the words around one, the largest count and then the smallest word is the least (-n, word)
    sides = [F.struct(F.col(w).alias("word"), F.col(n).alias("n"), F.struct((-F.col(on)).alias("m"), F.col(ow).alias("w")).alias("o"))
             for w, n, ow, on in (("a", "an", "b", "bn"), ("b", "bn", "a", "an"))]
    around = (pairs.select(F.inline(F.array(*sides))).groupBy("word", "n")
              .agg(F.count("*").alias("n_near"), F.min("o").alias("o")))
    formed = -F.col("o.m") >= FORM_RATIO * F.col("n")
    around = written(around.select("word", "n_near", F.when(formed, F.col("o.w")).alias("form"),
                                   F.when(formed, -F.col("o.m")).alias("form_n")), "near-words")
    root = roots(around.filter("form is not null"))
    return (words.join(around, "word", "left").join(root, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))
