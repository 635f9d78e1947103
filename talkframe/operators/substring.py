"""Substring joins: B11 (a term inside a name) and the ground truth of C5 (an item inside a text).

Both find candidates by an equi-join on character grams and confirm each one exactly, so no needle
is compared with every haystack:

* names are short: every gram of a name is indexed with its place. A term is looked for by the one
  of its grams that the fewest index rows have; the place tells where the term must lie, and the
  name, which the index row carries, is read there;
* texts are long: of every window of ``w`` grams only the least hash is kept. The windows of an item
  lie in the text that holds the item, so all grams kept of the item are kept of the text. The item is
  looked for by the one that the fewest texts have, and the text is read past the candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sparse import join_payload

# Characters of a gram of a name; a shorter term is a gram of its own.
NAME_GRAM = 3
# Anchors (one row a term) broadcast to the index rows; beyond it both sides are shuffled by gram.
MAX_BROADCAST_ANCHORS = 1_000_000
# Matches that a task holds, besides those already cut, before it cuts them to the first of each term.
FIRST_ROWS = 1 << 16
# Index rows of one gram that one part of the shuffled join holds.
GRAM_ROWS = 100_000
# (characters of a gram, grams of a window) for items of at least gram + window - 1 characters,
# the longest that fits an item is used.
SAMPLING = ((8, 17), (5, 4), (3, 1), (1, 1))
# Distinct grams of items broadcast to the texts (8 bytes each); beyond it they are shuffled.
MAX_BROADCAST_GRAMS = 4_000_000
# Candidates (with the item's text) broadcast in one block to the texts.
MAX_BROADCAST_CANDIDATES = 100_000
# Characters of a text that are hashed at once.
HASHED_CHARS = 1 << 20


# ---------------------------------------------------------------- terms in names

def _places(text: Column, size: Column | int) -> Column:
    """array<struct<at:int, gram:string>> of all grams of ``size`` characters; none if the text is shorter."""
    size = F.lit(size) if isinstance(size, int) else size
    last = F.char_length(text) - size + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(
        i.alias("at"), F.substring(text, i, size).alias("gram"))))


def name_index(names: DataFrame, key: str, name: str, sizes: list | None = None) -> DataFrame:
    """(gram, at, key, low): every gram of each lower-cased name with its place. NULL names have none."""
    low = names.select(F.col(key), F.lower(F.col(name)).alias("low"))
    each = F.concat(*[F.coalesce(_places(F.col("low"), s), F.array().cast("array<struct<at:int,gram:string>>"))
                      for s in (sizes or [NAME_GRAM])])
    return low.select(key, "low", F.inline(each)).select("gram", "at", key, "low")


def term_matches(terms: DataFrame, names: DataFrame, key: str, name: str,
                 max_broadcast: int = MAX_BROADCAST_ANCHORS, gram_rows: int = GRAM_ROWS) -> DataFrame:
    """(term, key), distinct: every name that contains the term, in any case of its letters.

    ``terms``: (term), distinct. NULL and empty terms, and NULL names, match nothing. A term of fewer than
    NAME_GRAM characters is a gram itself, and the index then holds grams of that size too.
    """
    t = terms.select("term", F.lower("term").alias("_low")).where("_low <> ''")
    t = t.withColumn("_size", F.least(F.lit(NAME_GRAM), F.char_length("_low")))
    seen = t.agg(F.count(F.lit(1)).alias("n"), F.collect_set("_size").alias("sizes")).first()   # at most NAME_GRAM sizes
    index = name_index(names, key, name, sorted(seen.sizes) or [NAME_GRAM])
    grams = t.select("term", "_low", F.inline(_places(F.col("_low"), F.col("_size"))))
    rows = index.groupBy("gram").agg(F.count(F.lit(1)).alias("_rows"))
    # a gram that no name holds has no rows: such a term is found nowhere and leaves the inner join
    # of one of its grams, so its anchor needs all of them to be there
    rarest = (grams.join(rows, "gram", "left").groupBy("term", "_low")
              .agg(F.min_by(F.struct("gram", F.col("at").alias("_off"), "_rows"),
                            F.struct(F.coalesce("_rows", F.lit(0)), "gram", "at")).alias("_a"))
              .select("term", "_low", "_a.*").where("_rows is not null"))
    if seen.n <= max_broadcast:
        met = index.join(F.broadcast(rarest), "gram")
    else:
        # a gram with many index rows is dealt to parts; its terms go to each of them
        parts = F.ceil(F.col("_rows") / gram_rows).cast("int")
        hot = rows.where(F.col("_rows") > gram_rows).select("gram", parts.alias("_parts"))
        dealt = index.join(hot, "gram", "left").withColumn(
            "_part", F.pmod(F.xxhash64(key, "at"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
        spread = rarest.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
        met = dealt.join(spread, ["gram", "_part"])
    # the term lies where its gram says; of several places in a name the first counts
    place = F.col("at") - F.col("_off") + 1
    return met.where((place > 0) & (F.position("_low", "low") == place)).select("term", key)


# ---------------------------------------------------------------- items in texts

def _hashes(codes: np.ndarray, size: int) -> np.ndarray:
    n = len(codes) - size + 1
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k:k + n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def kept_grams(text: str, size: int, window: int) -> np.ndarray:
    """The distinct least hashes of every window of ``window`` grams; none if the text is shorter.

    A long text is hashed piece by piece, each reaching over into the next by what a window spans.
    """
    span = size + window - 1
    if len(text) < span:
        return np.zeros(0, np.int64)
    found = []
    for start in range(0, len(text) - span + 1, HASHED_CHARS):
        piece = text[start:start + HASHED_CHARS + span - 1]
        least = _hashes(np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), size)
        reach = 1                             # least[i] is the minimum of ``reach`` hashes from i
        while 2 * reach <= window:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < window:
            least = np.minimum(least[:reach - window], least[window - reach:])
        found.append(np.unique(least))
    return np.unique(np.concatenate(found)).view(np.int64)


def _grams(tiers: list, kind):
    """Rows (id, text, tier) -> (id, tier, gram); a NULL tier means all of ``tiers``."""
    def out(ids: list, where: list, found: list) -> pa.RecordBatch:
        n = [len(g) for g in found]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, kind).take(pa.array(np.repeat(np.arange(len(ids)), n))),
             pa.array(np.repeat(np.array(where, np.int32), n)),
             pa.array(np.concatenate(found))], names=["id", "tier", "gram"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, where, found, held = [], [], [], 0
            for i, text, own in zip(b.column(0), b.column(1), b.column(2).to_pylist()):
                for tier in (tiers if own is None else [own]):
                    g = kept_grams(text.as_py(), *SAMPLING[tier])
                    ids.append(i.as_py())
                    where.append(tier)
                    found.append(g)
                    held += len(g)
                if held > HASHED_CHARS:
                    yield out(ids, where, found)
                    ids, where, found, held = [], [], [], 0
            if found:
                yield out(ids, where, found)
    return run


def _gram_rows(rows: DataFrame, kind: str, tiers: list) -> DataFrame:
    arrow = pa.string() if kind == "string" else pa.int64()
    return rows.mapInArrow(_grams(tiers, arrow), f"id {kind}, tier int, gram bigint")


def text_matches(items: DataFrame, texts: DataFrame, max_grams: int = MAX_BROADCAST_GRAMS,
                 max_candidates: int = MAX_BROADCAST_CANDIDATES) -> DataFrame:
    """(qid, id): every text that contains the item's whole text, once for each pair of rows.

    ``items``: (qid bigint, question); ``texts``: (id string, text), ids unique. NULL and empty items are
    contained in nothing. Candidates come from an equi-join on each item's rarest kept gram; a gram
    that only texts have is dropped where it arises (or in the shuffle of a semi join beyond
    ``max_grams``), and texts are streamed past the candidates, never moved.
    """
    from ..session import cut_lineage
    tier = F.lit(None).cast("int")
    for i in reversed(range(len(SAMPLING))):
        size, window = SAMPLING[i]
        tier = F.when(F.char_length("question") >= size + window - 1, F.lit(i)).otherwise(tier)
    items = items.select("qid", "question").where("question <> ''")
    wanted = cut_lineage(_gram_rows(items.select("qid", "question", tier.alias("tier")), "bigint", [])
                         .withColumnRenamed("id", "qid"))
    grams = wanted.select("tier", "gram").distinct()
    tiers = sorted(r[0] for r in grams.select("tier").distinct().collect())   # at most len(SAMPLING) rows
    if not tiers:
        return items.sparkSession.createDataFrame([], "qid bigint, id string")
    if grams.count() <= max_grams:
        grams = F.broadcast(grams)
    d = texts.select(F.col("id").cast("string").alias("id"), "text").where("text <> ''")
    held = cut_lineage(_gram_rows(d.select("id", "text", F.lit(None).cast("int").alias("tier")), "string", tiers)
                       .join(grams, ["tier", "gram"], "left_semi"))
    n_texts = held.groupBy("tier", "gram").agg(F.count(F.lit(1)).alias("_n"))
    anchor = (wanted.join(n_texts, ["tier", "gram"], "left").groupBy("qid", "tier")
              .agg(F.min_by(F.struct("gram", "_n"), F.struct(F.coalesce("_n", F.lit(0)), "gram")).alias("_a"))
              .select("qid", "tier", "_a.gram", "_a._n").where("_n is not null").drop("_n"))
    candidates = anchor.join(held, ["tier", "gram"]).select("qid", "id").join(items, "qid")
    found = join_payload(candidates, d, key="id", block_rows=max_candidates)
    return found.where(F.contains("text", "question")).select("qid", "id")


def _least(limit: int):
    """Batches (term, key) -> the first ``limit`` rows of each term among those held at once, nulls first."""
    def cut(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[(rows.column_names[0], "ascending"), (rows.column_names[1], "ascending")],
                                         null_placement="at_start"))
        number = rows.column(0).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        heads = np.r_[0, np.flatnonzero(np.diff(number)) + 1]
        place = np.arange(len(number)) - np.repeat(heads, np.diff(np.r_[heads, len(number)]))
        return rows.filter(pa.array(place < limit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, new, n = None, [], 0
        for b in batches:
            new.append(b)
            n += b.num_rows
            if n >= max(FIRST_ROWS, held.num_rows if held else 0):
                held, new, n = cut(pa.concat_tables([*([held] if held else []), pa.Table.from_batches(new)])), [], 0
                if held.num_rows > 4 * FIRST_ROWS:
                    yield from held.combine_chunks().to_batches()
                    held = None
        if held or n:
            yield from cut(pa.concat_tables([*([held] if held else []), *([pa.Table.from_batches(new)] if n else [])])).combine_chunks().to_batches()
    return run


def first_matches(matches: DataFrame, term: str, key: str, limit: int) -> DataFrame:
    """(term, key, rank): the first ``limit`` keys of each term. Tasks cut their rows as they come, so that neither
    a sort nor the shuffle holds all matches."""
    rows, kinds = matches.select(term, key), dict(matches.dtypes)
    if limit > 0 and kinds[key] in ("string", "bigint", "int", "smallint", "tinyint"):
        rows = rows.mapInArrow(_least(limit), f"`{term}` {kinds[term]}, `{key}` {kinds[key]}")
    w = Window.partitionBy(term).orderBy(key)
    return (rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit)
            .withColumn("rank", F.col("_rn").cast("bigint")).drop("_rn"))
