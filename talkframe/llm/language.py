"""Language identification by hyperdimensional profiles.

Every letter has a random vector of signs that follows from its code point alone. An n-gram is its
letters' vectors, each rotated by its place, bound by multiplication; a text is the bundle (sum) of
its n-grams; a language's prototype is the bundle of the unit bundles of its texts. A document is
of the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import per_worker, written

NGRAM = 3
DIMENSIONS = 2048
SEED = 20_231
UNDETERMINED = "und"
# prototypes are collected: languages * DIMENSIONS * 8 bytes
MOST_LANGUAGES = 4096
# vectors of n-grams that a worker keeps, in bytes of signs
KEPT_GRAMS = 1 << 14
# n-grams of a text that are bundled at once
GRAM_BATCH = 1 << 12
# code points of a text that are read at once
READ_CHARS = 1 << 20
CODE_BITS = 21


def held_out(doc_id: str) -> Column:
    """Whether a row is never learnt from: crc32 of its id as text leaves 2 modulo 4 (null: not held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def letter_table() -> np.ndarray:
    """For every code point the lower-case letter it counts as, or 0 if it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            out[c] = ord(s.lower()[0])
    return out


def letters() -> np.ndarray:
    return per_worker("letters", letter_table)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams as numbers, counts) of a text's letters; whatever lies between letters is one gap (0).

    The text is framed by gaps and read whole, READ_CHARS code points at a time; the ends of a piece are
    carried on, so pieces don't show.
    """
    grams, counts = [], []
    kept = np.zeros(1, np.uint64)
    for at in range(0, len(text) + 1, READ_CHARS):
        piece = text[at:at + READ_CHARS]
        codes = letters()[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
        if at + READ_CHARS > len(text):
            codes = np.append(codes, np.uint64(0))
        codes = np.concatenate([kept, codes])
        codes = codes[(codes > 0) | np.concatenate([[True], codes[:-1] > 0])]
        if len(codes) >= NGRAM:
            grid = np.lib.stride_tricks.sliding_window_view(codes, NGRAM)
            number = np.zeros(len(grid), np.uint64)
            for k in range(NGRAM):
                number = (number << np.uint64(CODE_BITS)) | grid[:, k]
            g, c = np.unique(number, return_counts=True)
            grams.append(g)
            counts.append(c)
        kept = codes[-(NGRAM - 1):]
    if not grams:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(grams) == 1:
        return grams[0], counts[0]
    g, where = np.unique(np.concatenate(grams), return_inverse=True)
    return g, np.bincount(where, np.concatenate(counts)).astype(np.int64)


def letter_vector(code: int) -> np.ndarray:
    """The signs (+1, -1) of a letter or of the gap (0)."""
    bits = np.random.default_rng((SEED, code)).integers(0, 2, DIMENSIONS, np.int8)
    return 2 * bits - 1


class GramVectors:
    """Vectors of n-grams, bound when first asked for; a bounded number is kept."""

    def __init__(self):
        self.letter: dict[tuple[int, int], np.ndarray] = {}
        self.clear()

    def clear(self):
        self.row: dict[int, int] = {}
        self.signs = np.empty((KEPT_GRAMS, DIMENSIONS), np.int8)

    def _turned(self, code: int, place: int) -> np.ndarray:
        v = self.letter.get((code, place))
        if v is None:
            if len(self.letter) >= KEPT_GRAMS:
                self.letter.clear()
            v = self.letter[code, place] = np.roll(letter_vector(code), place)
        return v

    def rows(self, grams: list[int]) -> np.ndarray:
        """The signs of at most GRAM_BATCH n-grams."""
        if len(self.row) + len(grams) > KEPT_GRAMS:
            self.clear()
        at = np.empty(len(grams), np.int64)
        for i, g in enumerate(grams):
            r = self.row.get(g)
            if r is None:
                r = self.row[g] = len(self.row)
                v = self._turned(g & ((1 << CODE_BITS) - 1), 0)
                for place in range(1, NGRAM):
                    v = v * self._turned(g >> (CODE_BITS * place) & ((1 << CODE_BITS) - 1), place)
                self.signs[r] = v
            at[i] = r
        return self.signs[at]


def bundles(texts: list) -> np.ndarray:
    """The unit bundle of each text (rows); zeros for null texts and texts without a letter."""
    kept = per_worker("gram-vectors", GramVectors)
    found = [gram_counts(t) if t else (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for t in texts]
    out = np.zeros((len(texts), DIMENSIONS))
    if not sum(len(g) for g, _ in found):
        return out
    grams, where = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
    text = np.repeat(np.arange(len(texts)), [len(g) for g, _ in found])
    count = np.concatenate([c for _, c in found]).astype(np.float32)
    order = np.argsort(where, kind="stable")
    where, text, count = where[order], text[order], count[order]
    for at in range(0, len(grams), GRAM_BATCH):
        signs = kept.rows(grams[at:at + GRAM_BATCH].tolist()).astype(np.float32)
        lo, hi = np.searchsorted(where, [at, at + GRAM_BATCH])
        share = np.zeros((len(texts), len(signs)), np.float32)
        share[text[lo:hi], where[lo:hi] - at] = count[lo:hi]
        out += share @ signs
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-30)


TEXTS_AT_ONCE = 128


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    n: dict[str, int] = {}
    for b in batches:
        for at in range(0, b.num_rows, TEXTS_AT_ONCE):
            part = b.slice(at, TEXTS_AT_ONCE)
            found = bundles(part.column(0).to_pylist())
            langs = np.array(part.column(1).to_pylist(), object)
            for lang in set(langs):
                mine = found[langs == lang]
                total[lang] = total.get(lang, 0) + mine.sum(axis=0)
                n[lang] = n.get(lang, 0) + int((mine != 0).any(axis=1).sum())
    yield pa.RecordBatch.from_pydict({"lang": list(n), "n": list(n.values()), "bundle": list(total.values())},
                                     schema=pa.schema([("lang", pa.string()), ("n", pa.int64()), ("bundle", pa.list_(pa.float64()))]))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, n, bundle) of many tasks, added up by language where they are read."""
    total: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, bundle in zip(b.column(0).to_pylist(), b.column(1)):
            total[lang] = total.get(lang, 0) + bundle.values.to_numpy(zero_copy_only=False)
    yield pa.RecordBatch.from_pydict({"lang": list(total), "bundle": list(total.values())},
                                     schema=pa.schema([("lang", pa.string()), ("bundle", pa.list_(pa.float64()))]))


@dataclass
class Profiles:
    """The learnt languages and their unit prototypes (rows)."""

    langs: list
    prototypes: np.ndarray


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Profiles:
    """Prototypes of all rows with a language and a letter.

    A task adds its texts' bundles up by language and writes a row for each, whatever the share of a
    language. Rows are sums of doubles: reruns agree to rounding.
    """
    part = written(docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("lang is not null and text is not null")
                   .mapInArrow(_profiles, "lang string, n long, bundle array<double>"), "profiles").filter("n > 0")
    few = part.select("lang").distinct().limit(MOST_LANGUAGES + 1).count()
    if few > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: {lang} doesn't hold languages")
    # files of many tasks are read by few: their rows are added up before the dimensions are
    rows = (part.select("lang", "bundle").mapInArrow(_merged, "lang string, bundle array<double>")
            .select("lang", F.posexplode("bundle").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
            .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).orderBy("lang").collect())
    p = np.array([[c.x for c in r.v] for r in rows]).reshape(len(rows), DIMENSIONS)
    return Profiles([r.lang for r in rows], p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-30))


def identify(profiles: Profiles, texts: list) -> tuple[list, list]:
    """(language, score) of each text: the nearest prototype and the cosine as (1 + cos) / 2.

    Without a letter, or without a learnt language, UNDETERMINED and 0; ties go to the first language
    in code-point order.
    """
    found = bundles(texts)
    if not profiles.langs:
        return [UNDETERMINED] * len(texts), [0.0] * len(texts)
    cos = np.round(found @ profiles.prototypes.T, 9)
    best = cos.argmax(axis=1)
    some = (found != 0).any(axis=1)
    score = np.clip((1 + cos[np.arange(len(texts)), best]) / 2, 0, 1)
    return [profiles.langs[b] if s else UNDETERMINED for b, s in zip(best, some)], [float(x) if s else 0.0 for x, s in zip(score, some)]


def identifier(spark: SparkSession, profiles: Profiles):
    """Column -> struct(lang, score); the prototypes are a broadcast of checked size."""
    shared = spark.sparkContext.broadcast((profiles.langs, profiles.prototypes))

    @pandas_udf("lang string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        langs, scores = [], []
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            found = identify(Profiles(*shared.value), list(texts.iloc[at:at + TEXTS_AT_ONCE]))
            langs += found[0]
            scores += found[1]
        return pd.DataFrame({"lang": langs, "score": scores})
    return run
