"""Toxicity of noisy text: a Viterbi decoder undoes disguises, then the restored words are scored.

The channel model says how a letter may have been written: as itself, as a look-alike digit or
sign, repeated, or with signs or spaces between letters. Accents and doubled letters are undone by
further readings of a word, masks and pieces by the toxic words that were learnt. Each suspicious token (or run of single
letters) is a lattice of what its signs may stand for; the path that a character model of
the corpus (4-grams over all texts) and the channel together find likeliest is the restored text.
Plain tokens have one path and need no search.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_worker

# Signs that stand for letters.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y", "§": "s",
}
# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = str.maketrans({
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t",
    "у": "y", "х": "x", "і": "i", "ѕ": "s", "α": "a", "ε": "e", "ι": "i", "ο": "o", "ρ": "p", "υ": "u",
    "­": None, "​": None, "‌": None, "‍": None, "⁠": None, "﻿": None,
})
WILDCARDS = "*#%"
LETTERS = "abcdefghijklmnopqrstuvwxyz"

# log costs of the channel
SIGN, MASKED, DROPPED, EDGE, REPEATED, JOINED, PARTED = -1.5, -4.0, -2.5, -0.3, -0.7, -0.7, -1.0

# symbols of the character model: 0 a border of a word, 1-26 letters without accents, 27 others
SYMBOLS = 28
ORDER = 4
GRAMS = SYMBOLS ** ORDER
_TABLE = np.full(0x250, 27, np.int64)
for _c in range(0x250):
    _base = unicodedata.normalize("NFKD", chr(_c).lower())[0]
    if "a" <= _base <= "z":
        _TABLE[_c] = ord(_base) - 96
_TABLE[ord("\n")] = 0
_SYMBOL = {chr(c): int(_TABLE[c]) for c in range(0x250)}
# distinct words of a task that are held before they are counted into the table of 4-grams, or
# whose features are kept
HELD_WORDS = 50_000

# documents with a label that the classifier is fitted on, at most; chosen by hash
TRAIN_ROWS = 20_000
LEAST_TOXIC, LEAST_SHARE = 6, 0.95
MIN_HASHES = 4
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3

EDGES = ".,;:?\"'`´’“”«»()[]{}…-–—_~/\\"
RUN3 = re.compile(r"(.)\1\1")
SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
DOUBLED = re.compile(r"(.)\1+")


def _symbols(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(code < 0x250, _TABLE[np.minimum(code, 0x24F)], 27)


def _count_grams(words: Counter) -> np.ndarray:
    """Counts of 4-grams of words, each with three borders before and one after."""
    if not words:
        return np.zeros(GRAMS, np.int64)
    keys = list(words)
    s = _symbols("\n\n\n" + "\n\n\n\n".join(keys) + "\n")
    weight = np.repeat(np.fromiter(words.values(), np.float64, len(keys)), [len(k) + 4 for k in keys])
    code = s[3:].copy()
    for k in range(1, ORDER):
        code += s[3 - k:len(s) - k] * SYMBOLS ** k
    # of each word's len + 4 places the first len + 1 end within it; the others are borders only
    size = np.fromiter(map(len, keys), np.int64, len(keys))
    start = np.concatenate([[0], np.cumsum(size + 4)[:-1]])
    place = np.arange(len(code)) - np.repeat(start, size + 4)[:len(code)]
    inside = place <= np.repeat(size, size + 4)[:len(code)]
    return np.bincount(code[inside], weight[:len(code)][inside], GRAMS).astype(np.int64)


def _gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, words = np.zeros(GRAMS, np.int64), Counter()
    for b in batches:
        for t in b.column(0):
            words.update((t.as_py() or "").lower().split())
            if len(words) > HELD_WORDS:
                total += _count_grams(Counter({w: n for w, n in words.items() if w.isalpha()}))
                words.clear()
    total += _count_grams(Counter({w: n for w, n in words.items() if w.isalpha()}))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])


def character_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of character 4-grams over all texts. The alphabet bounds them: at most SYMBOLS**4
    rows leave a task or reach the driver, whatever the corpus."""
    rows = (docs.select(F.col(text).alias("text")).mapInArrow(_gram_batches, "gram int, n bigint")
            .groupBy("gram").agg(F.sum("n").alias("n")).toPandas())
    counts = np.zeros(GRAMS, np.int64)
    counts[rows["gram"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts


def character_model(counts: np.ndarray, strength: float = 5.0) -> np.ndarray:
    """log p(symbol | three before), shape (SYMBOLS**3, SYMBOLS): each order falls back on the
    next shorter one with the weight of ``strength`` observations."""
    p = np.full(SYMBOLS, 1.0 / SYMBOLS)
    c = counts.reshape((SYMBOLS,) * ORDER).astype(float)
    for order in range(1, ORDER + 1):
        n = c.sum(axis=tuple(range(ORDER - order)))
        p = (n + strength * p) / (n.sum(axis=-1, keepdims=True) + strength)
    return np.log(p).reshape(-1, SYMBOLS).astype(np.float32)


class Decoder:
    """Restores disguised tokens under a character model."""

    def __init__(self, logp: np.ndarray):
        self.rows = logp.tolist()

    def _arcs(self, chars: str) -> list[list[tuple[str, float]]]:
        """The lattice of a token: for each run of one sign its readings and their costs."""
        runs = [(m[0][0], len(m[0])) for m in re.finditer(r"(.)\1*", chars, re.S)]
        lattice = []
        for k, (c, n) in enumerate(runs):
            edge = k in (0, len(runs) - 1)
            if c.isalpha():
                lattice.append([(c * n, 0.0)] if n < 3 else [(c, REPEATED), (c * 2, 2 * REPEATED)])
            elif c in WILDCARDS:
                drop = EDGE if edge else DROPPED
                lattice.append([("", drop)] + ([(x, MASKED) for x in LETTERS] if n == 1 else []))
            elif c in LOOKALIKES:
                readings = [("", EDGE if edge and not c.isdigit() else DROPPED)]
                for x in LOOKALIKES[c]:
                    readings += [(x * n, SIGN * n)] if n < 3 else [(x, SIGN + REPEATED), (x * 2, SIGN + 2 * REPEATED)]
                lattice.append(readings)
            else:  # other signs join the letters around them or part words
                lattice.append([("", EDGE)] if edge else [("", JOINED), (" ", PARTED)])
        return lattice

    def best(self, lattice: list[list[tuple[str, float]]]) -> str:
        """The likeliest reading of a lattice (Viterbi over the last three symbols; of equal
        ones the first in code point order)."""
        square, rows = SYMBOLS * SYMBOLS, self.rows
        paths = {0: (0.0, None, "")}  # history -> score, path before, letters added
        for arcs in lattice:
            after: dict[int, tuple] = {}
            for hist, path in paths.items():
                for letters, cost in arcs:
                    h, score = hist, path[0] + cost
                    for c in letters:
                        if c == " ":
                            if h:
                                score += rows[h][0]
                            h = 0
                        else:
                            s = _SYMBOL.get(c, 27)
                            score += rows[h][s]
                            h = h % square * SYMBOLS + s
                    known = after.get(h)
                    if known is None or score > known[0]:
                        after[h] = (score, path, letters)
            paths = after
        _, end = min((-(p[0] + (rows[h][0] if h else 0.0)), h) for h, p in paths.items())
        path, out = paths[end], []
        while path is not None:
            out.append(path[2])
            path = path[1]
        return "".join(reversed(out)).strip()

    def token(self, token: str) -> str:
        """A lower-case token without its disguise."""
        # most tokens are plain words and need nothing but their signs cut off
        core = token.strip(EDGES)
        if not core.isalpha() or max(core) >= "\u0250":
            core = unicodedata.normalize("NFKC", token).lower().translate(HOMOGLYPHS).strip(EDGES)
        if core.isalpha() and not RUN3.search(core):
            return core
        if not any(c.isalpha() for c in core):
            return core
        return self.best(self._arcs(core))

    def spaced(self, run: str) -> str:
        """A run of single signs ("w o r d") as words: each gap joins letters or parts words."""
        signs = unicodedata.normalize("NFKC", run).lower().translate(HOMOGLYPHS).split()
        if sum(s.isalpha() for s in signs) < 2:
            return ""
        lattice: list[list[tuple[str, float]]] = []
        for s in signs:
            if lattice:
                lattice.append([("", 0.0), (" ", PARTED)])
            lattice += self._arcs(s)
        return self.best(lattice)

    def restore(self, text: str | None) -> str:
        """A text with its disguised tokens and spaced words restored (lower case, words parted
        by one space; null: empty)."""
        joined = SPACED.sub(lambda m: f" {self.spaced(m[0]) or m[0]} ", text or "")
        return " ".join(w for w in map(self.token, joined.lower().split()) if w)


def features(word: str) -> list[str]:
    """The word and its beginnings."""
    return [word + "$"] + [word[:k] for k in PREFIXES if len(word) > k]


def readings(word: str) -> list[str]:
    """A restored word, and if they differ the word without accents and also without doubled
    letters. Texts that labels are learnt from are read the same way, so that a doubled letter
    that belongs to a word and one that disguises it meet in the last reading."""
    plain = word
    if not word.isascii():
        plain = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
    return list(dict.fromkeys([word, plain, DOUBLED.sub(r"\1", plain)]))


def _token_features(decoder: Decoder, token: str) -> list[str]:
    return [f for w in decoder.token(token).split() for v in readings(w) for f in features(v)]


class Lexicon:
    """The toxic words that were learnt, for disguises that hide letters or cut a word up."""

    def __init__(self, shares: dict[str, float]):
        self.words = {f[:-1]: s for f, s in shares.items() if f.endswith("$") and len(f) > 1}
        self.begins = {w[:k] for w in self.words for k in range(1, len(w))}
        self.by_length: dict[int, list[str]] = {}
        for w in sorted(self.words):
            self.by_length.setdefault(len(w), []).append(w)

    def masked(self, token: str) -> float:
        """Share of a token whose masks stand for one letter each ("st**id"); at least two letters
        and half of the word must show."""
        core = unicodedata.normalize("NFKC", token).lower().translate(HOMOGLYPHS).strip(EDGES)
        hidden = sum(c in WILDCARDS for c in core)
        known = self.by_length.get(len(core), ())
        if not hidden or not known or sum(c.isalpha() for c in core) < 2 or 2 * hidden > len(core):
            return 0.0
        like = re.compile("".join("." if c in WILDCARDS else f"[{re.escape(c + LOOKALIKES.get(c, ''))}]" for c in core), re.S)
        return max((self.words[w] for w in known if like.fullmatch(w)), default=0.0)

    def parted(self, tokens: list[str]) -> set[str]:
        """Words that neighbouring tokens are pieces of ("stu pid", "s tup id")."""
        found: set[str] = set()
        tokens = [t if t.isalpha() else t.strip(EDGES) for t in tokens]
        if self.begins.isdisjoint(tokens):
            return found
        for i, t in enumerate(tokens):
            j = i + 1
            while t in self.begins and j < len(tokens):
                t += tokens[j]
                j += 1
                if t in self.words:
                    found.add(t)
        return found


def _has_spaced(pieces: list[str]) -> bool:
    """Whether three single signs follow each other."""
    return b"\1\1\1" in bytes([len(p) if len(p) < 3 else 3 for p in pieces])


class Scorer:
    """Score of a text: the chance that any of its restored words makes it toxic."""

    MAX_TOKENS = 1 << 19  # kept tokens (a bound on memory)

    def __init__(self, logp: np.ndarray, shares: dict[str, float]):
        self.decoder, self.shares, self.lexicon = Decoder(logp), shares, Lexicon(shares)
        self.clean: set[str] = set()
        self.toxic: dict[str, float] = {}
        self.begins: set[str] = set()  # tokens that a learnt word begins with
        self.heads = {f.removesuffix("$")[:2] for f in shares}
        self.foreign: dict[str, bool] = {}

    def _foreign(self, two: str) -> bool:
        """Whether no reading of a Latin word that begins with these two letters has a learnt feature: readings
        keep the first two different letters, but for accents."""
        known = self.foreign.get(two)
        if known is None:
            base = "".join(c for c in unicodedata.normalize("NFKD", two) if not unicodedata.combining(c))
            known = len(two) == 2 == len(base) and two[0] != two[1] and base[0] != base[1] and self.heads.isdisjoint((two, base))
            self.foreign[two] = known
        return known

    def _share(self, words: list[str]) -> float:
        get = self.shares.get
        return max((get(f, 0.0) for w in words for f in features(w)), default=0.0)

    def _token(self, token: str) -> float:
        """Share of a token that isn't known yet."""
        core = token.strip(EDGES)
        if core.isalpha() and (core.isascii() or max(core) < "\u0250") and self._foreign(core[:2]):
            found = 0.0
        elif core.isascii() and core.isalpha() and not RUN3.search(core):
            # a plain word stands for itself and has no mask
            found = self._share([core, DOUBLED.sub(r"\1", core)])
        else:
            found = self._share([v for w in self.decoder.token(token).split() for v in readings(w)])
            if not found and not token.isalpha():
                found = self.lexicon.masked(token)
        if len(self.clean) + len(self.toxic) >= self.MAX_TOKENS:
            for kept in (self.clean, self.toxic, self.begins):
                kept.clear()
        if found:
            self.toxic[token] = found
        else:
            self.clean.add(token)
        if (token if token.isalpha() else core) in self.lexicon.begins:
            self.begins.add(token)
        return found

    def _known(self, tokens: set[str]) -> dict[str, float]:
        """The shares of those tokens that have one."""
        return {t: share for t in tokens - self.clean if (share := self.toxic.get(t) or self._token(t))}

    def score(self, text: str | None) -> float:
        if not text:
            return 0.0
        pieces = text.lower().split()
        found = self._known(set(pieces))
        more: set[str] = set()
        # a sign may be longer in lower case: the text itself then tells
        if _has_spaced(pieces) or "\u0130" in text:
            for run in SPACED.findall(text):
                more.update(self.decoder.spaced(run).split())
        if not self.begins.isdisjoint(pieces):
            more |= self.lexicon.parted(pieces)
        found |= self._known(more)
        rest = 1.0
        for t in sorted(found):
            rest *= 1.0 - found[t]
        return 1.0 - rest


def _text_features(decoder: Decoder, text: str, words: dict[str, list[str]]) -> set[str]:
    """Features of a text's restored words; ``words`` keeps those of tokens seen before."""
    tokens = set(text.lower().split())
    for run in SPACED.findall(text):
        tokens.update(decoder.spaced(run).split())
    found: set[str] = set()
    for token in tokens:
        f = words.get(token)
        if f is None:
            if len(words) >= HELD_WORDS:
                words.clear()
            f = words[token] = _token_features(decoder, token)
        found.update(f)
    return found


def _feature_batches(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, words, seen = Decoder(model.value), {}, (Counter(), Counter())

        def rows():
            names = list(seen[0].keys() | seen[1].keys())
            out = pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([seen[1][f] for f in names], pa.int64()),
                 pa.array([seen[0][f] for f in names], pa.int64())], names=["feature", "toxic", "clean"])
            seen[0].clear()
            seen[1].clear()
            return out
        for b in batches:
            for t, label in zip(b.column(0), b.column(1)):
                seen[1 if label.as_py() else 0].update(_text_features(decoder, t.as_py() or "", words))
                if len(seen[0]) + len(seen[1]) > HELD_WORDS * 5:
                    yield rows()
        yield rows()
    return run


def _origin_batches(model, names):
    """For each toxic text its candidate features and MIN_HASHES least hashes of its word pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, words = Decoder(model.value), {}
        for b in batches:
            rows, least = [], []
            for t in b.column(0):
                text = t.as_py() or ""
                rows.append(sorted(_text_features(decoder, text, words) & names.value.keys()))
                tokens = text.lower().split()
                pairs = {f"{a} {b}".encode("utf-8", "surrogatepass") for a, b in zip(tokens, tokens[1:] or tokens)}
                least.append([min((zlib.crc32(p, k + 1) for p in pairs), default=0) for k in range(MIN_HASHES)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.list_(pa.string())), pa.array(least, pa.list_(pa.int64()))], names=["features", "least"])
    return run


def origins(texts: list[tuple[list[str], list[int]]]) -> dict[str, int]:
    """From how many different texts each feature comes, copies and near copies counted once.

    Copies of one toxic text make all its words look toxic. Near copies mostly agree in a least
    hash of their word pairs; a feature counts as many origins as its texts have different
    least hashes, by the hash that tells the fewest apart.
    """
    seen: dict[str, list[set[int]]] = {}
    for features_, least in texts:
        for f in features_:
            for s, h in zip(seen.setdefault(f, [set() for _ in least]), least):
                s.add(h)
    return {f: min(map(len, sets)) for f, sets in seen.items()}


def held_out(doc_id: str) -> Column:
    """Whether the labels of a row are kept for tests: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
        train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, dict[str, float]]:
    """(character model, feature -> share of toxic texts among those that have it).

    The character model counts all texts. The shares come from at most ``train_rows`` labelled
    texts (a bounded sample by hash of the id), never from held-out rows; null labels are left
    out. Candidates are features that LEAST_TOXIC toxic texts have and that are LEAST_SHARE toxic; Those with
    LEAST_TOXIC origins (copies of a text counted once) are kept.
    """
    spark = docs.sparkSession
    logp = character_model(character_counts(docs, text))
    model = spark.sparkContext.broadcast(logp)
    known = (labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).filter(~held_out(doc_id))
             .groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).alias("_label"))
             .orderBy(F.xxhash64("_id"), "_id").limit(train_rows))
    train = (docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
             .join(F.broadcast(known), "_id").select("_text", (F.col("_label") > 0).cast("int").alias("_label")))
    found = (train.mapInArrow(_feature_batches(model), "feature string, toxic bigint, clean bigint")
             .groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
             .filter((F.col("toxic") >= LEAST_TOXIC)
                     & (F.col("toxic") >= LEAST_SHARE * (F.col("toxic") + F.col("clean")))).collect())
    counts = {r.feature: (r.toxic, r.clean) for r in found}
    names = spark.sparkContext.broadcast(dict.fromkeys(counts))
    # rows of the bounded sample, with the few features that passed
    texts = (train.filter("_label = 1").select("_text")
             .mapInArrow(_origin_batches(model, names), "features array<string>, least array<bigint>").collect())
    chosen = sorted(f for f, n in origins([(r.features, r.least) for r in texts]).items() if n >= LEAST_TOXIC)
    return logp, {f: (counts[f][0] + 0.5) / (sum(counts[f]) + 1.0) for f in chosen}


def scorer(spark: SparkSession, logp: np.ndarray, shares: dict[str, float]):
    """A column function: text -> score in [0, 1]; null and empty texts score 0.

    A worker keeps its scorer, and with it the tokens it knows, from task to task.
    """
    model = spark.sparkContext.broadcast((logp, shares))
    name = f"scorer-{uuid.uuid4().hex}"

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = per_worker(name, lambda: Scorer(*model.value), "scorer-")
        for batch in texts:
            yield pd.Series([s.score(t) for t in batch], dtype="float64")
    return score
