"""Sparse (TF-IDF) index and search, set-at-a-time: D1 D2 C1 D3 B1 B2 B4 J5.

Definition (per text field; N counts every document, empty ones included)::

    tf(x,t)  = occurrences of t in x               (sublinear: 1 + ln tf)
    idf(t)   = ln((1+N)/(1+df(t))) + 1             (smooth_idf=False: ln(N/df) + 1)
    w(x,t)   = tf * idf, only for vocabulary terms (query words outside it vanish)
    cos(q,d) = sum_t w(q,t) w(d,t) / (|w(q)| |w(d)|)
    score    = sum_fields boost(field, default 1) * cos ; keep score > 0 ; top-k

Physical layout, chosen for a corpus far larger than one machine:

* term frequencies are computed where a text lies: the *forward* table has a row per document with its
  terms and counts; tokens are never exploded nor shuffled. ``df`` is summed per task first, so a
  term present in every document costs one row per task, not one per document;
* the forward rows carry the keyword fields (filters are plain predicates, no join) and the norms;
  ``postings`` is the same index with a row per (document, term);
* a search broadcasts the query terms (size checked; above the bound the queries are cut into
  blocks, each on its own) and streams the forward rows. Each task bounds the score of every
  (query, document) pair from a sketch of the document, completes the pairs whose bound
  reaches the query's k-th best score so far, and only its top-k per query is shuffled (``search``).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field as dc_field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import TOKEN_PATTERN, tokenize
from .topk import RunningTopK, top_k

# Upper bound of query-term rows broadcast in one block (about 100 bytes a row).
MAX_BROADCAST_QUERY_TERMS = 2_000_000
# A query term in more than this share of the documents is common: it goes into the sketch. All
# documents together have few of them: fewer than terms per document / share.
COMMON_SHARE = 1 / 32
# Slots of a sketch: the most frequent common terms have one each, the others share.
OWN_SLOTS, SHARED_SLOTS = 128, 64
# Terms in two or more documents, of all fields, whose weights travel to the tasks as (hash, code of the idf),
# 12 bytes each at most; beyond it postings meet their term's weight in a join.
MAX_BROADCAST_VOCABULARY = 8_000_000
# Terms in most documents whose idf is broadcast where postings meet their weights in a join: they make up
# nearly all postings, so that only those of rarer terms are shuffled.
FREQUENT_TERMS = 250_000
# Characters of text that a task counts at once.
COUNTED_CHARS = 4 << 20
# Numbers that a task holds at once in one matrix of (documents, queries) or (documents, terms).
CELLS_AT_ONCE = 1 << 21
# Scores are ranked rounded: a bound this close to the k-th best may still tie with it.
MARGIN = 2e-6

_PARAM_NAMES = {"lowercase", "token_pattern", "min_df", "max_df", "stop_words",
                "sublinear_tf", "smooth_idf", "use_idf"}


@dataclass(frozen=True)
class TfidfParams:
    """The vectoriser keyword arguments that are honoured; any other raises."""

    lowercase: bool = True
    token_pattern: str = TOKEN_PATTERN
    min_df: float = 1
    max_df: float = 1.0
    stop_words: tuple = ()
    sublinear_tf: bool = False
    smooth_idf: bool = True
    use_idf: bool = True

    @classmethod
    def of(cls, params: dict | None) -> "TfidfParams":
        params = dict(params or {})
        unknown = set(params) - _PARAM_NAMES
        if unknown:
            raise ValueError(f"unsupported vectorizer parameters: {sorted(unknown)}")
        sw = params.get("stop_words")
        if isinstance(sw, str):
            raise ValueError("stop_words must be a list of words")
        if sw is not None:
            params["stop_words"] = tuple(sw)
        else:
            params.pop("stop_words", None)
        return cls(**params)

    def doc_count_bound(self, value, n_docs: int) -> float:
        # An int is an absolute document count, a float a proportion of the corpus.
        if isinstance(value, float):
            return value * n_docs
        return value


@dataclass
class SparseIndex:
    """A fitted TF-IDF index: four DataFrames and the fitting parameters."""

    text_fields: list
    keyword_fields: list
    params: TfidfParams
    n_docs: int
    docs: DataFrame          # doc_id, text fields, keyword fields
    idf: DataFrame           # field, term, df, idf
    forward: DataFrame       # doc_id, keyword fields, per field i: runs_i (term, tf), norm_i
    keyword_types: dict = dc_field(default_factory=dict)
    stored_postings: DataFrame | None = None
    source: DataFrame | None = None    # the texts, while forward is computed on reading,
    forwarded: object = None           # and the function (carried columns) -> batches to forward batches
    vocabulary: object = None          # broadcast weights of the terms (``_vocabulary``), if they are few enough

    @property
    def postings(self) -> DataFrame:
        """Field, doc_id, term, tf, w, norm, wn, keyword fields."""
        if self.stored_postings is not None:
            return self.stored_postings
        if self.vocabulary is not None:
            return _posting_rows(self)
        return _postings(self.forward, self.idf, self.text_fields, self.keyword_fields, self.params)

    def materialize(self) -> "SparseIndex":
        """Write what is still computed on reading, so that many searches reuse one build."""
        from ..session import stored
        return SparseIndex(self.text_fields, self.keyword_fields, self.params, self.n_docs, self.docs, self.idf,
                           stored(self.forward, "forward"), self.keyword_types, vocabulary=self.vocabulary)


def _tokens(col: Column, p: TfidfParams) -> Column:
    toks = tokenize(col, p.token_pattern, p.lowercase)
    if p.stop_words:
        stop = F.array(*[F.lit(w) for w in p.stop_words])
        toks = F.filter(toks, lambda t: ~F.array_contains(stop, t))
    return toks


RUNS = "array<struct<term:string,tf:int>>"
# TOKEN_PATTERN in Python's words: letters, numbers and underscores.
FIND_TOKENS = re.compile(r"\w{2,}").findall
# Terms counted in a task before the counts go on to the shuffle.
COUNTED_TERMS = 250_000


def _source(df: DataFrame, fields: list, p: TfidfParams, keep: list) -> DataFrame:
    """(keep..., _s0, _s1, ...): what tokens are counted from. The default pattern is applied by the counting
    itself, any other (a Java expression) here by the JVM."""
    col = (lambda f: F.coalesce(F.col(f), F.lit(""))) if p.token_pattern == TOKEN_PATTERN else (lambda f: _tokens(F.col(f), p))
    return df.select(*keep, *[col(f).alias(f"_s{i}") for i, f in enumerate(fields)])


def _token_counter(p: TfidfParams):
    """Value of a source column -> Counter of its tokens."""
    if p.token_pattern != TOKEN_PATTERN:
        return Counter
    stop, lower = set(p.stop_words), p.lowercase

    def count(text: str) -> Counter:
        c = Counter(FIND_TOKENS(text.lower() if lower else text))
        for word in stop & c.keys():
            del c[word]
        return c
    return count


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch cut so that its parts hold about COUNTED_CHARS each."""
    step = max(1, batch.num_rows * COUNTED_CHARS // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def _counted(carried: list, n_fields: int, p: TfidfParams):
    """Source batches -> batches with (term, tf) of the distinct terms of each text."""
    count = _token_counter(p)

    def runs(values: pa.Array) -> pa.Array:
        terms, counts, ends = [], [], [0]
        for v in values:
            c = count(v.as_py())
            terms += c.keys()
            counts += c.values()
            ends.append(len(terms))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
            [pa.array(terms, pa.string()), pa.array(counts, pa.int32())], names=["term", "tf"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in _portions(whole)):
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(carried)], *[runs(c) for c in b.columns[len(carried):]]],
                names=[*carried, *[f"runs_{i}" for i in range(n_fields)]])
    return run


def _document_counts(n_fields: int, p: TfidfParams):
    """Source batches of the text columns alone -> (i, term, df): texts of the task that hold a term of field i."""
    count = _token_counter(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Counter() for _ in range(n_fields)]

        def out():
            for i, c in enumerate(found):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), i, np.int32)), pa.array(list(c), pa.string()),
                                                  pa.array(list(c.values()), pa.int64())], names=["i", "term", "df"])
                c.clear()
        for b in batches:
            for c, values in zip(found, b.columns):
                for v in values:
                    c.update(count(v.as_py()).keys())
                    if len(c) > COUNTED_TERMS:
                        yield from out()
        yield from out()
    return run


def _runs(source: DataFrame, keep: list, n_fields: int, p: TfidfParams) -> DataFrame:
    """(keep..., runs_i per field) of a source, its text columns last."""
    return source.mapInArrow(_counted(list(keep), n_fields, p), _schema(source, keep, n_fields))


def _schema(df: DataFrame, keep: list, n_fields: int, norms: bool = False) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"runs_{i} {RUNS}" for i in range(n_fields)]
                     + [f"norm_{i} double" for i in range(n_fields) if norms])


def _term_rows(runs: DataFrame, fields: list, keep: list) -> DataFrame:
    """(field, keep..., term, tf): a row per term of each text."""
    out = None
    for i, f in enumerate(fields):
        # explode_outer: an inner explode makes Catalyst infer size(<array>) > 0 and push that
        # filter down, inlining the whole array computation a second time
        part = runs.select(F.lit(f).alias("field"), *keep, F.explode_outer(f"runs_{i}").alias("_t")).where("_t is not null")
        part = part.select("field", *keep, F.col("_t.term").alias("term"), F.col("_t.tf").cast("double").alias("tf"))
        out = part if out is None else out.unionByName(part)
    return out


def _tf_weight(tf: Column, p: TfidfParams) -> Column:
    return (F.log(tf) + F.lit(1.0)) if p.sublinear_tf else tf


def document_key(id_col: str | list) -> Column:
    """The document key as a string. Several columns (episode, chunk) become one key that
    tells them apart whatever their values: a JSON array."""
    if isinstance(id_col, str):
        return F.col(id_col).cast("string")
    return F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in id_col]))


def fit(docs: DataFrame, text_fields: list, keyword_fields: list | None = None,
        id_col: str | list = "id", params: dict | TfidfParams | None = None,
        max_vocabulary: int = MAX_BROADCAST_VOCABULARY) -> SparseIndex:
    """D1 + D2 (A10): fit one vectoriser per text field over ``docs``. The counts are taken when fitting.

    Missing text or keyword values (strings) behave as '' (B4); ids become strings (B5). Chunk ids
    that repeat over episodes need both columns as ``id_col`` (``document_key``); rows that agree
    in the whole key are hits of their own but share one norm: quarantine them (``duplicate_keys``).
    """
    from ..session import stored
    p = params if isinstance(params, TfidfParams) else TfidfParams.of(params)
    keyword_fields = list(keyword_fields or [])
    cols = []
    for f in text_fields:
        src = F.col(f) if f in docs.columns else F.lit(None).cast("string")
        cols.append(F.coalesce(src.cast("string"), F.lit("")).alias(f))
    kw_types = {}
    for f in keyword_fields:
        if f in text_fields:           # already projected (as a string, missing -> '')
            kw_types[f] = T.StringType()
            continue
        if f in docs.columns:
            dtype = docs.schema[f].dataType
            cols.append(F.coalesce(F.col(f), F.lit("")).alias(f) if isinstance(dtype, T.StringType) else F.col(f))
        else:
            dtype = T.StringType()
            cols.append(F.lit("").alias(f))
        kw_types[f] = dtype
    base = docs.select(document_key(id_col).alias("doc_id"), *cols)

    carry = [c for c in base.columns if c in keyword_fields]   # filters are predicates on the forward rows
    keep, n_fields = ["doc_id", *carry], len(text_fields)
    source = _source(base, text_fields, p, keep)
    n_docs = base.count()   # one long to the driver; N includes empty documents
    counts = source.select(*[f"_s{i}" for i in range(n_fields)]).mapInArrow(
        _document_counts(n_fields, p), "i int, term string, df bigint")
    dfreq = counts.groupBy("i", "term").agg(F.sum("df").cast("bigint").alias("df"))
    lo = p.doc_count_bound(p.min_df, n_docs)
    hi = p.doc_count_bound(p.max_df, n_docs)
    n = F.lit(float(n_docs))
    if not p.use_idf:
        idf_val = F.lit(1.0)
    elif p.smooth_idf:
        idf_val = F.log((n + 1.0) / (F.col("df") + 1.0)) + 1.0
    else:
        idf_val = F.log(n / F.col("df")) + 1.0
    every = stored(dfreq.select("i", "term", "df", idf_val.alias("idf")), "idf")
    names = F.element_at(F.array(*[F.lit(f) for f in text_fields]), F.col("i") + 1)
    taken = (F.col("df") >= F.lit(lo)) & (F.col("df") <= F.lit(hi))
    idf = every.where(taken).select(names.alias("field"), "term", "df", "idf")

    # terms that travel; any other term is in one document, or in too few for the vocabulary
    hashed = F.xxhash64("term").alias("h")
    known = every.where((F.col("df") >= 2) & (F.col("df") >= F.lit(lo)))
    if known.count() <= max_vocabulary and every.groupBy("i", hashed).count().where("count > 1").isEmpty():
        once = every.where((F.col("df") == 1) & taken).select("idf").first()
        shared = _vocabulary(known.select("i", hashed, F.when(taken, F.col("idf")).alias("idf")), n_fields, once and once.idf)
        normed = _normed(shared, n_fields, p)

        def forwarded(carried: list):
            counted = _counted(carried, n_fields, p)
            return lambda batches: normed(counted(batches))
        forward = source.mapInArrow(forwarded(keep), _schema(source, keep, n_fields, True))
        return SparseIndex(list(text_fields), keyword_fields, p, n_docs, base, idf, forward, kw_types,
                           source=source, forwarded=forwarded, vocabulary=shared)
    # read three times; written first, so that the numbers of its rows stay
    runs = stored(_runs(source, keep, n_fields, p).withColumn("_row", F.monotonically_increasing_id()), "runs")
    # every posting meets its term's idf once; what comes back is a row per document
    w = _tf_weight(F.col("tf"), p) * F.col("idf")
    weighted = _with_idf(_term_rows(runs, text_fields, ["_row"]), idf).withColumn("_w2", w * w)
    norms = weighted.groupBy("_row").agg(*[
        F.sqrt(F.sum(F.when(F.col("field") == f, F.col("_w2")))).alias(f"norm_{i}") for i, f in enumerate(text_fields)])
    forward = runs.join(norms, "_row", "left").drop("_row")
    return SparseIndex(list(text_fields), keyword_fields, p, n_docs, base, idf, forward, kw_types)


def _with_idf(terms: DataFrame, idf: DataFrame) -> DataFrame:
    """``terms`` of the vocabulary with the idf of each: a broadcast has that of the FREQUENT_TERMS terms in most
    documents, the others' rows meet it in a shuffle."""
    weights = idf.select("field", "term", "idf")
    top = idf.select("df").orderBy(F.desc("df")).limit(FREQUENT_TERMS + 1).agg(F.count("*").alias("n"), F.min("df").alias("df")).first()
    if top.n <= FREQUENT_TERMS:
        return terms.join(F.broadcast(weights), ["field", "term"])
    frequent, rare = F.broadcast(idf.where(F.col("df") > top.df).select("field", "term", "idf")), idf.where(F.col("df") <= top.df).select("field", "term", "idf")
    others = terms.join(frequent, ["field", "term"], "left_anti")
    return terms.join(frequent, ["field", "term"]).unionByName(others.join(rare, ["field", "term"]))


def _vocabulary(known: DataFrame, n_fields: int, once: float | None):
    """Broadcast of each field's (hashes of terms in order, codes, idf by code) and ``once``, the idf of every other
    term (None: it isn't in the vocabulary). ``known``: (i, h, idf), a null idf is one left out; the caller has
    checked that they are few enough and that no hash is that of two terms."""
    found = known.toArrow().combine_chunks()
    out = []
    for i in range(n_fields):
        own = found.filter(pc.equal(found["i"], i))
        h = own["h"].to_numpy()
        idf, code = np.unique(own["idf"].to_numpy(), return_inverse=True)   # a null becomes NaN
        order = np.argsort(h)
        out.append((h[order], code[order].astype(np.min_scalar_type(len(idf))), idf))
    return known.sparkSession.sparkContext.broadcast((out, np.nan if once is None else once))


def _idf_of(terms: pa.Array, shared, i: int) -> np.ndarray:
    """The idf of each term of field i, NaN outside of the vocabulary."""
    fields, once = shared.value
    hashes, code, idf = fields[i]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(t, 42) for t in terms.to_pylist()), np.uint64, len(terms)).view(np.int64)
    if not len(hashes):
        return np.full(len(h), once)
    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    return np.where(hashes[at] == h, idf[code[at]], once)


def _weights(runs: pa.Array, shared, i: int, sublinear: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place among the flattened runs, row, weight) of the terms of the vocabulary."""
    flat = runs.flatten()
    idf = _idf_of(flat.field("term"), shared, i)
    here = np.flatnonzero(~np.isnan(idf))
    tf = flat.field("tf").to_numpy(zero_copy_only=False)[here].astype(float)
    return here, pc.list_parent_indices(runs).to_numpy()[here], (np.log(tf) + 1 if sublinear else tf) * idf[here]


def _normed(shared, n_fields: int, p: TfidfParams):
    """Forward rows without norms -> with the length of each text's weights (null without a term)."""
    sublinear = p.sublinear_tf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            norms = []
            for i in range(n_fields):
                _, row, w = _weights(b.column(f"runs_{i}"), shared, i, sublinear)
                square = np.bincount(row, w * w, minlength=b.num_rows)
                norms.append(pa.array(np.sqrt(square), mask=square == 0))
            yield pa.RecordBatch.from_arrays([*b.columns, *norms], names=[*b.schema.names, *[f"norm_{i}" for i in range(n_fields)]])
    return run


def _posting_rows(index: SparseIndex) -> DataFrame:
    """``_postings`` where the forward rows lie, by the broadcast weights."""
    fields, carry, shared = list(index.text_fields), list(dict.fromkeys(index.keyword_fields)), index.vocabulary
    sublinear = index.params.sublinear_tf
    own = [c for c in index.forward.columns if c == "doc_id" or c in carry]
    forwarded = index.forwarded(own) if index.forwarded else iter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in forwarded(batches):
            for i, f in enumerate(fields):
                runs = b.column(f"runs_{i}")
                at, row, w = _weights(runs, shared, i, sublinear)
                norm = b.column(f"norm_{i}").to_numpy(zero_copy_only=False)[row]
                flat, rows = runs.flatten().take(pa.array(at)), pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f] * len(at), pa.string()), b.column("doc_id").take(rows), flat.field("term"),
                     flat.field("tf").cast(pa.float64()), pa.array(w), pa.array(norm), pa.array(w / norm),
                     *[b.column(c).take(rows) for c in carry]],
                    names=["field", "doc_id", "term", "tf", "w", "norm", "wn", *carry])
    kinds = dict(index.forward.dtypes)
    schema = ", ".join(["field string", "doc_id string", "term string", "tf double", "w double", "norm double", "wn double",
                        *[f"`{c}` {kinds[c]}" for c in carry]])
    return (index.source if index.forwarded else index.forward).mapInArrow(run, schema)


def _postings(forward: DataFrame, idf: DataFrame, fields: list, keyword_fields: list, p: TfidfParams) -> DataFrame:
    """A row per (field, document, term) with its weight, the document's norm and the unit weight."""
    carry = list(dict.fromkeys(keyword_fields))
    terms = _term_rows(forward, fields, ["doc_id", *carry, *[f"norm_{i}" for i in range(len(fields))]])
    norm = F.coalesce(*[F.when(F.col("field") == f, F.col(f"norm_{i}")) for i, f in enumerate(fields)])
    return (_with_idf(terms, idf)
            .withColumn("w", _tf_weight(F.col("tf"), p) * F.col("idf")).withColumn("norm", norm)
            .withColumn("wn", F.col("w") / F.col("norm"))
            .select("field", "doc_id", "term", "tf", "w", "norm", "wn", *carry))


def duplicate_keys(docs: DataFrame, id_col: str | list = "id") -> DataFrame:
    """Quarantine check before ``fit``: (doc_id, rows) of the keys that more than one row has."""
    return (docs.groupBy(document_key(id_col).alias("doc_id")).agg(F.count("*").alias("rows"))
            .where(F.col("rows") > 1))


def type_matches(value, dtype: T.DataType) -> bool:
    if isinstance(value, bool):
        return isinstance(dtype, T.BooleanType)
    if isinstance(value, int):
        return isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    if isinstance(value, float):
        return isinstance(dtype, (T.FloatType, T.DoubleType))
    if isinstance(value, str):
        return isinstance(dtype, T.StringType)
    return False


def keyword_mask(index: SparseIndex, filter_dict: dict | None) -> Column:
    """B1: AND of equality filters on declared keyword fields; undeclared keys are ignored and
    a value whose type differs from the field's type matches nothing ('5' is not 5)."""
    cond = F.lit(True)
    for key, value in (filter_dict or {}).items():
        if key not in index.keyword_fields:
            continue
        if not type_matches(value, index.keyword_types[key]):
            return F.lit(False)
        col = F.col(key)
        cond = cond & (col == F.lit(value))
    return cond


def query_terms(index: SparseIndex, queries: DataFrame, qid_col: str = "qid",
                text_col: str = "query", boost: dict | None = None) -> DataFrame:
    """Vectorise queries with the fitted vocabulary: (qid, field, term, qwn, idf, df).

    ``qwn`` is the unit-normalised query weight times the field boost (unlisted field -> 1).
    """
    boost = boost or {}
    p = index.params
    q = queries.select(F.col(qid_col).alias("qid"), F.col(text_col).cast("string").alias("_q"))
    fields = index.text_fields
    q = q.select("qid", *[F.col("_q").alias(f) for f in fields])
    terms = _term_rows(_runs(_source(q, fields, p, ["qid"]), ["qid"], len(fields), p), fields, ["qid"])
    qw = (terms.join(index.idf.select("field", "term", "idf", "df"), ["field", "term"])
               .withColumn("qw", _tf_weight(F.col("tf"), p) * F.col("idf")))
    wq = Window.partitionBy("qid", "field")
    bcol = F.lit(1.0)
    for f, b in boost.items():
        bcol = F.when(F.col("field") == f, F.lit(float(b))).otherwise(bcol)
    return (qw.withColumn("qnorm", F.sqrt(F.sum(F.col("qw") * F.col("qw")).over(wq)))
              .select("qid", "field", "term", (F.col("qw") / F.col("qnorm") * bcol).alias("qwn"), "idf", "df"))


def query_term_bound(index: SparseIndex, queries: DataFrame, qid_col: str = "qid",
                     text_col: str = "query") -> int:
    """Upper bound of the vectorised query rows, from the queries alone (no index pass)."""
    q = queries.select(F.col(qid_col).alias("qid"), F.col(text_col).cast("string").alias("_q"))
    toks = q.select(F.size(F.array_distinct(_tokens(F.col("_q"), index.params))).alias("_n"))
    n = toks.agg(F.sum("_n")).first()[0] or 0
    return int(n) * len(index.text_fields)


def score(index: SparseIndex, qterms: DataFrame, filter_dict: dict | None = None,
          max_broadcast_rows: int = MAX_BROADCAST_QUERY_TERMS,
          n_rows: int | None = None) -> DataFrame:
    """(qid, doc_id, score) for every pair sharing a vocabulary term, filters applied first.

    Filtering before scoring equals masking after it: masked documents score 0 and are
    dropped, while N and df still come from the whole corpus.
    """
    postings = index.postings.where(keyword_mask(index, filter_dict)).select(
        "field", "term", "doc_id", "wn")
    if n_rows is None:
        n_rows = qterms.count()
    n_blocks = max(1, math.ceil(n_rows / max_broadcast_rows))
    if n_blocks == 1:
        blocks = [qterms]
    else:
        tagged = qterms.withColumn("_qb", F.pmod(F.xxhash64("qid"), F.lit(n_blocks)))
        blocks = [tagged.where(F.col("_qb") == i).drop("_qb") for i in range(n_blocks)]
    out = None
    for blk in blocks:
        part = (postings.join(F.broadcast(blk.select("qid", "field", "term", "qwn")), ["field", "term"])
                        .groupBy("qid", "doc_id")
                        .agg(F.sum(F.col("qwn") * F.col("wn")).alias("score")))
        out = part if out is None else out.unionByName(part)
    return out


@dataclass
class QueryBlock:
    """Vectorised queries as arrays: terms by falling document frequency, the first ``common`` of them common.

    ``entry_*`` hold (term, query, weight) by term; ``first`` cuts them into terms.
    """

    qids: np.ndarray
    fields: list                 # field of each term
    terms: list
    idf: np.ndarray
    common: int
    entry_query: np.ndarray
    entry_weight: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, rows: pd.DataFrame, n_docs: int) -> "QueryBlock":
        """``rows``: (qid, field, term, qwn, idf, df), one row per query and term."""
        rows = rows.sort_values(["df", "field", "term"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        number = rows.groupby(["field", "term"], sort=False).ngroup().to_numpy()
        heads = np.r_[0, np.nonzero(np.diff(number))[0] + 1] if len(rows) else np.zeros(0, np.int64)
        codes, qids = pd.factorize(rows["qid"])
        first = np.r_[heads, len(rows)]
        one = rows.iloc[heads]
        return cls(np.asarray(qids, dtype=object), one["field"].tolist(), one["term"].tolist(), one["idf"].to_numpy(float),
                   int((one["df"] > n_docs * COMMON_SHARE).sum()), codes, rows["qwn"].to_numpy(float), first)

    def slots(self) -> np.ndarray:
        """Slot of each common term: its own for the most frequent, then shared in turn."""
        i = np.arange(self.common)
        return np.where(i < OWN_SLOTS, i, OWN_SLOTS + (i - OWN_SLOTS) % SHARED_SLOTS)

    def common_weights(self) -> np.ndarray:
        """(queries, common terms): the queries' weights."""
        out = np.zeros((len(self.qids), self.common))
        n = self.first[self.common]
        term = np.repeat(np.arange(len(self.terms)), np.diff(self.first))[:n]
        out[self.entry_query[:n], term] = self.entry_weight[:n]
        return out


def _norms_by_slot(weights: np.ndarray, slots: np.ndarray, size: int) -> np.ndarray:
    """(rows, slots): the length of each row's part in each slot."""
    out = np.zeros((len(weights), size))
    own = min(len(slots), OWN_SLOTS)
    out[:, :own] = np.abs(weights[:, :own])
    for s in range(OWN_SLOTS, size):
        out[:, s] = np.linalg.norm(weights[:, slots == s], axis=1)
    return out


class BlockScorer:
    """Exact top-k of a block of queries over the forward rows that one task reads.

    A document's *sketch* has the weights of the most frequent common terms and, per shared slot, the
    length of what the other common terms weigh. By the inequality of Cauchy and Schwarz a
    query's score is at most the product of the two sketches plus what the rare terms, which
    few documents hold, add exactly. Pairs are completed in the order of their bounds as long as the
    bound reaches the query's k-th best score so far.
    """

    def __init__(self, block: QueryBlock, fields: list, sublinear: bool, k: int):
        self.block, self.k, self.sublinear = block, k, sublinear
        self.fields = fields
        self.lookup = [pa.array([t if own == f else None for own, t in zip(block.fields, block.terms)], pa.string()) for f in fields]
        self.slots = block.slots()
        self.size = int(self.slots.max()) + 1 if len(self.slots) else 0
        self.weights = block.common_weights()
        self.sketch = _norms_by_slot(self.weights, self.slots, self.size)
        self.best = RunningTopK(len(block.qids), k)
        self.pairs = self.completed = 0

    def _entries(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, query-vocabulary term, unit weight) of the batch's rows."""
        found = []
        for i in range(len(self.fields)):
            runs = batch.column(f"runs_{i}")
            flat = runs.flatten()
            at = pc.index_in(flat.field("term"), self.lookup[i], skip_nulls=True)
            here = pc.is_valid(at).to_numpy(zero_copy_only=False)
            doc = pc.list_parent_indices(runs).to_numpy()[here]
            term = at.drop_null().to_numpy()
            tf = flat.field("tf").to_numpy(zero_copy_only=False)[here].astype(float)
            w = (np.log(tf) + 1 if self.sublinear else tf) * self.block.idf[term]
            found.append((doc, term, w / batch.column(f"norm_{i}").to_numpy(zero_copy_only=False)[doc]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def add(self, batch: pa.RecordBatch) -> None:
        if not batch.num_rows or not len(self.block.qids):
            return
        doc, term, weight = self._entries(batch)
        order = np.argsort(doc, kind="stable")
        doc, term, weight = doc[order], term[order], weight[order]
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        step = max(1, CELLS_AT_ONCE // max(len(self.block.qids), self.block.common, 1))
        for at in range(0, batch.num_rows, step):
            lo, hi = np.searchsorted(doc, [at, at + step])
            self._part(ids[at:at + step], doc[lo:hi] - at, term[lo:hi], weight[lo:hi])

    def _part(self, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        b, n = self.block, len(ids)
        is_common = term < b.common
        common = np.zeros((n, b.common))
        common[doc[is_common], term[is_common]] = weight[is_common]
        # the rare terms: each entry meets the queries of its term
        rdoc, rterm, rweight = doc[~is_common], term[~is_common], weight[~is_common]
        many = b.first[rterm + 1] - b.first[rterm]
        entry = np.repeat(b.first[rterm] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
        cell = np.repeat(rdoc, many) * len(b.qids) + b.entry_query[entry]
        rare = np.bincount(cell, np.repeat(rweight, many) * b.entry_weight[entry], minlength=n * len(b.qids)).reshape(n, -1)
        bound = rare + _norms_by_slot(common, self.slots, self.size) @ self.sketch.T
        self.pairs += int((bound > 0).sum())
        # first the k best bounds of each query, then whatever still reaches the k-th best score
        done = np.zeros(bound.shape, bool)
        k = min(self.k, n)
        top = np.argpartition(-bound, k - 1, axis=0)[:k]
        done[top, np.arange(bound.shape[1])] = True
        done &= bound + MARGIN >= -self.best.cut()[None, :]
        done &= bound > 0
        self._complete(ids, common, rare, done)
        rest = (bound + MARGIN >= -self.best.cut()[None, :]) & (bound > 0) & ~done
        self._complete(ids, common, rare, rest)

    def _complete(self, ids: np.ndarray, common: np.ndarray, rare: np.ndarray, chosen: np.ndarray) -> None:
        rows, cols = np.nonzero(chosen)
        self.completed += len(rows)
        step = max(1, CELLS_AT_ONCE // max(1, self.block.common))
        score = np.concatenate([np.zeros(0)] + [
            np.einsum("ij,ij->i", common[rows[i:i + step]], self.weights[cols[i:i + step]]) for i in range(0, len(rows), step)])
        score += rare[rows, cols]
        keep = score > 0
        self.best.add(cols[keep], ids[rows[keep]], score[keep])


def _scorers(index: SparseIndex, shared, k: int):
    fields, sublinear = list(index.text_fields), index.params.sublinear_tf
    forwarded = index.forwarded(["doc_id"]) if index.forwarded else iter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[BlockScorer]:
        scorer = BlockScorer(QueryBlock(*shared.value), fields, sublinear, k)
        for b in forwarded(batches):
            scorer.add(b)
        yield scorer
    return run


def _scored_rows(index: SparseIndex, filter_dict: dict | None) -> DataFrame:
    """The rows that a search reads: forward rows, or texts that its tasks make forward rows of."""
    rows = index.source if index.forwarded else index.forward
    return rows.where(keyword_mask(index, filter_dict)).drop(*index.keyword_fields)


def _query_blocks(index: SparseIndex, queries: DataFrame, qid_col: str, text_col: str, boost: dict | None,
                  max_rows: int) -> Iterator:
    """The vectorised queries as broadcasts of at most about ``max_rows`` rows each."""
    qt = query_terms(index, queries, qid_col, text_col, boost)
    n = max(1, math.ceil(query_term_bound(index, queries, qid_col, text_col) / max_rows))
    for i in range(n):
        part = qt if n == 1 else qt.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == i)
        b = QueryBlock.of(part.toPandas(), index.n_docs)
        yield qt.sparkSession.sparkContext.broadcast(
            (b.qids, b.fields, b.terms, b.idf, b.common, b.entry_query, b.entry_weight, b.first))


def search(index: SparseIndex, queries: DataFrame, qid_col: str = "qid",
           text_col: str = "query", filter_dict: dict | None = None,
           boost_dict: dict | None = None, num_results: int = 10,
           max_broadcast_rows: int = MAX_BROADCAST_QUERY_TERMS) -> DataFrame:
    """C1 (+ B1, B2, D3, E1): top ``num_results`` documents per query, positive scores only.

    Returns (qid, doc_id, score, rank). Exact: a pair is left out only if its bound is below the
    query's k-th best score (``BlockScorer``; ``search_work`` counts the pairs). The terms of a block of
    queries are collected and broadcast, at most ``max_broadcast_rows`` rows at once.
    """
    kind = queries.select(F.col(qid_col).alias("qid")).schema[0].dataType.simpleString()
    schema = f"qid {kind}, doc_id string, score double"
    if num_results <= 0:
        return top_k(queries.sparkSession.createDataFrame([], schema), ["qid"], "score", 0, tie="doc_id")
    rows = _scored_rows(index, filter_dict)
    arrow = None
    out = None
    for shared in _query_blocks(index, queries, qid_col, text_col, boost_dict, max_broadcast_rows):
        scored = _scorers(index, shared, num_results)

        def hits(batches, scored=scored):
            for s in scored(batches):
                found = s.best.frame(s.block.qids)
                yield pa.RecordBatch.from_pandas(found, schema=arrow, preserve_index=False)
        arrow = pa.schema([("qid", _arrow_type(kind)), ("doc_id", pa.string()), ("score", pa.float64())])
        part = rows.mapInArrow(hits, schema)
        out = part if out is None else out.unionByName(part)
    return top_k(out, ["qid"], "score", num_results, tie="doc_id")


def _arrow_type(kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(T._parse_datatype_string(kind))


def search_work(index: SparseIndex, queries: DataFrame, qid_col: str = "qid", text_col: str = "query",
                boost_dict: dict | None = None, num_results: int = 10,
                max_broadcast_rows: int = MAX_BROADCAST_QUERY_TERMS) -> DataFrame:
    """(pairs, completed): pairs of a query and a document that share a term, and those whose score a
    search completes, over all tasks."""
    rows = _scored_rows(index, None)
    out = None
    for shared in _query_blocks(index, queries, qid_col, text_col, boost_dict, max_broadcast_rows):
        scored = _scorers(index, shared, num_results)

        def work(batches, scored=scored):
            for s in scored(batches):
                yield pa.RecordBatch.from_pydict({"pairs": [s.pairs], "completed": [s.completed]})
        part = rows.mapInArrow(work, "pairs bigint, completed bigint")
        out = part if out is None else out.unionByName(part)
    return out.agg(F.sum("pairs").alias("pairs"), F.sum("completed").alias("completed"))


# Hits broadcast in one block (about 100 bytes a row).
MAX_BROADCAST_HITS = 1_000_000


def join_payload(hits: DataFrame, docs: DataFrame, max_rows: int | None = None, key: str = "doc_id",
                 block_rows: int = MAX_BROADCAST_HITS) -> DataFrame:
    """``hits`` with the columns of their documents, without moving the documents.

    ``max_rows`` is a proven bound of the hits (k times the questions); without one they are
    checkpointed and counted. Hits up to ``block_rows`` are broadcast and the documents
    streamed past them; more are cut into blocks by key, each broadcast on its own. Every hit
    id is an id of ``docs``, so this inner join keeps all hits.
    """
    if max_rows is None:
        from ..session import cut_lineage
        hits = cut_lineage(hits)
        max_rows = hits.count()
    n = max(1, math.ceil(max_rows / block_rows))
    cols = [*hits.columns, *[c for c in docs.columns if c != key]]
    out = None
    for i in range(n):
        part = hits if n == 1 else hits.where(F.pmod(F.xxhash64(key), F.lit(n)) == i)
        part = docs.join(F.broadcast(part), key).select(*cols)
        out = part if out is None else out.unionByName(part)
    return out


def attach_text(hits: DataFrame, index: SparseIndex, text_field: str = "text",
                max_rows: int | None = None) -> DataFrame:
    """Join the payload after top-k (late materialisation; the hit side is k per query)."""
    return join_payload(hits, index.docs.select("doc_id", text_field), max_rows)
