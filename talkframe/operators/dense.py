"""Dense vector search: C2 (cos + 1), C4 (1 - cos, exact path), C3, D8, K2.

Exact search compares every query with every document, but never as rows. Two plans, one kernel:

* queries of a checked size travel to the documents as one matrix; each task multiplies it with its
  documents batch by batch and keeps a running top-k per query, so no document is moved;
* beyond that bound, or per partition key (feed, cell), queries and documents are cut into blocks of
  bounded size, the largest that a task can hold, and each (query block, document block) pair meets in one cogroup. A key
  holding a third of all documents is cut into as many blocks as it needs, a small key stays
  one block, and a query is replicated only to the blocks of its own key.

A product in singles is compared with each query's k-th best so far, less what singles can be wrong by; what
passes is scored again in doubles, so the hits are those of a product in doubles.

The global top-k per query is then a window over at most k rows per task or document block.
The approximate index is in ``ann``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import as_double
from .topk import SCORE_DIGITS, RunningTopK, top_k

# Rows scored at once: a 1024 x 4096 float64 score matrix is 32 MiB.
QUERY_BLOCK = 1024
DOC_BLOCK = 4096
# Rows and bytes of a block that travels to meet the blocks of the other side: every row is sent as often
# as the other side has blocks, so they are as large as a task can hold.
TRAVEL_ROWS = 65_536
TRAVEL_BYTES = 32 << 20
# Documents that give a block of queries its first k-th best scores.
FIRST_DOCS = 512
# Scores that a task holds at once.
SCORES_AT_ONCE = QUERY_BLOCK * DOC_BLOCK
# Keys (feeds, cells) whose block counts are broadcast: 3 longs a key, about 50 MiB at most.
MAX_BROADCAST_KEYS = 2_000_000
# Queries that travel to the documents: rows, and bytes of their vectors.
MAX_STREAMED_QUERIES = 100_000
MAX_STREAMED_BYTES = 64 << 20

METRICS = {
    # name: (score from cosine, ascending order)
    "cosine": (lambda c: c, False),
    "cos_plus_one": (lambda c: c + 1.0, False),    # script score of the search server
    "cos_distance": (lambda c: 1.0 - c, True),     # cosine space of the vector store
}


@dataclass(frozen=True)
class _Spec:
    fields: tuple          # vector column names (same names on both sides)
    boosts: tuple          # one weight per field
    metric: str
    k: int
    positive_only: bool
    exclude_self: bool


@dataclass
class _Side:
    """Rows of one side of a product: ids and one matrix of unit vectors per field."""

    ids: np.ndarray
    units: list
    single: np.ndarray | None = None

    @classmethod
    def of(cls, rows: pd.DataFrame, id_col: str, fields: tuple) -> "_Side":
        """Rows with a NULL vector, or one that holds NULL or NaN, are left out, and so are rows whose
        dimensions aren't those of the first sound one (callers group by dimensions)."""
        columns = [rows[f].tolist() for f in fields]
        dims = [tuple(len(v) for v in vs) if all(v is not None and not np.isnan(v).any() for v in vs) else None
                for vs in zip(*columns)]
        first = next((d for d in dims if d is not None), None)
        keep = [i for i, d in enumerate(dims) if d is not None and d == first]
        return cls(rows[id_col].to_numpy(dtype=object)[keep], [_unit([c[i] for i in keep]) for c in columns])

    def slice(self, at: int, n: int) -> "_Side":
        return _Side(self.ids[at:at + n], [u[at:at + n] for u in self.units],
                     None if self.single is None else self.single[at:at + n])

    def singles(self) -> np.ndarray:
        """All fields side by side in singles, made once."""
        if self.single is None:
            self.single = np.hstack(self.units).astype(np.float32)
        return self.single

    def dims(self) -> tuple:
        return tuple(u.shape[1] for u in self.units)


def _unit(rows: list) -> np.ndarray:
    if not rows:
        return np.zeros((0, 0))
    m = np.stack([np.asarray(r, dtype=np.float64) for r in rows])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.where(n > 0, m / np.where(n > 0, n, 1.0), 0.0)


def _better(spec: _Spec, q: _Side, d: _Side, best: RunningTopK) -> None:
    """Adds the documents ``d`` that may be among the k best of a query."""
    if not len(q.ids) or not len(d.ids) or spec.k <= 0 or q.dims() != d.dims():
        return
    cos = sum(b * (qu @ du.T) for qu, du, b in zip(q.units, d.units, spec.boosts))
    s = METRICS[spec.metric][0](cos)
    valid = s > 0 if spec.positive_only else np.ones(s.shape, dtype=bool)
    if spec.exclude_self:
        # ids as numbers once, not as strings for each pair
        codes = pd.factorize(np.concatenate([q.ids, d.ids]))[0]
        valid &= codes[:len(q.ids), None] != codes[None, len(q.ids):]
    key = np.where(valid, best.key(s), np.inf)
    # k-th best key per query, of these documents and of the hits so far, then every candidate at
    # least that good (ties included)
    k = min(spec.k, s.shape[1])
    cut = best.cut()
    if k == spec.k:
        cut = np.minimum(cut, np.partition(key, k - 1, axis=1)[:, k - 1])
    rows, cols = np.nonzero((key <= cut[:, None]) & valid)
    best.add(rows, d.ids[cols], s[rows, cols])


def _all_of(spec: _Spec, q: _Side, d: _Side, best: RunningTopK) -> RunningTopK:
    """Adds the documents ``d`` to the running top-k: all scores in doubles until each query has k hits, from
    then on only those that a product in singles doesn't rule out."""
    if not len(q.ids) or not len(d.ids) or spec.k <= 0 or q.dims() != d.dims():
        return best
    step = max(1, SCORES_AT_ONCE // len(q.ids))
    score, ascending = METRICS[spec.metric]
    asked = q.singles() * np.repeat(spec.boosts, q.dims()).astype(np.float32)
    # above the rounding errors of a sum of so many singles and of the rank by SCORE_DIGITS
    slack = 2.0 ** -23 * (asked.shape[1] + 8) * sum(map(abs, spec.boosts)) + 10.0 ** -SCORE_DIGITS
    docs, cut, at, first = d.singles(), best.cut(), 0, FIRST_DOCS
    pending, many = [], 0
    while at < len(d.ids):
        if np.isinf(cut).any():
            n = min(step, first)
            _better(spec, q, d.slice(at, n), best)
            cut, at, first = best.cut(), at + n, 2 * first
            continue
        least = (score(0.0) - cut if ascending else -cut - score(0.0)) - slack
        near = np.flatnonzero(asked @ docs[at:at + step].T >= least.astype(np.float32)[:, None])
        rows, cols = np.divmod(near, min(step, len(d.ids) - at))
        pending.append((rows, at + cols))
        at, many = at + step, many + len(rows)
        if many >= best.k * len(q.ids) or at >= len(d.ids):
            _rescored(spec, q, d, np.concatenate([r for r, _ in pending]), np.concatenate([c for _, c in pending]), best)
            cut, pending, many = best.cut(), [], 0
    return best


def _rescored(spec: _Spec, q: _Side, d: _Side, rows: np.ndarray, cols: np.ndarray, best: RunningTopK) -> None:
    """Adds the pairs (row of ``q``, row of ``d``) with their scores in doubles."""
    for at in range(0, len(rows), 1 << 16):
        r, c = rows[at:at + (1 << 16)], cols[at:at + (1 << 16)]
        s = METRICS[spec.metric][0](sum(b * np.einsum("ij,ij->i", qu[r], du[c]) for qu, du, b in zip(q.units, d.units, spec.boosts)))
        keep = best.key(s) <= best.cut()[r]
        if spec.positive_only:
            keep &= s > 0
        if spec.exclude_self:
            keep &= q.ids[r] != d.ids[c]
        best.add(r[keep], d.ids[c[keep]], s[keep])


def _nothing_yet(spec: _Spec, q: _Side) -> RunningTopK:
    return RunningTopK(len(q.ids), spec.k, METRICS[spec.metric][1])


HITS = "qid string, doc_id string, score double"


def _block_topk(spec: _Spec):
    def run(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        qs, ds = _Side.of(q, "qid", spec.fields), _Side.of(d, "doc_id", spec.fields)
        found = []
        for at in range(0, max(1, len(qs.ids)), QUERY_BLOCK):
            part = qs.slice(at, QUERY_BLOCK)
            found.append(_all_of(spec, part, ds, _nothing_yet(spec, part)).frame(part.ids))
        return pd.concat(found, ignore_index=True)
    return run


def travel_rows(width: int) -> int:
    """Rows of a travelling block of vectors with ``width`` numbers a row."""
    return max(QUERY_BLOCK, min(TRAVEL_ROWS, TRAVEL_BYTES // (8 * max(1, width))))


def _width(d: DataFrame, fields: list) -> int:
    """Numbers of a row, from the first few rows."""
    n = sum((F.greatest(F.size(f), F.lit(0)) for f in fields), F.lit(0))
    return d.select(n.alias("n")).limit(100).agg(F.max("n").alias("n")).first().n or 1


def _streamed_topk(spec: _Spec, shared):
    """Batches of documents -> the running top-k of each query over the whole task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sides = (_Side(ids, units) for ids, units in shared.value)
        parts = (q.slice(at, QUERY_BLOCK) for q in sides for at in range(0, len(q.ids), QUERY_BLOCK))
        groups = [(q, _nothing_yet(spec, q)) for q in parts]
        for rows in batches:
            for _, same in rows.groupby("_dims", sort=False):
                d = _Side.of(same, "doc_id", spec.fields)
                for q, best in groups:
                    _all_of(spec, q, d, best)
        for q, best in groups:
            if len(best.rows):
                yield best.frame(q.ids)
    return run


def _streamable(q: DataFrame, fields: list) -> bool:
    """Whether the queries are small enough to travel: rows first, bytes only if these are few."""
    if q.count() > MAX_STREAMED_QUERIES:
        return False
    size = sum((F.coalesce(F.sum(F.size(f).cast("bigint")), F.lit(0)) for f in fields), F.lit(0))
    return q.agg(size.alias("n")).first().n * 8 <= MAX_STREAMED_BYTES


def _as_numbers(rows: DataFrame, f: str) -> Column:
    """A vector as it travels: floats stay floats (they become doubles in the task), the rest are doubles."""
    return (F.col(f) if dict(rows.dtypes)[f] == "array<float>" else as_double(f)).alias(f)


def filter_mask(docs: DataFrame, filter_dict: dict | None) -> Column:
    """B1 for a dense index: AND of equality filters on the documents' own columns. Keys that are no
    column are ignored; a value whose type differs from the column's matches nothing."""
    from .sparse import type_matches
    cond = F.lit(True)
    for name, value in (filter_dict or {}).items():
        if name in docs.columns:
            same = type_matches(value, docs.schema[name].dataType)
            cond = cond & ((F.col(name) == F.lit(value)) if same else F.lit(False))
    return cond


def blocks(q: DataFrame, d: DataFrame, keys: list, query_block: int, doc_block: int):
    """Both sides grouped by (keys, query block, document block), ready for ``cogroup``.

    Blocks per key come from per-key row counts, taken before any vector is looked at. The counts are
    broadcast while the keys are under the bound, so that documents aren't shuffled for it;
    beyond it the join shuffles on many distinct keys and AQE splits a skewed one.
    """
    qsz = q.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / query_block).alias("_nq"))
    dsz = d.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / doc_block).alias("_nd"))
    sz = qsz.join(dsz, keys)
    if sz.count() <= MAX_BROADCAST_KEYS:
        sz = F.broadcast(sz)
    qb = (q.join(sz, keys)
           .withColumn("_qb", F.pmod(F.xxhash64("qid"), F.col("_nq")))
           .withColumn("_db", F.explode(F.sequence(F.lit(0), F.col("_nd") - 1)))
           .drop("_nq", "_nd"))
    db = (d.join(sz, keys)
           .withColumn("_db", F.pmod(F.xxhash64("doc_id"), F.col("_nd")))
           .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.col("_nq") - 1)))
           .drop("_nq", "_nd"))
    by = [*keys, "_qb", "_db"]
    return qb.groupBy(*by), db.groupBy(*by)


def blocked_search(queries: DataFrame, docs: DataFrame, fields: list, k: int,
                   metric: str = "cosine", boosts: list | None = None, key: str | None = None,
                   positive_only: bool = False, exclude_self: bool = False,
                   query_block: int | None = None, doc_block: int | None = None,
                   filter_dict: dict | None = None, stream: bool | None = None) -> DataFrame:
    """Exact top-k per query. ``queries``: (qid, fields..., [key]); ``docs``: (doc_id, ...).

    Vectors that are NULL or hold a NULL or NaN are left out (a query then has no hits), and
    only vectors of equal dimensions meet. ``filter_dict`` keeps the documents whose columns have
    these values (``filter_mask``). Without a ``key``, queries of a checked size travel to the documents;
    ``stream`` says so beforehand. Returns (qid, doc_id, score, rank); ids are strings.
    """
    spec = _Spec(tuple(fields), tuple(float(b) for b in (boosts or [1.0] * len(fields))), metric, k,
                 positive_only, exclude_self)
    _, ascending = METRICS[metric]
    kq = F.col(key) if key else F.lit(0)
    dims = F.concat_ws(",", *[F.coalesce(F.size(f), F.lit(-1)) for f in fields]).alias("_dims")
    docs = docs.where(filter_mask(docs, filter_dict))
    q = queries.select(F.col("qid").cast("string").alias("qid"), kq.alias("_key"),
                       *[_as_numbers(queries, f) for f in fields])
    d = docs.select(F.col("doc_id").cast("string").alias("doc_id"), kq.alias("_key"),
                    *[_as_numbers(docs, f) for f in fields])
    streamed = key is None and (stream if stream is not None else _streamable(q, fields))
    if not streamed and not (query_block and doc_block):
        rows = travel_rows(_width(d, fields))
        query_block, doc_block = query_block or rows, doc_block or rows
    if streamed:
        rows = q.select("qid", *fields, dims).toPandas()
        sides = [_Side.of(same, "qid", spec.fields) for _, same in rows.groupby("_dims", sort=False)]
        shared = q.sparkSession.sparkContext.broadcast([(s.ids, s.units) for s in sides if len(s.ids)])
        local = d.select("doc_id", *fields, dims).mapInPandas(_streamed_topk(spec, shared), HITS)
    elif key is None:
        # one global key: block counts are two numbers, used as literals (no join at all); they are
        # taken from the rows alone, so no vector is computed for them
        n_qb = max(1, math.ceil(queries.count() / query_block))
        n_db = max(1, math.ceil(docs.count() / doc_block))
        # long like pmod's: keys of unlike types are dealt to unlike partitions and never meet
        zero = F.lit(0).cast("bigint")
        qb = (q.withColumn("_qb", F.pmod(F.xxhash64("qid"), F.lit(n_qb)))
               .withColumn("_db", F.explode(F.sequence(zero, F.lit(n_db - 1).cast("bigint")))))
        db = (d.withColumn("_db", F.pmod(F.xxhash64("doc_id"), F.lit(n_db)))
               .withColumn("_qb", F.explode(F.sequence(zero, F.lit(n_qb - 1).cast("bigint")))))
        by = ["_qb", "_db", "_dims"]
        local = (qb.select("*", dims).groupBy(*by).cogroup(db.select("*", dims).groupBy(*by))
                 .applyInPandas(_block_topk(spec), HITS))
    else:
        qg, dg = blocks(q.select("*", dims), d.select("*", dims), ["_key", "_dims"], query_block, doc_block)
        local = qg.cogroup(dg).applyInPandas(_block_topk(spec), HITS)
    return top_k(local, ["qid"], "score", k, tie="doc_id", ascending=ascending)


def search(queries: DataFrame, docs: DataFrame, vector: str = "vector", k: int = 5,
           metric: str = "cos_plus_one", filter_dict: dict | None = None) -> DataFrame:
    """C2 / C4 exact path: one vector field, every document scored."""
    return blocked_search(queries, docs, [vector], k, metric, filter_dict=filter_dict)


def nearest_in_feed(queries: DataFrame, entries: DataFrame, feed_key: str,
                    vector: str = "vector", threshold: float = 0.95,
                    exclude_self: bool = False) -> DataFrame:
    """C3 + B3 + B9: best entry of the query's own feed, gated at ``threshold``.

    Ties on the rounded similarity go to the smaller entry id (feed position). Queries
    whose feed is empty get status Fail with a NULL match.
    Returns (qid, doc_id, cos_sim, status, status_message).
    """
    best = blocked_search(queries, entries, [vector], 1, "cosine", key=feed_key,
                          exclude_self=exclude_self)
    ok = F.col("cos_sim") >= threshold
    q = queries.select(F.col("qid").cast("string").alias("qid"))
    return (q.join(best.select("qid", "doc_id", F.col("score").alias("cos_sim")), "qid", "left")
             .withColumn("status", F.when(ok, F.lit("Success")).otherwise(F.lit("Fail")))
             .withColumn("status_message", F.when(
                 ok, F.concat(F.lit("Episode "), F.col("doc_id"), F.lit(" matched.")))
                 .otherwise(F.lit("Failed to download the podcast. Please try again."))))


def mean_pool(df: DataFrame, key: str, vector: str, out: str = "vector") -> DataFrame:
    """Element-wise mean of the vectors of each key (partial aggregation per dimension)."""
    e = df.select(key, F.posexplode(as_double(vector)).alias("dim", "x"))
    per_dim = e.groupBy(key, "dim").agg(F.avg("x").alias("x"))
    return (per_dim.groupBy(key)
                   .agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("_p"))
                   .select(key, F.transform("_p", lambda s: s["x"]).alias(out)))
