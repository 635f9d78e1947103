"""C4: an approximate index that says when it may stop. Cosine distance over quantised cells.

Vectors are cut to unit length and dealt to KMeans cells; what is left of a vector in its cell is
stored as one byte per group of dimensions (product code), with the exact length of the rest that the code
misses. Distances to codes come from a table per query and cell. By the triangle inequality the true
distance differs from the code's by that rest at most, so every coded row has a lower and an upper
bound, and so has every cell (distance to its centre minus its radius).

A search probes each query's ``nprobe`` nearest cells. A task that holds a block of queries and one of the
rows of a cell compares the k rows of the nearest codes exactly, then the rows whose lower bound is
below the k-th best distance so far; k rows per query leave it, however many were compared. The second
pass probes the cells whose lower bound is below the k-th distance found (``exact``; without it the search
ends after the first).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import as_double, cosine_of_many
from .dense import DOC_BLOCK, FIRST_DOCS, QUERY_BLOCK, blocks, travel_rows
from .sparse import join_payload
from .topk import SCORE_DIGITS, RunningTopK, top_k

# Rows that the centres and codes are fitted on, chosen by a hash of their id; all rows are indexed.
SAMPLE_ROWS = 65_536
# Cells at most: their centres travel to every task.
MAX_CELLS = 16_384
# Dimensions that share one byte of the code, and values of that byte.
CODE_DIMS = 4
CODE_VALUES = 256
ROUNDS = 10
# Scores are ranked rounded: bounds closer than this may change places.
MARGIN = 10.0 ** -SCORE_DIGITS
# Pairs are compared one by one where fewer than one in so many are left.
SPARSE = 16
# The cell of vectors of length 0, whose cosine with anything is 0.
ZERO_CELL = -1


@dataclass
class AnnModel:
    """What a fit learns: cell centres (cells x dims) and, per code byte, its values (values x dims)."""

    dims: int
    centers: np.ndarray
    codebooks: list

    def cuts(self) -> list:
        return [(at, min(at + CODE_DIMS, self.dims)) for at in range(0, self.dims, CODE_DIMS)]

    def nearest(self, units: np.ndarray) -> np.ndarray:
        return _nearest(units, self.centers)

    def encode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, code bytes, length of the rest) of unit vectors."""
        cell = self.nearest(units)
        rest = units - self.centers[cell]
        code = np.stack([_nearest(rest[:, a:b], book) for (a, b), book in zip(self.cuts(), self.codebooks)], axis=1)
        for j, ((a, b), book) in enumerate(zip(self.cuts(), self.codebooks)):
            rest[:, a:b] -= book[code[:, j]]
        return cell, code.astype(np.uint8), np.linalg.norm(rest, axis=1)

    def distances(self, units: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Distance of every unit vector to every code of one cell."""
        rest = units - self.centers[cell]
        return _gaps(rest, self.decode(codes))

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """What codes stand for, without their cell's centre."""
        return np.concatenate([book[codes[:, j]] for j, book in enumerate(self.codebooks)], axis=1)


@dataclass
class AnnIndex:
    """model, ``codes``: (doc_id, cell, code, err, same, unit), ``cells``: (cell, radius), ``vectors``: (doc_id, vector).

    ``same`` is a hash of the vector: rows of one code and one hash are copies. ``unit`` is the vector cut to
    length 1, beside its code so that a search compares it where it meets the code.
    """

    model: AnnModel
    codes: DataFrame
    cells: DataFrame
    vectors: DataFrame


def _gaps(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Distance of every row to every other."""
    square = (rows ** 2).sum(axis=1)[:, None] - 2 * rows @ others.T + (others ** 2).sum(axis=1)
    return np.sqrt(np.maximum(square, 0))


def _nearest(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), np.int64)
    step = max(1, (1 << 22) // max(1, len(centers)))
    for at in range(0, len(rows), step):
        out[at:at + step] = ((centers ** 2).sum(axis=1) - 2 * rows[at:at + step] @ centers.T).argmin(axis=1)
    return out


def _codebook(rows: np.ndarray, seed: int) -> np.ndarray:
    """Lloyd's rounds over one group of dimensions of the sample."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(rows, axis=0)
    book = distinct[rng.permutation(len(distinct))[:CODE_VALUES]].copy()
    for _ in range(ROUNDS):
        own = _nearest(rows, book)
        n = np.bincount(own, minlength=len(book))
        for j in range(rows.shape[1]):
            total = np.bincount(own, rows[:, j], minlength=len(book))
            book[:, j] = np.where(n > 0, total / np.maximum(n, 1), book[:, j])
    return book


def _unit_rows(docs: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, _u, _zero): unit vectors; NULL vectors and vectors with NULL or NaN are left out."""
    v = docs.select(F.col(id_col).cast("string").alias(id_col), as_double(vector).alias("_v"))
    v = v.where(F.col("_v").isNotNull() & ~F.exists("_v", lambda x: x.isNull() | F.isnan(x)))
    n = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    v = v.select("*", n.alias("_n"))
    return v.select(id_col, F.when(F.col("_n") > 0, F.transform("_v", lambda x: x / F.col("_n"))).otherwise(F.col("_v")).alias("_u"),
                    (F.col("_n") == 0).alias("_zero"))


def fit(docs: DataFrame, vector: str = "vector", n_cells: int | None = None, seed: int = 42,
        sample_rows: int = SAMPLE_ROWS) -> AnnIndex:
    """Build the index of (doc_id, vector); ids unique, one number of dimensions (the rest of the rows
    is left out, as are NULL vectors and vectors with NULL or NaN).

    Centres (Spark's KMeans) and codes (one task per code byte) are fitted on at most about
    ``sample_rows`` rows; every row is encoded. Without ``n_cells`` there are about
    sqrt(documents) cells, MAX_CELLS at most.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from ..session import cut_lineage
    spark = docs.sparkSession
    n = docs.count()
    rows = _unit_rows(docs, "doc_id", vector)
    size = rows.groupBy(F.size("_u").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dims = int(size.d) if size else 0
    rows = rows.where(F.size("_u") == dims)
    sample = rows.where(~F.col("_zero") & (F.pmod(F.xxhash64("doc_id"), F.lit(max(1, math.ceil(n / sample_rows)))) == 0))
    n_sample = sample.count()
    if not dims or not n_sample:
        model = AnnModel(dims, np.zeros((0, dims)), [])
    else:
        cells = min(n_cells or max(1, math.isqrt(n)), MAX_CELLS, n_sample)
        if cells == 1:
            mean = sample.select(F.posexplode("_u").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x")).orderBy("i")
            centers = np.array([[r.x for r in mean.collect()]])
        else:
            centers = np.stack(KMeans(k=cells, seed=seed, maxIter=ROUNDS, featuresCol="_f", predictionCol="_c").fit(
                sample.select(array_to_vector("_u").alias("_f"))).clusterCenters())
        model = AnnModel(dims, centers, [])
        model.codebooks = _codebooks(sample, model, seed)
    shared = spark.sparkContext.broadcast((model.dims, model.centers, model.codebooks))
    codes = cut_lineage(rows.select("doc_id", "_u", "_zero", F.xxhash64("_u").alias("same")).mapInPandas(
        _encoder(shared), "doc_id string, cell int, code binary, err double, same bigint, unit array<double>"))
    vectors = docs.select(F.col("doc_id").cast("string").alias("doc_id"), as_double(vector).alias("vector"))
    return AnnIndex(model, codes, cut_lineage(_radii(rows, shared)), vectors)


def _codebooks(sample: DataFrame, model: AnnModel, seed: int) -> list:
    """The values of each code byte, one task a byte; a group is as many rows as the sample has."""
    spark = sample.sparkSession
    shared = spark.sparkContext.broadcast(model.centers)
    cuts = model.cuts()

    def rests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            u = np.stack(b["_u"].to_list())
            rest = u - shared.value[_nearest(u, shared.value)]
            for j, (lo, hi) in enumerate(cuts):
                yield pd.DataFrame({"byte": j, "doc_id": b["doc_id"], "x": list(rest[:, lo:hi])})

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")          # the order of the shuffle doesn't matter
        book = _codebook(np.stack(rows["x"].to_list()), seed)
        return pd.DataFrame({"byte": rows["byte"].iloc[:1], "book": [book.ravel()]})
    books = (sample.select("doc_id", "_u").mapInPandas(rests, "byte int, doc_id string, x array<double>")
             .groupBy("byte").applyInPandas(learn, "byte int, book array<double>").orderBy("byte").collect())
    return [np.array(r.book).reshape(-1, hi - lo) for r, (lo, hi) in zip(books, cuts)]


def _encoder(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = AnnModel(*shared.value)
        for b in batches:
            zero = b["_zero"].to_numpy(bool) | (len(model.centers) == 0)
            cell, err = np.full(len(b), ZERO_CELL, np.int32), np.zeros(len(b))
            code = np.zeros((len(b), len(model.codebooks)), np.uint8)
            if not zero.all():
                cell[~zero], code[~zero], err[~zero] = model.encode(np.stack(b["_u"][~zero].to_list()))
            yield pd.DataFrame({"doc_id": b["doc_id"], "cell": cell, "code": [c.tobytes() for c in code], "err": err, "same": b["same"],
                                "unit": b["_u"]})
    return run


def _radii(rows: DataFrame, shared) -> DataFrame:
    """(cell, radius, n): the largest distance of a row of the cell to its centre. At most MAX_CELLS rows."""
    def far(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centers = shared.value[1]
        for b in batches:
            u = np.stack(b["_u"].to_list())
            cell = _nearest(u, centers)
            yield pd.DataFrame({"cell": cell.astype(np.int32), "radius": np.linalg.norm(u - centers[cell], axis=1)})
    if not len(shared.value[1]):
        return rows.sparkSession.createDataFrame([], "cell int, radius double, n bigint")
    each = rows.where(~F.col("_zero")).select("_u").mapInPandas(far, "cell int, radius double")
    return each.groupBy("cell").agg(F.max("radius").alias("radius"), F.count(F.lit(1)).alias("n"))


def _cell_bounds(shared, nprobe: int):
    """Unit vectors -> the cells in order of their centres' distance, with each cell's lower bound."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (dims, centers, _), cells, radius = shared.value
        for b in batches:
            u = np.stack(b["_u"].to_list())
            for at in range(0, len(u), QUERY_BLOCK):
                part = u[at:at + QUERY_BLOCK]
                square = (part ** 2).sum(axis=1)[:, None] - 2 * part @ centers[cells].T + (centers[cells] ** 2).sum(axis=1)
                gap = np.sqrt(np.maximum(square, 0))
                order = np.argsort(gap, axis=1, kind="stable")
                low = np.maximum(gap - radius - 1e-9, 0) ** 2 / 2
                near = [cells[o[:nprobe]] for o in order]
                rest = [cells[o[nprobe:]] for o in order]
                bound = [x[o[nprobe:]] for x, o in zip(low, order)]
                yield pd.DataFrame({"qid": b["qid"].iloc[at:at + QUERY_BLOCK], "_u": list(part), "near": near, "rest": rest, "bound": bound})
    return run


def _refined(shared, k: int):
    """One block of queries and one of coded rows of the same cell -> (qid, doc_id, score, read): the k nearest
    rows of each query, none of them farther than the query's ``most``. ``read`` on the first row of a query
    is the number of vectors that were compared with it."""
    def run(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"qid": pd.Series([], dtype=object), "doc_id": pd.Series([], dtype=object),
                               "score": pd.Series([], dtype=float), "read": pd.Series([], dtype=np.int64)})]
        if not len(q) or not len(d):
            return found[0]
        model = AnnModel(*shared.value)
        # of copies only the k smallest ids can be hits
        d = d.sort_values("doc_id")
        d = d[d.groupby(["same", "code", "err"]).cumcount() < k]
        ids, err = d["doc_id"].to_numpy(object), d["err"].to_numpy()
        codes = np.frombuffer(b"".join(d["code"]), np.uint8).reshape(len(d), -1)
        units, center = np.stack(d["unit"].to_list()), model.centers[int(d["cell"].iloc[0])]
        coded = model.decode(codes)
        most_coded = np.sqrt((coded ** 2).sum(axis=1).max())
        # |query - code|^2 <= (limit + err)^2 as one product, see ``allowed``
        sides = np.column_stack([coded, np.ones(len(d)), (err ** 2 - (coded ** 2).sum(axis=1)) / 2, err]).astype(np.float32)
        singles = units.astype(np.float32)
        for at in range(0, len(q), QUERY_BLOCK):
            part = q.iloc[at:at + QUERY_BLOCK]
            u, most = np.stack(part["_u"].to_list()), part["most"].to_numpy(float)
            rest, asked = u - center, u.astype(np.float32)
            length = (rest ** 2).sum(axis=1)
            best, read = RunningTopK(len(u), k, ascending=True), np.zeros(len(u), np.int64)

            def compare(chosen, lo):
                cols = np.flatnonzero(chosen.any(axis=0))
                if not len(cols):
                    return
                some = chosen[:, cols]
                score = 1.0 - u @ units[lo + cols].T
                key = np.where(some, best.key(score), np.inf)
                cut, n = best.cut(), min(k, len(cols))
                if n == k:
                    cut = np.minimum(cut, np.partition(key, n - 1, axis=1)[:, n - 1])
                r, c = np.nonzero(some & (key <= cut[:, None]))
                best.add(r, ids[lo + cols[c]], score[r, c])
                read[:] += some.sum(axis=1)
            def allowed(lo, hi, limit):
                """Pairs whose lower bound is within ``limit``, and those that the errors of singles may put there."""
                far = np.minimum(np.sqrt(2 * limit) + 1e-9, np.sqrt(length.max()) + most_coded)
                mine = np.column_stack([rest, (far ** 2 - length) / 2, np.ones(len(u)), far])
                size = np.sqrt(length.max()) * most_coded + np.abs(mine[:, -3]).max() + np.abs(sides[lo:hi, -2]).max() + far.max() * err[lo:hi].max()
                return mine.astype(np.float32) @ sides[lo:hi].T >= -np.float32(2.0 ** -23 * (mine.shape[1] + 8) * size)

            lo, step = 0, FIRST_DOCS
            while lo < len(d):
                hi = min(lo + step, len(d))
                cut = best.cut()
                limit = np.minimum(most, cut) + 2 * MARGIN
                if np.isinf(limit).any():
                    gap = _gaps(rest, coded[lo:hi])
                    low = np.maximum(gap - err[lo:hi] - 1e-9, 0) ** 2 / 2
                    first = np.zeros(gap.shape, bool)
                    n = min(k, gap.shape[1])
                    first[np.arange(len(u))[:, None], np.argpartition(gap, n - 1, axis=1)[:, :n]] = True
                    first &= low <= limit[:, None]
                    compare(first, lo)
                    compare((low <= np.minimum(most, best.cut())[:, None] + 2 * MARGIN) & ~first, lo)
                else:
                    near = allowed(lo, hi, limit)
                    n_near = near.sum(axis=1)
                    # of many, those that a product in singles doesn't rule out
                    if n_near.sum() * SPARSE > near.size:
                        near &= asked @ singles[lo:hi].T >= (1.0 - cut - 2 * MARGIN - 2.0 ** -23 * (u.shape[1] + 8)).astype(np.float32)[:, None]
                    pairs = np.flatnonzero(near)
                    if len(pairs) * SPARSE > near.size:
                        compare(near, lo)
                        read -= near.sum(axis=1)
                    else:
                        for some in range(0, len(pairs), 1 << 16):
                            r, c = np.divmod(pairs[some:some + (1 << 16)], hi - lo)
                            score = 1.0 - np.einsum("ij,ij->i", u[r], units[lo + c])
                            good = best.key(score) <= best.cut()[r]
                            best.add(r[good], ids[lo + c[good]], score[good])
                    read += n_near
                lo, step = hi, min(2 * step, DOC_BLOCK)
            out = best.frame(part["qid"].to_numpy(object))
            lead = np.r_[True, best.rows[1:] != best.rows[:-1]] if len(out) else np.zeros(0, bool)
            found.append(out.assign(read=np.where(lead, read[best.rows], 0)))
        return pd.concat(found, ignore_index=True)
    return run


FOUND = "qid string, doc_id string, score double, read bigint"


def _probe(probes: DataFrame, codes: DataFrame, shared, k: int, rows: int) -> DataFrame:
    """Nearest rows of (qid, _u, cell, most) among the coded rows of their cells."""
    qg, dg = blocks(probes, codes.select("doc_id", "cell", "code", "err", "same", "unit"), ["cell"], rows, rows)
    return qg.cogroup(dg).applyInPandas(_refined(shared, k), FOUND)


def _kth(found: DataFrame, k: int) -> DataFrame:
    """(qid, most): the k-th least distance; queries with fewer rows have none."""
    w = Window.partitionBy("qid").orderBy("score")
    ranked = found.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    return ranked.groupBy("qid").agg(F.max("score").alias("most"), F.count(F.lit(1)).alias("_n")).where(
        F.col("_n") == k).drop("_n")


def candidates(index: AnnIndex, queries: DataFrame, k: int, vector: str = "vector", nprobe: int = 4,
               exact: bool = True) -> DataFrame:
    """(qid, doc_id, read): each query's k nearest rows among those probed, the k best of all if ``exact``, and
    those that tie as vectors of length 0. ``read`` on a query's rows adds up to the number of rows whose
    vectors had to be read."""
    from ..session import cut_lineage
    spark = queries.sparkSession
    radii = {r.cell: r.radius for r in index.cells.collect()}          # at most MAX_CELLS rows
    shared = spark.sparkContext.broadcast((index.model.dims, index.model.centers, index.model.codebooks))
    q = _unit_rows(queries, "qid", vector).where(F.size("_u") == index.model.dims)
    rows = travel_rows(index.model.dims)
    out = []
    if radii:
        cells = np.array(sorted(radii), np.int32)
        bounds = spark.sparkContext.broadcast(((index.model.dims, index.model.centers, None), cells,
                                               np.array([radii[c] for c in cells])))
        inside = index.codes.where(F.col("cell") != ZERO_CELL)
        dealt = cut_lineage(q.where(~F.col("_zero")).select("qid", "_u").mapInPandas(
            _cell_bounds(bounds, nprobe), "qid string, _u array<double>, near array<int>, rest array<int>, bound array<double>"))
        first = dealt.select("qid", "_u", F.explode("near").alias("cell"), F.lit(math.inf).alias("most"))
        found = cut_lineage(_probe(first, inside, shared, k, rows))
        if exact:
            most = dealt.join(_kth(found, k), "qid", "left").withColumn("most", F.coalesce("most", F.lit(math.inf)))
            rest = (most.select("qid", "_u", "most", F.explode(F.arrays_zip("rest", "bound")).alias("c"))
                    .select("qid", "_u", "most", F.col("c.rest").alias("cell"), F.col("c.bound").alias("low"))
                    .where(F.col("low") <= F.col("most") + 2 * MARGIN).drop("low"))
            found = cut_lineage(found.unionByName(_probe(rest, inside, shared, k, rows)))
        read = F.when(F.col("rank") == 1, F.col("_read")).otherwise(F.lit(0))
        out.append(top_k(found.withColumn("_read", F.sum("read").over(Window.partitionBy("qid"))),
                         ["qid"], "score", k, tie="doc_id", ascending=True).select("qid", "doc_id", read.alias("read")))
    # a vector of length 0, as query or row, is at distance 1 from everything: the k smallest ids tie
    zero = _first_ids(index.codes.where(F.col("cell") == ZERO_CELL), k)
    anyone = _first_ids(index.codes, k)
    out.append(q.where(~F.col("_zero")).select("qid", F.explode(F.array(*map(F.lit, zero)).cast("array<string>")).alias("doc_id"), F.lit(1).cast("bigint").alias("read")))
    out.append(q.where("_zero").select("qid", F.explode(F.array(*map(F.lit, anyone)).cast("array<string>")).alias("doc_id"), F.lit(1).cast("bigint").alias("read")))
    both = out[0]
    for part in out[1:]:
        both = both.unionByName(part)
    return both


def _first_ids(rows: DataFrame, k: int) -> list:
    return [r.doc_id for r in rows.select("doc_id").orderBy("doc_id").limit(k).collect()]


def search(index: AnnIndex, queries: DataFrame, k: int = 5, vector: str = "vector", nprobe: int = 4,
           exact: bool = True) -> DataFrame:
    """Top-k by cosine distance: (qid, doc_id, score, rank). With ``exact`` the hits of the full search,
    else those of the ``nprobe`` nearest cells."""
    if k <= 0:
        return queries.sparkSession.createDataFrame([], "qid string, doc_id string, score double, rank bigint")
    read = candidates(index, queries, k, vector, nprobe, exact).drop("read")
    qv = queries.select(F.col("qid").cast("string").alias("qid"), as_double(vector).alias("_q"))
    met = join_payload(read, index.vectors).join(qv, "qid")
    scored = met.select("qid", "doc_id", (F.lit(1.0) - cosine_of_many("_q", "vector")).alias("score"))
    return top_k(scored, ["qid"], "score", k, tie="doc_id", ascending=True)
