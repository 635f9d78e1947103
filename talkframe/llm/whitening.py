"""Embedding whitening with MLlib's BlockMatrix.

The vectors are written once as blocks of rows, numbered without a shuffle: a task cuts its rows
into blocks, and the last block of a task is filled with rows of zeros, which add nothing to
any product. Centred, the blocks are a BlockMatrix A. Its scatter A' A is a BlockMatrix product cut into as many
pieces along the rows as there are tasks; the eigenvectors of the small result are found on the
driver; A times the whitening matrix projects the rows. An identity block beside the whitening matrix
carries each row's id and deviation through that product, so no join has to find them again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, written

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
# a block of rows holds this many values, more where there would be over MANY_BLOCKS blocks: their
# coordinates are what a BlockMatrix product plans with on the driver
BLOCK_VALUES, MOST_VALUES, MANY_BLOCKS = 1 << 16, 1 << 20, 4096
# columns of a square block of the scatter
BLOCK_COLUMNS = 512
# an eigenvalue below this share of the largest is rounding: its component doesn't exist
RANK_TOLERANCE = 1e-13
# columns that carry a row's own values through the projection
CARRIED = ("held", "id_high", "id_low", "dev_high", "dev_low")
LOW = 1 << 32
# vectors summed as longs at once: entries below 2**53 stay below 2**63
SUMMED = 1 << 10
MOST = np.iinfo(np.int64).max


def whole(vector) -> np.ndarray | None:
    """The vector's entries as longs, or None if it is null or holds null or non-finite entries."""
    if not vector.is_valid:
        return None
    c = np.array(vector.values.to_numpy(zero_copy_only=False), np.float64)  # nulls become NaN
    if not len(c) or not np.isfinite(c).all():
        return None
    x = np.floor(SCALE * c) + SHIFT
    if np.abs(x).max() >= 1 << 53:
        raise ValueError(f"an entry beyond 2**53 / {SCALE} has no exact whole number")
    return x.astype(np.int64)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("d", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))])
    for b in batches:
        by_length: dict[int, list] = {}
        for v in b.column(0):
            if (x := whole(v)) is not None:
                by_length.setdefault(len(x), []).append(x)
        parts = [(d, g[at:at + SUMMED]) for d, g in by_length.items() for at in range(0, len(g), SUMMED)]
        yield pa.RecordBatch.from_pydict(
            {"d": [d for d, _ in parts], "n": [len(g) for _, g in parts], "s": [np.sum(g, axis=0) for _, g in parts]}, schema=schema)


def fit_list(vectors: DataFrame, vector: str) -> tuple[int, list[int]]:
    """(rows, sum of each dimension) of the vectors of the most frequent length (ties: the longer)."""
    part = vectors.select(F.col(vector).alias("v")).mapInArrow(_sums, "d int, n long, s array<long>")
    part = written(part, "vector-sums")
    d = part.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if d is None:
        return 0, []
    sums = (part.filter(F.col("d") == d.d).select(F.posexplode("s").alias("i", "x")).groupBy("i")
            .agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).orderBy("i").collect())
    return d.n, [int(r.x) for r in sums]


def _blocks(d: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task, number = TaskContext.get().partitionId(), 0
        ids: list = []
        xs: list[np.ndarray] = []

        def out():
            nonlocal number
            number += 1
            x = pa.array([np.stack(xs, axis=1).astype("<i8").tobytes()], pa.binary())
            b = pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([number - 1], pa.int32()), pa.array([ids]), x],
                                           names=["task", "number", "ids", "x"])
            ids.clear()
            xs.clear()
            return b
        for b in batches:
            for vec_id, v in zip(b.column(0), b.column(1)):
                if (x := whole(v)) is not None and len(x) == d:
                    ids.append(vec_id.as_py())
                    xs.append(x)
                    if len(ids) == rows:
                        yield out()
        if ids:
            yield out()
    return run


def row_blocks(vectors: DataFrame, vec_id: str, vector: str, d: int, rows: int) -> tuple[DataFrame, int]:
    """(block, ids, x) with x the block's whole numbers, column by column, as bytes; and the number of blocks.

    Block numbers are the task's first one plus its own count: one row a task goes to the driver.
    """
    raw = written(vectors.select(F.col(vec_id).cast("long").alias("i"), F.col(vector).alias("v"))
                  .mapInArrow(_blocks(d, rows), "task int, number int, ids array<long>, x binary"), "vector-blocks")
    first, at = {}, 0
    for task, n in sorted((r.task, r.n) for r in raw.groupBy("task").agg(F.count("*").alias("n")).collect()):
        first[task], at = at, at + n
    starts = raw.sparkSession.createDataFrame(list(first.items()), "task int, first int")
    return raw.join(F.broadcast(starts), "task").select((F.col("first") + F.col("number")).alias("block"), "ids", "x"), at


def carried(ids: list, deviation: np.ndarray) -> np.ndarray:
    """One row per vector: whether a row is there (2: its id is null), then id and deviation in halves
    of 32 bits, each exact as a double."""
    held = np.array([2.0 if i is None else 1.0 for i in ids])
    whole_ids = np.array([0 if i is None else i for i in ids], np.int64)
    return np.stack([held, *[half.astype(np.float64) for v in (whole_ids, deviation) for half in (v >> 32, v & (LOW - 1))]], axis=1)


def deviations(moved: np.ndarray) -> np.ndarray:
    """Sum of squares of each row, exact; -1 where it is beyond the range of a long."""
    top = int(np.abs(moved).max(initial=0))
    if top * top * moved.shape[1] <= MOST:
        return (moved * moved).sum(axis=1)
    exact = (moved.astype(object) ** 2).sum(axis=1)
    return np.array([v if v <= MOST else -1 for v in exact], np.int64)


def centred(ids, x: bytes, n: int, sums: list[int], with_carried: bool, rows: int) -> np.ndarray:
    """The block's rows x - S/n, filled with zeros to ``rows``. n*x - S is exact before the division."""
    x = np.frombuffer(x, "<i8").reshape(len(sums), -1).T
    bound = n * max(int(np.abs(x).max()), 1)
    kind = np.int64 if 2 * max(bound, max(map(abs, sums))) <= MOST else object
    moved = x.astype(kind) * n - np.array(sums, kind)
    a = (moved / n).astype(np.float64)
    if with_carried:
        dev = deviations(moved)
        a = np.hstack([a, carried(ids, dev)])
    return np.vstack([a, np.zeros((rows - len(a), a.shape[1]))])


def block_matrix(blocks: DataFrame, count: int, n: int, sums: list[int], rows: int, width: int, with_carried: bool) -> BlockMatrix:
    """The centred rows as a BlockMatrix with blocks of ``rows`` x ``width``."""
    columns = len(sums) + (len(CARRIED) if with_carried else 0)

    def cut(r):
        a = centred(r.ids, r.x, n, sums, with_carried, rows)
        return [((r.block, j), DenseMatrix(rows, min(width, columns - at), a[:, at:at + width].ravel(order="F")))
                for j, at in enumerate(range(0, columns, width))]
    return BlockMatrix(blocks.rdd.flatMap(cut), rows, width, count * rows, columns)


def multiply(a: BlockMatrix, b: BlockMatrix, cuts: int) -> BlockMatrix:
    """a * b with the dimension that both share cut into ``cuts`` pieces, which meet in a task each."""
    wrapper = a._java_matrix_wrapper  # BlockMatrix.multiply hands no number of pieces on
    return BlockMatrix(wrapper.call("multiply", b._java_matrix_wrapper._java_model, cuts), a.rowsPerBlock, b.colsPerBlock)


def local(m: BlockMatrix) -> np.ndarray:
    """A small BlockMatrix as an array."""
    return m.toLocalMatrix().toArray()


def components_of(scatter: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors in columns, explained) by falling eigenvalue, as many as have rank."""
    v = (scatter + scatter.T) / (2 * n)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(most, int((e > RANK_TOLERANCE * max(e[0], 0)).sum())) if len(e) else 0
    u = u[:, :k]
    u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    return e[:k], u, e[:k] / np.trace(v)


def refined(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, factors of the eigenvalues) that the whitened rows and the eigenvalues still need.

    An eigenvalue far below the largest is known from the scatter to that one's rounding only. The whitened
    rows are well scaled, so their covariance shows what is left: taking each component's share of the
    stronger ones out (Cholesky) mends vectors and eigenvalues to first order.
    """
    low = np.linalg.cholesky((cov + cov.T) / 2)
    return np.linalg.inv(low).T, np.diag(low) ** 2


def _gram(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for b in batches:
            for z in b.column(1):
                z = np.frombuffer(z.as_py(), "<f8").reshape(-1, k)
                total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], names=["i", "g"])
    return run


def _rows(k: int, turn: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, z in zip(b.column(0), b.column(1)):
                z = (np.frombuffer(z.as_py(), "<f8").reshape(-1, k) @ turn).ravel()
                own = np.frombuffer(own.as_py(), "<i8").reshape(-1, 3)
                each = [pa.array(np.repeat(own[:, j], k), mask=np.repeat(bad, k))
                        for j, bad in ((1, own[:, 0] == 2), (2, own[:, 2] < 0))]
                component = np.tile(np.arange(1, k + 1, dtype=np.int32), len(own))
                yield pa.RecordBatch.from_arrays([each[0], pa.array(component), each[1], pa.array(z)],
                                                 names=["vec_id", "component", "deviation", "whitened"])
    return run


EMPTY = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, vec_id: str, vector: str, most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): one row per vector and component.

    Null vectors and vectors with null or non-finite entries, or without entries, are left out; so are those
    whose length is not the most frequent one. A null id stays null; repeated rows count and come
    out as often as they are there; other columns are ignored. Components end where the
    rank ends, so equal vectors alone give no rows, as does an empty table. A deviation
    beyond the range of a long is null. The driver holds d x d numbers, no rows.
    """
    spark = vectors.sparkSession
    n, sums = fit_list(vectors, vector)
    if not n:
        return spark.createDataFrame([], EMPTY)
    d = len(sums)
    rows = max(16, min(MOST_VALUES // d, max(BLOCK_VALUES // d, n // MANY_BLOCKS)))
    blocks, count = row_blocks(vectors, vec_id, vector, d, rows)
    cuts = max(1, min(count, partitions(spark)))
    a = block_matrix(blocks, count, n, sums, rows, min(d, BLOCK_COLUMNS), False)
    scatter = local(multiply(a.transpose(), a, cuts))
    e, u, explained = components_of(scatter, n, most)
    k = len(e)
    if not k:
        return spark.createDataFrame([], EMPTY)
    z = written(_projected(spark, blocks, count, n, sums, rows, u / np.sqrt(e)), "whitened")
    gram = z.mapInArrow(_gram(k), "i long, g double").groupBy("i").agg(F.sum("g").alias("g")).collect()
    cov = np.zeros(k * k)
    for r in gram:
        cov[r.i] = r.g / n
    turn, scale = refined(cov.reshape(k, k))
    error = float(np.abs(turn.T @ cov.reshape(k, k) @ turn - np.eye(k)).max())
    share = F.element_at(F.array(*[F.lit(float(x)) for x in explained * scale]), F.col("component"))
    return z.mapInArrow(_rows(k, turn), "vec_id long, component int, deviation long, whitened double").select(
        "vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        share.alias("explained"), F.lit(error).alias("identity_error"))


def _projected(spark: SparkSession, blocks: DataFrame, count: int, n: int, sums: list[int], rows: int, w: np.ndarray) -> DataFrame:
    """(own, z): each block's (held, id, deviation) and whitened rows, as bytes."""
    d, k = w.shape
    side = np.zeros((d + len(CARRIED), k + len(CARRIED)))
    side[:d, :k] = w
    side[d:, k:] = np.eye(len(CARRIED))
    a = block_matrix(blocks, count, n, sums, rows, d + len(CARRIED), True)
    wide = BlockMatrix(spark.sparkContext.parallelize([((0, 0), DenseMatrix(*side.shape, side.ravel(order="F")))], 1), *side.shape)

    def unpack(block):
        both = block[1].toArray()
        held, ih, il, dh, dl = both[:, k:].astype(np.int64).T
        there = held > 0
        own = np.stack([held, (ih << 32) + il, (dh << 32) + dl], axis=1)[there]
        return bytearray(own.astype("<i8").tobytes()), bytearray(both[there, :k].astype("<f8").tobytes())
    return spark.createDataFrame(multiply(a, wide, 1).blocks.map(unpack), "own binary, z binary")
