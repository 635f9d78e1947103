"""Index storage as Parquet directories.

Layout under an index root: ``docs/``, ``idf/``, ``forward/``, ``postings/`` (sparse), ``vectors/batch_id=*/``
and ``rejects/batch_id=*/`` (dense; batch and streaming writes alike), ``versions/batch_id=*/`` (upserts), ``model/``, ``cells/``, ``codes/`` and
``ann_vectors/`` (approximate). Creating an index replaces the directories (drop-then-create).
Postings are written bucketed by ``doc_id`` so a search scans them without shuffling.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import uuid

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import validity_reason
from ..operators.ann import AnnIndex, AnnModel
from ..operators.sparse import SparseIndex, TfidfParams

EMPTY_VECTORS = "doc_id string, text string, vector array<float>"


def _table_name(root: str, version: str) -> str:
    return "talkframe_postings_" + hashlib.sha1(f"{root} {version}".encode()).hexdigest()[:16]


def save_sparse(index: SparseIndex, root: str, buckets: int | None = None) -> None:
    """A7 + A10: write (replace) a fitted TF-IDF index.

    Searches read the forward rows. Postings are bucketed by doc_id, so ``sparse.score`` over the loaded
    index sums per (query, doc) inside each bucket without a shuffle.
    """
    spark = index.docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    index.docs.write.mode("overwrite").parquet(f"{root}/docs")
    index.idf.write.mode("overwrite").parquet(f"{root}/idf")
    index.forward.write.mode("overwrite").parquet(f"{root}/forward")
    version = uuid.uuid4().hex
    (index.postings.write.mode("overwrite").bucketBy(buckets, "doc_id").sortBy("doc_id")
          .option("path", f"{root}/postings").saveAsTable(_table_name(root, version)))
    meta = spark.createDataFrame(
        [(index.n_docs, list(index.text_fields), list(index.keyword_fields), buckets, version,
          json.dumps(dataclasses.asdict(index.params)))],
        "n_docs bigint, text_fields array<string>, keyword_fields array<string>, buckets int, "
        "version string, params string")
    meta.write.mode("overwrite").parquet(f"{root}/meta")


def load_sparse(spark: SparkSession, root: str, params: dict | None = None) -> SparseIndex:
    """Open a saved TF-IDF index with the parameters it was fitted with.

    ``params`` may repeat them; others are refused, as the stored weights would not fit. Each
    save has its own table name, so an index that another session rewrote is read as it is now.
    """
    meta = spark.read.parquet(f"{root}/meta").first()
    docs = spark.read.parquet(f"{root}/docs")
    stored = json.loads(meta["params"])
    fitted = TfidfParams.of({**stored, "stop_words": list(stored["stop_words"])})
    if params is not None and TfidfParams.of({**stored, "stop_words": list(stored["stop_words"]), **params}) != fitted:
        raise ValueError(f"the index was fitted with {stored}; it can't be opened with {params}")
    kw = list(meta["keyword_fields"])
    name = _table_name(root, meta["version"])
    if not spark.catalog.tableExists(name):
        spark.sql(f"CREATE TABLE {name} USING parquet CLUSTERED BY (doc_id) SORTED BY (doc_id) "
                  f"INTO {int(meta['buckets'])} BUCKETS LOCATION '{root}/postings'")
    return SparseIndex(list(meta["text_fields"]), kw, fitted, int(meta["n_docs"]), docs,
                       spark.read.parquet(f"{root}/idf"), spark.read.parquet(f"{root}/forward"),
                       {f: docs.schema[f].dataType for f in kw}, spark.table(name))


def save_ann(index: AnnIndex, root: str) -> None:
    """Write (replace) an approximate index with its model.

    Codes are laid out by cell, so a search that needs some cells skips the other files and row groups.
    """
    spark = index.codes.sparkSession
    m = index.model
    arrays = [("center", i, c) for i, c in enumerate(m.centers)] + [("code", i, b.ravel()) for i, b in enumerate(m.codebooks)]
    # one row at most per cell and code byte
    model = spark.createDataFrame([(kind, i, m.dims, [float(x) for x in v]) for kind, i, v in arrays] or [("none", 0, m.dims, [])],
                                  "kind string, i int, dims int, x array<double>")
    model.write.mode("overwrite").parquet(f"{root}/model")
    index.cells.write.mode("overwrite").parquet(f"{root}/cells")
    (index.codes.repartitionByRange("cell", "doc_id").sortWithinPartitions("cell", "doc_id")
          .write.mode("overwrite").parquet(f"{root}/codes"))
    index.vectors.write.mode("overwrite").parquet(f"{root}/ann_vectors")


def load_ann(spark: SparkSession, root: str) -> AnnIndex:
    """Open a saved approximate index; the model is the saved one, nothing is fitted anew."""
    rows = sorted(spark.read.parquet(f"{root}/model").collect(), key=lambda r: (r.kind, r.i))
    dims = rows[0].dims
    centers = np.array([r.x for r in rows if r.kind == "center"]).reshape(-1, dims)
    model = AnnModel(dims, centers, [])
    model.codebooks = [np.array(r.x).reshape(-1, hi - lo) for r, (lo, hi) in zip((r for r in rows if r.kind == "code"), model.cuts())]
    return AnnIndex(model, spark.read.parquet(f"{root}/codes"), spark.read.parquet(f"{root}/cells"),
                    spark.read.parquet(f"{root}/ann_vectors"))


def populate_vectors(docs: DataFrame, root: str, dims: int, vector: str = "vector",
                     mode: str = "append", batch_id: str | int | None = None) -> None:
    """A8 + B8: valid vectors go to ``vectors/``, the others to ``rejects/`` with their
    reason (the reference prints the error and skips the document).

    Each write has its folder ``batch_id=<id>`` (a new id if none is given), replaced if it
    exists, so a repeated batch doesn't double its rows. ``mode="overwrite"`` drops all
    earlier batches first.
    """
    batch = uuid.uuid4().hex if batch_id is None else batch_id
    tagged = docs.withColumn("reason", validity_reason(vector, dims))
    for name, rows in (("vectors", tagged.where(F.col("reason").isNull()).drop("reason")),
                       ("rejects", tagged.where(F.col("reason").isNotNull()))):
        if mode == "overwrite":
            rows.withColumn("batch_id", F.lit(str(batch))).write.mode("overwrite").partitionBy("batch_id").parquet(f"{root}/{name}")
        else:
            rows.write.mode("overwrite").parquet(f"{root}/{name}/batch_id={batch}")


def write_versions(docs: DataFrame, root: str, dims: int, batch_id: str | int) -> None:
    """Versions of documents (schemas.VERSIONED), appended to ``versions/batch_id=<id>``.

    A version with an invalid vector goes to ``version_rejects/`` with its reason and changes nothing, a
    deleted one needs no vector, and one without a version counts as version 0. A batch that is written
    again replaces its folder.
    """
    rows = docs.select("id", "text", "vector", F.coalesce("version", F.lit(0)).cast("bigint").alias("version"),
                       F.coalesce("deleted", F.lit(False)).alias("deleted"))
    reason = F.when(F.col("id").isNull(), F.lit("null id")).when(~F.col("deleted"), validity_reason("vector", dims))
    tagged = rows.withColumn("reason", reason)
    for name, part in (("versions", tagged.where("reason is null").drop("reason")), ("version_rejects", tagged.where("reason is not null"))):
        part.write.mode("overwrite").parquet(f"{root}/{name}/batch_id={batch_id}")


def open_current(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, text, vector) of the documents as they are now: of all versions ever written the largest
    one of each id, unless it is deleted. The order in which versions arrived, and whether some arrived twice,
    doesn't matter; of different rows with the same version a deletion wins, then the larger hash.

    Only ids, versions and hashes are aggregated; the texts and vectors meet the winners once.
    """
    try:
        rows = spark.read.parquet(f"{root}/versions").drop("batch_id")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], EMPTY_VECTORS)
    rows = rows.withColumn("_h", F.xxhash64("text", "vector"))
    last = rows.groupBy("id").agg(F.max(F.struct("version", "deleted", "_h")).alias("_last")).select("id", "_last.*")
    kept = rows.join(last.where("not deleted"), ["id", "version", "deleted", "_h"]).dropDuplicates(["id"])
    return kept.select(F.col("id").alias("doc_id"), "text", "vector")


def open_vectors(spark: SparkSession, root: str) -> DataFrame:
    """The vector collection, or an empty frame with the schema when it is missing.

    Only a missing path is an empty index; an unreadable one raises.
    """
    try:
        found = spark.read.parquet(f"{root}/vectors")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], EMPTY_VECTORS)
    return found.drop("batch_id")


def fetch_by_ids(collection: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents whose id is in ``ids`` (semi join); no order is promised."""
    return collection.join(ids.select(key).distinct(), key, "left_semi")
