"""K4: one search entry point over the three backends.

Backends: "tfidf" (TF-IDF, C1), "search_server" (exact cosine + 1, C2), "vector_store"
(cosine distance: the full search, or quantised cells when ``approximate``; C4). Unknown names
raise (the reference falls through to an unbound name).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import ann, dense, sparse

BACKENDS = ("tfidf", "search_server", "vector_store")


@dataclass
class Index:
    """What a backend searches: a sparse index, or a vector table (doc_id, vector, other columns), with
    the cells and codes of an approximate vector store."""

    backend: str
    sparse: sparse.SparseIndex | None = None
    vectors: DataFrame | None = None
    cells: ann.AnnIndex | None = None
    nprobe: int = 4


def create_index(backend: str, docs: DataFrame, text_fields=("text",), keyword_fields=(),
                 vector: str = "vector", **kw) -> Index:
    """A7 + A10: build the backend's index from (id, text[, vector]) documents.

    ``approximate`` (with ``n_cells``, ``nprobe``) fits the quantised cells of a vector store.
    """
    if backend == "tfidf":
        return Index(backend, sparse=sparse.fit(docs, list(text_fields), list(keyword_fields),
                                                 id_col="id", params=kw.get("params")))
    if backend in ("search_server", "vector_store"):
        v = docs.select(docs["id"].cast("string").alias("doc_id"), docs[vector].alias("vector"),
                        *[c for c in docs.columns if c not in ("id", "doc_id", vector, "vector")])
        near = ann.fit(v, "vector", kw.get("n_cells")) if backend == "vector_store" and kw.get("approximate") else None
        return Index(backend, vectors=v, cells=near, nprobe=kw.get("nprobe", 4))
    raise ValueError(f"unknown backend {backend!r}; expected one of {BACKENDS}")


def search(index: Index, queries: DataFrame, k: int = 5, query_col: str = "query",
           vector_col: str = "vector", boost_dict: dict | None = None,
           filter_dict: dict | None = None) -> DataFrame:
    """Top-k hits (qid, doc_id, score, rank) for a table of queries.

    Sparse queries carry text in ``query_col``; dense ones a vector in ``vector_col``. A filtered
    search of a vector store is the full one over the rows that the filter keeps."""
    if index.backend == "tfidf":
        return sparse.search(index.sparse, queries, "qid", query_col, filter_dict,
                             boost_dict if boost_dict is not None else {"text": 3.0}, k)
    q = queries.select("qid", queries[vector_col].alias("vector"))
    if index.backend == "search_server":
        return dense.search(q, index.vectors, "vector", k, "cos_plus_one", filter_dict)
    if index.backend == "vector_store":
        if index.cells is not None and not filter_dict:
            return ann.search(index.cells, q, k, "vector", index.nprobe)
        return dense.search(q, index.vectors, "vector", k, "cos_distance", filter_dict)
    raise ValueError(f"unknown backend {index.backend!r}; expected one of {BACKENDS}")
