"""The approximate index against the full search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkframe.operators import ann, dense
from talkframe.plans import backends
from talkframe.sources import index_io

SCHEMA = "doc_id long, vector array<float>"


def _clustered(n=500, dims=10, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, dims)) * 3
    rows = [(i, (centers[i % 12] + rng.normal(size=dims)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[5][1]) for i in range(30)]                                    # copies tie
    rows += [(900, None), (901, [float("nan")] * dims), (902, [None] * dims), (903, [1.0]), (904, [0.0] * dims), (905, [0.0] * dims)]
    return rows


def _hits(df):
    return sorted((r.qid, r.doc_id, round(r.score, 6), r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def built(spark):
    docs = spark.createDataFrame(_clustered(), SCHEMA)
    return docs, ann.fit(docs, n_cells=12)


@pytest.mark.parametrize("k,nprobe", [(1, 1), (7, 3), (40, 1), (1000, 2)])
def test_exact_stop_gives_the_full_search(spark, built, k, nprobe):
    docs, index = built
    q = docs.where("doc_id % 9 = 0 or doc_id in (5, 904, 900, 901)").withColumnRenamed("doc_id", "qid")
    sound = docs.where("doc_id <> 903")
    assert _hits(ann.search(index, q, k, nprobe=nprobe)) == _hits(dense.search(q, sound, "vector", k, "cos_distance"))


def test_reads_a_part_of_the_vectors(spark, built):
    docs, index = built
    q = docs.where("doc_id < 60").withColumnRenamed("doc_id", "qid")
    read = ann.candidates(index, q, 5, nprobe=2).count()
    assert 60 * 5 <= read < 0.25 * 60 * docs.count()


def test_without_exact_stop(spark, built):
    docs, index = built
    q = docs.where("doc_id < 60").withColumnRenamed("doc_id", "qid")
    want = {(r.qid, r.doc_id) for r in dense.search(q, docs, "vector", 10, "cos_distance").collect()}
    some = {(r.qid, r.doc_id) for r in ann.search(index, q, 10, nprobe=4, exact=False).collect()}
    assert len(some & want) >= 0.9 * len(want)


def test_saved_index_answers_alike(spark, built, tmpdir_path):
    docs, index = built
    q = docs.where("doc_id < 40").withColumnRenamed("doc_id", "qid")
    index_io.save_ann(index, tmpdir_path)
    opened = index_io.load_ann(spark, tmpdir_path)
    assert np.array_equal(opened.model.centers, index.model.centers)
    assert all(np.array_equal(a, b) for a, b in zip(opened.model.codebooks, index.model.codebooks))
    assert _hits(ann.search(opened, q, 5)) == _hits(ann.search(index, q, 5))


def test_bounds_hold_for_every_row(built):
    docs, index = built
    rows = {str(r.doc_id): r.vector for r in docs.where("doc_id < 800").collect()}
    for r in index.codes.where(F.col("cell") >= 0).collect():
        u = np.array(rows[r.doc_id], float)
        u /= np.linalg.norm(u)
        code = np.frombuffer(r.code, np.uint8)[None, :]
        other = np.array(rows["17"], float)[None, :] / np.linalg.norm(rows["17"])
        gap = index.model.distances(other, r.cell, code)[0, 0]
        assert gap - r.err - 1e-9 <= np.linalg.norm(other[0] - u) <= gap + r.err + 1e-9


def test_fit_is_repeatable_and_bounded(spark):
    docs = spark.createDataFrame(_clustered(seed=4), SCHEMA)
    a, b = (ann.fit(d, n_cells=5, sample_rows=100) for d in (docs, docs))
    assert np.allclose(a.model.centers, b.model.centers) and a.codes.count() == b.codes.count() == 532
    q = docs.where("doc_id < 30").withColumnRenamed("doc_id", "qid")
    assert _hits(ann.search(a, q, 4)) == _hits(dense.search(q, docs.where("doc_id <> 903"), "vector", 4, "cos_distance"))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.0, 0.0]), (2, [0.0, 0.0])], [(1, [1.0, 2.0])], [(2, [3.0, 0.0])] + [(i, [1.0, 2.0]) for i in range(5, 9)]])
def test_small_and_empty(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    q = spark.createDataFrame([(7, [1.0, 1.0]), (8, [0.0, 0.0]), (9, None)], "qid long, vector array<float>")
    assert _hits(ann.search(ann.fit(docs), q, 3)) == _hits(dense.search(q, docs, "vector", 3, "cos_distance"))


def test_backend(spark):
    docs = spark.createDataFrame(_clustered()[:200], "id long, vector array<float>").withColumn("lang", F.when(F.col("id") % 2 == 0, "a"))
    q = docs.where("id < 20").withColumnRenamed("id", "qid")
    near = backends.create_index("vector_store", docs, approximate=True, n_cells=6)
    full = backends.create_index("vector_store", docs)
    assert near.cells is not None and full.cells is None
    for flt in (None, {"lang": "a"}):
        assert _hits(backends.search(near, q, 4, filter_dict=flt)) == _hits(backends.search(full, q, 4, filter_dict=flt))


def test_tasks_pass_on_k_rows_per_query(spark):
    # vectors without clusters: their bounds leave many rows to compare, but only k of them may leave a task
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, rng.normal(size=24).astype(np.float32).tolist()) for i in range(400)], SCHEMA)
    q = docs.withColumnRenamed("doc_id", "qid")
    read = ann.candidates(ann.fit(docs, n_cells=4), q, 5, nprobe=2)
    per_query = {r["qid"]: (r["n"], r["read"]) for r in read.groupBy("qid").agg(
        F.count("*").alias("n"), F.sum("read").alias("read")).collect()}
    assert len(per_query) == 400 and all(n == 5 <= compared <= 400 for n, compared in per_query.values())
    assert sum(compared for _, compared in per_query.values()) < 400 * 400
    want = {(r.qid, r.doc_id) for r in dense.search(q, docs, "vector", 5, "cos_distance").collect()}
    assert {(r.qid, r.doc_id) for r in read.collect()} == want


@pytest.mark.parametrize("spread", [1.0, 0.05])
def test_singles_rule_out_rows_of_a_cell(monkeypatch, spread):
    """Beyond the first rows of a cell a block is bounded in singles; the hits are those of a full search."""
    import types

    import pandas as pd
    rng = np.random.default_rng(4)
    x = rng.normal(size=(5, 8))[rng.integers(0, 5, 3000)] + spread * rng.normal(size=(3000, 8))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    u[-3:] = u[:3]                                          # copies tie
    model = ann.AnnModel(8, u.mean(axis=0, keepdims=True), [])
    rest = u - model.centers[0]
    model.codebooks = [ann._codebook(rest[:, a:b], 1) for a, b in model.cuts()]
    cell, code, err = model.encode(u)
    ids = np.array([str(i) for i in range(len(u))], object)
    d = pd.DataFrame({"doc_id": ids, "cell": cell, "code": [c.tobytes() for c in code], "err": err,
                      "same": [hash(v.tobytes()) for v in u], "unit": list(u)})
    q = pd.DataFrame({"qid": ids[:50], "_u": list(u[:50]), "most": np.inf})
    bounded, gaps = [], ann._gaps
    monkeypatch.setattr(ann, "_gaps", lambda a, b: (bounded.append(len(a) * len(b)), gaps(a, b))[1])
    shared = types.SimpleNamespace(value=(8, model.centers, model.codebooks))
    got = ann._refined(shared, 4)(q, d)
    score = 1.0 - u[:50] @ u.T
    want = {i: [str(j) for j in sorted(range(len(u)), key=lambda j: (round(score[i, j], 6), str(j)))[:4]] for i in range(50)}
    assert {int(i): rows.doc_id.tolist() for i, rows in got.groupby("qid")} == want
    assert (got.groupby("qid")["read"].sum() >= 4).all() and got["read"].sum() <= 50 * len(u)
    assert sum(bounded) < 50 * len(u) / 4
    # with limits known beforehand none of them is missed
    again = ann._refined(shared, 4)(q.assign(most=[score[i, int(want[i][-1])] for i in range(50)]), d)
    assert {int(i): rows.doc_id.tolist() for i, rows in again.groupby("qid")} == want
