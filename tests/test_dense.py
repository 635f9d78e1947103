import numpy as np
import pytest
from pyspark.sql import functions as F

from talkframe.functions.vectors import cosine, validity_reason, with_hash_vector
from talkframe.operators import dense


def _vectors(n=60, dims=8, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(size=dims).astype(np.float32).tolist(), i % 3) for i in range(n)]


def _brute(rows, qrows, k, metric):
    d = np.array([r[1] for r in rows], dtype=np.float64)
    q = np.array([r[1] for r in qrows], dtype=np.float64)
    du = d / np.linalg.norm(d, axis=1, keepdims=True)
    qu = q / np.linalg.norm(q, axis=1, keepdims=True)
    cos = qu @ du.T
    out = {}
    for i, qr in enumerate(qrows):
        s = cos[i] + 1.0 if metric == "cos_plus_one" else 1.0 - cos[i]
        key = [(-round(v, 6) if metric == "cos_plus_one" else round(v, 6), str(rows[j][0]))
               for j, v in enumerate(s)]
        out[str(qr[0])] = [doc for _, doc in sorted(key)[:k]]
    return out


@pytest.mark.parametrize("stream", [False, True])
@pytest.mark.parametrize("metric", ["cos_plus_one", "cos_distance"])
def test_search_equals_brute_force_across_blocks(spark, monkeypatch, metric, stream):
    rows = _vectors()
    rows += [(100 + i, rows[3][1], 0) for i in range(6)]                      # ties
    monkeypatch.setattr(dense, "SCORES_AT_ONCE", 300)
    docs = spark.createDataFrame(rows, "doc_id long, vector array<float>, label int")
    q = docs.withColumnRenamed("doc_id", "qid")
    # tiny blocks force several (query block, document block) pairs
    bad = spark.createDataFrame([(900, None, 0), (901, [1.0, float("nan")] * 4, 0), (902, [1.0, None] * 4, 0), (903, [1.0], 0)],
                                docs.schema)
    docs, q = docs.union(bad), q.union(bad.limit(3))
    res = dense.blocked_search(q, docs, ["vector"], 4, metric, query_block=7, doc_block=9, stream=stream)
    got = {}
    for r in res.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.doc_id)
    assert got == _brute(rows, rows, 4, metric)


def test_filter_is_a_parameter(spark):
    docs = spark.createDataFrame(_vectors(), "doc_id long, vector array<float>, label int")
    q = docs.limit(5).withColumnRenamed("doc_id", "qid")
    want = sorted(map(tuple, dense.search(q, docs.where("label = 1"), "vector", 3).collect()))
    for stream in (True, False):
        got = dense.blocked_search(q, docs, ["vector"], 3, "cos_plus_one", filter_dict={"label": 1, "no column": "x"}, stream=stream)
        assert sorted(map(tuple, got.collect())) == want
    assert dense.search(q, docs, "vector", 3, filter_dict={"label": "1"}).count() == 0


def test_large_query_tables_are_not_collected(spark, monkeypatch):
    docs = spark.createDataFrame(_vectors(), "doc_id long, vector array<float>, label int")
    q = docs.withColumnRenamed("doc_id", "qid")
    want = sorted(map(tuple, dense.search(q, docs, "vector", 3).collect()))
    for name, most in (("MAX_STREAMED_QUERIES", 59), ("MAX_STREAMED_BYTES", 60 * 8 * 8 - 1)):
        monkeypatch.setattr(dense, name, most)
        res = dense.search(q, docs, "vector", 3)
        assert "FlatMapCoGroupsInPandas" in res._jdf.queryExecution().toString()
        assert sorted(map(tuple, res.collect())) == want


def test_nearest_in_feed_gate(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (3, [0.0, 1.0], 1), (4, [1.0, 1.0], 1),
            (5, [1.0, 0.0], 2)]
    v = spark.createDataFrame(rows, "doc_id long, vector array<float>, label int")
    g = {r.qid: (r.doc_id, r.status) for r in dense.nearest_in_feed(
        v.withColumnRenamed("doc_id", "qid"), v, "label", exclude_self=True).collect()}
    assert g["1"] == ("2", "Success")
    assert g["3"] == ("4", "Fail")          # cos 0.707 < 0.95
    assert g["5"] == (None, "Fail")         # alone in its feed


def test_vector_validation(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [1.0, None]), (4, [0.0, 0.0]),
                                (5, None)], "id long, v array<float>")
    got = {r.id: r.reason for r in df.select("id", validity_reason("v", 2).alias("reason"))
           .collect()}
    assert got == {1: None, 2: "expected 2 dimensions, got 1", 3: "null element",
                   4: "zero vector", 5: "null vector"}


def test_cosine_properties(spark):
    rows = _vectors(n=10, dims=5)
    df = spark.createDataFrame([(a[1], b[1]) for a in rows for b in rows], "a array<float>, b array<float>")
    r = df.select(cosine("a", "b").alias("ab"), cosine("b", "a").alias("ba")).collect()
    for x in r:
        assert x.ab == pytest.approx(x.ba)
        assert -1 - 1e-9 <= x.ab <= 1 + 1e-9
    z = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert z.select(cosine("a", "b")).first()[0] == 0.0


def test_hash_vector_counts(spark):
    df = spark.createDataFrame([(1, "a bb bb cc"), (2, "")], "id long, t string")
    v = {r.id: r.v for r in with_hash_vector(df, "t", "v", 16, keep=["id"]).collect()}
    assert sum(v[1]) == 3.0 and max(v[1]) >= 2.0
    assert sum(v[2]) == 0.0 and len(v[2]) == 16


def test_mean_pool(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 5.0])],
                               "k long, v array<float>")
    got = {r.k: r.vector for r in dense.mean_pool(df, "k", "v").collect()}
    assert got == {1: [2.0, 3.0], 2: [5.0, 5.0]}


def test_blocks_are_as_large_as_a_task_holds(spark):
    # every row travels once per block of the other side: 5000 rows of two numbers are one block
    rng = np.random.default_rng(2)
    docs = spark.createDataFrame([(i, rng.normal(size=2).astype(np.float32).tolist()) for i in range(5000)],
                                 "doc_id long, vector array<float>")
    q = docs.withColumnRenamed("doc_id", "qid")
    h = dense.blocked_search(q, docs, ["vector"], 1, stream=False)
    assert "explode([0,1" not in h._jdf.queryExecution().optimizedPlan().toString()
    assert dense.travel_rows(64) >= 32_768 and dense.travel_rows(10 ** 6) == dense.QUERY_BLOCK
    got = {(r.qid, r.doc_id) for r in h.where("qid % 50 = 0").collect()}
    want = {(r.qid, r.doc_id) for r in dense.blocked_search(q.where("qid % 50 = 0"), docs, ["vector"], 1, stream=True).collect()}
    assert got == want and len(got) == 100


def test_blocks_meet_over_many_partitions(spark):
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(i, rng.normal(size=3).astype(np.float32).tolist()) for i in range(90)],
                                 "doc_id long, vector array<float>")
    q = docs.withColumnRenamed("doc_id", "qid")
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")     # small tables else end up in one partition
    try:
        got, want = ({(r.qid, r.doc_id) for r in dense.blocked_search(
            q, docs, ["vector"], 3, query_block=20, doc_block=30, stream=stream).collect()} for stream in (False, True))
    finally:
        spark.conf.set(name, before)
    assert got == want and len(got) == 270


@pytest.mark.parametrize("metric", ["cosine", "cos_plus_one", "cos_distance"])
def test_singles_rule_out_most_pairs_and_no_hit(monkeypatch, metric):
    """Scores that singles can't tell apart and ties are settled in doubles; few pairs get that far."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(2500, 8))
    rows = np.concatenate([base, base[:40] * (1 + 1e-7 * rng.normal(size=(40, 8))), base[:40] * 3, np.zeros((3, 8))])
    ids = np.array([str(i) for i in range(len(rows))], object)
    rescored = []
    real = dense._rescored
    monkeypatch.setattr(dense, "_rescored", lambda spec, q, d, r, c, best: (rescored.append(len(r)), real(spec, q, d, r, c, best)))
    for exclude_self, positive_only in ((False, False), (True, False), (True, True)):
        spec = dense._Spec(("v", "w"), (2.0, 0.5), metric, 4, positive_only, exclude_self)
        fields = [dense._unit(list(rows)), dense._unit(list(rows[:, ::-1][:, :5]))]
        d, q = dense._Side(ids, fields), dense._Side(ids[:60], [f[:60] for f in fields])
        quick, whole = (dense._nothing_yet(spec, q) for _ in range(2))
        dense._all_of(spec, q, d, quick)
        dense._better(spec, q, d, whole)
        assert quick.frame(q.ids)[["qid", "doc_id"]].values.tolist() == whole.frame(q.ids)[["qid", "doc_id"]].values.tolist()
        assert np.allclose(quick.scores, whole.scores, atol=1e-12)
    assert 0 < sum(rescored) < 3 * 60 * len(rows) // 10
