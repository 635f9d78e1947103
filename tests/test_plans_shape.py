"""Guards on the physical plans that the scale design relies on."""

from talkframe.operators import dense, sparse


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sparse_search_plan(spark):
    docs = spark.createDataFrame([(i, f"red fish {i} blue") for i in range(40)],
                                 "id long, text string")
    idx = sparse.fit(docs, ["text"], [])
    q = spark.createDataFrame([(1, "red fish"), (2, "blue")], "qid long, query string")
    hits = sparse.search(idx, q, num_results=3)
    hits.collect()
    plan = _plan(hits).split("Initial Plan")[0]
    # partial top-k before the only shuffle by query; the forward rows are streamed past the query terms
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert plan.count("Exchange hashpartitioning(qid") == 1
    assert "SortMergeJoin" not in plan
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_dense_docs_not_shuffled_by_key(spark):
    rows = [(i, [float(i % 5), 1.0]) for i in range(30)]
    v = spark.createDataFrame(rows, "doc_id long, vector array<float>")
    res = dense.search(v.withColumnRenamed("doc_id", "qid"), v, "vector", 2, "cosine")
    res.collect()
    plan = _plan(res)
    # the queries travel: no document is moved, and no join is needed
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert "SortMergeJoin" not in plan and "MapInPandas" in plan
    res = dense.blocked_search(v.withColumnRenamed("doc_id", "qid"), v, ["vector"], 2, stream=False)
    res.collect()
    plan = _plan(res)
    # no join at all on the global key (no nested-loop / cross join), one cogroup
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert "SortMergeJoin" not in plan
    assert "FlatMapCoGroupsInPandas" in plan
    # with a feed key: an equi-join of the block sizes by broadcast
    kv = spark.createDataFrame([(i, [float(i % 5), 1.0], i % 3) for i in range(30)],
                               "doc_id long, vector array<float>, label int")
    kres = dense.blocked_search(kv.withColumnRenamed("doc_id", "qid"), kv, ["vector"], 1,
                                "cosine", key="label")
    kres.collect()
    kp = _plan(kres)
    assert "BroadcastHashJoin" in kp and "NestedLoopJoin" not in kp
