"""What one task holds is bounded by constants, not by the tables."""

import numpy as np
import pyarrow as pa
import pytest

from talkframe.operators import substring


def test_first_matches_are_cut_before_the_sort(spark, monkeypatch):
    monkeypatch.setattr(substring, "FIRST_ROWS", 16)
    rows = [(f"t{i % 7}", None if i % 50 == 0 else i * 37 % 400) for i in range(600)] + [("once", 5), ("once", 5), ("nil", None)]
    df = spark.createDataFrame(rows, "term string, key long").coalesce(2)
    got = substring.first_matches(df, "term", "key", 3)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    key = lambda k: (k is not None, k or 0)
    want = [(t, k, i + 1) for t in sorted({t for t, _ in rows})
            for i, k in enumerate(sorted((k for u, k in rows if u == t), key=key)[:3])]
    assert [tuple(r) for r in got.orderBy("term", "rank").collect()] == want


def test_a_task_passes_on_few_of_its_matches():
    rng = np.random.default_rng(0)
    batches = [pa.RecordBatch.from_pydict({"term": [f"t{x}" for x in rng.integers(0, 20, 10_000)], "key": rng.integers(0, 10**9, 10_000)})
               for _ in range(40)]
    out = pa.Table.from_batches(list(substring._least(3)(iter(batches))))
    assert out.num_rows == 60
    every = pa.Table.from_batches(batches).to_pandas().groupby("term")["key"].nsmallest(3)
    assert sorted(out.column("key").to_pylist()) == sorted(every.tolist())


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_bm25_shards_by_postings(spark, monkeypatch, broadcast):
    bm25 = pytest.importorskip("talkframe.llm.bm25")
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.5, 40) % 300)) for i in range(200)] + [(200, None), (201, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    queries = docs.filter("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id")
    want = sorted(map(tuple, bm25.search(docs, queries, 5).collect()))
    monkeypatch.setattr(bm25, "POSTINGS_PER_SHARD", 500)
    monkeypatch.setattr(bm25, "BROADCAST_TERMS", broadcast)
    got = bm25.search(docs, queries, 5)
    assert sorted(map(tuple, got.collect())) == want and len(want) == 100
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ("Union" in plan) == (not broadcast)
    assert int(plan.split("RepartitionByExpression")[1].split("], ")[1].split()[0]) > 5
