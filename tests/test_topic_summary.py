"""Bounded topic counts (I3): the ranking equals the full one, the state doesn't grow."""

import random

import pytest
from pyspark.sql import functions as F

from talkframe import schemas
from talkframe.operators import topics
from talkframe.streaming import streams


def _mentions(rng, n):
    text = lambda: f"t{min(int(rng.paretovariate(0.9)), 3000)}"
    return [(rng.choice(["a", "a", "a", "b", None]), text(), 1.0) for _ in range(n)] + [("few", "x", 1.0), ("few", "y", 0.5)]


@pytest.mark.parametrize("capacity", [60, 4])
def test_stream_summary_ranks_like_the_batch(spark, tmpdir_path, capacity):
    rng = random.Random(capacity)
    src, out = f"{tmpdir_path}/in", f"{tmpdir_path}/out"
    rows = []
    for step in range(3):                                     # a restart before each
        new = _mentions(rng, 1500)
        rows += new
        spark.createDataFrame(new, schemas.ENTITY).write.mode("append").parquet(src)
        streams.topic_summary(spark, src, out, f"{tmpdir_path}/ckpt", capacity).awaitTermination()
    last = spark.read.schema(streams.SUMMARY).parquet(f"{out}/batch_id=2")
    mentions = spark.createDataFrame(rows, schemas.ENTITY)
    true = {(r.label, r.text): r["count"] for r in topics.topic_stats(mentions).collect()}
    state = [r for r in last.collect() if r["count"]]
    assert len(state) <= 4 * capacity
    labels = {label for label, _ in true}
    error = {r.label: r.error for r in last.collect()}
    assert error.keys() == labels and all(e <= len(rows) / (capacity + 1) for e in error.values())
    here = {(r.label, r.text): r["count"] for r in state}
    assert all(here.get(k, 0) <= n <= here.get(k, 0) + error[k[0]] for k, n in true.items())
    want = sorted(map(str, topics.rank_in_label(topics.topic_stats(mentions), 5).collect()))
    assert sorted(map(str, topics.rank_by_summary(mentions, last, 5).collect())) == want


def test_empty_stream_and_merge_of_partial_summaries(spark):
    rng = random.Random(9)
    rows = _mentions(rng, 3000)
    df = spark.createDataFrame(rows, schemas.ENTITY)
    parts = None
    for i in range(3):
        counts = df.where(F.pmod(F.xxhash64("text", "score", "label"), F.lit(3)) == i).groupBy("label", "text").agg(
            F.count(F.lit(1)).alias("count")).withColumns({"error": F.lit(0).cast("bigint"), "part": F.lit(0)})
        one = topics.merge_summaries(counts, 30).withColumn("part", F.lit(i))
        parts = one if parts is None else parts.unionByName(one)
    both = topics.merge_summaries(parts, 30)
    want = sorted(map(str, topics.rank_in_label(topics.topic_stats(df), 3).collect()))
    assert sorted(map(str, topics.rank_by_summary(df, both, 3).collect())) == want
    none = topics.merge_summaries(parts.limit(0), 30)
    assert none.count() == 0 and topics.rank_by_summary(df.limit(0), none, 3).count() == 0
