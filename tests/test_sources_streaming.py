import json
import os
import time

from pyspark.sql import functions as F

from talkframe.operators import sparse, topics
from talkframe.plans import backends, ingest
from talkframe.sources import files, index_io
from talkframe.streaming import streams

FEED = """<?xml version="1.0" encoding="UTF-8"?>
<rss version="2.0"><channel><title>Show</title>
<item><title>Ep 2</title><description>&lt;p&gt;Two&lt;/p&gt;</description>
<pubDate>Mon, 02 Sep 2024 10:00:00 +0000</pubDate>
<enclosure url="http://a/2.mp3"/><enclosure url="http://a/2b.mp3"/></item>
<item><title>Ep 1</title><description>One</description>
<pubDate>Sun, 01 Sep 2024 09:30:00 GMT</pubDate></item>
</channel></rss>"""


def test_feed_reader_keeps_position(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "feed.xml")
    with open(p, "w") as f:
        f.write(FEED)
    rows = files.read_feeds(spark, p).orderBy("pos").collect()
    assert [(r.pos, r.title, r.audio_url) for r in rows] == [(0, "Ep 2", "http://a/2.mp3"),
                                                             (1, "Ep 1", None)]
    ts = files.read_feeds(spark, p).select(files.published_ts(F.col("published_date"))
                                           .alias("t")).collect()
    assert all(r.t is not None for r in ts)


def test_episode_json_and_documents(spark, tmpdir_path):
    ep = {"title": "T", "summary": "<p>s</p>", "text": " a. b.",
          "chunks": [{"id": "1", "text": "a."}, {"id": "2", "text": "b."}]}
    p = os.path.join(tmpdir_path, "episode_details.json")
    with open(p, "w") as f:
        json.dump(ep, f, indent=2)
    eps = files.read_episodes(spark, p)
    docs = ingest.episode_documents(eps, dims=8).collect()
    assert sorted((d.id, d.text) for d in docs) == [("1", "a."), ("2", "b.")]
    assert all(len(d.vector) == 8 for d in docs)


def test_catalogue_json(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "lookup.json")
    with open(p, "w") as f:
        json.dump({"resultCount": 1, "results": [{"collectionId": "9", "collectionName": "C",
                                                  "artistName": "A", "feedUrl": "u"}]}, f)
    r = files.read_catalogue(spark, p).collect()
    assert [(x.collection_id, x.feed_url) for x in r] == [("9", "u")]


def test_ground_truth_csv_roundtrip(spark, tmpdir_path):
    gt = spark.createDataFrame([("1", 'say "hi", twice\nok?'), ("2", "plain")],
                               "id string, question string")
    out = os.path.join(tmpdir_path, "gt")
    files.write_ground_truth(gt, out)
    back = files.read_ground_truth(spark, out).collect()
    assert sorted(map(tuple, back)) == sorted(map(tuple, gt.collect()))


def test_sparse_index_save_load(spark, tmpdir_path):
    docs = spark.createDataFrame([(1, "red fish", "a"), (2, "blue fish", "b")],
                                 "id long, text string, lang string")
    idx = sparse.fit(docs, ["text"], ["lang"])
    root = os.path.join(tmpdir_path, "idx")
    index_io.save_sparse(idx, root)
    idx2 = index_io.load_sparse(spark, root)
    q = spark.createDataFrame([(1, "fish red")], "qid long, query string")
    a = sorted(map(tuple, sparse.search(idx, q).collect()))
    b = sorted(map(tuple, sparse.search(idx2, q, filter_dict={"lang": "a"}).collect()))
    assert a[0] == b[0] and len(b) == 1
    assert sorted(map(tuple, sparse.search(idx2, q).collect())) == a
    # bucketed postings: no exchange between the postings scan and the (qid, doc) sum
    scored = sparse.score(idx2, sparse.query_terms(idx2, q))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("HashAggregate")[-1].split("BroadcastExchange")[0]


def test_populate_vectors_and_fetch(spark, tmpdir_path):
    docs = spark.createDataFrame([("1", "a", [1.0, 0.0]), ("2", "b", [1.0])],
                                 "doc_id string, text string, vector array<float>")
    root = os.path.join(tmpdir_path, "vec")
    index_io.populate_vectors(docs, root, 2)
    assert [r.doc_id for r in index_io.open_vectors(spark, root).collect()] == ["1"]
    rej = spark.read.parquet(f"{root}/rejects").collect()
    assert rej[0].reason == "expected 2 dimensions, got 1"
    assert index_io.open_vectors(spark, os.path.join(tmpdir_path, "none")).count() == 0
    ids = spark.createDataFrame([("1",), ("3",)], "doc_id string")
    assert index_io.fetch_by_ids(docs, ids).count() == 1


def test_ground_truth_build_resumes(spark, tmpdir_path):
    chunks = spark.createDataFrame([("1", "A. B."), ("2", "C.")], "id string, text string")
    done = spark.createDataFrame([("2",)], "id string")
    gt, bad = ingest.build_ground_truth(chunks, done, os.path.join(tmpdir_path, "gt"))
    assert sorted(r.question for r in gt.collect()) == ["A.", "B."]
    assert bad.count() == 0


def _wait(q):
    q.awaitTermination(120)


def test_stream_topic_counts_equal_batch(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "mentions")
    rows = [("L", f"t{i % 4}", float(i)) for i in range(30)]
    for part in range(3):
        spark.createDataFrame(rows[part * 10:(part + 1) * 10], "label string, text string, score double") \
            .write.mode("append").parquet(src)
    out = os.path.join(tmpdir_path, "counts")
    q = streams.topic_counts(spark, src, out, os.path.join(tmpdir_path, "ck"))
    _wait(q)
    last = max(os.listdir(out), key=lambda d: int(d.partition("batch_id=")[2] or -1))
    stream = sorted(map(tuple, spark.read.parquet(f"{out}/{last}").collect()))
    batch = sorted(map(tuple, topics.topic_stats(spark.createDataFrame(
        rows, "label string, text string, score double")).collect()))
    assert stream == batch


def test_stream_answers_and_chat_log(spark, tmpdir_path):
    docs = spark.createDataFrame([(1, "red fish"), (2, "blue fish")], "id long, text string")
    idx = backends.create_index("tfidf", docs)
    src = os.path.join(tmpdir_path, "questions")
    spark.createDataFrame([(1, "red")], "qid long, query string").write.parquet(src)
    out = os.path.join(tmpdir_path, "answers")
    q = streams.answer_questions(spark, src, idx, out, os.path.join(tmpdir_path, "ck1"))
    _wait(q)
    assert [(r.qid, r.doc_id) for r in spark.read.parquet(f"{out}/hits").collect()] == [(1, "1")]
    answers = spark.read.parquet(f"{out}/answers").collect()
    assert [(r.qid, r.answer) for r in answers] == [(1, "red fish")] and "red" in answers[0].prompt
    assert sorted((r.pos, r.word) for r in spark.read.parquet(f"{out}/words").collect()) == [(0, "red "), (1, "fish ")]
    log_src = os.path.join(tmpdir_path, "log")
    spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn long, role string, text string") \
        .write.parquet(log_src)
    log_out = os.path.join(tmpdir_path, "logout")
    q2 = streams.chat_log(spark, log_src, log_out, os.path.join(tmpdir_path, "ck2"))
    _wait(q2)
    assert spark.read.parquet(log_out).count() == 1


def test_backend_dispatch(spark):
    import pytest
    docs = spark.createDataFrame([(1, "red fish", [1.0, 0.0]), (2, "blue", [0.0, 1.0])],
                                 "id long, text string, vector array<float>")
    with pytest.raises(ValueError):
        backends.create_index("nope", docs)
    vs = backends.create_index("vector_store", docs)
    q = spark.createDataFrame([(1, [1.0, 0.1])], "qid long, vector array<float>")
    r = backends.search(vs, q, k=1).first()
    assert r.doc_id == "1"


def test_stream_topic_ranking_equals_batch(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "m")
    rows = [("L", f"t{i % 5}", float(i % 3)) for i in range(40)] + [("K", "x", 1.0)]
    for part in range(2):
        spark.createDataFrame(rows[part::2], "label string, text string, score double") \
            .write.mode("append").parquet(src)
    out = os.path.join(tmpdir_path, "ranked")
    q = streams.topic_ranking(spark, src, out, os.path.join(tmpdir_path, "ck"), top_n=3)
    _wait(q)
    got = spark.read.parquet(out)
    last = got.agg({"batch_id": "max"}).first()[0]
    stream = sorted((r.label, r.rank, r.text) for r in got.where(f"batch_id = {last}").collect())
    batch = sorted((r.label, r.rank, r.text) for r in topics.rank_in_label(topics.topic_stats(
        spark.createDataFrame(rows, "label string, text string, score double")), 3).collect())
    assert stream == batch
