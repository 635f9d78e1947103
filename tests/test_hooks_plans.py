import os

from pyspark.sql import functions as F

from talkframe.operators import inference, rag
from talkframe.operators.media import segment_plan
from talkframe.plans import backends, ingest
from talkframe.plans import rag as rag_plan
from talkframe.streaming import streams


def test_encode_hook_truncates(spark):
    # factories are defined inside the test: cloudpickle ships them by value
    def _encoder_factory():
        def fn(texts):
            return [[float(len(t)), 1.0, 2.0, 3.0] for t in texts]
        return fn

    df = spark.createDataFrame([(1, "abc"), (2, None)], "id long, text string")
    out = {r.id: r.v for r in inference.encode(df, "text", "v", _encoder_factory, dims=2)
           .collect()}
    assert out == {1: [3.0, 1.0], 2: [0.0, 1.0]}


def test_transcribe_hook_and_concat(spark):
    def _transcriber_factory():
        def fn(path, start, end):
            if start < 0:
                raise ValueError("bad range")
            return [f"{path}:{start}", f"{end}"], f"{path} {start}-{end}"
        return fn

    media = spark.createDataFrame([(1, 10, "a.mp3")], "media_id long, length_ms long, path string")
    plan = segment_plan(media, 2)
    out = inference.transcribe(plan, _transcriber_factory).orderBy("part").collect()
    assert [r.text for r in out] == ["a_part_1.mp3 0-5", "a_part_2.mp3 5-10"]
    assert [c.text for c in out[0].chunks] == ["a_part_1.mp3:0", "5"]
    assert all(r.error is None for r in out)
    parts = spark.createDataFrame([(r.media_id, r.part, r.text) for r in out],
                                  "media_id long, part long, text string")
    docs = {d.id: d.text for d in ingest.transcript_documents(parts, dims=8).collect()}
    # a period inside a name ends no sentence; ids run across parts in order
    assert docs == {"1": "a_part_1.mp3 0-5", "2": "a_part_2.mp3 5-10"}


def test_generate_hook_errors_per_row(spark):
    prompts = spark.createDataFrame([(1, "p1"), (2, "boom")], "qid long, prompt string")

    def gen(batch):
        if "boom" in batch:
            raise RuntimeError("model failed")
        return [p.upper() for p in batch]

    out = {r.qid: (r.answer, r.answer_error) for r in
           rag.generate(prompts, gen, batch_size=1).collect()}
    assert out[1] == ("P1", None)
    assert out[2][0] is None and "model failed" in out[2][1]


def test_batch_rag_plan(spark):
    docs = spark.createDataFrame([(1, "red fish swims"), (2, "blue bird sings")],
                                 "id long, text string")
    idx = backends.create_index("tfidf", docs)
    q = spark.createDataFrame([(1, "red fish"), (2, "nothing")], "qid long, query string")
    ans = {r.qid: r for r in rag_plan.answer(idx, q, k=5).collect()}
    assert ans[1].answer == "red fish swims"
    assert ans[2].answer == "" and ans[2].prompt.endswith("CONTEXT:")
    words = rag_plan.answer_words(rag_plan.answer(idx, q, k=5)).where(F.col("qid") == 1)
    assert [w.word for w in words.orderBy("pos").collect()] == ["red ", "fish ", "swims "]
    ans2 = {r.qid: r.answer for r in rag_plan.answer(idx, q, 5, lambda ps: ["x"] * len(ps))
            .collect()}
    assert ans2 == {1: "x", 2: "x"}


def test_stream_index_documents(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "incoming")
    spark.createDataFrame([("1", "a", [1.0, 0.0]), ("2", "b", [0.0, 0.0])],
                          "id string, text string, vector array<float>").write.parquet(src)
    root = os.path.join(tmpdir_path, "index")
    q = streams.index_documents(spark, src, root, os.path.join(tmpdir_path, "ck"), 2)
    q.awaitTermination(120)
    assert [r.id for r in spark.read.parquet(f"{root}/vectors").collect()] == ["1"]
    assert [r.reason for r in spark.read.parquet(f"{root}/rejects").collect()] == ["zero vector"]


def test_episodes_from_urls(spark):
    cat = spark.createDataFrame([("1682047968", "Big Ideas: Show.", "Ann", "f1")],
                                "collection_id string, collection_name string, "
                                "artist_name string, feed_url string")
    entries = spark.createDataFrame(
        [("f1", 0, "Why the Bolsheviks won", "http://a/0.mp3"),
         ("f1", 1, "What If the Russian Revolution Failed?", "http://a/1.mp3"),
         ("f1", 2, "What if the Russian revolution failed", "http://a/2.mp3")],
        "feed_url string, pos long, title string, audio_url string")
    urls = spark.createDataFrame(
        [("https://x.example/us/podcast/what-if-the-russian-revolution-failed/id1682047968?i=1",),
         ("https://x.example/us/podcast/some-title/id999",)], "url string")
    rows = {r.podcast_id: r for r in ingest.episodes_from_urls(urls, cat, entries, dims=64)
            .collect()}
    ok = rows["1682047968"]
    # positions 1 and 2 normalise to the same title: the earlier feed position wins
    assert (ok.pos, ok.audio_url, ok.status) == (1, "http://a/1.mp3", "Success")
    assert ok.path == "./audio/Big_Ideas-_Show/episode_0.mp3"
    assert rows["999"].status == "Fail" and rows["999"].path is None
