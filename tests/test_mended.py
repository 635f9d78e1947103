"""Cases that lost or changed data in an earlier version."""

import json
import os

import pytest

from talkframe.operators import catalog, chat, inference, rag, sparse, topics, transcript
from talkframe.sources import files, index_io
from talkframe.streaming import streams


def test_catalogue_lines_and_rejects(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "lines.json")
    doc = lambda *ids: json.dumps({"resultCount": len(ids), "results": [{"collectionId": i, "collectionName": "n" + i} for i in ids]})
    with open(p, "w") as f:
        f.write("\n".join([doc("3", "1"), "{broken", doc("2"), doc()]))
    got = sorted((r.collection_id, r.pos) for r in files.read_catalogue(spark, p).collect())
    assert got == [("1", 1), ("2", 0), ("3", 0)]
    assert [r.raw for r in files.catalogue_rejects(spark, p).collect()] == ["{broken"]
    whole = os.path.join(tmpdir_path, "whole.json")
    with open(whole, "w") as f:
        json.dump(json.loads(doc("7", "8")), f, indent=2)
    assert files.read_catalogue(spark, whole, multi_line=True).count() == 2


def test_batch_and_stream_vectors_live_together(spark, tmpdir_path):
    root, src = os.path.join(tmpdir_path, "ix"), os.path.join(tmpdir_path, "src")
    frame = lambda lo, hi: spark.createDataFrame([(str(i), "t", [1.0, float(i)]) for i in range(lo, hi)] + [(f"bad{lo}", "t", [1.0])],
                                                 "id string, text string, vector array<float>")
    index_io.populate_vectors(frame(0, 5), root, 2)
    frame(5, 8).write.parquet(src)
    q = streams.index_documents(spark, src, root, os.path.join(tmpdir_path, "ck"), 2)
    q.awaitTermination(120)
    assert sorted(r.id for r in index_io.open_vectors(spark, root).collect()) == [str(i) for i in range(8)]
    assert spark.read.parquet(f"{root}/rejects").count() == 2
    index_io.populate_vectors(frame(0, 2), root, 2, batch_id="again")
    index_io.populate_vectors(frame(0, 2), root, 2, batch_id="again")
    assert index_io.open_vectors(spark, root).count() == 10
    index_io.populate_vectors(frame(0, 2), root, 2, mode="overwrite")
    assert index_io.open_vectors(spark, root).count() == 2


def test_unreadable_index_is_no_empty_index(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "ix")
    os.makedirs(f"{root}/vectors")
    with open(f"{root}/vectors/part-0.parquet", "w") as f:
        f.write("not parquet")
    with pytest.raises(Exception):
        index_io.open_vectors(spark, root).count()


def test_saved_index_keeps_its_parameters(spark, tmpdir_path):
    docs = spark.createDataFrame([(1, "red red red fish", "a,b"), (2, "blue fish", "c"), (3, "red sea", None)], "id long, text string, `k,1` string")
    docs = docs.withColumnRenamed("k,1", "k")
    idx = sparse.fit(docs, ["text"], ["k"], params={"sublinear_tf": True, "stop_words": ["sea"]})
    q = spark.createDataFrame([(1, "red fish fish")], "qid long, query string")
    want = sorted(map(tuple, sparse.search(idx, q).collect()))
    root = os.path.join(tmpdir_path, "ix")
    for buckets in (4, 2):
        index_io.save_sparse(idx, root, buckets)
        assert sorted(map(tuple, sparse.search(index_io.load_sparse(spark, root), q).collect())) == want
    assert index_io.load_sparse(spark, root, {"sublinear_tf": True}).params == idx.params
    with pytest.raises(ValueError):
        index_io.load_sparse(spark, root, {"sublinear_tf": False})
    empty = sparse.search(idx, spark.createDataFrame([(1, "red")], "qid long, query string"), filter_dict={"k": ""})
    assert [r.doc_id for r in empty.collect()] == ["3"]


def test_chunk_ids_may_repeat_over_episodes(spark):
    docs = spark.createDataFrame([("e1", "1", "red fish"), ("e2", "1", "blue sky"), ("e,", "1", "x")], "ep string, id string, text string")
    idx = sparse.fit(docs, ["text"], id_col=["ep", "id"])
    q = spark.createDataFrame([(1, "red"), (2, "blue")], "qid long, query string")
    hits = sparse.search(idx, q)
    assert sorted((r.qid, r.doc_id, r.text) for r in sparse.attach_text(hits, idx).collect()) == [
        (1, '["e1","1"]', "red fish"), (2, '["e2","1"]', "blue sky")]
    assert [(r.doc_id, r.rows) for r in sparse.duplicate_keys(docs, "id").collect()] == [("1", 3)]
    assert sparse.duplicate_keys(docs, ["ep", "id"]).count() == 0


def test_payload_join_moves_no_text(spark):
    docs = spark.createDataFrame([(i, f"word{i} common") for i in range(20)], "id long, text string")
    idx = sparse.fit(docs, ["text"], [])
    hits = spark.createDataFrame([(1, "3"), (1, "5"), (2, "3")], "qid long, doc_id string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rows in (1000, 1):
            out = sparse.join_payload(hits, idx.docs, 3, block_rows=rows)
            assert sorted((r.qid, r.doc_id, r.text) for r in out.collect()) == [
                (1, "3", "word3 common"), (1, "5", "word5 common"), (2, "3", "word3 common")]
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_short_batches_shift_no_answers(spark):
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(3)], "qid long, prompt string").coalesce(1)
    out = rag.generate(prompts, lambda ps: ps[:2], deterministic=True).collect()
    assert all(r.answer is None and "2 answers to 3 prompts" in r.answer_error for r in out)


def test_pairs_with_gaps_and_nulls(spark):
    log = spark.createDataFrame([(1, 1, "user", "a"), (1, 3, "assistant", "b"), (1, 9, "user", "c"), (1, 2000, "system", "d"),
                                 (None, 1, "user", "x"), (None, 5, "assistant", "y")], "conv_id long, turn long, role string, text string")
    got = sorted(((r.conv_id, r.turn, r.answer) for r in chat.chat_pairs(log).collect()), key=str)
    assert got == sorted([(1, 1, "b"), (1, 9, None), (None, 1, "y")], key=str)
    parts = spark.createDataFrame([(None, 1, "A. B."), (1, None, "C."), (1, 2, "D. E.")], "e long, p long, t string")
    ids = sorted(((r.e, r.p, r.id) for r in transcript.renumber_chunks(parts, "e", "p", "t").collect()), key=str)
    assert ids == sorted([(None, 1, "1"), (None, 1, "2"), (1, None, "1"), (1, 2, "2"), (1, 2, "3")], key=str)


def test_lookup_takes_the_first_result(spark):
    cat = spark.createDataFrame([("9", 1, "alpha"), ("9", 0, "zeta"), ("8", 0, None)], "collection_id string, pos int, name string")
    ids = spark.createDataFrame([("9",), ("8",), ("7",)], "podcast_id string")
    got = {r.podcast_id: (r["name"], r.status) for r in catalog.lookup(ids, cat).collect()}
    assert got == {"9": ("zeta", "Success"), "8": (None, "Success"), "7": (None, "Fail")}


def test_pivot_shows_every_label(spark):
    m = spark.createDataFrame([(f"label{i}", "t", 1.0) for i in range(6)], "label string, text string, score double")
    assert len(topics.pivot(topics.rank_in_label(topics.topic_stats(m))).columns) == 7


def test_models_load_once_per_worker(spark, tmpdir_path):
    def factory():
        with open(os.path.join(tmpdir_path, "loads"), "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda texts: [[1.0] for _ in texts]
    df = spark.createDataFrame([(str(i),) for i in range(64)], "t string").repartition(16)
    assert inference.encode(df, "t", "v", factory).where("v is not null").count() == 64
    with open(os.path.join(tmpdir_path, "loads")) as f:
        pids = f.read().split()
    assert len(pids) == len(set(pids))


def test_checkpoints_need_a_shared_folder():
    from talkframe import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())


def test_invalid_vectors_are_left_out(spark):
    from talkframe.operators import dense
    rows = [("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", None), ("d", [1.0]), ("e", [float("nan"), 1.0]), ("f", [None, 1.0])]
    v = spark.createDataFrame(rows, "doc_id string, vector array<float>")
    hits = dense.search(v.withColumnRenamed("doc_id", "qid"), v, "vector", 5, "cosine").collect()
    assert sorted((r.qid, r.doc_id) for r in hits) == [("a", "a"), ("a", "b"), ("b", "a"), ("b", "b"), ("d", "d")]


def test_hooks_report_errors_per_row(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(4)], "id long, t string").coalesce(1)
    bad = inference.encode(df, "t", "v", lambda: lambda texts: [[1.0]], error="why").collect()
    assert all(r.v is None and "1 results for 4 texts" in r.why for r in bad)
    names = lambda: lambda texts, labels: [[(labels[0], t.split()[-1], 0.5)] for t in texts]
    got = inference.entities(df, "id", "t", ["Number", "Person"], names).collect()
    assert sorted((r.id, r.label, r.text, r.score, r.error) for r in got) == [(i, "Number", str(i), 0.5, None) for i in range(4)]

    def broken():
        def fn(texts, labels):
            raise RuntimeError("no model")
        return fn
    failed = inference.entities(df, "id", "t", ["Number"], broken).collect()
    assert len(failed) == 4 and all("no model" in r.error and r.label is None for r in failed)


def test_every_ingest_path_takes_the_encoder(spark):
    from talkframe.plans import ingest
    enc = lambda: lambda texts: [[float(len(t)), 1.0, 2.0] for t in texts]
    parts = spark.createDataFrame([("m", 1, "One. Two.")], "media_id string, part long, text string")
    assert sorted((r.id, r.vector) for r in ingest.transcript_documents(parts, 2, enc).collect()) == [
        ("1", [4.0, 1.0]), ("2", [4.0, 1.0])]


def test_transcripts_round_trip_and_option(spark, tmpdir_path):
    t = spark.createDataFrame([("m", " a b", ["a", "b"])], "media_id string, text string, c array<string>").selectExpr(
        "media_id", "transform(c, x -> named_struct('text', x)) AS chunks", "text")
    path = os.path.join(tmpdir_path, "tr")
    files.write_transcripts(t, path)
    files.write_transcripts(t, path)
    back = spark.read.schema("media_id string, chunks array<struct<text:string>>, text string").json(path)
    assert back.collect() == t.collect()
    terms = spark.createDataFrame([("red",)], "term string")
    cat = spark.createDataFrame([("1", "red one", "x"), ("2", "two red", "y")], "collection_id string, collection_name string, artist_name string")
    assert [r.collection_id for r in catalog.select_option(catalog.term_search(terms, cat), 2).collect()] == ["2"]
