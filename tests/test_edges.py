"""Edge cases decided in SURVEY §7.4 and property checks."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from talkframe.operators import dense, sparse, transcript
from talkframe.operators import evaluate as ev


def test_dense_keeps_non_positive_scores(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 1.0])],
                                 "doc_id long, vector array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "qid long, vector array<float>")
    rows = dense.search(q, docs, "vector", 3, "cosine").orderBy("rank").collect()
    assert [(r.doc_id, round(r.score, 6)) for r in rows] == [("1", 1.0), ("3", 0.0), ("2", -1.0)]
    rows = dense.search(q, docs, "vector", 3, "cos_distance").orderBy("rank").collect()
    assert [r.doc_id for r in rows] == ["1", "3", "2"]


def test_hot_key_split_into_blocks(spark):
    rng = np.random.default_rng(7)
    # label 0 holds most rows; tiny blocks force it into many document blocks
    rows = [(i, rng.normal(size=4).tolist(), 0 if i < 90 else 1) for i in range(100)]
    v = spark.createDataFrame(rows, "doc_id long, vector array<double>, label int")
    q = v.withColumnRenamed("doc_id", "qid")
    got = {(r.qid, r.doc_id) for r in dense.blocked_search(
        q, v, ["vector"], 1, "cosine", key="label", exclude_self=True,
        query_block=5, doc_block=8).collect()}
    m = np.array([r[1] for r in rows])
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    cos = u @ u.T
    exp = set()
    for i, r in enumerate(rows):
        cands = [(-round(cos[i, j], 6), str(j)) for j in range(100) if j != i and rows[j][2] == r[2]]
        exp.add((str(i), min(cands)[1]))
    assert got == exp


def test_sentence_borders(spark):
    text = 'Dr. Smith paid 3.50 to a.b@c.org. "Was it late?" Yes! (Really.) e.g. this... Then\nno end'
    df = spark.createDataFrame([(1, text), (2, None), (3, " . "), (4, "")], "id long, t string")
    rows = transcript.sentence_chunks(df.where("id = 1"), "id", "t").orderBy("pos").collect()
    assert [r.text for r in rows] == ["Dr.", "Smith paid 3.50 to a.b@c.org.", '"Was it late?"', "Yes!", "(Really.)", "e.g.",
                                      "this...", "Then\nno end"]
    rows = transcript.sentence_chunks(df, "id", "t", ["dr", "e.g"]).orderBy("id", "pos").collect()
    assert [r.text for r in rows] == ["Dr. Smith paid 3.50 to a.b@c.org.", '"Was it late?"', "Yes!", "(Really.)",
                                      "e.g. this...", "Then\nno end", "."]


def test_abbreviations_are_learnt_from_the_corpus(spark):
    import random

    from talkframe.operators import sentences
    rng = random.Random(1)
    words = "the house was red and every garden grew along river roads with many small birds".split()
    docs = []
    for i in range(400):
        body = [rng.choice(words) for _ in range(rng.randint(5, 14))]
        body.insert(rng.randint(1, 4), rng.choice(["Dr. Miller", "approx. five", "e.g. some", "No. 3", "3.5 per cent"]))
        docs.append((i, " ".join(body).capitalize() + rng.choice(".!?")))
    df = spark.createDataFrame(docs + [(900, None), (901, ""), (902, "...")], "id long, t string")
    found = sentences.learn_abbreviations(df, "t")
    assert {"dr", "approx", "e.g"} <= set(found) and not set(found) & set(words)
    n = transcript.sentence_chunks(df.where("id < 400"), "id", "t", found).groupBy("id").count().where("count > 1").count()
    assert n == 0
    assert sentences.learn_abbreviations(df.limit(0), "t") == []
    assert sentences.learn_abbreviations(df.where("id >= 900"), "t") == []


def test_empty_ground_truth_gives_null(spark):
    gt = spark.createDataFrame([], "qid long, id string, question string")
    hits = spark.createDataFrame([], "qid long, doc_id string, rank long")
    rel = ev.relevance(gt, hits)
    assert ev.hit_rate(rel).first()[0] is None
    assert ev.mrr(rel).first()[0] is None


def test_k_equal_n_gives_all_positive(spark):
    docs = spark.createDataFrame([(i, f"word{i % 3} common") for i in range(9)],
                                 "id long, text string")
    idx = sparse.fit(docs, ["text"], [])
    q = spark.createDataFrame([(1, "word1 common")], "qid long, query string")
    all_pos = sparse.score(idx, sparse.query_terms(idx, q)).where("score > 0").count()
    assert sparse.search(idx, q, num_results=9).count() == all_pos == 9


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.lists(st.booleans(), max_size=4)),
                min_size=1, max_size=6))
def test_metrics_bounds(spark, data):
    gt_rows, hit_rows = [], []
    for qid, (doc, rels) in enumerate(data):
        gt_rows.append((qid, str(doc), "q"))
        for rank, is_rel in enumerate(rels, start=1):
            hit_rows.append((qid, str(doc) if is_rel else "x", rank))
    gt = spark.createDataFrame(gt_rows, "qid long, id string, question string")
    hits = spark.createDataFrame(hit_rows, "qid long, doc_id string, rank long")
    rel = ev.relevance(gt, hits)
    hr = ev.hit_rate(rel).first()[0]
    assert 0.0 <= hr <= 1.0
    exp_hr = sum(any(r) for _, r in data) / len(data)
    exp_mrr = sum(sum(1 / (i + 1) for i, x in enumerate(r) if x) for _, r in data) / len(data)
    assert hr == pytest.approx(exp_hr)
    assert ev.mrr(rel).first()[0] == pytest.approx(exp_mrr)
