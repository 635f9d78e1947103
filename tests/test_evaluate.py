import pytest

from talkframe.operators import evaluate as ev


def test_hit_rate_and_mrr(spark):
    gt = spark.createDataFrame([(1, "a", "q1"), (2, "b", "q2"), (3, "c", "q3")],
                               "qid long, id string, question string")
    hits = spark.createDataFrame(
        [(1, "x", 1), (1, "a", 2), (2, "y", 1), (3, "c", 1), (3, "z", 2), (3, "c", 3)],
        "qid long, doc_id string, rank long")
    rel = ev.relevance(gt, hits)
    assert ev.hit_rate(rel).first()[0] == pytest.approx(2 / 3)
    assert ev.mrr(rel).first()[0] == pytest.approx((1 / 2 + 0 + 1 + 1 / 3) / 3)


def test_question_without_hits_counts(spark):
    gt = spark.createDataFrame([(1, "a", "q1"), (2, "b", "q2")],
                               "qid long, id string, question string")
    hits = spark.createDataFrame([(1, "a", 1)], "qid long, doc_id string, rank long")
    out = ev.evaluate(gt, lambda q: hits, "x").first()
    assert out.hit_rate == pytest.approx(0.5)
    assert out.mrr == pytest.approx(0.5)


def test_ids_compared_as_strings(spark):
    gt = spark.createDataFrame([(1, "7", "q")], "qid long, id string, question string")
    hits = spark.createDataFrame([(1, 7, 1)], "qid long, doc_id long, rank long")
    assert ev.hit_rate(ev.relevance(gt, hits)).first()[0] == 1.0


def test_containment_ground_truth_equals_brute_force(spark):
    docs = spark.createDataFrame(
        [(1, "Alpha beta gamma delta."), (2, "xbeta gamma deltax and more"), (3, "beta gamma")],
        "id long, text string")
    items = spark.createDataFrame([(10, "beta gamma delta"), (11, "ta gamma del"),
                                   (12, "nothing here"), (13, "amm"), (14, "."), (15, "amm")],
                                  "qid long, question string")
    got = {(r.qid, r.id) for r in ev.containment_ground_truth(
        items, docs.withColumnRenamed("id", "doc_id")).collect()}
    brute = {(q, str(d)) for q, qt in [(10, "beta gamma delta"), (11, "ta gamma del"), (12, "nothing here"),
                                       (13, "amm"), (14, "."), (15, "amm")]
             for d, dt in [(1, "Alpha beta gamma delta."), (2, "xbeta gamma deltax and more"),
                           (3, "beta gamma")] if qt in dt}
    assert got == brute
