"""Weights of a large vocabulary travel to the tasks as hashes; terms of one document need no row."""

import pytest

from talkframe.operators import sparse

ROWS = [(1, "ab ab cd x1 x2", "t a1"), (1, "ab cd ef x3", "t"), (2, "", None), (None, "cd ef ef gh x4", "uu t"),
        (3, "ab cd ef ij kl x5", "uu"), (4, None, "t x1")]


def _docs(spark):
    return spark.createDataFrame(ROWS, "id long, text string, title string").repartition(3)


def _key(df):
    return sorted((str(r.doc_id), r.field, r.term, r.tf, round(r.w, 9), round(r.norm, 9), round(r.wn, 9), r.title) for r in df.collect())


def test_terms_of_one_document_do_not_count_as_vocabulary(spark):
    docs = spark.createDataFrame(ROWS, "id long, text string, title string")
    idx = sparse.fit(docs, ["text"], ["title"], max_vocabulary=3)   # ab, cd, ef; nine others are in one document
    plan = idx.postings._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    plan = idx.forward._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    got = _key(idx.postings)
    assert got == _key(sparse.fit(docs, ["text"], ["title"], max_vocabulary=0).postings) and len(got) == 18
    assert _key(idx.materialize().postings) == got


@pytest.mark.parametrize("params", [{"min_df": 2}, {"min_df": 2, "max_df": 0.5}, {"max_df": 1}, {"max_df": 0.6, "use_idf": False},
                                    {"min_df": 1.5}, {"max_df": 0.01}, {"sublinear_tf": True, "smooth_idf": False}])
def test_weights_that_travel_are_those_of_the_join(spark, params):
    docs = _docs(spark)
    got, want = (sparse.fit(docs, ["text", "title"], ["title"], params=params, max_vocabulary=n) for n in (100, 0))
    assert got.vocabulary is not None
    assert _key(got.postings) == _key(want.postings)
    norms = lambda idx: sorted((str(r.doc_id), r.title, round(r.norm_0 or 0, 9), round(r.norm_1 or 0, 9)) for r in idx.forward.collect())
    assert norms(got) == norms(want)
    assert sorted(got.idf.collect()) == sorted(want.idf.collect())


def test_terms_of_equal_hash_meet_their_weights_in_a_join(spark, monkeypatch):
    from pyspark.sql import functions as F
    docs = _docs(spark)
    want = _key(sparse.fit(docs, ["text"], ["title"]).postings)
    monkeypatch.setattr(sparse.F, "xxhash64", lambda *c: F.length(F.col(c[0])).cast("bigint"))
    idx = sparse.fit(docs, ["text"], ["title"])
    assert idx.vocabulary is None and _key(idx.postings) == want
