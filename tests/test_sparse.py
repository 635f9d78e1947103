import math

import pytest
from pyspark.sql import functions as F

from talkframe.operators import sparse


def tiny(spark):
    return spark.createDataFrame(
        [(1, "red fish", "a", 5), (2, "blue fish fish", "b", 5), (3, "", "a", 6)],
        "id long, text string, lang string, n int")


def expected_scores():
    # idf = ln((1+N)/(1+df)) + 1 with N = 3 (the empty document counts)
    idf = {t: math.log(4 / (1 + df)) + 1 for t, df in {"red": 1, "fish": 2, "blue": 1}.items()}
    d1 = {"red": idf["red"], "fish": idf["fish"]}
    d2 = {"blue": idf["blue"], "fish": 2 * idf["fish"]}
    n1 = math.sqrt(sum(v * v for v in d1.values()))
    n2 = math.sqrt(sum(v * v for v in d2.values()))
    return idf, {"1": d1["fish"] / n1, "2": d2["fish"] / n2}


def test_idf_counts_empty_documents(spark):
    idx = sparse.fit(tiny(spark), ["text"], ["lang"])
    assert idx.n_docs == 3
    idf, _ = expected_scores()
    got = {r.term: r.idf for r in idx.idf.collect()}
    assert got.keys() == idf.keys()
    for t in idf:
        assert got[t] == pytest.approx(idf[t], abs=1e-12)


def test_search_scores_and_order(spark):
    idx = sparse.fit(tiny(spark), ["text"], ["lang"])
    q = spark.createDataFrame([(10, "fish"), (11, "unknown words"), (12, "")],
                              "qid long, query string")
    rows = sparse.search(idx, q, num_results=10).orderBy("qid", "rank").collect()
    _, exp = expected_scores()
    assert [(r.qid, r.doc_id, r.rank) for r in rows] == [(10, "2", 1), (10, "1", 2)]
    for r in rows:
        assert r.score == pytest.approx(exp[r.doc_id], abs=1e-12)


def test_boost_scales_score(spark):
    idx = sparse.fit(tiny(spark), ["text"], [])
    q = spark.createDataFrame([(1, "fish")], "qid long, query string")
    a = {r.doc_id: r.score for r in sparse.search(idx, q).collect()}
    b = {r.doc_id: r.score for r in sparse.search(idx, q, boost_dict={"text": 3.0}).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert b[k] == pytest.approx(3 * a[k])


def test_filter_before_equals_mask_after(spark):
    idx = sparse.fit(tiny(spark), ["text"], ["lang", "n"])
    q = spark.createDataFrame([(1, "fish")], "qid long, query string")
    full = {r.doc_id: r.score for r in sparse.search(idx, q).collect()}
    filt = {r.doc_id: r.score for r in sparse.search(idx, q, filter_dict={"lang": "a"}).collect()}
    assert filt == {"1": full["1"]}          # IDF still from the whole corpus
    # undeclared field is ignored
    ign = {r.doc_id for r in sparse.search(idx, q, filter_dict={"nope": "x"}).collect()}
    assert ign == set(full)
    # type-strict: 5 matches the int column, "5" matches nothing
    assert {r.doc_id for r in sparse.search(idx, q, filter_dict={"n": 5}).collect()} == {"1", "2"}
    assert sparse.search(idx, q, filter_dict={"n": "5"}).count() == 0


def test_topk_edges(spark):
    idx = sparse.fit(tiny(spark), ["text"], [])
    q = spark.createDataFrame([(1, "fish")], "qid long, query string")
    assert sparse.search(idx, q, num_results=0).count() == 0
    assert sparse.search(idx, q, num_results=100).count() == 2   # only positive scores
    same = spark.createDataFrame([(5, "xx yy"), (3, "xx yy"), (4, "xx yy")], "id long, text string")
    idx2 = sparse.fit(same, ["text"], [])
    q2 = spark.createDataFrame([(1, "xx")], "qid long, query string")
    rows = sparse.search(idx2, q2, num_results=2).orderBy("rank").collect()
    assert [r.doc_id for r in rows] == ["3", "4"]      # ties: doc id ascending


def test_unknown_vectorizer_param_raises():
    with pytest.raises(ValueError):
        sparse.TfidfParams.of({"ngram_range": (1, 2)})


def test_min_df_and_sublinear(spark):
    idx = sparse.fit(tiny(spark), ["text"], [], params={"min_df": 2, "sublinear_tf": True})
    assert [r.term for r in idx.idf.collect()] == ["fish"]
    p = {r.doc_id: r.tf for r in idx.postings.collect()}
    assert p == {"1": 1.0, "2": 2.0}
    w = {r.doc_id: r.w for r in idx.postings.collect()}
    idf = math.log(4 / 3) + 1
    assert w["2"] == pytest.approx((1 + math.log(2)) * idf)


def test_multifield_sum(spark):
    docs = spark.createDataFrame([(1, "red fish", "sea"), (2, "blue", "fish sea")],
                                 "id long, text string, source string")
    idx = sparse.fit(docs, ["text", "source"], [])
    q = spark.createDataFrame([(1, "fish")], "qid long, query string")
    rows = {r.doc_id: r.score for r in sparse.search(idx, q, boost_dict={"text": 2.0}).collect()}
    one_t = sparse.fit(docs, ["text"], [])
    one_s = sparse.fit(docs.withColumnRenamed("source", "s").withColumnRenamed("text", "t")
                       .withColumnRenamed("s", "text"), ["text"], [])
    t = {r.doc_id: r.score for r in sparse.search(one_t, q).collect()}
    s = {r.doc_id: r.score for r in sparse.search(one_s, q).collect()}
    for d in rows:
        assert rows[d] == pytest.approx(2.0 * t.get(d, 0) + s.get(d, 0))


def test_permuting_input_changes_nothing(spark):
    docs = tiny(spark)
    q = spark.createDataFrame([(1, "fish red")], "qid long, query string")
    a = sparse.search(sparse.fit(docs, ["text"], []), q).collect()
    b = sparse.search(sparse.fit(docs.orderBy(F.desc("id")).repartition(3), ["text"], []),
                      q).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_field_both_text_and_keyword(spark):
    docs = spark.createDataFrame([(1, "red fish", "news"), (2, "blue fish", "sport")],
                                 "id long, text string, source string")
    idx = sparse.fit(docs, ["text", "source"], ["source"])
    q = spark.createDataFrame([(1, "fish news")], "qid long, query string")
    rows = sparse.search(idx, q, filter_dict={"source": "news"}).collect()
    assert [r.doc_id for r in rows] == ["1"]


def _corpus(seed=3, docs=300):
    """Documents with a few very common words, some of middling frequency and many rare ones."""
    import random
    rng = random.Random(seed)
    common, middle = [f"com{i}" for i in range(9)], [f"mid{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(rng.choices([common, middle, [f"rare{rng.randrange(900)}"]], [5, 3, 2])[0])
                              for _ in range(n))
    rows = [(i, text(rng.randint(0, 80)), rng.choice(["xx yy", "yy", "com1 xx", ""]), rng.choice("ab")) for i in range(docs)]
    rows += [(docs + i, rows[7][1], rows[7][2], "a") for i in range(20)]          # copies tie
    queries = [(i, text(rng.randint(1, 25))) for i in range(25)] + [(90, ""), (91, "unknown"), (92, rows[7][1]), (93, None)]
    return rows, queries


def _brute(rows, queries, fields, k, boosts, sublinear=False, keep=lambda r: True):
    import re
    from collections import Counter
    token = lambda t: re.findall(r"\w{2,}", (t or "").lower())
    out = {q: Counter() for q, _ in queries}
    tfw = (lambda n: 1 + math.log(n)) if sublinear else (lambda n: n)
    for f in fields:
        tf = [Counter(token(r[f])) for r in rows]
        df = Counter(t for c in tf for t in c)
        idf = {t: math.log((1 + len(rows)) / (1 + n)) + 1 for t, n in df.items()}

        def unit(c):
            w = {t: tfw(n) * idf[t] for t, n in c.items() if t in idf}
            n = math.sqrt(sum(x * x for x in w.values()))
            return {t: x / n for t, x in w.items()}
        docs = [unit(c) for c in tf]
        for q, text in queries:
            for t, x in unit(Counter(token(text))).items():
                for r, d in zip(rows, docs):
                    if t in d and keep(r):
                        out[q][str(r[0])] += x * d[t] * boosts.get(f, 1.0)
    return {q: sorted(((d, s) for d, s in c.items() if s > 0), key=lambda x: (-round(x[1], 6), x[0]))[:k] for q, c in out.items()}


@pytest.mark.parametrize("k,own,shared,cells", [(10, 128, 64, 1 << 21), (4, 3, 2, 500)])
def test_pruned_search_is_exact(spark, monkeypatch, k, own, shared, cells):
    monkeypatch.setattr(sparse, "OWN_SLOTS", own)
    monkeypatch.setattr(sparse, "SHARED_SLOTS", shared)
    monkeypatch.setattr(sparse, "CELLS_AT_ONCE", cells)
    rows, queries = _corpus()
    docs = spark.createDataFrame(rows, "id long, text string, title string, lang string").repartition(3)
    q = spark.createDataFrame(queries, "qid long, query string")
    own_pattern = {"sublinear_tf": True, "token_pattern": r"[a-z0-9]{2,}"}
    # weights travel to the tasks, or meet the postings in a join
    for params, flt, vocabulary in (({}, None, 10_000), (own_pattern, {"lang": "a"}, 10_000), (own_pattern, {"lang": "a"}, 0)):
        idx = sparse.fit(docs, ["text", "title"], ["lang"], params=params, max_vocabulary=vocabulary)
        want = _brute(rows, queries, [1, 2], k, {1: 3.0}, bool(params), lambda r: not flt or r[3] == "a")
        for blocks in (sparse.MAX_BROADCAST_QUERY_TERMS, 150)[:1 if flt else 2]:
            got = {i: [] for i, _ in queries}
            for r in sparse.search(idx, q, filter_dict=flt, boost_dict={"text": 3.0}, num_results=k,
                                   max_broadcast_rows=blocks).orderBy("qid", "rank").collect():
                got[r.qid].append((r.doc_id, r.score))
            assert {i: [d for d, _ in v] for i, v in got.items()} == {i: [d for d, _ in v] for i, v in want.items()}
            for i in got:
                assert [s for _, s in got[i]] == pytest.approx([s for _, s in want[i]], abs=1e-9)


def test_search_completes_few_pairs(spark):
    rows, queries = _corpus(5, 2000)
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows], "id long, text string").repartition(2)
    q = spark.createDataFrame(queries, "qid long, query string")
    work = sparse.search_work(sparse.fit(docs, ["text"], []), q, num_results=5).first()
    assert 0 < work.completed < 0.1 * work.pairs


def test_bounds_hold():
    import numpy as np
    rng = np.random.default_rng(1)
    w = rng.random((50, 30)) * (rng.random((50, 30)) < 0.4)
    slots = np.r_[np.arange(sparse.OWN_SLOTS)][:30]
    slots = np.where(np.arange(30) < 5, np.arange(30), 5 + (np.arange(30) - 5) % 4)
    old = sparse.OWN_SLOTS
    try:
        sparse.OWN_SLOTS = 5
        s = sparse._norms_by_slot(w, slots, 9)
    finally:
        sparse.OWN_SLOTS = old
    assert (s @ s.T + 1e-12 >= w @ w.T).all()
    assert np.allclose(s[:, :5], w[:, :5])


@pytest.mark.parametrize("frequent", [0, 3, 1000])
def test_postings_of_frequent_terms_are_not_shuffled(spark, monkeypatch, frequent):
    rows = [(1, "ab ab cd x1"), (1, "ab cd ef"), (2, ""), (None, "cd ef ef gh"), (3, "ab cd ef ij kl"), (4, None)]
    docs = spark.createDataFrame(rows, "id long, text string")
    want = sparse.fit(docs, ["text"]).postings
    monkeypatch.setattr(sparse, "FREQUENT_TERMS", frequent)
    monkeypatch.setattr(sparse, "COUNTED_CHARS", 1)
    got = sparse.fit(docs, ["text"], max_vocabulary=0).postings
    key = lambda df: sorted((str(r.doc_id), r.term, r.tf, round(r.w, 9), round(r.norm, 9), round(r.wn, 9)) for r in df.collect())
    assert key(got) == key(want) and got.count() == 14
