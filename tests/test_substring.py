"""Substring joins against plain ``in``."""

import random

import pytest
from pyspark.sql import functions as F

from talkframe.operators import catalog, evaluate, substring


def _names(seed=1):
    rng = random.Random(seed)
    names = ["".join(rng.choice("abé ") for _ in range(rng.randint(0, 12))) for _ in range(150)]
    names += ["Red Fish Talk", "fisherman", "FISH", "Straße 5", "aaaaaaaa", "aaa", "日本語の話", None, "", "  "]
    rows = [(i, n, f"artist {i}") for i, n in enumerate(names)]
    terms = {n[a:a + rng.randint(1, 5)] for n in names if n for a in (rng.randrange(len(n)),)}
    terms |= {"fish", "ISH", "a", "É", "aa", "aaaa", "aaaaaaaaa", "straße", "本語", "zzz", "a%", "_", ".", "\\", "", None, " "}
    return rows, sorted(terms, key=lambda t: (t is None, t))


@pytest.mark.parametrize("bounds", [{}, {"max_broadcast": 0}, {"max_broadcast": 0, "gram_rows": 2}])
def test_term_search_is_substring_search(spark, bounds):
    rows, terms = _names()
    cat = spark.createDataFrame(rows, "collection_id long, collection_name string, artist_name string")
    t = spark.createDataFrame([(x,) for x in terms] + [("fish",)], "term string")
    got = {}
    for r in catalog.term_search(t, cat, 3, **bounds).orderBy("term", "rank").collect():
        got.setdefault(r.term, []).append((r.collection_id, r.status))
        if r.rank is not None:
            assert r.label == f"{rows[r.collection_id][1]} by artist {r.collection_id}" and len(got[r.term]) == r["rank"]
    assert got.keys() == set(terms)
    for term in terms:
        want = [i for i, n, _ in rows if term and n is not None and term.lower() in n.lower()][:3]
        assert got[term] == ([(i, "Success") for i in want] or [(None, "Fail")]), term


def test_empty_catalogue_and_terms(spark):
    cat = spark.createDataFrame([], "collection_id long, collection_name string, artist_name string")
    t = spark.createDataFrame([("a",), ("abc",)], "term string")
    assert {(r.term, r.status) for r in catalog.term_search(t, cat).collect()} == {("a", "Fail"), ("abc", "Fail")}
    assert catalog.term_search(t.limit(0), cat).count() == 0


def _texts(seed=2):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    texts = [text(rng.choice([0, 1, 5, 40, 300, 2000])) for _ in range(60)] + [None, "", "naïve 日本", "aaaa" * 50]
    shared = text(120)
    texts += [text(50) + shared + text(rng.randint(0, 50)) for _ in range(15)]
    items = [shared, shared[3:90], shared[:24], shared[5:28], text(30), "aaaa" * 20, "aaaa" * 51, "日", "é", "ab", "abc", "a\n", None, ""]
    for n in (1, 2, 3, 7, 8, 9, 23, 24, 25, 100, 400):
        for t in rng.sample([t for t in texts if t and len(t) >= n], 3):
            at = rng.randint(0, len(t) - n)
            items.append(t[at:at + n])
    return list(enumerate(texts)), list(enumerate(items))


@pytest.mark.parametrize("bounds", [{}, {"max_grams": 0, "max_candidates": 20}])
def test_text_matches(spark, monkeypatch, bounds):
    texts, items = _texts()
    d = spark.createDataFrame(texts, "id long, text string").withColumn("id", F.col("id").cast("string")).repartition(3)
    i = spark.createDataFrame(items, "qid long, question string")
    want = sorted((q, str(t)) for q, x in items for t, text in texts if x and text and x in text)
    assert sorted(map(tuple, substring.text_matches(i, d, **bounds).collect())) == want
    if not bounds:
        gt = evaluate.containment_ground_truth(i, d.withColumnRenamed("id", "doc_id"))
        assert gt.columns == ["id", "question", "qid"]
        assert sorted((r.qid, r.id) for r in gt.collect()) == want


def test_nothing_to_find(spark):
    d = spark.createDataFrame([("1", "some text"), ("2", None)], "id string, text string")
    for items in ([], [(1, None), (2, "")], [(1, "not there at all, not even in part")]):
        assert substring.text_matches(spark.createDataFrame(items, "qid long, question string"), d).count() == 0
    one = spark.createDataFrame([(1, "text")], "qid long, question string")
    assert substring.text_matches(one, d.limit(0)).count() == 0


@pytest.mark.parametrize("size,window", substring.SAMPLING)
def test_kept_grams_of_a_part_are_kept_of_the_whole(monkeypatch, size, window):
    rng = random.Random(7)
    whole = "".join(rng.choice("abcd ") for _ in range(3000))
    kept = set(substring.kept_grams(whole, size, window).tolist())
    for _ in range(200):
        n = rng.randint(size + window - 1, 90)
        at = rng.randint(0, len(whole) - n)
        part = substring.kept_grams(whole[at:at + n], size, window)
        assert len(part) and set(part.tolist()) <= kept
    assert len(substring.kept_grams("a" * (size + window - 2), size, window)) == 0
    for piece in (1, 7, 100, 2999):
        monkeypatch.setattr(substring, "HASHED_CHARS", piece)
        assert set(substring.kept_grams(whole, size, window).tolist()) == kept
