"""op11_spelling against plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest

from talkframe.llm import spelling as sp
from talkframe.llm.op11 import op11_spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, n long, key string"


def edits(a, b):
    """Edit distance by the full table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def expected(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = {w: [v for v in n if edits(v, w) == 1] for w in n}
    form = {}
    for w, around in near.items():
        best = min(around, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    rows = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return rows


def corpus(seed, letters, words=260):
    rng = random.Random(seed)
    some = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 11))) for _ in range(words // 4)]
    while len(some) < words:
        w = rng.choice(some)
        at, x = rng.randrange(len(w)), rng.choice(letters)
        some.append(rng.choice([w[:at] + w[at + 1:], w[:at] + x + w[at + 1:], w[:at] + x + w[at:]]))
    weights = [rng.choice([1, 1, 5, 30, 200]) for _ in some]
    return [(i, " ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(some, weights, k=150)))
            for i in range(60)]


def run(spark, path, docs):
    spark.createDataFrame([(i, t, 1, "x") for i, t in docs], SCHEMA).write.parquet(f"{path}/documents.parquet")
    out = op11_spelling(spark, str(path))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("letters", ["ab", "abcéÉ"])
def test_query_is_brute_force(spark, tmp_path, letters):
    docs = corpus(len(letters), letters)
    docs += [(None, docs[0][1]), (None, None), (77, None), (78, ""), (79, "12 -- ?"), docs[3], docs[3]]
    want = expected(docs)
    assert len(want) > 50 and (letters != "ab" or any(r[1] for r in want))
    assert run(spark, tmp_path, docs) == want


def test_hot_keys_are_dealt_to_parts(spark, tmp_path, monkeypatch):
    docs = corpus(9, "ab")
    monkeypatch.setattr(sp, "KEY_ROWS", 3)
    assert run(spark, tmp_path, docs) == expected(docs)


def test_long_texts_and_small_counts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sp, "WHOLE_CHARS", 100)
    monkeypatch.setattr(sp, "COUNTED_WORDS", 7)
    docs = corpus(4, "abc", 40) + [(500, "Straßenbahn " * 40_000 + "x" * 50_000)]
    assert run(spark, tmp_path, docs) == expected(docs)


def test_without_words(spark, tmp_path):
    assert run(spark, tmp_path / "a", []) == set()
    assert run(spark, tmp_path / "b", [(1, "one two " * 9), (2, None)]) == set()


def test_chain_and_ties(spark, tmp_path):
    docs = [(1000 + i, w) for w, n in (("mountain", 150), ("mountan", 30), ("montan", 6), ("gardens", 25), ("gardena", 25), ("garden", 5))
            for i in range(n)]
    rows = {r[0]: r for r in run(spark, tmp_path, docs)}
    assert rows == {r[0]: r for r in expected(docs)}
    assert rows["montan"][2] == "mountain" and rows["garden"][1] == "gardena"


def test_pivots_are_the_cheapest_disjoint_pair():
    rng = random.Random(5)
    for _ in range(300):
        places = sorted(rng.sample(range(12), rng.randint(3, 7)))
        cost = [rng.randint(1, 9) for _ in places]
        got = sp.pivots(places, cost)
        price = dict(zip(places, cost))
        best = min(price[a] + price[b] for a in places for b in places if b >= a + 2)
        assert got[0] + 2 <= got[1] and price[got[0]] + price[got[1]] == best


def test_index_of_words_is_never_broadcast(spark, monkeypatch):
    """Spark sizes index and probes by the words alone; a dozen rows a word don't go through the driver."""
    words = [(f"{a}{b}planet{c}", 5) for a in "abcdefgh" for b in "aeiou" for c in "rstu"]
    df = spark.createDataFrame(words, "word string, n long")
    for most in (sp.KEY_ROWS, 1):  # without and with keys that are dealt to parts
        monkeypatch.setattr(sp, "KEY_ROWS", most)
        pairs = sp.near_pairs(df)
        assert pairs.count() > 0
        plan = pairs._jdf.queryExecution().optimizedPlan().toString()
        assert "rightHint=(strategy=merge)" in plan
        joins = [line for line in pairs._jdf.queryExecution().executedPlan().toString().split("\n")
                 if "MergeJoin" in line or "BroadcastHashJoin" in line or "ShuffledHashJoin" in line]
        met = [line for line in joins if "[key#" in line and "levenshtein" in line]
        assert met and all("SortMergeJoin" in line for line in met), joins
