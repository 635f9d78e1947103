"""Noisy-channel decoder and toxicity scores."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest

from talkframe.llm import toxicity as T
from talkframe.llm.op1 import drop_toxic

WORDS = "the of and river mountain garden window little yellow morning silence letter forest bridge".split()


@pytest.fixture(scope="module")
def logp():
    words = Counter({w: 200 for w in WORDS} | {"idiot": 4, "stupid": 4, "loser": 4})
    return T.character_model(T._count_grams(words))


def test_gram_counts_by_brute_force():
    words = Counter({"ab": 3, "été": 2, "x": 1, "жz": 5})
    want = Counter()
    for w, n in words.items():
        s = [0, 0, 0, *T._symbols(w).tolist(), 0]
        for i in range(len(s) - 3):
            code = 0
            for x in s[i:i + 4]:
                code = code * T.SYMBOLS + x
            want[code] += n
    got = T._count_grams(words)
    assert {int(i): int(got[i]) for i in np.flatnonzero(got)} == dict(want)


def test_viterbi_finds_the_best_path(logp):
    d = T.Decoder(logp)

    def score(text, cost):
        s, h = cost, 0
        for c in text:
            if c == " ":
                s, h = s + (float(logp[h, 0]) if h else 0.0), 0
            else:
                x = int(T._symbols(c)[0])
                s, h = s + float(logp[h, x]), h % T.SYMBOLS**2 * T.SYMBOLS + x
        return s + (float(logp[h, 0]) if h else 0.0)
    for token in ("1d10t", "!t0", "l-o5er", "aaab@@", "s7up!d", "st*p"):
        lattice = d._arcs(token)
        best = max(score("".join(x for x, _ in path), sum(c for _, c in path)) for path in itertools.product(*lattice))
        found = d.best(lattice)
        paths = [sum(c for _, c in path) for path in itertools.product(*lattice) if "".join(x for x, _ in path).strip() == found]
        assert max(score(found, c) for c in paths) == pytest.approx(best, abs=1e-4)


def test_disguises_are_undone(logp):
    d = T.Decoder(logp)
    for noisy, plain in {"1d10t": "idiot", "$tup1d": "stupid", "i d i o t": "idiot", "iiidiooot": "idiot",
                         "l.o.s.e.r": "loser", "L0SER!!!": "loser", "st*pid": "stupid", "іdіоt": "idiot",
                         "yellow": "yellow", "(letter),": "letter"}.items():
        assert d.restore(noisy) == plain, noisy
    assert d.restore(None) == d.restore("") == d.restore(" \n") == ""
    assert d.restore("+1 2024 ...") == "+1 2024"
    assert len(d.restore("a1" * 20_000)) >= 20_000


def test_scores_and_stage(spark, tmp_path):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(400):
        text = " ".join(rng.choice(WORDS) + rng.choice(["", "er", "ing", "s"]) for _ in range(40))
        toxic = i % 4 == 0
        if toxic:
            w = rng.choice(["idiot", "stupid", "loser"])
            text += " " + rng.choice([w, w, w, w.replace("i", "1").replace("o", "0"), " ".join(w)])
        docs.append((i, text, "x", 0.5))
        labels.append((i, int(toxic)))
    docs += [(1000, None, "x", 0.5), (1001, "", "x", 0.5), (None, "you 1d10t " + "the " * 5000, "x", 0.5), (0, docs[0][1], "x", 0.5)]
    labels += [(1, None), (None, 1), (5000, 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, score double").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    logp, shares = T.fit(df, lab)
    assert {"idiot$", "stupid$", "loser$"} <= set(shares)
    got = {(r.doc_id, r.text): r.s for r in df.withColumn("s", T.scorer(spark, logp, shares)("text")).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    wrong = [i for i, t, _, _ in docs[:400] if (got[(i, t)] >= T.THRESHOLD) != (i % 4 == 0)]
    assert not wrong
    assert got[(1000, None)] == got[(1001, "")] == 0
    assert got[(None, docs[402][1])] >= T.THRESHOLD
    lab.write.parquet(f"{tmp_path}/labels.parquet")
    kept = drop_toxic(spark, df, str(tmp_path))
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted([i for i in range(400) if i % 4] + [1000, 1001])
    none = T.fit(df.limit(0), lab.limit(0))
    assert none[1] == {} and df.limit(0).withColumn("s", T.scorer(spark, *none)("text")).count() == 0


def test_copies_count_once():
    texts = [(["a", "rare"], [1, 1])] * 50 + [(["a"], [k, k]) for k in range(2, 9)]
    assert T.origins(texts) == {"a": 8, "rare": 1}


def test_doubled_masked_parted_and_accented_words_score(logp):
    s = T.Scorer(logp, {"stupid$": 0.9, "stupi": 0.8, "idiot$": 0.9})
    for noisy in ("stuupid", "sttuppid", "st**id", "s***id", "st#*id!", "s t u p i d", "s  t  u  p  i  d", "s\tt u\n p i d", "stu pid",
                  "you are stu pi d", "(id iot)", "stüpid", "stüpid", "Stüüpid."):
        assert s.score(f"the river {noisy} garden") >= 0.8, noisy
    for clean in ("little yellow letter", "**letter**", "s*****", "#### river", "id the iot", "stu", "st**"):
        assert s.score(f"the river {clean} garden") == 0.0, clean


def test_doubled_letters_of_a_word_meet_their_disguise(logp):
    found = [set(T._token_features(T.Decoder(logp), w)) for w in ("asshat", "ashat", "assshhat")]
    assert "ashat$" in set.intersection(*found)
