"""Fingerprints and block tables against brute force."""

import random

import xxhash

from talkframe.llm import simhash as S
from talkframe.llm.op2 import with_next


def chained(words):
    """Spark's hash of several strings: each is hashed with the hash before it as seed."""
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return h


def brute(text, shingle=3):
    w = (text or "").split(" ")
    w = [x for x in w if x]
    if not w:
        return 0
    hs = [chained(w[i:i + shingle]) for i in range(len(w) - shingle + 1)] if len(w) >= shingle else [chained([" ".join(w)])]
    fp = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    return fp - (1 << 64) if fp >> 63 else fp


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(S, "RUN", 50)  # texts of several runs
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 2, 3, 7, 49, 53, 400]))), "clash")
            for i in range(60)] + [(100, None, "clash"), (101, "   ", "clash"), (5, None, "clash")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _h string").repartition(3)
    got = {(r.doc_id, r.text): r.fp for r in S.fingerprints(df, ["doc_id", "text"]).collect()}
    assert got == {(i, t): brute(t) for i, t, _ in rows}
    copies = spark.createDataFrame([(1, rows[5][1])] * 9, "doc_id bigint, text string")
    assert [r.fp for r in S.fingerprints(copies, ["doc_id"]).collect()] == [brute(rows[5][1])]
    assert S.fingerprints(df.limit(0), ["doc_id"]).collect() == []


def test_block_tables_find_all_pairs(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    for _ in range(200):
        x = rng.choice(sorted(fps))
        for _ in range(rng.randint(1, 5)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed + signed[:20]] + [(None,)], "fp bigint")
    for radius in (0, 1, 3, 5):
        want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= radius}
        got = [(r.a, r.b) for r in S.neighbours(df, "fp", radius).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_next_document(spark):
    rows = [(i * 7, f"t{i}") for i in range(50)] + [(1_000_000, "far"), (7, "b"), (None, "none"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = sorted((str(i), t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order))
    assert sorted((str(r.doc_id), r.text, r.next_text) for r in with_next(df).collect()) == want
    assert with_next(df.limit(0)).collect() == []
    one = spark.createDataFrame([(1, "x")], "doc_id bigint, text string")
    assert [(r.text, r.next_text) for r in with_next(one).collect()] == [("x", "x")]
