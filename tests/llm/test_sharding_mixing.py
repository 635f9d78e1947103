"""Exact shards and mixes."""

import random
from collections import Counter, defaultdict
from math import comb

import pytest
from pyspark.sql import functions as F

from talkframe.llm import mixing, sharding
from talkframe.llm.op4 import take_mix


def test_hypergeometric_draws_have_the_right_law(spark):
    for total, marked, drawn in ((20, 8, 6), (10, 10, 4), (9, 3, 9), (7, 0, 3), (50, 25, 10)):
        n = 4000
        df = spark.range(n).select(sharding.hypergeometric(
            (F.col("id") + 0.5) / n, *[F.lit(x).cast("long") for x in (total, marked, drawn)]).alias("k"))
        got = Counter(r.k for r in df.collect())
        for k in range(drawn + 1):
            p = comb(marked, k) * comb(total - marked, drawn - k) / comb(total, drawn) if k <= marked and drawn - k <= total - marked else 0
            assert abs(got[k] / n - p) <= 1.01 / n  # u runs evenly over (0, 1)


def test_matrix_has_its_margins(spark):
    counts = [(0, 100), (1, 0), (2, 57), (3, 301), (5, 1)]
    df = spark.createDataFrame([c for c in counts if c[1]], "part bigint, n bigint")
    sizes = [46] * 8 + [45, 46]
    m = {r.part: r.deal for r in sharding.communication_matrix(df, sizes, 3, "s").collect()}
    assert sorted(m) == list(range(8))
    assert [sum(m[p]) for p in range(8)] == [100, 0, 57, 301, 0, 1, 0, 0]
    assert [sum(m[p][j] for p in m) for j in range(10)] == sizes


def test_shards_are_exact_and_agree(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_SLOT_RUN", 16)
    rows = [(i if i % 50 else None, f"t{i % 7}", "x") for i in range(1003)] + [(5, "t5", "x")] * 4
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n string").repartition(5)

    def places(d):
        return sorted((str(r.doc_id), r.text, r["_shard"], r["_slot"]) for r in
                      sharding.shard_rows(d, ["doc_id", "text"], 8, rows_per_partition=64).collect())
    got = places(df)
    by = defaultdict(list)
    for _, _, s, slot in got:
        by[s].append(slot)
    assert sorted(by) == list(range(8))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert sorted((a, b) for a, b, _, _ in got) == sorted((str(a), b) for a, b, _ in rows)
    unique = [x for x in got if x[0] not in ("5", "None")]
    assert unique == [x for x in places(df.repartition(3)) if x[0] not in ("5", "None")]
    assert places(df.limit(0)) == []
    few = sharding.shard_rows(df.limit(3), ["doc_id", "text"], 8).collect()
    assert sorted(r["_slot"] for r in few) == [0, 0, 0]


def fill(sizes, names):
    """Targets by sharing the excess again and again."""
    names = sorted(names, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, free, left = {}, list(names), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_reaches_its_targets(spark, seed):
    rng = random.Random(seed)
    docs = []
    for i in range(1500):
        s = rng.choice(["a"] * 30 + ["b"] * 5 + ["c", "d", "é", None, ""])
        docs.append((i, " ".join(["w"] * rng.choice([0, 1, 5, 20, 80, 200])), s, 1))
    docs += [(9000, None, "a", 1), (None, "w w w", "a", 1), (3, docs[3][1], docs[3][2], 1), (9001, None, "zero", 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, copies int").repartition(4)
    got = mixing.mix(df).collect()
    assert len(got) == len(docs)
    size = lambda t: len((t or "").split())
    total = Counter()
    for _, t, s, _ in docs:
        total[s] += size(t)
    want = fill(total, set(s for _, _, s, _ in docs))
    taken, largest = Counter(), Counter()
    for r in got:
        assert 0 <= r.copies <= 3 and r.source_size == total[r.source]
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] + 1e-6 for s in want)
    again = mixing.mix(df.repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mixing.mix(df.limit(0)).collect() == []


def test_expected_copies_are_kept(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 5), "ab"[i % 2]) for i in range(400)], "doc_id bigint, text string, source string")
    n, by = 30, Counter()
    for k in range(n):
        rate = {}
        for r in mixing.mix(df.filter("doc_id < 60"), seed=f"s{k}").collect():
            by[r.doc_id] += r.copies
            rate[r.doc_id] = r.target / r.source_size
        if k == 4:
            break
    assert abs(sum(by.values()) / 5 - sum(rate.values())) < 3


def test_stage_repeats_whole_documents(spark):
    docs = [(i, "w " * (1 + i % 4), "en", "abc"[min(2, i // 100)], 5) for i in range(230)] + [(7, "w w w w ", "en", "a", 5)] * 3
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = take_mix(spark, df, "")
    assert out.columns == df.columns
    got = Counter(map(tuple, out.collect()))
    ident = F.xxhash64(*[F.col(c) for c in df.columns])
    want = Counter()
    row = {r.h: tuple(r)[:5] for r in df.withColumn("h", ident).collect()}
    for r in mixing.mix(df, doc_id=ident).collect():
        want[row[r.doc_id]] += r.copies
    assert got == +want
