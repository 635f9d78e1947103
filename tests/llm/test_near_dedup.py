"""SimHash near-dedup against brute force."""

import random

import numpy as np
import pytest

from talkframe.llm import near_dedup as nd


def brute(fps):
    """Smallest index per chain of pairs within three bits."""
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if bin(fps[i] ^ fps[j]).count("1") <= 3 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_anchors_cover_every_near_half():
    rng = np.random.default_rng(1)
    half = rng.integers(0, 1 << 32, 400, dtype=np.uint64)
    near = half ^ (np.uint64(1) << rng.integers(0, 32, 400).astype(np.uint64))
    for a, b in ((half, near), (near, half), (half, half)):
        ra, at_a, home = nd.anchors(a)
        rb, at_b, _ = nd.anchors(b)
        sent = set(zip(rb.tolist(), at_b.tolist()))
        assert all((r, x) in sent for r, x, h in zip(ra.tolist(), at_a.tolist(), home) if h)
        counts = np.bincount(ra, minlength=400)
        assert set(counts.tolist()) <= {2, 17}
        assert (np.bitwise_count(at_a ^ a[ra]) <= 2).all()
        assert (np.bitwise_count(at_a ^ a[ra])[home] <= 1).all()


@pytest.mark.parametrize("block", [4, 2048])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, block):
    monkeypatch.setattr(nd, "CELL_BLOCK", block)
    rng = random.Random(7)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(250):  # chains around earlier ones
        x = rng.choice(fps)
        for _ in range(rng.randint(1, 4)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    dense = rng.getrandbits(64)
    fps += [dense ^ (1 << i) for i in range(40)] + [0, 1, (1 << 64) - 1, 7 << 61]
    fps = list(dict.fromkeys(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed] + [(None,)], "fp bigint").repartition(5)
    found = nd.components(nd.links(df)).collect()
    root = {r.vertex: r.root for r in found}
    label = brute(fps)
    for i in range(len(fps)):
        for j in range(i):
            same = root.get(signed[i], signed[i]) == root.get(signed[j], signed[j])
            assert same == (label[i] == label[j])


def test_fingerprint_of_edge_texts():
    assert nd.fingerprint(None, 3) == nd.fingerprint("", 3) == nd.fingerprint(" \t\n", 3) == 0
    import xxhash
    assert nd.fingerprint("A b", 3) == xxhash.xxh64_intdigest("a b", 42)
    h = [xxhash.xxh64_intdigest(t, 42) for t in ("a b c", "b c Ä", "c Ä a")]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 3)
    assert nd.fingerprint("A  b\x0bC Ä a", 3) == want


def test_classes_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(5, "one two three four", 1), (3, "One  two three four", 2), (9, None, 3), (8, "", 4),
            (None, "one two three four", 5), (7, "something else altogether here", 6),
            (5, "one two three four", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp int")
    got = sorted(((r["id"], r["component"]) for r in nd.near_dedup(df).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 8), (8, 8), (None, 3), (7, 7), (5, 3)], key=str)
    assert nd.near_dedup(df.limit(0)).collect() == []
