"""WARC archives: round trips and salvage."""

import glob
import gzip

from talkframe.llm import warc


def build(n, plain=()):
    parts, at, spans = [], 0, []
    for i in range(n):
        raw = warc.record("response", f"urn:page:{i}", "2024-01-01T00:00:00Z", b"HTTP/1.1 200 OK\r\n\r\n" + b"<p>%d WARC/1.0\r\n" % i * (i + 1))
        data = raw if i in plain else warc.member(raw)
        parts.append(data)
        spans.append((at, at + len(data)))
        at += len(data)
    return b"".join(parts), spans


def ids(data):
    return [h["warc-record-id"] for _, _, h, _, g in warc.salvage(data) if h is not None]


def covered(data):
    """The rows cover every byte but for empty members."""
    at = 0
    for s, e, head, _, gap in warc.salvage(data):
        assert s == at or not gzip.decompress(data[at:s])
        assert (head is None) == (gap is not None)
        at = e
    assert at == len(data) or not gzip.decompress(data[at:])


def test_damage_costs_only_the_damaged_records():
    for plain in ((), (1, 4), tuple(range(8))):
        data, spans = build(8, plain)
        name = lambda *lost: [f"<urn:page:{i}>" for i in range(8) if i not in lost]
        assert ids(data) == name()
        for k in range(8):
            s, e = spans[k]
            mid = (s + e) // 2
            hit = e - 6 if k in plain else mid  # headers of plain records have no checksum
            flipped = data[:hit] + bytes([data[hit] ^ 0x55]) + data[hit + 1:]
            cut = data[:mid] + data[e - 3:]
            for broken in (flipped, cut, data[:s] + b"junk\x1f\x8b\x08junk WARC/1.1 junk" + data[s:]):
                found = ids(broken)
                assert set(name(k)) <= set(found) | {f"<urn:page:{k}>"}
                covered(broken)
            assert name(k) == [x for x in ids(flipped)]
            gaps = [(a, b) for a, b, h, _, g in warc.salvage(flipped) if g]
            assert gaps and all(s <= a and b <= e for a, b in gaps)
        s, e = spans[-1]
        assert ids(data[:e - 5]) == name(7)
        assert ids(data[3:]) == name(0)
    assert list(warc.salvage(b"")) == []
    assert [(a, b, bool(g)) for a, b, _, _, g in warc.salvage(b"no archive")] == [(0, 10, True)]


def test_digest_failures_are_gaps():
    raw = warc.record("response", "urn:page:1", "d", b"HTTP/1.1 200 OK\r\n\r\nabc").replace(b"abc", b"abd")
    for data in (raw, warc.member(raw)):
        good = warc.member(warc.record("metadata", "urn:x", "d", b"x"))
        rows = list(warc.salvage(data + good))
        assert [(a, b, g) for a, b, _, _, g in rows] == [(0, len(data), "block digest"), (len(data), len(data) + len(good), None)]


def test_members_end_with_a_zero_byte():
    for n in (0, 1, 1000, (1 << 24) + 5):
        data = b"x" * n
        out = warc.member(data, 1)
        assert out[-1] == 0 and gzip.decompress(out) == data


def test_round_trip_of_pages(spark, tmp_path):
    rows = [(3, "http://a/x y", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "u\nv", None), (5, "u", ""), (None, "n", "<p>é</p>"),
            (7, "u", "\0\x1f\x8b\x08 WARC/1.1\r\n\r\n" * 2000), (1, None, "<p>é</p>"), (None, "n", "only")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, page string").repartition(3)
    path = f"{tmp_path}/warc"
    warc.write_pages(df, path, least_bytes=0)
    found = warc.read_archives(spark, path, payloads=True)
    assert warc.gaps(found).count() == 0
    pages = found.filter("record_type <> 'warcinfo'").select(warc.page_of("record_id").alias("p"), warc.page_of("refers_to").alias("r"), "*").collect()
    first = {"<p>é</p>": 1, "": 2}
    want = []
    for p, _, h in rows:
        h = h or ""
        rev = h in first and p != first[h]
        want.append((str(p), len(h.encode()), warc.digest(h.encode()), "revisit" if rev else "response", first[h] if rev else None, None if rev else h.encode()))
    got = [(str(r.p), r.payload_bytes, r.payload_digest, r.record_type, r.r, None if r.payload is None else bytes(r.payload)) for r in pages]
    assert sorted(got, key=str) == sorted(want, key=str)
    # a longer payload alone is deduplicated from a bound on
    warc.write_pages(df, f"{tmp_path}/b", least_bytes=9)
    kinds = warc.read_archives(spark, f"{tmp_path}/b").filter("record_type <> 'warcinfo'").groupBy("record_type").count().collect()
    assert {r[0]: r[1] for r in kinds} == {"response": 6, "revisit": 2}
    # damage one file on disk: its other records stay
    name = max(glob.glob(f"{path}/part-*"), key=lambda f: len(open(f, "rb").read()))
    data = bytearray(open(name, "rb").read())
    data[len(data) - 40] ^= 0xFF
    (tmp_path / "hurt").mkdir()
    (tmp_path / "hurt" / "a.warc.gz").write_bytes(bytes(data))
    hurt = warc.read_archives(spark, f"{tmp_path}/hurt")
    assert warc.gaps(hurt).count() == 1 and hurt.count() > 1
    warc.write_pages(df.limit(0), f"{tmp_path}/empty")
    assert warc.read_archives(spark, f"{tmp_path}/empty").filter("record_type <> 'warcinfo'").count() == 0
