"""Keyed upserts (I2), Atom feeds (A2) and quarantine of broken files (A1, A2)."""

import json
import os
import random

from talkframe import schemas
from talkframe.sources import files, index_io
from talkframe.streaming import streams

ATOM = """<?xml version="1.0" encoding="utf-8"?><feed xmlns="http://www.w3.org/2005/Atom"><title>Show</title>
<entry><title>Second</title><content>Two</content><updated>2024-09-02T10:00:00Z</updated>
<link rel="alternate" href="http://a/page"/><link rel="enclosure" href="http://a/2.mp3"/></entry>
<entry><title>First</title><summary>One</summary><published>2024-09-01T09:30:00Z</published><updated>2024-09-05T00:00:00Z</updated></entry>
</feed>"""
RSS = """<?xml version="1.0"?><rss><channel><title>S</title><item><title>E</title><description>d</description>
<pubDate>Mon, 02 Sep 2024 10:00:00 +0000</pubDate><enclosure url="http://a/1.mp3"/></item></channel></rss>"""


def _versions(seed):
    rng = random.Random(seed)
    rows = [(f"d{rng.randrange(30)}", f"text {v}", [float(v), 1.0], v, rng.random() < 0.2) for v in range(120)]
    rows += [("d1", "bad", [1.0], 500, False), (None, "no id", [1.0, 2.0], 1, False), ("d2", None, None, 600, True),
             ("new", "no version", [5.0, 5.0], None, None)]
    return rows


def _now(rows):
    last = {}
    for i, text, vector, version, deleted in rows:
        if i is not None and (deleted or (vector and len(vector) == 2)):
            last[i] = max(last.get(i, (-1,)), (version or 0, bool(deleted), text or "", vector or []))
    return sorted((i, t, v) for i, (_, gone, t, v) in last.items() if not gone)


def _read(df):
    return sorted((r.doc_id, r.text, list(r.vector)) for r in df.collect())


def test_replayed_and_reordered_stream_equals_one_load(spark, tmpdir_path):
    rows = _versions(1)
    index_io.write_versions(spark.createDataFrame(rows, schemas.VERSIONED), f"{tmpdir_path}/batch", 2, "one")
    assert _read(index_io.open_current(spark, f"{tmpdir_path}/batch")) == _now(rows)
    assert spark.read.parquet(f"{tmpdir_path}/batch/version_rejects").count() == 2
    random.Random(2).shuffle(rows)
    src, root = f"{tmpdir_path}/in", f"{tmpdir_path}/stream"
    for at in (0, 70):                                            # a restart between them, and a replay of 20 rows
        spark.createDataFrame(rows[max(0, at - 20):at + 70], schemas.VERSIONED).write.mode("append").parquet(src)
        streams.upsert_documents(spark, src, root, f"{tmpdir_path}/ckpt", 2).awaitTermination()
        assert _read(index_io.open_current(spark, root)) == _now(rows[:at + 70])
    assert index_io.open_current(spark, f"{tmpdir_path}/none").count() == 0


def test_atom_and_rss_and_what_is_neither(spark, tmpdir_path):
    for name, text in (("a.xml", ATOM), ("r.xml", RSS), ("bad.xml", "<html><p>no feed</p></html>"), ("empty.xml", "")):
        with open(os.path.join(tmpdir_path, name), "w") as f:
            f.write(text)
    rows = files.read_feeds(spark, tmpdir_path).orderBy("feed_path", "pos")
    got = [(os.path.basename(r.feed_path), r.pos, r.title, r.summary, r.audio_url) for r in rows.collect()]
    assert got == [("a.xml", 0, "Second", "Two", "http://a/2.mp3"), ("a.xml", 1, "First", "One", None), ("r.xml", 0, "E", "d", "http://a/1.mp3")]
    ts = [str(r.t) for r in rows.select(files.published_ts(rows.published_date).alias("t")).collect()]
    assert ts == ["2024-09-02 10:00:00", "2024-09-01 09:30:00", "2024-09-02 10:00:00"]
    assert sorted(os.path.basename(r.file) for r in files.feed_rejects(spark, tmpdir_path).collect()) == ["bad.xml"]


def test_broken_episode_files_are_quarantined(spark, tmpdir_path):
    for name, text in (("good.json", json.dumps({"title": "T", "chunks": [{"id": "1", "text": "a."}]}, indent=1)), ("bad.json", '{"title": "T", ')):
        with open(os.path.join(tmpdir_path, name), "w") as f:
            f.write(text)
    assert [r.title for r in files.read_episodes(spark, tmpdir_path).collect()] == ["T"]
    bad = files.episode_rejects(spark, tmpdir_path).collect()
    assert [os.path.basename(r.file) for r in bad] == ["bad.json"] and '"title"' in bad[0].raw
