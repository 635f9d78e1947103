import pytest

from talkframe.operators import chat, ordered, topics, transcript
from talkframe.operators.media import download_manifest, segment_plan


def test_transcript_parts_in_reverse_order(spark):
    parts = spark.createDataFrame(
        [(7, 2, "Six. Seven. Eight. Nine. Ten. Eleven."), (7, 1, "One. Two. Three. Four. Five.")],
        "ep long, part long, text string")
    ch = transcript.renumber_chunks(parts, "ep", "part", "text").collect()
    ids = {r.id: r.text for r in ch}
    assert len(ch) == 11
    assert ids["1"] == "One." and ids["9"] == "Nine." and ids["10"] == "Ten."
    assert ids["11"] == "Eleven."
    c = transcript.concat_transcript(parts, "ep", "part", "text").first()
    assert c.text == " One. Two. Three. Four. Five. Six. Seven. Eight. Nine. Ten. Eleven."


def test_ordered_helpers_with_small_blocks(spark):
    rows = [(g, i, (i * 7) % 5) for g in (1, 2) for i in range(23)]
    df = spark.createDataFrame(rows, "g long, o long, n long")
    got = {(r.g, r.o): r.offset for r in ordered.ordered_offsets(df, "g", "o", "n", 4).collect()}
    for g in (1, 2):
        acc = 0
        for i in range(23):
            assert got[(g, i)] == acc
            acc += (i * 7) % 5
    txt = spark.createDataFrame([(1, i, f"w{i}") for i in range(10)], "g long, o long, t string")
    c = ordered.ordered_concat(txt, "g", "o", "t", "-", block=3).first()
    assert c.text == "-".join(f"w{i}" for i in range(10))


def test_chat_pairs_and_replay(spark):
    log = spark.createDataFrame(
        [(1, 0, "system", "be nice"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"),
         (1, 3, "user", "bye"), (2, 0, "user", "q"), (2, 1, "user", "q2")],
        "conv_id long, turn long, role string, text string")
    p = {(r.conv_id, r.turn): r.answer for r in chat.chat_pairs(log).collect()}
    assert p == {(1, 1): "hello", (1, 3): None, (2, 0): None, (2, 1): None}
    t = {r.conv_id: r.transcript for r in chat.chat_transcript(log).collect()}
    assert t[1] == "system: be nice\nuser: hi\nassistant: hello\nuser: bye"


def test_topics_rank_and_pivot(spark):
    m = [("A", "x", 1.0), ("A", "x", 1.0), ("A", "y", 0.5), ("A", "y", 2.0), ("A", "z", 0.1)]
    m += [("B", f"t{i:02d}", 1.0) for i in range(16)]
    df = spark.createDataFrame(m, "label string, text string, score double")
    ranked = topics.rank_in_label(topics.topic_stats(df))
    tw = {r.label: r.words for r in topics.top_words(ranked).collect()}
    # equal counts: higher total score first
    assert tw["A"] == ["y", "x", "z"]
    assert len(tw["B"]) == 15 and tw["B"][0] == "t00"
    pv = topics.pivot(ranked, ["A", "B", "C"]).orderBy("rank").collect()
    assert len(pv) == 15
    assert pv[3].A == "" and pv[3].C == ""
    empty = spark.createDataFrame([], "label string, text string, score double")
    assert topics.pivot(topics.rank_in_label(topics.topic_stats(empty)), ["A"]).count() == 0


def test_extract_entities_default_rules(spark):
    df = spark.createDataFrame([(1, "Alice met Bob in 2024 and 7 more")], "id long, t string")
    got = sorted((r.label, r.text) for r in topics.extract_entities(df, "id", "t").collect())
    assert got == [("Capitalized", "Alice"), ("Capitalized", "Bob"), ("Number", "2024"),
                   ("Number", "7")]


def test_segments(spark):
    m = spark.createDataFrame([(1, 10, "./audio/x/episode_0.mp3")],
                              "media_id long, length_ms long, path string")
    rows = segment_plan(m, 3).orderBy("part").collect()
    assert [(r.start_ms, r.end_ms) for r in rows] == [(0, 3), (3, 6), (6, 10)]
    assert rows[0].part_path == "./audio/x/episode_0_part_1.mp3"


def test_manifest(spark):
    df = spark.createDataFrame([(1, "My Show: Ep. 1")], "k long, name string")
    r = download_manifest(df, "k", "name").first()
    assert r.path == "./audio/My_Show-_Ep_1/episode_0.mp3" and r.status == "planned"


def test_latest_entry_and_lookup(spark):
    from talkframe.operators.catalog import latest_entry, lookup, term_search
    pods = spark.createDataFrame([(1,), (2,)], "pid long")
    entries = spark.createDataFrame([(1, 5, "later"), (1, 3, "first")],
                                    "pid long, pos long, title string")
    got = {r.pid: (r.title, r.status) for r in latest_entry(pods, entries, "pid", "pos").collect()}
    assert got == {1: ("first", "Success"), 2: (None, "Fail")}
    cat = spark.createDataFrame([(1, "Red Fish Talk", "Ann"), (2, "Fish Stories", "Bo"),
                                 (3, "Red Fish Daily", "Cy"), (4, "red fish", "Di")],
                                "collection_id long, collection_name string, artist_name string")
    terms = spark.createDataFrame([("red fish",), ("nothing",)], "term string")
    rows = term_search(terms, cat, 3).orderBy("term", "rank").collect()
    assert [(r.term, r.collection_id, r.status) for r in rows] == [
        ("nothing", None, "Fail"), ("red fish", 1, "Success"), ("red fish", 3, "Success"),
        ("red fish", 4, "Success")]
    assert rows[1].label == "Red Fish Talk by Ann"
    ids = spark.createDataFrame([(2,), (9,)], "podcast_id long")
    lk = {r.podcast_id: r.status for r in lookup(ids, cat).collect()}
    assert lk == {2: "Success", 9: "Fail"}


def test_tagger_keeps_the_heaviest_matches_without_overlap(spark):
    import itertools
    import random

    from talkframe.operators import tagger
    rng = random.Random(4)
    words = "red blue old new York town Hall of é1".split()
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 14))).replace(" of ", ", of ")) for i in range(40)]
    texts += [(90, None), (91, ""), (92, "?!")]
    table = [("City", "new YORK"), ("Place", "new-york"), ("Place", "York town hall"), ("Hall", "town hall of"), ("Colour", "red"),
             ("Colour", "blue red"), ("Word", "é1"), ("Old", "old old"), (None, "red blue"), ("No", None), ("No", " ., ")]
    tokens = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    known = {}
    for label, p in table:
        if label and tokens(p):
            known.setdefault(" ".join(tokens(p)), set()).add(label)
    docs = spark.createDataFrame(texts, "id long, t string")
    for most in (10, 0):
        got = {}
        for r in tagger.tag_phrases(docs, "id", "t", spark.createDataFrame(table, "label string, phrase string"), max_broadcast=most).collect():
            got.setdefault(r.id, {}).setdefault((r.start, r.text), set()).add(r.label)
        for i, t in texts:
            w = tokens(t)
            spans = [(s, s + n) for n in (1, 2, 3) for s in range(len(w) - n + 1) if " ".join(w[s:s + n]) in known]
            mine = got.get(i, {})
            cover = sorted((s, s + len(g.split())) for s, g in mine)
            assert all(a[1] <= b[0] for a, b in zip(cover, cover[1:])) and set(cover) <= set(spans)
            assert all(labels == known[g] for (_, g), labels in mine.items())
            best = max(sum((e - s) ** 2 for s, e in c) for k in range(len(spans) + 1) for c in itertools.combinations(sorted(spans), k)
                       if all(a[1] <= b[0] for a, b in zip(c, c[1:]))) if len(spans) <= 12 else None
            assert best is None or sum((e - s) ** 2 for s, e in cover) == best
    assert tagger.tag_phrases(docs, "id", "t", spark.createDataFrame([], "label string, phrase string")).count() == 0
