"""The pipeline's stages against plain Python, each on what the one before it kept."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import tiktoken
from test_line_dedup import edit, expected
from test_near_dedup import brute

import corpus_pipeline
from talkframe.llm import bpe, mixing
from talkframe.llm import near_dedup as nd
from talkframe.llm import toxicity as T

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "the of and river mountain garden window little yellow morning silence letter forest bridge".split()


def make(path, spark):
    rng = random.Random(12)
    sentence = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "s", "er", "ing"]) for _ in range(n))
    docs, labels = [], []
    for i in range(160):
        lines = [sentence(rng.randint(6, 20)) for _ in range(rng.randint(1, 4))]
        toxic = i % 4 == 0
        if toxic:
            lines[0] += " " + rng.choice(["moron", "m0r0n", "m o r o n", "moron"])
        docs.append([i, "\n".join(lines)])
        labels.append((i, int(toxic)))
    for i in range(160, 200):  # copies, near copies and shared lines of earlier documents
        old = docs[rng.choice([1, 2, 3, 5, 6, 7])][1]
        docs.append([i, rng.choice([old, edit(rng, old, 1), old + "\n" + sentence(9), old.upper()])])
    docs += [[300, None], [301, ""], [302, "x"], [None, sentence(5)]]
    rows = [(i, t, "en", "ab"[(i or 0) % 2], len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{path}/labels.parquet")


def test_stages(spark, tmp_path):
    make(tmp_path, spark)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "mixing", "encoding"]
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    def step(name):
        nonlocal docs
        before = docs.collect()
        out = stages[name](spark, docs, str(tmp_path))
        if name != "encoding":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        return before, docs.collect()

    scorer = T.Scorer(*T.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")))
    before, after = step("toxicity")
    assert Counter(map(tuple, after)) == Counter(tuple(r) for r in before if scorer.score(r.text) < T.THRESHOLD)
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == set(range(0, 160, 4))

    before, after = step("line_dedup")
    last = 10**6  # a null id comes last
    want = expected([(last if r.doc_id is None else r.doc_id, r.text) for r in before])
    assert {last if r.doc_id is None else r.doc_id: r.text for r in after} == want
    assert all(r.n_chars == len(r.text) if r.text is not None else r.n_chars is None for r in after)
    assert len(before) == len(after)

    before, after = step("near_dedup")
    known = sorted((r for r in before if r.doc_id is not None), key=lambda r: r.doc_id)
    label = brute([nd.fingerprint(r.text, 3) for r in known])
    want = Counter(tuple(r) for k, r in enumerate(known) if label[k] == k) + Counter(tuple(r) for r in before if r.doc_id is None)
    assert Counter(map(tuple, after)) == want

    before, after = step("mixing")
    rows = Counter(map(tuple, after))
    assert set(rows) <= set(map(tuple, before)) and max(rows.values()) <= mixing.MAX_COPIES
    taken, goal = Counter(), {}
    for r in after:
        taken[r.source] += len((r.text or "").split())
    for r in mixing.mix(spark.createDataFrame(before, SCHEMA)).collect():
        goal[r.source] = r.target
    most = max(len((r.text or "").split()) for r in before)
    assert all(abs(taken[s] - goal[s]) <= most for s in goal)

    before, after = step("encoding")
    full = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks=bpe.load_ranks(
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    want = Counter()
    for r in before:
        ids = full.encode_ordinary(r.text or "")
        want[(r.doc_id, len(ids), hashlib.sha256((r.text or "").encode()).hexdigest(), tuple(ids))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.decoded_sha256, tuple(r.ids)) for r in after) == want


def test_empty_documents(spark, tmp_path):
    make(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).collect() == []
