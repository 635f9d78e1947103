"""Byte-level BPE against tiktoken."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from talkframe.llm import bpe
from talkframe.llm.op6 import encode_documents


@pytest.fixture(scope="module", params=["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def pair(request):
    ranks = bpe.load_ranks(public_tokenizers.path(request.param))
    return (bpe.Encoder(ranks, public_tokenizers.PATTERN),
            tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))


def texts():
    rng = random.Random(9)
    signs = "abcdeghinorstu  \n\t'.,1290üßñé—²½\xa0\x85\x1c漢字かな🙂🏽عين"
    yield from ["", " ", "\n\n  x", "don't we'll I'M", "<|endoftext|>", "a" * 5000, "ab" * 9000 + "ü🙂" * 3000]
    for _ in range(1500):
        yield "".join(rng.choice(signs) for _ in range(rng.randint(1, 40)))


def test_ids_agree_and_decode(pair, monkeypatch):
    enc, known = pair
    monkeypatch.setattr(bpe, "FLUSH", 300)
    monkeypatch.setattr(bpe, "DECODE_BLOCK", 3)
    for t in texts():
        ids = enc.encode(t)
        assert ids == known.encode_ordinary(t), ascii(t[:60])
        assert "".join(bpe.decode_stream(ids, enc.fst.token)) == t


def test_bounded_tables_change_nothing(pair, monkeypatch):
    _, known = pair
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    monkeypatch.setattr(bpe, "MAX_STATES", 40)
    monkeypatch.setattr(bpe, "MAX_PAIRS", 10)
    small = bpe.Encoder(ranks, public_tokenizers.PATTERN, max_pieces=5)
    full = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for t in list(texts())[:300]:
        assert small.encode(t) == full.encode_ordinary(t)


def test_truncated_streams(pair):
    enc, _ = pair
    ids = enc.fst.encode("é".encode()[:1])
    with pytest.raises(UnicodeDecodeError):
        list(bpe.decode_stream(ids, enc.fst.token))
    assert "".join(bpe.decode_stream(ids, enc.fst.token, "replace")) == "�"


def test_documents(spark):
    rows = [(1, "Hello world", 5), (2, None, 6), (3, "", 7), (None, "x", 8), (1, "Hello world", 5), (4, "öä " * 9000, 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks=bpe.load_ranks(
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((str(i), len(ids := known.encode_ordinary(t or "")), sha(",".join(map(str, ids))), sha(t or ""), ids) for i, t, _ in rows)
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in encode_documents(df, keep_ids=True).collect())
    assert got == want
    assert encode_documents(df.limit(0)).collect() == []
