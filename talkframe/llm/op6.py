"""op6_byte_bpe: every document encoded to token ids and decoded again."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Encoder, decode_stream, load_ranks
from .common import per_worker, table

# ids that one batch of rows hands on at a time
BATCH_TOKENS = 1 << 19
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _encoder(vocabulary: str, pattern: str | None) -> Encoder:
    import public_tokenizers
    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    return per_worker(f"bpe {path} {pattern}", lambda: Encoder(load_ranks(path), pattern or public_tokenizers.PATTERN))


def encode_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                     vocabulary: str = VOCABULARY, pattern: str | None = None,
                     keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]): one row per row of ``docs``.

    ``vocabulary`` is a path to a file of ranks that every worker can open, or the name of an
    installed public one. A null or empty text has no tokens. Null ids and repeated rows pass
    through; other columns are ignored; no rows are shuffled. A text is worked on as a whole; the
    kept pieces, states and pairs of a worker are bounded in number.
    """
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(vocabulary, pattern)
        token = enc.fst.token
        for b in batches:
            first, counts, digests, backs, held, tokens = 0, [], [], [], [], 0
            for row, t in enumerate(b.column(1)):
                ids = enc.encode(t.as_py() or "")
                back = hashlib.sha256()
                for part in decode_stream(ids, token):
                    back.update(part.encode())
                counts.append(len(ids))
                digests.append(hashlib.sha256(enc.joined(ids).encode()).hexdigest())
                backs.append(back.hexdigest())
                if keep_ids:
                    held.append(np.array(ids, np.int32))
                    tokens += len(ids)
                if tokens >= BATCH_TOKENS or row == len(b) - 1:
                    arrays = [b.column(0).slice(first, len(counts)), pa.array(counts, pa.int64()), pa.array(digests), pa.array(backs)]
                    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                    if keep_ids:
                        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                        arrays.append(pa.ListArray.from_arrays(ends, np.concatenate(held)))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(arrays, names=names)
                    first, counts, digests, backs, held, tokens = row + 1, [], [], [], [], 0

    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, schema + (", ids array<int>" if keep_ids else ""))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of documents."""
    return encode_documents(table(spark, sf_dir, "documents"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: every document with its token ids."""
    return encode_documents(docs, keep_ids=True)
