"""Batch inference hooks (J1, J3, J4): the Spark side of model calls.

A hook is a plain Python callable the caller provides (a sentence encoder, an LLM client, a
speech recogniser). Spark handles batching through Arrow, one model load per Python worker
(the callable is built lazily by a factory), the output schema and per-row errors. Every hook
has a deterministic, model-free default elsewhere in the package (hashed encoder,
extractive answer); there is none for transcription.
"""

from __future__ import annotations

import sys
import types
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

def _model(factory: Callable, name: str | None = None):
    """The model of ``factory``, built once per Python worker.

    Functions of this package travel by value, so a global of this module is new in every task;
    models are kept in a module of the worker's own instead, under the caller's ``name`` (or
    the factory's module, name and code).
    """
    kept = sys.modules.setdefault("_talkframe_models", types.ModuleType("_talkframe_models")).__dict__
    code = getattr(factory, "__code__", None)
    key = name or f"{getattr(factory, '__module__', '')}.{getattr(factory, '__qualname__', '')} {hash(code)}"
    if key not in kept:
        kept[key] = factory()
    return kept[key]


def _in_batches(fn: Callable, texts: list, batch_size: int, *more) -> tuple[list, list]:
    """(results, errors) of ``fn`` over batches: a batch that fails or returns another number
    of results than texts has NULL results and the error, and shifts nothing."""
    out, errors = [], []
    for i in range(0, len(texts), batch_size):
        part = texts[i:i + batch_size]
        try:
            res = list(fn(part, *more))
            if len(res) != len(part):
                raise ValueError(f"{len(res)} results for {len(part)} texts")
            out += res
            errors += [None] * len(part)
        except Exception as e:  # noqa: BLE001 - reported per row
            out += [None] * len(part)
            errors += [repr(e)] * len(part)
    return out, errors


def encode(df: DataFrame, text_col: str, out: str, factory: Callable[[], Callable],
           dims: int | None = None, batch_size: int = 32, error: str | None = None) -> DataFrame:
    """``factory()`` returns ``fn(list[str]) -> list[list[float]]``; vectors are cut to
    ``dims`` (B7, no renormalising) when given. Rows of a failing batch get a NULL vector, and
    the error in the column ``error`` if one is named."""

    @pandas_udf("vector array<float>, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fn = _model(factory)
        for texts in batches:
            vals, errors = _in_batches(fn, texts.fillna("").tolist(), batch_size)
            vals = [None if v is None else list(v)[:dims] if dims else list(v) for v in vals]
            yield pd.DataFrame({"vector": pd.Series(vals, dtype=object), "error": pd.Series(errors, dtype=object)})

    got = df.withColumn("_encoded", run(F.col(text_col)))
    got = got.withColumn(out, F.col("_encoded.vector"))
    return (got.withColumn(error, F.col("_encoded.error")) if error else got).drop("_encoded")


def entities(df: DataFrame, key: str, text: str, labels: list, factory: Callable[[], Callable],
             batch_size: int = 32) -> DataFrame:
    """``factory()`` returns ``fn(list[str], labels) -> list[list[(label, text, score)]]``, a
    model that looks for the user's labels.

    Returns (key, label, text, score, error): a row per mention, and one with only the error for
    each text of a failing batch (``topics.topic_stats`` takes those without an error).
    """
    kind = dict(df.dtypes)[key]

    def run(batches):
        fn = _model(factory)
        for pdf in batches:
            found, errors = _in_batches(fn, pdf["_text"].fillna("").tolist(), batch_size, labels)
            rows = []
            for k, mentions, e in zip(pdf["_key"], found, errors):
                rows += [(k, None, None, None, e)] if e else [(k, lb, t, float(s), None) for lb, t, s in mentions]
            yield pd.DataFrame(rows, columns=[key, "label", "text", "score", "error"]).astype(
                {"label": object, "text": object, "score": "float64", "error": object})

    return df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInPandas(
        run, f"{key} {kind}, label string, text string, score double, error string")


def transcribe(segments: DataFrame, factory: Callable[[], Callable]) -> DataFrame:
    """``factory()`` returns ``fn(path, start_ms, end_ms) -> (chunks: list[str], text)``.

    Input: the segment plan (media_id, part, start_ms, end_ms, part_path). Output: one row
    per segment with its chunks and text, or NULLs and the error."""
    out_schema = ("media_id long, part long, start_ms long, chunks array<struct<text:string>>, "
                  "text string, error string")

    def run(batches):
        fn = _model(factory)
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                try:
                    chunks, text = fn(r.part_path, r.start_ms, r.end_ms)
                    rows.append((r.media_id, r.part, r.start_ms,
                                 [{"text": c} for c in chunks], text, None))
                except Exception as e:  # noqa: BLE001 - reported per row
                    rows.append((r.media_id, r.part, r.start_ms, None, None, repr(e)))
            yield pd.DataFrame(rows, columns=["media_id", "part", "start_ms", "chunks", "text",
                                              "error"])

    return segments.select("media_id", "part", "start_ms", "end_ms", "part_path").mapInPandas(
        run, out_schema)
