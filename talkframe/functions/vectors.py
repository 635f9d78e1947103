"""Vector expressions (H6, H7, B7, B8) and the default hashed text encoder.

Vectors are ``array<float>`` on disk and ``array<double>`` for arithmetic.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from .text import tokenize


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(v) -> Column:
    return _c(v).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """H6: cosine similarity, 0 when either vector has norm 0."""
    na, nb = norm(a), norm(b)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


@pandas_udf(DoubleType())
def cosine_of_many(a: pd.Series, b: pd.Series) -> pd.Series:
    """H6 on Arrow batches, for many pairs of long vectors of one dimension (no NULLs)."""
    if not len(a):
        return pd.Series([], dtype=float)
    x, y = np.stack(a.to_list()).astype(float), np.stack(b.to_list()).astype(float)
    size = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
    return pd.Series(np.where(size > 0, np.einsum("ij,ij->i", x, y) / np.where(size > 0, size, 1.0), 0.0))


def truncate(v, n: int) -> Column:
    """First n dimensions, no renormalising."""
    return F.slice(_c(v), 1, n)


def validity_reason(v, dims: int) -> Column:
    """NULL when the vector is acceptable for a ``dims``-dimensional index, else a reason."""
    v = _c(v)
    return (F.when(v.isNull(), F.lit("null vector"))
             .when(F.size(v) != dims, F.concat(F.lit("expected "), F.lit(str(dims)),
                                                F.lit(" dimensions, got "),
                                                F.size(v).cast("string")))
             .when(F.exists(v, lambda x: x.isNull()), F.lit("null element"))
             .when(F.exists(v, lambda x: F.isnan(x)), F.lit("NaN element"))
             .when(norm(v) == 0, F.lit("zero vector")))


def token_bucket(t: Column, n_buckets: int) -> Column:
    """Bucket of a token: first 32 bits of its md5, modulo n (computable in SQL engines too)."""
    h = F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, F.lit(n_buckets)).cast("int")


def _bucket_counter(n_buckets: int):
    @pandas_udf("array<float>")
    def count(ids: pd.Series) -> pd.Series:
        return pd.Series([np.bincount(np.asarray(a, dtype=np.int64), minlength=n_buckets)
                          .astype(np.float32) for a in ids])
    return count


def with_hash_vector(df, text_col: str, out: str, n_buckets: int, keep: list | None = None):
    """J1 default encoder: counts of tokens per md5 bucket as a dense ``array<float>``.

    Deterministic and model-free, so tests and the SQL oracle can reproduce it. Tokens and
    bucket ids are computed in the JVM; the per-row counting is one numpy ``bincount`` per row
    on Arrow batches (no explode, no shuffle).
    """
    keep = list(keep if keep is not None else df.columns)
    ids = F.transform(tokenize(F.col(text_col)), lambda t: token_bucket(t, n_buckets))
    return df.select(*keep, _bucket_counter(n_buckets)(ids).alias(out))
