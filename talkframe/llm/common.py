"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import sys
import types
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# ASCII white space, the separators of the word pattern [^\x20\x09-\x0D]+
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table ``name``; column pruning is left to Catalyst."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the session names in spark.checkpoint.dir."""
    return f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder and read back.

    It cuts the lineage: what is read later doesn't depend on shuffle files of executors
    that may be gone by then.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words as a long, without keeping the words."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def uniform(*cols, salt: str) -> Column:
    """A number in (0, 1) that depends on the columns and the salt alone, so reruns agree."""
    h = F.xxhash64(F.lit(salt), *cols)
    return ((F.shiftrightunsigned(h, 11)).cast("double") + 0.5) / float(1 << 53)


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def per_worker(key: str, make: Callable[[], Any], family: str | None = None) -> Any:
    """``make()``, kept under ``key`` for as long as the Python worker lives.

    Functions of this package travel to the workers by value, so a global of their own module
    is new in each task; a module registered in sys.modules stays. Of a ``family`` (keys that begin with
    it) only the latest is kept.
    """
    kept = sys.modules.setdefault("_talkframe_worker", types.ModuleType("_talkframe_worker")).__dict__
    if key not in kept:
        for old in [k for k in kept if family and k.startswith(family)]:
            del kept[old]
        kept[key] = make()
    return kept[key]


def forget() -> None:
    """Drops what ``per_worker`` keeps in this worker and gives back memory that Arrow holds.

    A stage after one with a model calls it first: workers are used again, and would hold the model
    beside the JVM through all stages that follow.
    """
    kept = sys.modules.pop("_talkframe_worker", None)
    if kept is not None:
        del kept
        gc.collect()
    pa.default_memory_pool().release_unused()
