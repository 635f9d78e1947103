"""Top-k per group with one tie-break rule for the whole package.

Ranking is on the score rounded to ``digits`` decimals, then on the tie column ascending, so
that scores equal up to floating-point summation order rank the same way in every engine.
``row_number() <= k`` directly over the window lets Catalyst insert a partial
``WindowGroupLimit`` before the shuffle: only k rows per group and partition cross the network.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCORE_DIGITS = 6


def top_k(df: DataFrame, group: list[str], score: str, k: int, tie: str,
          ascending: bool = False, rank_col: str = "rank",
          digits: int = SCORE_DIGITS) -> DataFrame:
    """Keep the best ``k`` rows per ``group``; adds a bigint ``rank_col`` (1 = best).

    k <= 0 returns no rows; k larger than the group returns the whole group.
    """
    if k <= 0:
        return df.limit(0).withColumn(rank_col, F.lit(None).cast("bigint"))
    key = F.round(F.col(score), digits)
    order = [key.asc() if ascending else key.desc(), F.col(tie).asc()]
    w = Window.partitionBy(*group).orderBy(*order)
    ranked = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    return ranked.withColumn(rank_col, F.col("_rn").cast("bigint")).drop("_rn")


def rounded(score: np.ndarray, digits: int = SCORE_DIGITS) -> np.ndarray:
    """Half up, as the global cut rounds; the margin covers scores just below a half."""
    return np.floor(score * 10.0 ** digits + 0.5 + 1e-9) / 10.0 ** digits


class RunningTopK:
    """The k best hits of each query among the documents a task has seen, under the package's tie rule.

    Flat arrays with at most k entries per query. Ties at the k-th place are cut by document id.
    """

    def __init__(self, n_queries: int, k: int, ascending: bool = False):
        self.n, self.k, self.ascending = n_queries, k, ascending
        self.rows = np.zeros(0, np.int64)
        self.ids = np.zeros(0, object)
        self.keys = np.zeros(0)
        self.scores = np.zeros(0)

    def key(self, score: np.ndarray) -> np.ndarray:
        """What is ranked by, small is good."""
        return rounded(score) if self.ascending else -rounded(score)

    def cut(self) -> np.ndarray:
        """Per query the k-th best key so far, infinite while there are fewer hits."""
        worst = np.full(self.n, -np.inf)
        np.maximum.at(worst, self.rows, self.keys)
        return np.where(np.bincount(self.rows, minlength=self.n) >= self.k, worst, np.inf)

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Hits (query row, document id, score) that may be among the best."""
        if not len(rows):
            return
        rows, ids = np.concatenate([self.rows, rows]), np.concatenate([self.ids, ids])
        keys, scores = np.concatenate([self.keys, self.key(scores)]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids.astype(str), keys, rows))
        rows, ids, keys, scores = rows[order], ids[order], keys[order], scores[order]
        first = np.r_[0, np.nonzero(np.diff(rows))[0] + 1]
        pos = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
        keep = pos < self.k
        self.rows, self.ids, self.keys, self.scores = rows[keep], ids[keep], keys[keep], scores[keep]

    def frame(self, qids: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"qid": qids[self.rows], "doc_id": self.ids, "score": self.scores})
