"""Connected components of an edge table by alternating stars, with joins and min aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over rows (u, v), each link held once with u > v."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if large:  # link every larger neighbour of a vertex to the least vertex around it
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # link a vertex and its smaller neighbours to the least of them
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = (edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
               .union(least.select("u", F.col("m").alias("v"))))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) for every vertex with a link; root is the least vertex of its component.

    ``edges`` has columns u, v of one ordered type. Self links, repeated links and links with
    a null end say nothing and are left out. A vertex with many links is a join key on one row
    of the other side, which adaptive execution splits; no neighbour list is ever gathered.
    The rounds end when the set of links no longer changes (rounds grow with the logarithm
    of the longest chain). Each round is a written table in the shared folder.
    """
    e = (edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
         .filter("u <> v").distinct())
    e = written(e, "links")
    state = None
    while True:
        e = written(_stars(_stars(e, True), False), "links")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") / 2**40)).first()
        now = (now[0], now[1])
        if now == state:
            break
        state = now
    return (e.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
            .union(e.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct()))
