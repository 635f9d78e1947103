"""Exact uniform sharding by a hypergeometric communication matrix (DataFrame functions only).

A uniform shuffle of n rows into shards of exact sizes needs no global sort: draw how many rows
each partition gives to each shard (a random matrix with the partitions' row counts and the
shards' sizes as margins, distributed as a uniform shuffle has it), permute each partition and
deal its rows out by its row of the matrix, exchange, and permute each shard. The matrix is
drawn over a binary tree of partitions: a node's demand on each shard is split between its two
halves by a multivariate hypergeometric draw, one shard after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import uniform, written

ROWS_PER_PARTITION = 16_384
ROWS_PER_SLOT_RUN = 16_384
# the support of a hypergeometric draw is followed so many standard deviations around its mode;
# what lies beyond weighs less than 1e-30 of the mode, below the rounding of the doubles summed
DEVIATIONS = 12.0


def hypergeometric(u: Column, total: Column, marked: Column, drawn: Column) -> Column:
    """How many of ``drawn`` items out of ``total`` are among its ``marked`` ones, by inverse CDF.

    ``u`` is uniform on (0, 1). Weights are followed from the mode down and up by the ratio of
    neighbouring probabilities, so no factorial is formed and no weight overflows.
    """
    n, k, d = (x.cast("double") for x in (total, marked, drawn))

    def by(p):
        mode, lo, hi = p["mode"], p["lo"], p["hi"]
        up = F.aggregate(
            F.when(hi > mode, F.sequence(mode + 1, hi)).otherwise(F.array().cast("array<bigint>")),
            F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum")),
            lambda a, x: F.struct(
                (a["w"] * (k - x + 1) * (d - x + 1) / (x * (n - k - d + x))).alias("w"),
                (a["sum"] + a["w"] * (k - x + 1) * (d - x + 1) / (x * (n - k - d + x))).alias("sum")),
            lambda a: a["sum"])
        down = F.aggregate(
            F.when(mode > lo, F.sequence(mode - 1, lo, F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>")),
            F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum")),
            lambda a, x: F.struct(
                (a["w"] * (x + 1) * (n - k - d + x + 1) / ((k - x) * (d - x))).alias("w"),
                (a["sum"] + a["w"] * (x + 1) * (n - k - d + x + 1) / ((k - x) * (d - x))).alias("sum")),
            lambda a: a["sum"])
        # the goal in units of the mode's weight; first the mode, then upwards, then downwards
        goal = F.transform(F.array(F.struct(up.alias("up"), down.alias("down"))),
                           lambda t: F.struct(t["up"].alias("up"), (u * (1 + t["up"] + t["down"])).alias("goal")))[0]

        def walk(t):
            # what is left to pass over on the side that the goal falls on
            upward = t["goal"] < 1 + t["up"]
            rest = F.when(t["goal"] < 1, F.lit(-1.0)).when(upward, t["goal"] - 1).otherwise(t["goal"] - 1 - t["up"])
            steps = (F.when(t["goal"] < 1, F.array().cast("array<bigint>"))
                     .when(upward & (hi > mode), F.sequence(mode + 1, hi))
                     .when(~upward & (mode > lo), F.sequence(mode - 1, lo, F.lit(-1).cast("long")))
                     .otherwise(F.array().cast("array<bigint>")))

            def step(a, x):
                w = F.when(upward, a["w"] * (k - x + 1) * (d - x + 1) / (x * (n - k - d + x))) \
                    .otherwise(a["w"] * (x + 1) * (n - k - d + x + 1) / ((k - x) * (d - x)))
                # a["rest"] < 0: reached, the answer stands
                return F.when(a["rest"] < 0, a).otherwise(F.transform(
                    F.array(w), lambda v: F.struct(v.alias("w"), (a["rest"] - v).alias("rest"), x.alias("at")))[0])
            return F.aggregate(steps, F.struct(F.lit(1.0).alias("w"), rest.alias("rest"), mode.alias("at")),
                               step, lambda a: a["at"])
        return F.transform(F.array(goal), walk)[0]

    lo = F.greatest(F.lit(0).cast("long"), marked + drawn - total)
    hi = F.least(marked, drawn)
    mode = F.least(F.greatest(F.floor((d + 1) * (k + 1) / (n + 2)), lo), hi)
    span = F.ceil(F.lit(DEVIATIONS) * F.sqrt(F.greatest(
        F.lit(1.0), d * (k / n) * (1 - k / n) * ((n - d) / F.greatest(n - 1, F.lit(1.0)))))) + 30
    p = F.struct(mode.alias("mode"), F.greatest(lo, mode - span).alias("lo"), F.least(hi, mode + span).alias("hi"))
    return (F.when(lo >= hi, lo)
            .otherwise(F.transform(F.array(p), by)[0]))


def communication_matrix(counts: DataFrame, sizes: list[int], depth: int, seed: str) -> DataFrame:
    """(part, deal array<long>): rows that each of the 2**depth partitions gives to each shard.

    ``counts`` has (part, n) for the partitions that have rows; ``sizes`` add up to the rows.
    """
    width = 1 << depth
    every = counts.sparkSession.range(width).select(F.col("id").alias("part"))
    sums = (every.join(counts, "part", "left").agg(F.array_sort(F.collect_list(
        F.struct("part", F.coalesce("n", F.lit(0)).cast("long").alias("n")))).alias("c"))
        .select(F.transform("c", lambda x: x["n"]).alias("c")))
    node = sums.select(F.lit(0).cast("long").alias("node"), "c",
                       F.array(*[F.lit(int(s)).cast("long") for s in sizes]).alias("need"))
    for level in range(depth):
        node = (node.withColumn("half", (F.size("c") / 2).cast("int"))
                .withColumn("left_n", F.aggregate(F.slice("c", F.lit(1), F.col("half")), F.lit(0).cast("long"), lambda a, x: a + x))
                .withColumn("all", F.aggregate("need", F.lit(0).cast("long"), lambda a, x: a + x)))

        def draw(a, s):
            u = uniform(F.lit(level), F.col("node"), s["i"], salt=seed)
            got = hypergeometric(u, a["all"], s["need"], a["left"])
            return F.transform(F.array(got), lambda g: F.struct(
                (a["all"] - s["need"]).alias("all"), (a["left"] - g).alias("left"),
                F.concat(a["deal"], F.array(g)).alias("deal")))[0]

        left = F.aggregate(
            F.transform("need", lambda x, i: F.struct(x.alias("need"), i.alias("i"))),
            F.struct(F.col("all"), F.col("left_n").alias("left"), F.array().cast("array<bigint>").alias("deal")),
            draw, lambda a: a["deal"])
        node = (node.withColumn("l", left)
                .withColumn("r", F.zip_with("need", "l", lambda x, y: x - y))
                .withColumn("kids", F.array(
                    F.struct((2 * F.col("node")).alias("node"), F.slice("c", F.lit(1), F.col("half")).alias("c"),
                             F.col("l").alias("need")),
                    F.struct((2 * F.col("node") + 1).alias("node"),
                             F.slice("c", F.col("half") + 1, F.col("half")).alias("c"), F.col("r").alias("need"))))
                .select(F.explode("kids").alias("k")).select("k.*"))
    return node.select(F.col("node").alias("part"), F.col("need").alias("deal"))


def shard_rows(rows: DataFrame, key: list[str], n_shards: int, seed: str = "shards",
               rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """``rows`` with ``_shard`` (int) and ``_slot`` (long): a uniform shuffle into n_shards.

    Shard sizes are at most one apart, slots are gapless from 0 in each shard, and both depend
    only on the seed and the values of ``key``, which should tell rows apart: rows that agree in
    all of ``key`` are interchangeable and get different places in any order. Nulls are values
    like any other. An empty table gives none. Rows are dealt out by the hash of the whole key, so
    no source, text or size makes a large partition.
    """
    n = rows.count()
    sizes = [n // n_shards + (i < n % n_shards) for i in range(n_shards)]
    depth = max(0, (max(1, -(-n // rows_per_partition)) - 1).bit_length())
    width = 1 << depth
    order = F.xxhash64(F.lit(seed + "/deal"), *key)
    parted = rows.withColumn("_part", F.pmod(F.xxhash64(F.lit(seed + "/part"), *key), F.lit(width)).cast("long"))
    counts = parted.groupBy(F.col("_part").alias("part")).agg(F.count("*").alias("n"))
    matrix = written(communication_matrix(counts, sizes, depth, seed), "matrix").select(
        F.col("part").alias("_part"),
        F.aggregate("deal", F.array(F.lit(0).cast("long")),
                    lambda a, x: F.concat(a, F.array(a[F.size(a) - 1] + x))).alias("_ends"))
    w = Window.partitionBy("_part").orderBy(order, *key)
    dealt = (parted.withColumn("_at", F.row_number().over(w) - 1)
             .join(matrix, "_part")
             .withColumn("_shard", (F.size(F.filter("_ends", lambda e: e <= F.col("_at"))) - 1).cast("int"))
             .drop("_ends", "_at", "_part"))
    # permute each shard: rows in order of a fresh hash, run by run of the hash's range
    again = F.xxhash64(F.lit(seed + "/slot"), F.col("_shard"), *key)
    runs = max(1, -(-max(sizes) // ROWS_PER_SLOT_RUN)) if n else 1
    dealt = dealt.withColumn("_order", again).withColumn(
        "_run", F.least(F.lit(runs - 1), F.floor((F.col("_order") / float(1 << 64) + 0.5) * runs)).cast("int"))
    per_run = dealt.groupBy("_shard", "_run").agg(F.count("*").alias("_n"))
    before = per_run.select("_shard", "_run", (F.sum("_n").over(
        Window.partitionBy("_shard").orderBy("_run")) - F.col("_n")).alias("_before"))
    slot = F.row_number().over(Window.partitionBy("_shard", "_run").orderBy("_order", *key)) - 1
    return (dealt.withColumn("_in", slot).join(before, ["_shard", "_run"])
            .withColumn("_slot", (F.col("_before") + F.col("_in")).cast("long"))
            .drop("_order", "_run", "_in", "_before"))
