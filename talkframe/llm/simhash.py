"""Document fingerprints: SimHash votes and permuted block tables (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words

BITS = 64
# 16 running sums hold 64 counters: sum k holds bits k, k+16, k+32, k+48 in lanes of 16 bits
LANES = 16
LANE_MASK = 0x0001000100010001
# terms summed before the lanes are unpacked; below 2**15 a lane can't run over (nor turn the
# sign bit, so an unpacked lane is exact)
RUN = 32_000


def term_hashes(text: Column, shingle: int = 3) -> Column:
    """One 64-bit hash per word shingle, repeats included; shorter texts are one term."""
    w = words(text)

    def hashed(ws):
        n = F.size(ws)
        many = F.transform(
            F.sequence(F.lit(1), n - (shingle - 1)),
            lambda i: F.xxhash64(*[F.element_at(ws, i + k) for k in range(shingle)]))
        return F.when(n >= shingle, many).when(n > 0, F.array(F.xxhash64(F.array_join(ws, " ")))) \
            .otherwise(F.array().cast("array<bigint>"))
    # bind the word array once: transform over a one-element array
    return F.transform(F.array(w), hashed)[0]


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text", shingle: int = 3) -> DataFrame:
    """(keys..., fp long): every term votes +tf on the bits set in its hash and -tf on the others.

    The weight of a term is its number of occurrences; a bit is 1 if its votes are above
    zero. A text without words (null, empty, white space) has fingerprint 0. Rows that agree in
    ``keys`` are taken as copies of one text: keys should identify the text. Other columns of
    ``docs`` are ignored. Votes are summed where the rows lie, 64 counters packed in 16 longs;
    only one packed row per row and run of terms crosses the network, so long texts, hot
    words and repeated rows cost no skew.
    """
    h = (docs.select(*keys, F.monotonically_increasing_id().alias("_row"), term_hashes(F.col(text), shingle).alias("_hs"))
         .select(*keys, "_row", F.posexplode_outer("_hs").alias("_pos", "_h"))
         .withColumn("_run", F.floor(F.coalesce("_pos", F.lit(0)) / RUN)))
    mask = F.lit(LANE_MASK)
    packed = h.groupBy(*keys, "_row", "_run").agg(
        F.count("_h").alias("_n"),
        *[F.sum(F.shiftrightunsigned("_h", k).bitwiseAND(mask)).alias(f"_s{k}") for k in range(LANES)])
    lanes = [(F.shiftrightunsigned(f"_s{k}", 16 * j).bitwiseAND(F.lit(0xFFFF))).alias(f"_c{k + 16 * j}")
             for j in range(4) for k in range(LANES)]
    summed = (packed.select(*keys, "_n", *lanes).groupBy(*keys)
              .agg(F.sum("_n").alias("_n"), *[F.sum(f"_c{b}").alias(f"_c{b}") for b in range(BITS)]))
    fp = F.lit(0).cast("long")
    for b in range(BITS):
        bit = (1 << b) if b < 63 else -(1 << 63)
        fp = fp.bitwiseOR(F.when(2 * F.col(f"_c{b}") > F.col("_n"), F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return summed.select(*keys, fp.alias("fp"))


def hex16(fp: Column) -> Column:
    """A fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """1 minus the share of differing bits."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)).cast("double") / BITS


def block_tables(fps: DataFrame, fp: str, radius: int) -> DataFrame:
    """(fp, tab, block): ``radius + 1`` tables; table i is keyed by the i-th block of bits.

    The blocks cut the 64 bits into radius + 1 nearly equal runs. Two fingerprints that differ
    in at most ``radius`` bits agree in one block at least (pigeonhole), so they meet under one
    key of one table.
    """
    cuts = [i * BITS // (radius + 1) for i in range(radius + 2)]
    keys = [F.struct(F.lit(i).alias("tab"),
                     F.shiftrightunsigned(F.shiftleft(F.col(fp), BITS - hi), BITS - hi + lo).alias("block"))
            for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))]
    return fps.select(fp, F.explode(F.array(*keys)).alias("k")).select(fp, "k.tab", "k.block")


def neighbours(fps: DataFrame, fp: str = "fp", radius: int = 3) -> DataFrame:
    """(a, b, distance), a < b: all pairs of *distinct* fingerprints within ``radius`` bits.

    Null fingerprints match nothing; copies share one fingerprint and are not expanded. Within
    table i a pair is kept only if no earlier block agrees too, so each pair comes out once.
    """
    distinct = fps.select(F.col(fp).alias("fp")).filter("fp is not null").distinct()
    t = block_tables(distinct, "fp", radius)
    a, b = t.alias("a"), t.alias("b")
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    cuts = [i * BITS // (radius + 1) for i in range(radius + 2)]
    first = F.coalesce(*[F.when(F.shiftleft(x, BITS - hi).bitwiseAND(
        F.lit(-1 << (BITS - hi + lo)).cast("long")) == 0, F.lit(i))
        for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))])
    on = ((F.col("a.tab") == F.col("b.tab")) & (F.col("a.block") == F.col("b.block"))
          & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(x) <= radius) & (first == F.col("a.tab")))
    return a.join(b, on).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"),
                                F.bit_count(x).alias("distance"))
