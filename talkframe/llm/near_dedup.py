"""SimHash near-dedup by anchor points of a covering code.

Two 64-bit fingerprints within 3 bits agree up to 1 bit in one of their 32-bit halves. The
anchors of a half are the words of the perfect Hamming code of length 31 with the 32nd bit
left free: every half lies within one bit of an anchor (covering radius 1). A fingerprint is
sent to all anchors within covering radius plus threshold (1 + 1 = 2 bits) of each half: 2 or
17 anchors. Its *home* is the anchor within the covering radius. Whatever lies within one bit
of it in that half is within two bits of the home, so the pair meets there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER, partitions, written
from .components import components

HALF = 32
HALF_THRESHOLD = 1
MAX_DISTANCE = 2 * HALF_THRESHOLD + 1
# members of an anchor's cell that are compared at once with the cell's homes
CELL_BLOCK = 2048
LOWER = str.maketrans(UPPER, UPPER.lower())
SPACES = re.compile(r"[\x20\x09-\x0D]+")
SHINGLE_BATCH = 1 << 16


def fingerprint(text: str | None, shingle: int) -> int:
    """Majority bits of the XXH64 (seed 42) of the word shingles, repeats included.

    Null, empty and blank texts have fingerprint 0; a text of fewer words is one shingle.
    """
    w = [x for x in SPACES.split((text or "").translate(LOWER)) if x]
    if not w:
        return 0
    n = max(1, len(w) - shingle + 1)
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, SHINGLE_BATCH):
        stop = min(n, at + SHINGLE_BATCH)
        terms = zip(*[w[at + k:stop + k] for k in range(shingle)]) if len(w) >= shingle else [w]
        raw = b"".join([digest(" ".join(t).encode("utf-8", "surrogatepass"), 42) for t in terms])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _fingerprint_batches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["id", "fp"])
    return run


def fingerprints(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """(id, fp): one row per row of ``docs``; rows are worked on where they lie."""
    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(
        _fingerprint_batches(shingle), f"id {kind}, fp bigint")


_POSITION_BITS = [sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1) for k in range(5)]
# for each syndrome, the pairs of bits whose flip makes a code word: positions p, q with p ^ q = s
_PAIR_FLIPS = np.array([[1 << (p - 1) | 1 << ((p ^ s) - 1) for p in range(1, 32)
                         if p < p ^ s] for s in range(1, 32)], np.uint64)


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is home) of all anchors within two bits of each 32-bit value."""
    low = half & np.uint64(0x7FFFFFFF)
    syndrome = np.zeros(len(half), np.int64)
    for k, mask in enumerate(_POSITION_BITS):
        syndrome |= (np.bitwise_count(low & np.uint64(mask)).astype(np.int64) & 1) << k
    home = half ^ np.where(syndrome > 0, np.uint64(1) << np.maximum(syndrome - 1, 0).astype(np.uint64), np.uint64(0))
    i = np.arange(len(half))
    off = np.flatnonzero(syndrome)
    far = (half[off, None] ^ _PAIR_FLIPS[syndrome[off] - 1]).ravel()
    rows = np.concatenate([i, i, np.repeat(off, _PAIR_FLIPS.shape[1])])
    at = np.concatenate([home, home ^ np.uint64(1 << 31), far])
    is_home = np.zeros(len(rows), bool)
    is_home[:len(i)] = True
    return rows, at, is_home


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for side in (0, 1):
            half = (fp >> np.uint64(HALF * side)) & np.uint64(0xFFFFFFFF)
            rows, at, home = anchors(half)
            key = (at | np.uint64(side << HALF)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(home.astype(np.int8)), pa.array(fp[rows].view(np.int64))],
                names=["anchor", "home", "fp"])


def _links(homes: np.ndarray, root: np.ndarray, members: np.ndarray, out: list) -> None:
    """Add links that connect each member with the homes within reach, a spanning set of them.

    ``root`` labels the homes that links already connect; it is brought up to date.
    """
    near = np.bitwise_count(homes[:, None] ^ members[None, :]) <= MAX_DISTANCE
    near &= homes[:, None] != members[None, :]
    for j in np.flatnonzero(near.any(axis=0)):
        reached = np.flatnonzero(near[:, j])
        labels, first = np.unique(root[reached], return_index=True)
        out.extend((homes[i], members[j]) for i in reached[first])
        if len(labels) > 1:
            root[np.isin(root, labels)] = labels[0]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links per anchor cell; rows come sorted by cell, homes before the other members.

    A cell keeps only its homes (split beforehand so that a cell has a bounded number of them);
    members stream by.
    """
    cell, homes, root, out = None, np.empty(0, np.uint64), np.empty(0, np.int64), []

    def flush():
        a = np.array([x for x, _ in out], np.uint64).view(np.int64)
        b = np.array([x for _, x in out], np.uint64).view(np.int64)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])

    for batch in batches:
        anchor, part, home, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        fp = fp.view(np.uint64)
        cuts = np.flatnonzero((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])) + 1
        starts = np.concatenate([[0], cuts, [len(anchor)]])
        # a cell within the batch needs two rows and a home; single rows are skipped at once
        sizes = np.diff(starts)
        worth = sizes > 1
        worth[[0, -1]] = True
        for k in np.flatnonzero(worth):
            s, e = starts[k], starts[k + 1]
            if (now := (anchor[s], part[s])) != cell:
                cell, homes, root = now, np.empty(0, np.uint64), np.empty(0, np.int64)
            fresh = fp[s:e][home[s:e] == 1]
            root = np.concatenate([root, len(root) + np.arange(len(fresh))])
            homes = np.concatenate([homes, fresh])
            if not len(homes):
                continue
            for at in range(s, e, CELL_BLOCK):
                _links(homes, root, fp[at:min(e, at + CELL_BLOCK)], out)
            if len(out) >= 1 << 16:
                yield flush()
    yield flush()


def links(fps: DataFrame, fp: str = "fp") -> DataFrame:
    """(u, v): links between distinct fingerprints that join exactly those that a chain of
    pairs within MAX_DISTANCE bits connects.

    Every pair within reach is compared at an anchor; of a dense cell only a spanning set of its
    links is given, never all its pairs. Cells with many homes are cut into parts of about
    CELL_BLOCK homes; every member of such a cell goes to each part. Null fingerprints have no
    links.
    """
    spark = fps.sparkSession
    distinct = fps.select(F.col(fp).alias("fp")).filter("fp is not null").distinct()
    sent = distinct.mapInArrow(_replicate, "anchor bigint, home byte, fp bigint")
    cells = written(sent, "anchors")
    large = (cells.filter("home = 1").groupBy("anchor").agg(F.count("*").alias("n"))
             .filter(F.col("n") > CELL_BLOCK)
             .select("anchor", F.ceil(F.col("n") / CELL_BLOCK).cast("int").alias("parts")))
    cut = (cells.join(large, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
           .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
           .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
           # in another part than its own a home is an ordinary member
           .select("anchor", "part", ((F.col("home") == 1) & (F.col("own") == F.col("part")))
                   .cast("byte").alias("home"), "fp"))
    return (cut.repartition(partitions(spark), "anchor", "part")
            .sortWithinPartitions("anchor", "part", F.desc("home"))
            .mapInArrow(_compare, "u bigint, v bigint"))


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp, component): fingerprint and class of every row of ``docs``.

    The class of a row is the smallest id that it reaches over links (fingerprints that differ
    in at most three bits, equal ones included). Null and empty texts have fingerprint 0 and
    link like any other. Rows with a null id are fingerprinted and carry links, but don't name a
    class; a class of null ids alone is null. Repeated rows give repeated rows. An empty table
    gives none. Other columns are ignored.
    """
    fps = written(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    least = fps.groupBy("fp").agg(F.min("id").alias("own"))
    comp = components(links(fps))
    rooted = least.join(comp.withColumnRenamed("vertex", "fp"), "fp", "left")
    linked = rooted.filter("root is not null")
    name = linked.groupBy("root").agg(F.min("own").alias("component"))
    # only linked fingerprints move; all others keep the least id among their own copies
    named = (rooted.join(name, "root", "left")
             .select("fp", F.when(F.col("root").isNotNull(), F.col("component"))
                     .otherwise(F.col("own")).alias("component")))
    return fps.join(named, "fp").select("id", "fp", "component")
