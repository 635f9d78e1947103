"""Mixing sources to target weights by pivotal dependent rounding (DataFrame functions only).

Every document of a source asks for the same number of copies, r = target / source size. The
whole copies are given at once; the fractions are rounded dependently: two documents meet and
mass (words) moves from one to the other, at random in either direction, until one of the two
fractions is 0 or 1. Each fraction keeps its expectation and each pair its sum of words, so the
words a source gives stay at its target but for the one fraction that is left at the end. Meetings
run in leaves of a tree (about FANOUT documents each); the fraction left over in a leaf goes up
to the next level, so a source of any size is rounded in logarithmically many small steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import uniform, word_count, written

FANOUT = 48
MAX_COPIES = 3
SALTS = 16


def targets(sources: DataFrame) -> DataFrame:
    """(key, source, n, source_size, target) of a table of sources (key, source, n, source_size).

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share all words by weight;
    none gets more than MAX_COPIES times its own words, and the excess is shared by weight among
    the others until none is above: target = min(cap, level * weight) for the one level at which
    the targets add up. Works on one row per source.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    s = (sources.withColumn("weight", (F.row_number().over(rank) - 1) % 3 + 1)
         .withColumn("cap", MAX_COPIES * F.col("source_size").cast("double"))
         .withColumn("ratio", F.col("cap") / F.col("weight")))
    by = Window.orderBy("ratio", "key")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = (s.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                      / F.sum("weight").over(after))
         .withColumn("level", F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(every)))
    return s.select("key", "source", "n", "source_size",
                    F.least("cap", F.coalesce("level", F.lit(0.0)) * F.col("weight")).alias("target"))


def _let(value: Column, body):
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _meet(items: Column, salt: str) -> Column:
    """struct(done array<struct<item.., extra>>, rest item): one pass of meetings over items.

    Items are structs with size > 0 and a fraction p; large ones come first, so that what is
    left in the end is small. Afterwards each is settled (extra 0 or 1) but for the rest.
    """
    def settle(x, extra):
        return F.array(F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), F.lit(extra).alias("extra")))

    def with_p(x, p):
        return F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), p.alias("p"))

    def fight(acc, x):
        i = acc["rest"]
        give = F.least(i["size"] * (1 - i["p"]), x["size"] * x["p"])  # words that may go to i
        take = F.least(i["size"] * i["p"], x["size"] * (1 - x["p"]))  # words that may go to x
        u = uniform(i["doc_id"], x["doc_id"], i["size"], x["size"], salt=salt)
        odds = _let(F.struct(give.alias("give"), take.alias("take"), u.alias("u")), lambda t: F.struct(
            (t["u"] * (t["give"] + t["take"]) < t["take"]).alias("to_i"), t["give"].alias("give"), t["take"].alias("take")))

        def after(t):
            filled = i["size"] * (1 - i["p"]) <= x["size"] * x["p"]  # i gets full before x is empty
            emptied = i["size"] * i["p"] <= x["size"] * (1 - x["p"])  # i is empty before x gets full
            return (F.when(t["to_i"] & filled, F.struct(
                        F.concat(acc["done"], settle(i, 1)).alias("done"),
                        with_p(x, x["p"] - t["give"] / x["size"]).alias("rest")))
                    .when(t["to_i"], F.struct(
                        F.concat(acc["done"], settle(x, 0)).alias("done"),
                        with_p(i, i["p"] + t["give"] / i["size"]).alias("rest")))
                    .when(emptied, F.struct(
                        F.concat(acc["done"], settle(i, 0)).alias("done"),
                        with_p(x, x["p"] + t["take"] / x["size"]).alias("rest")))
                    .otherwise(F.struct(
                        F.concat(acc["done"], settle(x, 1)).alias("done"),
                        with_p(i, i["p"] - t["take"] / i["size"]).alias("rest"))))
        return _let(odds, after)

    none = F.array().cast("array<struct<doc_id:bigint,size:bigint,extra:int>>")
    return F.aggregate(F.slice(items, F.lit(2), F.size(items)), F.struct(none.alias("done"), items[0].alias("rest")), fight)


def mix(docs: DataFrame, doc_id: str | Column = "doc_id", text: str = "text", source: str = "source",
        seed: str = "mix") -> DataFrame:
    """(doc_id, size, source, source_size, target, copies) for every row of ``docs``.

    ``size`` counts the words ``[^\\x20\\x09-\\x0D]+`` of the text (null: 0); copies (0 to 3) says
    how often the mix takes the document, so copies * size are its words. Documents without words
    and sources without words get no fraction. Rows with a null id or source count like any other
    (null is a source of its own); repeated rows are rounded one by one. Choices come from hashes
    of ids and sizes: reruns agree. An empty table gives none. Texts are read once; only ids
    and sizes are shuffled.
    """
    sizes = written(docs.select(
        (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("long").alias("doc_id"), word_count(F.col(text)).alias("size"),
        F.when(F.col(source).isNull(), "").otherwise(F.concat(F.lit("s"), F.col(source).cast("string"))).alias("key"),
        F.col(source).alias("source")), "sizes")
    per = sizes.groupBy("key", "source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    goal = written(targets(per), "targets")
    most = goal.agg(F.max("n")).first()[0] or 0
    spread = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.lit(SALTS))
    # a source may hold a third of all rows: its one row of targets is repeated for each salt
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(MAX_COPIES)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    known = (goal.drop("source").withColumn("rate", rate)
             .withColumn("base", F.floor(F.col("rate") + 1e-12).cast("int"))
             .withColumn("p", F.when(F.col("rate") - F.col("base") < 1e-12, 0.0).otherwise(F.col("rate") - F.col("base")))
             .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))))
    d = sizes.withColumn("salt", spread).join(known, ["key", "salt"]).drop("salt")
    plain = (F.col("p") == 0) | (F.col("size") == 0)
    leaves = F.ceil(F.col("n") / FANOUT)
    level = (d.filter(~plain)
             .withColumn("cell", F.pmod(F.xxhash64(F.lit(seed + "/leaf"), "doc_id", "size"), leaves).cast("long"))
             .select("key", "cell", F.struct("doc_id", "size", "p").alias("item")))
    settled, depth, left = [], 0, most
    while True:
        groups = (level.groupBy("key", "cell")
                  .agg(F.sort_array(F.collect_list(F.struct(F.col("item.size").alias("size"), F.col("item.doc_id").alias("doc_id"),
                                                            F.col("item.p").alias("p"))), asc=False).alias("items"))
                  .select("key", "cell", F.transform("items", lambda x: F.struct(
                      x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["p"].alias("p"))).alias("items"))
                  .select("key", "cell", _meet(F.col("items"), f"{seed}/{depth}").alias("m")))
        groups = written(groups, "meetings")
        settled.append(groups.select("key", F.explode("m.done").alias("x"))
                       .select("key", "x.doc_id", "x.size", "x.extra"))
        level = groups.select("key", F.floor(F.col("cell") / FANOUT).alias("cell"), F.col("m.rest").alias("item"))
        left, depth = -(-left // FANOUT), depth + 1
        if left <= 1:
            break
    last = level.select("key", "item.doc_id", "item.size", (uniform(
        F.col("item.doc_id"), F.col("item.size"), salt=seed + "/last") < F.col("item.p")).cast("int").alias("extra"))
    for s in settled:
        last = last.unionByName(s)
    whole = d.filter(plain).select("key", "doc_id", "size", F.lit(0).alias("extra"))
    out = (last.unionByName(whole).withColumn("salt", spread)
           .join(known.join(goal.select("key", "source"), "key"), ["key", "salt"]))
    return out.select("doc_id", "size", "source", "source_size", "target",
                      (F.col("base") + F.col("extra")).alias("copies"))
