"""Mixing sources to target weights by weighted fair queueing.

Every document gets a virtual finish time: the words of its source up to and with it, in a hashed order,
divided by the source's target. Sorting all documents by finish time serves every source in proportion to its
target at every moment; the mix is that order, cut where the words reach the budget. A source whose target is
larger than itself is served again in the same order, so its later copies finish after its first ones.

Nulls: a null text has 0 words, a null source is a source of its own (the last), a null id hashes as its text does,
so that many null ids are dealt like other rows.
Ties and repeated rows are ordered by (hash, id, size); rows that agree in all of these are interchangeable. Empty
tables give empty results. Columns of the input whose names clash with ours are not touched: see mix_sources.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash32, join_small, n_words, release, stash

#: Hash ranges of a source, each of which is one window group; and parts into which a range of time is cut.
RANGES, PARTS = 1024, 2048
#: So many (time, source) sums may be brought to the driver when the cut is found.
FEW = 20_000


def source_targets(sized: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> tuple[DataFrame, float]:
    """sized: source, size. One row per source: rank, source, source_size, target; and the budget in words.

    Targets are in proportion to weights, which repeat over the sources in code-point order; a target stops at cap
    times its source's size and the excess goes to the others by weight.
    """
    spark = sized.sparkSession
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sums.orderBy(F.col("source").asc_nulls_last()).rdd.map(tuple).zipWithIndex().map(lambda r: (r[1], r[0][0], r[0][1], float(weights[r[1] % len(weights)])))
    src = stash(spark.createDataFrame(ranked, "rank long, source string, source_size long, w double"), "sources")
    full = cap * F.col("source_size")
    total = src.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    budget, level = share * total, 0.0
    held, free = 0.0, src.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    while free > 0:  # each turn only lifts the level, so a source once full stays full
        level = (budget - held) / free
        at = full <= F.lit(level) * F.col("w")
        new = src.agg(F.coalesce(F.sum(F.when(at, full)), F.lit(0.0)), F.coalesce(F.sum(F.when(~at, F.col("w"))), F.lit(0.0))).first()
        if (new[0], new[1]) == (held, free):
            break
        held, free = new
    target = F.when((full <= F.lit(level) * F.col("w")) | F.lit(free == 0), full).otherwise(F.lit(level) * F.col("w"))
    return src.select("rank", "source", "source_size", target.alias("target")), budget


def mix_sources(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: int = 2, keep: tuple[str, ...] = ("doc_id",), seed: str = "mix") -> DataFrame:
    """docs: doc_id, source, text. Returns keep's columns, size, source_size, target, finish, times, taken.

    finish is the first copy's virtual finish time, times how many copies the mix takes (0 to cap), taken its words.
    """
    base = docs.select(*[F.col(k) for k in keep if k != "doc_id"], F.col("doc_id"), F.col("source").alias("_source"), n_words(F.col("text")).alias("_size"), hash32(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))).alias("_h"))
    src, budget = source_targets(base.select(F.col("_source").alias("source"), F.col("_size").alias("size")), weights, share, cap)
    rows = join_small(base, src.withColumnRenamed("source", "_s"), base["_source"].eqNullSafe(F.col("_s")))
    rows = rows.withColumn("_range", F.floor(F.col("_h") / (2**32 // RANGES)).cast("int"))
    sums = rows.groupBy("rank", "_range").agg(F.sum("_size").alias("_sum"))
    before = sums.select("rank", "_range", (F.sum("_sum").over(Window.partitionBy("rank").orderBy("_range")) - F.col("_sum")).alias("_before"))
    inside = F.sum("_size").over(Window.partitionBy("rank", "_range").orderBy("_h", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_in", inside).join(before, ["rank", "_range"]).withColumn("_cum", F.col("_before") + F.col("_in"))
    # a source of size 0 has no target and is never served
    copies = [(F.col("source_size") * k + F.col("_cum")) / F.nullif("target", F.lit(0.0)) for k in range(cap)]
    rows = stash(rows.select(*keep, F.col("_size").alias("size"), "rank", "source_size", "target", *[c.alias(f"_f{k}") for k, c in enumerate(copies)]), "mix")
    release(rows.sparkSession)
    time, rank = _cut(rows.select("rank", "size", F.explode(F.array(*[f"_f{k}" for k in range(cap)])).alias("t")).where("t is not null"), budget)
    served = sum((F.when((F.col(f"_f{k}") < time) | (F.col(f"_f{k}") == time) & (F.col("rank") <= rank), 1).otherwise(0) for k in range(cap)), F.lit(0))
    return rows.withColumn("times", served).select(*keep, "size", "source_size", "target", F.col("_f0").alias("finish"), "times", (F.col("size") * F.col("times")).cast("long").alias("taken"))


def _cut(events: DataFrame, budget: float) -> tuple[float, int]:
    """The last (time, rank) in sorted order up to which the sizes sum to no more than budget.

    The range that holds the cut is narrowed by distributed histograms until it is small; nothing is sorted whole.
    """
    lo, hi, n = events.agg(F.min("t"), F.max("t"), F.count("t")).first()
    if not n:
        return -1.0, -1
    done, events = 0, events.groupBy("t", "rank").agg(F.sum("size").alias("size"))
    for _ in range(40):
        inner = events.where(F.col("t").between(lo, hi))
        step = (hi - lo) / PARTS
        if step <= 0 or lo + step == lo or inner.limit(FEW + 1).count() <= FEW:
            break
        part = F.least(F.floor((F.col("t") - lo) / step), F.lit(PARTS - 1))
        best = None
        for r in inner.groupBy(part.alias("p")).agg(F.sum("size").alias("s"), F.min("t").alias("lo"), F.max("t").alias("hi")).orderBy("p").collect():  # PARTS rows at most
            if done + r.s > budget:
                best = r
                break
            done += r.s
        if best is None:
            return hi, 2**62
        lo, hi = best.lo, best.hi
    last = (-1.0, -1) if done == 0 else (float(lo), -1)
    for r in events.where(F.col("t").between(lo, hi)).orderBy("t", "rank").toLocalIterator():
        if done + r.size > budget:
            break
        done, last = done + r.size, (r.t, r.rank)
    return last


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: docs' rows, each as often as it is taken, range-sorted by finish time."""
    rows = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("_row"))  # so that no name clashes
    taken = mix_sources(rows, keep=("_row",), **how)
    again = (F.col("_copy") - 1) * F.col("source_size") / F.nullif("target", F.lit(0.0))
    return taken.where("times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times")))).orderBy(F.col("finish") + again, "_copy").select("_row.*")
