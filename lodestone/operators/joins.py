"""Lookup, plan, range, similarity and calendar joins."""
from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import cut_lineage


def join_bounded(df: DataFrame, small: DataFrame, on: list[str], weigh: Column, how: str = "inner", spread: Column | None = None, most: int = 2_000_000, salts: int = 16) -> DataFrame:
    """Joins with a broadcast of small if the sum of weigh over its rows is within the bound.

    Beyond it the join shuffles; with spread, hot keys of df are dealt to salts by it, for each of which small's rows are repeated.
    """
    if (small.agg(F.coalesce(F.sum(weigh), F.lit(0))).first()[0] or 0) <= most:
        return df.join(F.broadcast(small), on, how)
    if spread is None:
        return df.join(small, on, how)
    left = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    return left.join(small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*on, "_salt"], how).drop("_salt")


def join_counted(df: DataFrame, other: DataFrame, on: list[str], how: str = "inner", count: str = "c", parts: int = 2000) -> DataFrame:
    """Join (inner or left) of df with one row a key of other, whose column count says how many rows of df have the key.

    Keys that hold over one in parts of df's rows are fewer than parts: these are broadcast, and no task gets many rows of the
    others. other is read more than once (write it first).
    """
    total, most = other.agg(F.coalesce(F.sum(count), F.lit(0)), F.coalesce(F.max(count), F.lit(0))).first()
    if most * parts <= total:  # no such key
        return df.join(other, on, how)
    if total < parts:  # nothing but such keys
        return df.join(F.broadcast(other), on, how)
    hot = other.where(F.col(count) * parts > total)
    cold = df.join(F.broadcast(hot.select(*on)), on, "left_anti").join(other.where(F.col(count) * parts <= total), on, how)
    return df.join(F.broadcast(hot), on).unionByName(cold)


def lookup(df: DataFrame, dim: DataFrame, key: str, order: list, first: bool = True) -> DataFrame:
    """Left join on the lower-cased key; where the dimension repeats a key, its first (or last) row by order counts."""
    w = Window.partitionBy(F.lower(key)).orderBy(*(order if first else [F.desc(o) for o in order]))
    one = dim.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").withColumn("_key", F.lower(key)).drop(key)
    return df.withColumn("_key", F.lower(key)).join(one, "_key", "left").drop("_key")


def left_counts(df: DataFrame, facts: DataFrame, keys: list[str], aggs: list[Column], zero: list[str]) -> DataFrame:
    """df with aggregates of its facts, 0 where it has none."""
    return df.join(facts.groupBy(*keys).agg(*aggs), keys, "left").fillna(0, zero)


def plan_vs_actual(plan: DataFrame, facts: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    """Every planned key with its actuals (0 by default), and actuals of unplanned keys with planned = false."""
    actual = facts.groupBy(*keys).agg(*aggs)
    names = [c for c in actual.columns if c not in keys]
    kept = plan.join(actual, keys, "left").fillna(0, names).withColumn("planned", F.lit(True))
    return kept.unionByName(actual.join(plan, keys, "left_anti").withColumn("planned", F.lit(False)), allowMissingColumns=True)


def range_join(df: DataFrame, ranges: DataFrame, value: str, lo: str, hi: str, step: int = 10) -> DataFrame:
    """Rows with the ranges that hold their value, as an equi-join on steps of the value's axis."""
    parts = ranges.withColumn("_step", F.explode(F.sequence(F.floor(F.col(lo) / step), F.floor(F.col(hi) / step))))
    return df.withColumn("_step", F.floor(F.col(value) / step)).join(parts, "_step").where(F.col(value).between(F.col(lo), F.col(hi))).drop("_step")


def shingles(text: Column, width: int = 5) -> Column:
    """Distinct hashes of runs of width words; of all words together if there are fewer."""
    w = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != "")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - width + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, width), " ")))
    return F.when(F.size(w) > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))


#: Bits of a set's sketch at most.
MOST_BITS = 1 << 13


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_bits(n: np.ndarray, h: np.ndarray) -> list[bytes]:
    """For each set a bit for each slot that an odd number of its elements falls on. n: sizes; h: hashes of elements, one set after the other.

    A set has about as many slots as elements, by powers of two. Two sets whose bits differ in d places differ in d elements at least, also
    when the longer bits are folded (by exclusive or) to the length of the others.
    """
    bits = np.clip(1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), 64, MOST_BITS)
    ends = np.cumsum(bits)
    at = np.repeat(np.arange(len(n)), n)
    slots = (ends - bits)[at] + ((_mix(h) >> np.uint64(33)).astype(np.int64) % bits[at])
    packed = np.packbits((np.bincount(slots, minlength=int(ends[-1]) if len(ends) else 0) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [packed[(e - b) // 8 : e // 8] for e, b in zip(ends.tolist(), bits.tolist(), strict=True)]


class OddBits:
    """Bits of sets, in order of size."""

    def __init__(self, n: np.ndarray, packed: list[bytes]):
        self.order = np.argsort(n, kind="stable")
        self.n, self.packed, self.made = n[self.order], [packed[k] for k in self.order], {}
        self.words = np.array([len(x) // 8 for x in self.packed], np.int64)

    def folded(self, lo: int, hi: int, words: int) -> np.ndarray:
        """The bits of sets lo to hi as so many words, one row a word."""
        if (lo, hi, words) not in self.made:
            all_ = np.frombuffer(b"".join(self.packed[lo:hi]), np.uint64).reshape(hi - lo, -1, words)
            self.made[lo, hi, words] = np.ascontiguousarray(np.bitwise_xor.reduce(all_, axis=1).T)
        return self.made[lo, hi, words]

    def classes(self) -> list[tuple[int, int, int]]:
        """(from, to, words) of the sets of one length of bits; lengths follow sizes."""
        ends = [0, *(np.flatnonzero(np.diff(self.words)) + 1).tolist(), len(self.n)] if len(self.n) else [0]
        return [(lo, hi, int(self.words[lo])) for lo, hi in zip(ends, ends[1:], strict=False)]


def near_sets(x: OddBits, y: OddBits | None, t: float) -> Iterator[tuple[np.ndarray, int]]:
    """(sets of x, set of y) whose bits allow a Jaccard similarity of at least t; y None: pairs within x, each once."""
    own = y is None
    y = x if own else y
    for from_y, to_y, words_y in y.classes():
        for lo_x, hi_x, words_x in x.classes():
            if (own and lo_x > from_y) or x.n[hi_x - 1] < t * y.n[from_y] - 1e-9 or y.n[to_y - 1] < t * x.n[lo_x] - 1e-9:
                continue
            words = min(words_x, words_y)
            bits, others, sizes = x.folded(lo_x, hi_x, words), y.folded(from_y, to_y, words), x.n[lo_x:hi_x]
            first = np.searchsorted(sizes, t * y.n[from_y:to_y] - 1e-9)
            last = np.searchsorted(sizes, y.n[from_y:to_y] / t + 1e-9, "right")
            for j in range(from_y, to_y):
                lo, hi = int(first[j - from_y]), int(last[j - from_y])
                if own:
                    hi = min(hi, j - lo_x)
                if lo >= hi:
                    continue
                most = np.minimum((1 - t) / (1 + t) * (sizes[lo:hi] + y.n[j]) + 1e-9, 65535).astype(np.uint16)
                differ = np.zeros(hi - lo, np.uint16)
                for w in range(half := (words + 1) // 2):
                    differ += np.bitwise_count(bits[w, lo:hi] ^ others[w, j - from_y])
                ok = np.flatnonzero(differ <= most)  # most are told apart by half of the bits
                if len(ok) and half < words:
                    rest = np.bitwise_count(bits[half:, lo + ok] ^ others[half:, j - from_y, None]).sum(0, dtype=np.int64)
                    ok = ok[differ[ok] + rest <= most[ok]]
                if len(ok):
                    yield x.order[lo_x + lo + ok], int(y.order[j])


def spanning(found: Iterable[tuple[np.ndarray, int]], many: int) -> list[tuple[int, int]]:
    """So few of the pairs (some, one) of nodes under many that they join the same components."""
    of, links = np.arange(many), []
    for some, one in found:
        for c in np.unique(of[some]).tolist():
            if c != of[one]:
                links.append((c, int(of[one])))
                of[of == c] = of[one]
    return links


def _distinct_sets(df: DataFrame, id_col: str, group: list[str], sets: str, more: list[Column] = (), text: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with a set and a group as (id, g, s, more), and those of them whose set another row of the group has: (id, rep, c), rep the smallest id of these c rows.

    text: a column by which rows are equal instead.
    """
    key = F.sha2(F.col(text) if text else F.to_json(F.array_sort(sets)), 256)
    # written before rows are left out: sets are made once
    rows = cut_lineage(df.select(F.col(id_col).alias("id"), F.struct(*group).alias("g"), F.col(sets).alias("s"), key.alias("key"), *more))
    rows = rows.where(F.size("s") > 0).where(" and ".join(f"g.`{c}` is not null" for c in group))
    same = cut_lineage(rows.groupBy("g", "key").agg(F.min("id").alias("rep"), F.count("*").alias("c")).where("c > 1"))
    return rows.drop("key"), cut_lineage(join_bounded(rows.select("id", "g", "key"), same, ["g", "key"], F.lit(1), spread=F.col("id")).select("id", "rep", "c"))


def _near_links(rows: DataFrame, same: DataFrame, t: float, block: int) -> DataFrame:
    """(a, b) of sets (id, g, s): so few that sets which may have a similarity of at least t are in one component. Of equal sets only rep takes part.

    Sets of a group are dealt to blocks by size; two blocks whose sizes allow a similarity meet in a task, as bits. That grows with the square of the
    sets of like size in a group, at about 10 nanoseconds a pair, and writes some bytes a set for each block that it meets.
    """
    kind = rows.schema["id"].dataType

    def sketched(batches):
        for batch in batches:
            for k in range(0, len(batch), 512):
                some = batch.slice(k, 512)
                n = pc.list_value_length(some["h"]).to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_arrays([some["id"], some["gh"], pa.array(n), pa.array(odd_bits(n, some["h"].flatten().to_numpy().view(np.uint64)), pa.binary())], names=["id", "g", "n", "bits"])

    hashed = rows.select("id", F.xxhash64("g").alias("gh"), F.transform("s", lambda w: F.xxhash64(w)).alias("h"))
    bits = hashed.mapInArrow(sketched, T.StructType([T.StructField("id", kind), T.StructField("g", T.LongType()), T.StructField("n", T.LongType()), T.StructField("bits", T.BinaryType())]))
    bits = cut_lineage(join_bounded(bits, same.where("id <> rep").select("id"), ["id"], F.lit(1), "left_anti"))
    # sizes of a group in order, cut where a block is full; a size of more sets than a block is cut by hash
    sizes = bits.groupBy("g", "n").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("g").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = cut_lineage(sizes.select("g", "n", F.floor(before / block).alias("at"), F.ceil(F.col("c") / block).cast("int").alias("k")))
    blocks = sizes.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).groupBy("g", "at", "sub").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    blocks = cut_lineage(blocks.select("g", F.struct("at", "sub").alias("b"), "lo", "hi"))
    x, y = blocks.select("g", F.col("b").alias("i"), F.col("lo").alias("xl"), F.col("hi").alias("xh")), blocks.select("g", F.col("b").alias("j"), F.col("lo").alias("yl"), F.col("hi").alias("yh"))
    meet = cut_lineage(x.join(y, "g").where((F.col("i") <= F.col("j")) & (F.col("xh") >= F.col("yl") * t - 1e-9) & (F.col("yh") >= F.col("xl") * t - 1e-9)).select("g", "i", "j"))
    bits = join_bounded(bits, sizes, ["g", "n"], F.lit(1)).withColumn("b", F.struct("at", F.pmod(F.xxhash64("id"), F.col("k")).cast("int").alias("sub"))).select("id", "g", "n", "bits", "b")
    side = lambda c, k: join_bounded(bits, meet.where("i <> j").withColumn("b", F.col(c)) if k else meet.withColumn("b", F.col(c)), ["g", "b"], F.lit(1)).select("g", "i", "j", F.lit(k).alias("side"), "id", "n", "bits")
    out = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])

    def compare(table: pa.Table) -> pa.Table:
        side, n, bits = table["side"].to_numpy(), table["n"].to_numpy(), table["bits"].to_pylist()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        x, y = (OddBits(n[at], [bits[k] for k in at]) for at in (left, right))
        names = np.concatenate([left, right])
        links = spanning(((some, j + len(left)) for some, j in near_sets(x, y, t)) if len(right) else near_sets(x, None, t), len(names))
        at = names[np.array(links, np.int64).reshape(-1, 2)]
        ids = table["id"].combine_chunks()
        return pa.table({"a": ids.take(pa.array(at[:, 0])), "b": ids.take(pa.array(at[:, 1]))})

    return cut_lineage(side("i", 0).unionByName(side("j", 1)).groupBy("g", "i", "j").applyInArrow(compare, out))


def deal_components(rows: DataFrame, links: DataFrame, block: int, costly: bool) -> DataFrame:
    """Rows (id, others) of the components of links, as often as they meet others: (task, i, j, component, side, id, others).

    Small components share a task; one of over a block of rows is cut into blocks i <= j, of which each two meet, as sides 0 and 1.
    costly: pairs cost time, not room, so they are dealt to many tasks, whatever their bytes.
    """
    from .dedupe import connected

    node = connected(links)
    many = cut_lineage(node.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("k"), F.count("*").alias("c")))
    tasks = max(1, (many.agg(F.sum("c")).first()[0] or 0) // block)
    node = cut_lineage(join_bounded(node, many.select("component", "k"), ["component"], F.lit(1), spread=F.col("node")))
    own = F.pmod(F.xxhash64("id"), F.col("k")).cast("int")
    last = F.col("k") - 1
    part = lambda lo, hi, f: F.transform(F.sequence(lo, hi), f)
    parts = F.concat(part(own, last, lambda x: F.struct(own.alias("i"), x.alias("j"), F.lit(0).alias("side"))), F.when(own > 0, part(F.lit(0), own - 1, lambda x: F.struct(x.alias("i"), own.alias("j"), F.lit(1).alias("side")))).otherwise(F.array().cast("array<struct<i:int,j:int,side:int>>")))
    task = F.when(F.col("k") == 1, F.pmod(F.xxhash64("component"), F.lit(tasks)).cast("string")).otherwise(F.concat(F.lit("c"), F.col("component").cast("string")))
    dealt = join_bounded(rows, node.withColumnRenamed("node", "id"), ["id"], F.lit(1)).select(task.alias("task"), "component", F.explode(parts).alias("p"), *rows.columns).select("task", "component", "p.*", *rows.columns)
    spark = rows.sparkSession
    return dealt.repartition(max(16 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "task", "i", "j") if costly else dealt


def _in_components(rows: DataFrame, links: DataFrame, t: float, only_links: bool, block: int, verify: Callable | None = None) -> DataFrame:
    """(a, b, similarity, back) of the sets (id, g, s) of a component of links that have a similarity of at least t; only_links: so few that they join the same components.

    verify: gives similarity and back, that of b to a, for pairs of the rows' texts (columns text, c).
    Shared elements are counted by 0/1 matrix products.
    """
    kind = rows.schema["id"].dataType
    dealt = deal_components(rows.select("id", "s", *(["text", "c"] if verify else [])), links, block, verify is not None)
    out = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("similarity", T.DoubleType()), T.StructField("back", T.DoubleType())])

    def compare(table: pa.Table) -> pa.Table:
        s = table["s"].combine_chunks()
        n = np.diff(s.offsets.to_numpy())
        ends = np.cumsum(n)
        flat = pc.dictionary_encode(s.flatten()).indices.to_numpy()
        side, of = table["side"].to_numpy(), pc.dictionary_encode(table["component"].combine_chunks()).indices.to_numpy()
        order = np.lexsort((side, of))
        pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
        for at in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else []:
            cut = int((side[at] == 0).sum())
            rows = np.repeat(np.arange(len(at)), n[at])
            values = np.unique(np.concatenate([flat[ends[r] - n[r] : ends[r]] for r in at]), return_inverse=True)[1]
            by = np.argsort(values, kind="stable")
            rows, values = rows[by], values[by]
            right = slice(cut, None) if cut < len(at) else slice(None)
            both = np.zeros((cut, len(at[right])))
            for k in range(0, int(values[-1]) + 1, 4096):  # elements, some at a time
                lo, hi = np.searchsorted(values, (k, k + 4096))
                has = np.zeros((len(at), int(values[hi - 1]) + 1 - k), np.float32)
                has[rows[lo:hi], values[lo:hi] - k] = 1
                both += has[:cut] @ has[right].T
            similarity = both / (n[at[:cut], None] + n[at[right]][None, :] - both)
            i, j = np.nonzero(similarity >= t if cut < len(at) else np.triu(similarity >= t, 1))
            value = back = similarity[i, j]
            j = j + (cut if cut < len(at) else 0)
            if only_links:
                cuts = np.flatnonzero(np.diff(i)) + 1
                of_row = ((js, int(row[0])) for js, row in zip(np.split(j, cuts), np.split(i, cuts), strict=True) if len(js))
                few = np.array(spanning(of_row, len(at)), np.int64).reshape(-1, 2)
                i, j, value, back = few[:, 0], few[:, 1], np.full(len(few), t), np.full(len(few), t)
            if verify:
                i, j, value, back = verify(table.take(pa.array(at)), i, j)
            pairs.append((at[i], at[j], value, back))
        a, b, value, back = (np.concatenate(x) for x in zip(*pairs, strict=True))
        ids = table["id"].combine_chunks()
        return pa.table({"a": ids.take(pa.array(a)), "b": ids.take(pa.array(b)), "similarity": pa.array(value), "back": pa.array(back)})

    return dealt.groupBy("task", "i", "j").applyInArrow(compare, out)


def pairs_of_rows(found: DataFrame, rows: DataFrame, same: DataFrame, keep: Column | None) -> DataFrame:
    """(a, b, similarity, da, db), a < b, of the rows (id, d) that pairs (a, b, similarity, back) of representatives stand for, and of those that are equal.

    same: (id, rep, c) of the rows that share a representative. keep: which pairs of x and y (id, d). No join or shuffle carries the pairs of rows.
    """
    row = join_bounded(rows.select("id", F.struct("id", "d").alias("r")), same, ["id"], F.lit(1), "left").select(F.coalesce("rep", "id").alias("rep"), "r", F.coalesce("c", F.lit(1)).alias("c"))
    # copies are dealt to lists of about 256, so that no row holds all
    member = cut_lineage(row.groupBy("rep", F.pmod(F.xxhash64("r"), F.ceil(F.col("c") / 256)).alias("chunk")).agg(F.collect_list("r").alias("m"), F.max("c").alias("c")))
    of = lambda s: member.select(F.col("rep").alias(s), F.col("m").alias(f"m{s}"))
    found = found.join(of("a"), "a").join(of("b"), "b")
    found = found.select("similarity", "back", F.explode("ma").alias("x"), "mb").select("similarity", "back", "x", F.explode("mb").alias("y"))
    twice = member.where("c > 1")
    equal = twice.select("rep", F.col("m").alias("ma"), F.col("chunk").alias("i")).join(twice.select("rep", F.col("m").alias("mb"), F.col("chunk").alias("j")), "rep").where("i <= j")
    equal = equal.select(F.lit(1.0).alias("similarity"), F.lit(1.0).alias("back"), "i", "j", F.explode("ma").alias("x"), "mb").select("similarity", "back", "i", "j", "x", F.explode("mb").alias("y")).where((F.col("i") < F.col("j")) | (F.col("x.id") < F.col("y.id"))).drop("i", "j")
    pairs = found.unionByName(equal)
    if keep is not None:
        pairs = pairs.where(keep)
    turned = F.col("x.id") > F.col("y.id")
    ends = lambda c: [F.when(turned, F.col(f"{p}.{c}")).otherwise(F.col(f"{q}.{c}")) for p, q in (("y", "x"), ("x", "y"))]
    (a, b), (da, db) = ends("id"), ends("d")
    return pairs.select(a.alias("a"), b.alias("b"), F.when(turned, F.col("back")).otherwise(F.col("similarity")).alias("similarity"), da.alias("da"), db.alias("db"))


def similar_links(df: DataFrame, id_col: str, group: list[str], sets: str, t: float, block: int = 16384, part: int = 2048) -> DataFrame:
    """Pairs (a, b), so few that rows whose sets have a Jaccard similarity of at least t within their group are in one component, and no others."""
    rows, same = _distinct_sets(df, id_col, group, sets)
    found = _in_components(rows, _near_links(rows, same, t, block), t, True, part).select("a", "b")
    return found.unionByName(same.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")))


def similar_pairs(df: DataFrame, id_col: str, group: list[str], sets: str, t: float, differ: str | None = None, block: int = 16384, part: int = 2048, text: str | None = None, verify: Callable | None = None) -> DataFrame:
    """Pairs of a group whose sets have a Jaccard similarity of at least t. No such pair is lost.

    Equal sets are one representative until the end. Bits of an exact bound say which sets may be similar, but only links that join these to
    components are written; within components sets are compared themselves. So what is written before the result grows with the rows, not
    with the pairs: these appear in the last step, in which representatives stand for their copies.
    differ: a column in which the two must differ; its values come with the pairs as da and db.
    verify: gives another similarity for pairs of texts (column text) in either order; equal texts are one representative then.
    """
    more = [(F.col(differ) if differ else F.lit(None).cast("string")).alias("d"), *([F.col(text).alias("text")] if text else [])]
    rows, same = _distinct_sets(df, id_col, group, sets, more, text)
    links = _near_links(rows, same, t, block)
    if verify:
        rows = join_bounded(rows, same.select("id", "c"), ["id"], F.lit(1), "left")
    found = _in_components(rows, links, t, False, part, verify)
    rows = rows.select("id", "d")
    pairs = pairs_of_rows(found, rows, same, F.col("x.d") != F.col("y.d") if differ else None)
    return pairs if differ else pairs.drop("da", "db")


def neighbour_pairs(df: DataFrame, order: str, span: int, first: int, sets: str, t: float) -> DataFrame:
    """Among the first rows by order, pairs at most span places apart with similarity of at least t (a bounded scan)."""
    rows = df.orderBy(order).limit(first).withColumn("pos", F.row_number().over(Window.orderBy(order)))
    rows = cut_lineage(rows.select(F.col(order).alias("id"), "pos", F.col(sets).alias("s"), F.size(sets).alias("n")))
    a = rows.select(F.col("id").alias("a"), "pos", F.col("s").alias("sa"), F.col("n").alias("na"))
    b = rows.select(F.col("id").alias("b"), F.col("s").alias("sb"), F.col("n").alias("nb"), F.explode(F.sequence(F.col("pos") - span, F.col("pos") - 1)).alias("pos"))
    # sizes tell most pairs apart before their elements are compared
    both = a.join(b, "pos").where((F.least("na", "nb") > 0) & (F.least("na", "nb") >= t * F.greatest("na", "nb") - 1e-9))
    both = both.withColumn("c", F.size(F.array_intersect("sa", "sb")))
    return both.select("a", "b", (F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("similarity")).where(F.col("similarity") >= t)


def complete_years(df: DataFrame, key: str, value: str, year: str = "year") -> DataFrame:
    """A row for each year between a key's first and last; gaps are filled in linearly between their neighbours."""
    ends = df.groupBy(key).agg(F.min(year).alias("lo"), F.max(year).alias("hi"))
    grid = ends.select(key, F.explode(F.sequence("lo", "hi")).alias(year))
    full = grid.join(df.select(key, year, value), [key, year], "left")
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(year).alias("y"), F.col(value).alias("v")))
    w = Window.partitionBy(key).orderBy(year)
    full = full.withColumns({"_p": F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_n": F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    step = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * (F.col(year) - F.col("_p.y")) / (F.col("_n.y") - F.col("_p.y"))
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_p").isNull(), F.col("_n.v")).when(F.col("_n").isNull(), F.col("_p.v")).otherwise(step)
    return full.select(key, year, F.coalesce(filled, F.lit(0.0)).alias(value), F.col(value).isNotNull().alias("observed"))


def task_grid(keywords: DataFrame, sources: DataFrame, start: str, end: str, months: int, template: Column) -> DataFrame:
    """A search task for each keyword, source and date range; template builds its address from their columns."""
    dates = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.make_interval(months=F.lit(months))))
    rows = keywords.join(F.broadcast(sources), F.lit(True)).withColumn("date_start", dates)
    rows = rows.withColumn("date_end", F.date_sub(F.add_months("date_start", months), 1))
    return rows.withColumn("url", template)
