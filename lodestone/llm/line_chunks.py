"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

A rolling hash runs over the hashes of neighbouring lines, two at a time. Pairs of lines whose hash is divisible by STARTS begin
a chunk, and pairs for which the rest is divisible by ENDS end one; a chunk runs from each beginning to the next end, over
two lines at least and MOST at most. So a chunk depends on its own lines alone, not on what stands around it: a passage that
is inserted or moved has the same chunks everywhere. Each of several rolling hashes (FAMILIES) chooses its own boundaries, so
that few lines at a passage's ends fall between them; a line goes if any of its chunks is a repetition.

Places of chunks of at least min_lines lines are grouped by a hash; of those with one hash the first (smallest id, then
the row's place in the input, then the line) stays, the lines of the others are removed. Their bytes are compared: only a
hash whose chunks are all the same, byte for byte, counts; chunks of any other hash are grouped by their bytes. Only the
chunks that no other removed chunk of their text contains need that. A chunk that overlaps the first occurrence of its
own bytes (a run of equal lines) stays too.

Null text counts as empty and stays null. Repeated rows: the same id again counts as a later occurrence of all its
chunks. Rows are written once with their numbers, so that a rerun of a lost task cannot number them otherwise. Texts of any
length are read whole. Empty tables give empty results. Only doc_id and text are read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_counted, join_small, stash, unstash

#: Multipliers of a line's hash and of the next line's, one pair for each rolling hash; sums are taken modulo PRIME.
FAMILIES, PRIME = ((31, 1), (1, 131), (7919, 104729), (611953, 1299709)), 2147483647
#: One pair of lines in so many begins a chunk, one in so many ends it; lines of a chunk at most.
STARTS, ENDS, MOST = 2, 2, 16


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def chunk_places(lines: Column, families=FAMILIES) -> Column:
    """Distinct (start, n) of the chunks of an array of lines, of all families."""
    hashes = F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long"))
    n = F.size(lines)

    def places(rolled: Column) -> Column:
        ends = F.transform(rolled, lambda r: F.floor(r / STARTS) % ENDS == 0)
        after = lambda ends, i: F.array_position(F.slice(ends, i + 1, F.lit(MOST - 1)), True)
        size = lambda ends, i: _let(after(ends, i), lambda k: F.when(k > 0, k + 1).otherwise(F.least(F.lit(MOST), n - i)))
        each = lambda ends: F.transform(rolled, lambda r, i: F.when(r % STARTS == 0, i.cast("long") * (MOST + 1) + size(ends, i)))
        return F.array_compact(_let(ends, each))

    # the last line has no pair
    pairs = lambda h, a, b: F.zip_with(F.slice(h, 1, F.size(h) - 1), F.slice(h, 2, F.size(h)), lambda x, y: (x * a + y * b) % PRIME)
    # a place is one number, as numbers are made distinct by hashing and structs by comparing all with all
    codes = _let(hashes, lambda h: F.array_distinct(F.concat(*[_let(pairs(h, a, b), places) for a, b in families])))
    return F.transform(codes, lambda c: F.struct(F.floor(c / (MOST + 1)).cast("int").alias("start"), (c % (MOST + 1)).cast("int").alias("n")))


def without_lines(rows: DataFrame) -> DataFrame:
    """rows: doc_id, text, gone (numbers of lines, null for none). doc_id, text (what stays), n_lines, n_removed."""
    kept = lambda l: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(l) - 1), F.col("gone")), lambda i: F.get(l, i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(_let(_lines(F.col("text")), kept))
    removed = F.greatest(F.coalesce(F.size("gone"), F.lit(0)), F.lit(0)).cast("long")
    return rows.select("doc_id", text.alias("text"), F.size(_lines(F.col("text"))).cast("long").alias("n_lines"), removed.alias("n_removed"))


def _chunk(lines: Column, place: Column) -> Column:
    return F.array_join(F.slice(lines, place["start"] + 1, place["n"]), "\n")


def _hash(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def _later(each: DataFrame, key: str) -> DataFrame:
    """each: doc_id, rid, start, n, key. The places whose key occurs before, with the first place of the key."""
    first = each.groupBy(key).agg(F.min(F.struct("doc_id", "rid", "start", "n")).alias("f"), F.count("*").alias("c")).where("c > 1")
    first = stash(first.select(key, "c", F.col("f.rid").alias("f_rid"), F.col("f.start").alias("f_start"), F.col("f.n").alias("f_n")), "first-chunks")
    return join_counted(each.drop("doc_id"), first, [key]).drop("c").where("rid <> f_rid or start >= f_start + f_n")


def _outermost(places: DataFrame) -> DataFrame:
    """Places that no other place of their text contains."""
    before = Window.partitionBy("rid").orderBy("start", F.desc("n"), "h").rowsBetween(Window.unboundedPreceding, -1)
    return places.withColumn("_end", F.max(F.col("start") + F.col("n")).over(before)).where(F.col("_end").isNull() | (F.col("start") + F.col("n") > F.col("_end"))).drop("_end")


def _with_places(rows: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """places: rid, start, n, h, later. rows with the array of their places."""
    lists = places.groupBy("rid").agg(F.collect_list(F.struct("start", "n", "h", "later")).alias("places"))
    return rows.join(lists, "rid", how)


def _with_bytes(rows: DataFrame) -> DataFrame:
    """Places of rows, with chunk, the bytes there."""
    each = _let(_lines(F.col("text")), lambda l: F.transform("places", lambda p: F.struct(p["start"].alias("start"), p["n"].alias("n"), p["h"].alias("h"), _chunk(l, p).alias("chunk"))))
    return rows.where("places is not null").select("doc_id", "rid", F.explode(each).alias("p")).select("doc_id", "rid", "p.*")


def _unequal(rows: DataFrame) -> DataFrame:
    """Hashes whose chunks differ."""
    return stash(_with_bytes(rows).groupBy("h").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).where("a <> b").select("h"), "unequal-chunks")


def _met(outer: DataFrame) -> DataFrame:
    """Places whose bytes are compared: those to remove and the first ones."""
    firsts = outer.select(F.col("f_rid").alias("rid"), F.col("f_start").alias("start"), F.col("f_n").alias("n"), "h").distinct()
    return outer.select("rid", "start", "n", "h", F.lit(True).alias("later")).union(firsts.withColumn("later", F.lit(False)))


def _by_bytes(rows: DataFrame, each: DataFrame, later: DataFrame, mixed: DataFrame) -> DataFrame:
    """(rid, gone) where some hashes have chunks that differ: these are grouped by their bytes."""
    exact = None
    while mixed.limit(1).count():
        whole = _with_bytes(_with_places(rows, join_small(each, mixed, "h", "left_semi").withColumn("later", F.lit(True)).drop("doc_id"), "inner"))
        found = _later(whole.drop("h"), "chunk").select("rid", "start", "n")
        exact = found if exact is None else exact.union(found)
        later = stash(join_small(later, mixed, "h", "left_anti"), "later")
        outer = stash(_outermost(later), "outermost")
        mixed = _unequal(_with_places(rows, _met(outer), "inner"))
    lines = exact.union(outer.select("rid", "start", "n")).select("rid", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("line"))
    return stash(lines.groupBy("rid").agg(F.collect_set("line").alias("gone")), "lines-gone")


def line_dedup(docs: DataFrame, min_lines: int = 2, families=FAMILIES) -> DataFrame:
    """docs: doc_id, text. Per document: doc_id, text (what stays), n_lines, n_removed (lines)."""
    rows = stash(docs.select(F.col("doc_id"), F.col("text"), F.monotonically_increasing_id().alias("rid")), "numbered")
    places = lambda l: F.transform(F.filter(chunk_places(l, families), lambda c: c["n"] >= min_lines), lambda c: F.struct(c["start"].alias("start"), c["n"].alias("n"), _hash(_chunk(l, c)).alias("h")))
    each = stash(rows.select("doc_id", "rid", F.explode(_let(_lines(F.col("text")), places)).alias("c")).select("doc_id", "rid", "c.*"), "chunk-places")
    later = stash(_later(each, "h"), "later")
    full = stash(_with_places(rows, _met(_outermost(later)), "left"), "with-places")
    unstash(rows)
    mixed = _unequal(full)
    if mixed.limit(1).count():
        out = full.drop("places").join(_by_bytes(full.drop("places"), each, later, mixed), "rid", "left")
    else:
        lines = F.flatten(F.transform(F.filter("places", lambda p: p["later"]), lambda p: F.sequence(p["start"], p["start"] + p["n"] - 1)))
        out = full.withColumn("gone", F.when(F.size(lines) > 0, F.array_distinct(lines)))
    return without_lines(out)
