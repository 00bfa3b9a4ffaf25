"""Removal of repeated passages, in DataFrame functions only.

A passage is min_lines lines or more in a row. Every window of min_lines lines is compared byte for byte with all others;
lines that lie in a window seen before (smaller id, then place in the input, then position) are removed. As every place
starts a window, nothing is lost at chunk boundaries: each repeated run goes from its first line to its last.

A window that overlaps the first occurrence of the same bytes (a run of equal lines) does not count as seen before. Null
text counts as empty and stays null. Repeated rows: the same id again counts as a later occurrence. Rows are written once
with their numbers. Empty tables give empty results. Only doc_id and text are read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_small, stash
from .line_chunks import _let, _lines, without_lines


def _windows(text: Column, n: int) -> Column:
    """Array of the windows of n lines, joined by newlines; null if there is none."""
    at = lambda s: F.when(F.size(s) >= n, F.transform(F.sequence(F.lit(0), F.size(s) - n), lambda i: F.concat_ws("\n", F.slice(s, i + 1, n))))
    return _let(_lines(text), at)


def passage_dedup(docs: DataFrame, min_lines: int = 2) -> DataFrame:
    """docs: doc_id, text. Per document: doc_id, text (what stays), n_lines, n_removed (lines)."""
    rows = stash(docs.select(F.col("doc_id"), F.col("text"), F.monotonically_increasing_id().alias("rid")), "numbered")
    each = rows.select("doc_id", "rid", F.posexplode(_windows(F.col("text"), min_lines)).alias("pos", "window")).withColumn("h", F.xxhash64("window"))
    again = stash(each.groupBy("h").count().where("count > 1").select("h"), "window-hashes")
    some = stash(join_small(each, again, "h"), "windows")
    first = F.min(F.struct("doc_id", "rid", "pos"))
    # bytes are compared here: the key is the window itself, not its hash; its salted part comes first
    part = some.groupBy("window", F.pmod("rid", F.lit(32)).alias("salt")).agg(first.alias("f"))
    keep = part.groupBy("window").agg(F.min("f").alias("f")).select(F.xxhash64("window").alias("h"), "f.rid", "f.pos")
    keep = keep.select("h", "rid", F.explode(F.sequence(F.col("pos"), F.col("pos") + (min_lines - 1))).alias("pos"))
    later = some.select("h", "rid", "pos").join(keep, ["h", "rid", "pos"], "left_anti")
    lines = later.select("rid", F.explode(F.sequence(F.col("pos"), F.col("pos") + (min_lines - 1))).alias("line"))
    gone = stash(lines.groupBy("rid").agg(F.collect_set("line").alias("gone")), "lines-gone")
    return without_lines(join_small(rows, gone, "rid", "left"))
