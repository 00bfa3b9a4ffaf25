"""URL filters: a blocked Bloom filter of the listed canonical URLs, then an exact hash join.

A rule is (verdict, host, path); it fits its host, all subdomains, and paths that start with its path. A url's
candidates are its host's suffixes with as many labels as some rule has, joined with its path's prefixes as long as
some rule's path. The filter (256-bit blocks, 8 bits a key, each in its own 32-bit word) passes the few candidates
that may be listed; the join with the rules removes false positives; the longest rule wins.

Nulls and urls without '://' have an empty host and path, and get the default verdict without a join. Repeated urls are
judged once. Rules' hosts are lower-cased; of rules with the same host and path the greatest verdict stays (block over
allow), and of fitting rules of the same length the one with the longer host wins (hosts are suffixes of one another, so
no further tie is possible). Rules without host or verdict are left out. Empty tables give empty results, empty rule lists the
default verdict for every row. Columns of pages other than the two named are not read.
"""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, join_salted, join_small, lower_az, stash

BITS_PER_KEY, BLOCK_BITS, WORDS = 16, 256, 8


def host_path(url: Column) -> tuple[Column, Column]:
    rx = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, rx, k), F.lit(""))
    return lower_az(part(1)), part(2)


def _hashed(df: DataFrame, n_blocks: int) -> DataFrame:
    """key -> block and one bit position for each word of the block."""
    df = df.withColumn("_h", F.xxhash64("key", F.lit(7)))
    return df.select("*", F.pmod(F.xxhash64("key"), F.lit(n_blocks)).alias("block"), *[F.expr(f"cast(shiftrightunsigned(_h, {5 * i}) & 31 as int)").alias(f"_b{i}") for i in range(WORDS)]).drop("_h")


def bloom_blocks(keys: DataFrame, n_blocks: int) -> DataFrame:
    return _hashed(keys, n_blocks).groupBy("block").agg(*[F.expr(f"bit_or(shiftleft(1, _b{i}))").alias(f"_w{i}") for i in range(WORDS)])


def bloom_pass(df: DataFrame, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """Rows of df whose key may be in the filter."""
    hit = join_small(_hashed(df, n_blocks), blocks, "block")
    return hit.where(" and ".join(f"(shiftrightunsigned(_w{i}, _b{i}) & 1) = 1" for i in range(WORDS))).select(*df.columns)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """pages: id_col, url_col; rules: verdict, host, path. One row per page: id_col, host, path, rule, verdict."""
    host, path = host_path(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    listed = rules.where("host <> '' and verdict is not null").select(lower_az(F.col("host")).alias("h"), F.coalesce("path", F.lit("")).alias("p"), "verdict")
    listed = listed.groupBy("h", "p").agg(F.max("verdict").alias("verdict"))
    # no host or path has a newline before it is part of a key, so a key names one rule
    listed = listed.select(F.concat_ws("\n", "h", "p").alias("key"), F.concat("h", "p").alias("rule"), "verdict", F.length("h").alias("hl"), F.length("p").alias("pl"), F.size(F.split("h", r"\.")).alias("labels"))
    listed = stash(listed, "rules")
    n, labels, lengths = listed.agg(F.count("*"), F.collect_set("labels"), F.collect_set("pl")).first()
    if not n:
        return rows.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    n_blocks = max(1, -(-n * BITS_PER_KEY // BLOCK_BITS))
    blocks = stash(bloom_blocks(listed.select("key"), n_blocks), "bloom")
    urls = rows.where("host <> ''").groupBy("host", "path").agg(F.count("*").alias("c"))
    parts = F.split("host", r"\.")
    suffixes = F.array_compact(F.array(*[F.when(F.size(parts) >= k, F.array_join(F.slice(parts, -k, k), ".")) for k in sorted(labels)]))
    prefixes = F.array_compact(F.array(*[F.when(F.length("path") >= k, F.substring(F.col("path"), 1, k)) for k in sorted(lengths)]))
    keys = urls.withColumn("_p", F.explode(prefixes)).select("host", "path", "c", F.explode(F.transform(suffixes, lambda s: F.concat_ws("\n", s, F.col("_p")))).alias("key"))
    exact = join_salted(bloom_pass(keys, blocks, n_blocks), listed.drop("pl", "labels"), ["key"], F.concat("host", "path"))
    best = exact.groupBy("host", "path", "c").agg(F.max(F.struct(F.length("rule").alias("n"), "hl", "rule", "verdict")).alias("m")).select("host", "path", "c", "m.rule", "m.verdict")
    found = join_counted(rows.where("host <> ''"), stash(best, "judged"), ["host", "path"], "left").drop("c")
    found = found.unionByName(rows.where("host = ''"), allowMissingColumns=True)
    return found.select(F.col(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def rule_table(spark, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")
