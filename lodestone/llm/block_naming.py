"""Exact dedup by deterministic block naming.

Each text, without the six ASCII white-space characters, is cut into fixed-size blocks. Equal blocks get the same
integer name: blocks are dealt to hash ranges and named by their rank in the sorted range. Then adjacent names are
paired and the pairs are named in the same way, level by level, until each text has one name. Names depend on
equality alone, so two texts of one level have the same name only if they are equal: no digest takes part.

A task first names its blocks locally and sends each distinct block once, and pairs are named once for each salt, so
a text that a third of all rows share costs a row for each task or salt (SALTS, and more with the number of rows). Names, pairs and groups never meet whole.

Null text counts as empty; empty texts form one group. Of equal texts the longest original (in code points), then the
smallest id, then the first row stays. Repeated rows (equal ids too) are told apart by their place in the input. An
empty table gives an empty result. Other columns of the input are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

BLOCK, SALTS, SALT_ROWS = 2048, 64, 1 << 20
#: A task forgets its local names beyond so many bytes of blocks; later blocks then get new local names.
LOCAL_BYTES = 64 << 20
WHITE = b" \t\n\x0b\x0c\r"
_ROW = "rid long, doc_id long, n_chars long, text_sha256 string, part int, lids array<int>, fresh array<struct<lid:int,block:binary>>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, row, local, held, lid = TaskContext.get().partitionId(), 0, {}, 0, 0
    kind = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("text_sha256", pa.string()), ("part", pa.int32()), ("lids", pa.list_(pa.int32())), ("fresh", pa.list_(pa.struct([("lid", pa.int32()), ("block", pa.binary())])))])
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            ids, texts = (c.to_pylist() for c in batch.slice(at, 500).columns)
            out = []
            for i, t in zip(ids, texts, strict=True):
                raw = (t or "").encode().translate(None, WHITE)
                lids, fresh = [], []
                for k in range(0, len(raw) or 1, BLOCK):
                    b = raw[k : k + BLOCK]
                    if (n := local.get(b)) is None:
                        if held > LOCAL_BYTES:
                            local, held = {}, 0
                        n, lid, held = lid, lid + 1, held + len(b)
                        local[b] = n
                        fresh.append({"lid": n, "block": b})
                    lids.append(n)
                out.append((part << 33 | row, i, len(t or ""), hashlib.sha256(raw).hexdigest(), part, lids, fresh))
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)


def _named(rows: DataFrame, keys: list[str], n_ranges: int) -> DataFrame:
    """rows with name: equal keys and only they get the same integer, by rank in a sorted hash range."""
    at = F.pmod(F.xxhash64(*keys), F.lit(n_ranges))
    rank = F.dense_rank().over(Window.partitionBy("_range").orderBy(*keys))
    return rows.withColumn("_range", at).withColumn("name", rank.cast("long") * n_ranges + F.col("_range")).drop("_range")


def _ranges(rows: int) -> int:
    return max(4096, 1 << (rows // 2048).bit_length())


def _salts(rows: int) -> int:
    return max(SALTS, rows // SALT_ROWS)


def identities(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs: doc_id, text. (rid, doc_id, n_chars, text_sha256), and (rid, level, name): each row's identity."""
    rows = stash(docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(_blocks, _ROW), "blocks")
    n_fresh, longest, n = rows.agg(F.coalesce(F.sum(F.size("fresh")), F.lit(0)), F.coalesce(F.max(F.size("lids")), F.lit(1)), F.count("*")).first()
    fresh = rows.select("part", F.explode("fresh").alias("f")).select("part", "f.lid", "f.block")
    names = _named(fresh, ["block"], _ranges(n_fresh)).select("part", "lid", "name")
    state = rows.select("rid", "part", F.size("lids").alias("n"), F.posexplode("lids").alias("pos", "lid")).join(names, ["part", "lid"]).select("rid", "n", "pos", "name")
    state = stash(state, "names0")
    done, level, salt = [state.where("n = 1").select("rid", F.lit(0).alias("level"), "name")], 0, F.pmod(F.xxhash64("rid"), F.lit(_salts(n)))
    while longest > 1:
        level, longest = level + 1, (longest + 1) // 2
        odd = F.col("pos") % 2 == 1
        pairs = state.where("n > 1").groupBy("rid", "n", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(F.max(F.when(~odd, F.col("name"))).alias("l"), F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(-1)).alias("r"))
        pairs = stash(pairs.withColumn("salt", salt), f"pairs{level}")
        each = pairs.select("salt", "l", "r").distinct()
        state = pairs.join(_named(each, ["l", "r"], _ranges(pairs.count())), ["salt", "l", "r"])
        state = stash(state.select("rid", F.ceil(F.col("n") / 2).cast("int").alias("n"), "pos", "name"), f"names{level}")
        done.append(state.where("n = 1").select("rid", F.lit(level).alias("level"), "name"))
    found = done[0]
    for d in done[1:]:
        found = found.union(d)
    return rows.select("rid", "doc_id", "n_chars", "text_sha256"), found


def exact_dedup(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows, found = identities(docs)
    every = stash(rows.join(found, "rid").withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(_salts(rows.count())))), "identities")
    neg = lambda c: (-F.col(c)).alias(c)
    best: Column = F.max(F.struct("n_chars", neg("doc_id"), neg("rid")))
    part = every.groupBy("level", "name", "salt").agg(F.count("*").alias("c"), best.alias("b"))
    full = part.groupBy("level", "name").agg(F.sum("c").alias("group_size"), F.max("b").alias("b"), F.collect_list("salt").alias("salts"))
    each = full.select("level", "name", "group_size", (-F.col("b.doc_id")).alias("keep_id"), (-F.col("b.rid")).alias("keep_rid"), F.explode("salts").alias("salt"))
    return every.join(each, ["level", "name", "salt"]).select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256")
