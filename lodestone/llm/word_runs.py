"""Periodic runs of words: Baier's grouping gives Lyndon arrays under both orders, Lyndon roots extend into runs.

Words are runs of characters other than space and tab .. carriage return, numbered from 0. A run is a stretch with smallest
period q (words q apart are the same) that cannot be extended and is at least max(least, times * q) words long; times is 3 or
more, so that two whole roots stand side by side in each run.

1. A run holds each of its words at least `times` times, so words that are rarer in a stretch are in none: they cut the
   text into stretches, which are cut again until nothing changes. Stretches under `least` words go.
2. Phase one of Baier's suffix sorter puts the suffixes of a stretch into groups by their longest Lyndon prefix, from the
   highest group down: a group lengthens the group of the nearest lower suffix before each of its members. The group's
   length is the Lyndon array. It is done for an order of the words and for its reverse; each run has its roots in one.
3. Suffixes q apart in one group of length q begin with the same Lyndon word: a chain of roots, compared as groups and not
   as hashes. The longest common extensions at both ends make it a run; runs that both orders find are one.

A document is one row of work: time is about linear and memory linear in its words, and there is no shuffle. Null and empty
texts have no words and no runs, and their collapsed text is empty (never null). Repeated rows and rows with null ids are rows of their own;
ties cannot occur, as runs are sets of words' places. Empty tables give empty results; columns other than doc_id and text are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that a Python worker holds at once.
ROWS = 500
LEAST, TIMES = 24, 3


def stretches(seq: np.ndarray, least: int = LEAST, times: int = TIMES) -> Iterator[tuple[int, int]]:
    """First and last + 1 of the stretches that may hold runs; each of their words occurs there at least so many times."""
    todo = [(0, len(seq))]
    while todo:
        a, b = todo.pop()
        if b - a < least:
            continue
        _, back, count = np.unique(seq[a:b], return_inverse=True, return_counts=True)
        rare = np.flatnonzero(count[back] < times)
        if not len(rare):
            yield a, b
            continue
        first, last = np.concatenate([[0], rare + 1]), np.concatenate([rare, [b - a]])
        wide = last - first >= least
        todo.extend(zip((first[wide] + a).tolist(), (last[wide] + a).tolist(), strict=True))


def lyndon_groups(w: list[int], m: int) -> tuple[list[int], list[int]]:
    """Group of each suffix of w, words of which are 0 .. m - 1, and the length of each group's Lyndon word."""
    n = len(w)
    members: list[list[int]] = [[] for _ in range(m)]
    for i, c in enumerate(w):
        members[c].append(i)
    group, length = list(w), [1] * m
    below, above = list(range(-1, m - 1)), list(range(1, m + 1))
    earlier, done = list(range(-1, n - 1)), bytearray(n + 1)  # place -1 is never done
    g = m - 1
    while g >= 0:
        mine = [s for s in members[g] if group[s] == g]
        for s in mine:
            done[s] = 1
        times: dict[int, int] = {}
        for s in mine:
            p = earlier[s]
            while done[p]:
                q = earlier[p]
                if done[q]:
                    q = earlier[p] = earlier[q]
                p = q
            earlier[s] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for p, k in times.items():
            moves.setdefault((k, group[p]), []).append(p)
        for k, h in sorted(moves, reverse=True) if len(moves) > 1 else moves:
            new, over = len(members), above[h]
            members.append(moves[k, h])
            length.append(length[h] + k * length[g])
            below.append(h)
            above.append(over)
            above[h] = new
            below[over] = new  # a lower group always has one above it
            for p in moves[k, h]:
                group[p] = new
        g = below[g]
    return group, length


def runs_of(seq: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of words, given as numbers, sorted by start and period."""
    found: set[tuple[int, int, int]] = set()
    for a, b in stretches(seq, least, times):
        names, rank = np.unique(seq[a:b], return_inverse=True)
        n, m = b - a, len(names)
        for w in (rank.tolist(), (m - 1 - rank).tolist()):
            groups, lengths = (np.array(x) for x in lyndon_groups(w, m))
            q, at = lengths[groups], np.arange(n)
            same = (at + q < n) & (groups[np.minimum(at + q, n - 1)] == groups)
            first = same & ~((at >= q) & (groups[at - q] == groups))
            for s, p in zip(at[first].tolist(), q[first].tolist(), strict=True):
                e = s + p
                while e < n and same[e - p]:
                    e += p
                if e - s + 2 * (p - 1) < max(least, times * p):
                    continue
                while e < n and w[e] == w[e - p]:
                    e += 1
                while s > 0 and w[s - 1] == w[s - 1 + p]:
                    s -= 1
                if e - s >= max(least, times * p):
                    found.add((s + a, e - s, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(text: str | None, least: int = LEAST, times: int = TIMES) -> tuple[list[tuple[int, int, int]], bytes]:
    """The runs of a text, and its words without those that any run holds after its first period."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    known: dict[bytes, int] = {}
    found = runs_of(np.array([known.setdefault(w, len(known)) for w in words], np.int64), least, times) if len(words) >= least else []
    if found:
        gone = np.zeros(len(words) + 1, np.int64)
        for s, n, p in found:
            gone[s + p] += 1
            gone[s + n] -= 1
        words = [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g]
    return found, b" ".join(words)


def word_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs: doc_id, text. doc_id, runs (start, length, period; by start, then period), text collapsed to one period of each run."""
    kind = "array<struct<start: long, length: long, period: long>>"
    each = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                some = batch.slice(k, ROWS)
                got = [collapse(t, least, times) for t in some.column(1).to_pylist()]
                runs = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in found] for found, _ in got], each)
                text = pa.array([t for _, t in got], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([some.column(0), runs, text], names=["doc_id", "runs", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, runs {kind}, text string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared as fractions; of equals the first by start, then period. Null if none."""
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def digests(found: DataFrame) -> DataFrame:
    """Of word_runs' rows: counts, the strongest run, checksums of all runs and of the collapsed text."""
    best = found.withColumn("best", strongest(F.col("runs")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2(F.col("text"), 256).alias("collapsed_sha256"),
    )


def with_repeats(docs: DataFrame) -> DataFrame:
    """Texts of a tenth of the documents, chosen by the id's checksum, with everything from some word on repeated periodically.

    h = crc32(id), g = h div 10; where h % 10 = 0, word i >= a becomes word a + (i - a) % p, a = g % n, p = 1 + (n - a) div (3 + g % 8).
    Other texts, and null or empty ones, stay as they are; the changed ones are words joined by a space.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("words"))
    placed = words.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.expr("h div 10 % n"))).withColumn("p", F.expr("1 + (n - a) div (3 + h div 10 % 8)"))
    tail = F.expr("slice(flatten(array_repeat(slice(words, cast(a + 1 as int), cast(p as int)), cast(1 + (n - a) div p as int))), 1, cast(n - a as int))")
    text = F.when(F.col("n") > 0, F.array_join(F.concat(F.expr("slice(words, 1, cast(a as int))"), tail), " ")).otherwise(F.col("text"))
    return placed.select("doc_id", text.alias("text"))
