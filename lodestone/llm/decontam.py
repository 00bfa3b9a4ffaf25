"""Benchmark decontamination by the q-gram lemma and banded alignment.

An item of m characters matches a document where some region is within k = RATE * m edits of it. By the q-gram lemma
such a region shares at least m - q + 1 - k q of the item's q-grams, all on diagonals (document position minus item
position) that lie within k of each other. Hits are counted in bands of 2 (k + 1) diagonals that overlap by half, so
one band holds them all; bands that reach the bound are verified by a banded alignment of the whole item.

Case and white space do not count: texts are lower-cased, runs of white space become one space. The benchmark is the
query set: it is read in blocks of bounded size, each of which is one pass over all documents.

Null and empty texts and items match nothing. Items of under 1 / RATE characters allow no edit: they match where they
occur exactly, however short they are. Documents with null or equal ids, repeated documents and items match as rows of their own, except that rows that
agree in document and item id are reported once for each document row. Texts of any length are read whole; hits of
repeated q-grams are counted HITS at a time. Empty tables give empty results. Only the named columns are read.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edits allowed for each character of an item; q-grams' length (shorter for short items).
RATE, Q = 0.08, 10
#: Characters of items in a block; characters of documents, and hits of q-grams, looked at together.
BLOCK_CHARS, CHUNK, HITS = 4 << 20, 1 << 20, 1 << 22
#: Texts that a Python worker holds at once.
ROWS = 1000
_WHITE = re.compile(r"\s+")
_TABLE_BITS = 22
#: Stands before a document's first character; no character has this code.
_OUTSIDE = np.uint32(0xFFFFFFFF)


def normalise(text: str | None) -> str:
    return _WHITE.sub(" ", (text or "").lower()).strip()


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(c: np.ndarray, q: int) -> np.ndarray:
    n = len(c) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    c = c.astype(np.uint64)
    for j in range(q):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += c[j : j + n]
        h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def edits_of(m: int) -> int:
    return int(m * RATE)


def gram_length(m: int) -> int:
    """The largest q up to Q for which the lemma's bound is at least 1."""
    return max(1, min(Q, m // (edits_of(m) + 1)))


def best_alignment(item: np.ndarray, region: np.ndarray, k: int) -> tuple[int, int] | None:
    """(edits, end) of the best match of the whole item within the region, if within k edits.

    Both ends in the region are free; region[0] is the first diagonal of the band and the last is len(region) - len(item) + k.
    """
    m, width = len(item), len(region) - len(item) + k + 1
    if width <= 0:
        return None
    at = np.arange(width)
    big = m + 1
    row = np.zeros(width, np.int64)  # row 0: no character of the item, any start
    pad = np.concatenate([region.astype(np.int64), np.full(k + 1, -1)])
    for i in range(1, m + 1):
        # cell d of row i stands for region position i + d
        sub = row + (pad[i - 1 : i - 1 + width] != item[i - 1])
        skip = np.concatenate([row[1:], [big]]) + 1  # an item character without a partner
        new = np.minimum(sub, skip)
        row = np.minimum.accumulate(new - at) + at  # region characters without a partner
        if row.min() > k:
            return None
    row = np.where(m + at <= len(region), row, big)
    d = int(row.argmin())
    return (int(row[d]), m + d) if row[d] <= k else None


class Items:
    """A block of items with its q-gram index."""

    def __init__(self, ids: list[int], texts: list[str], q: int):
        self.ids, self.q, self.codes = ids, q, [_codes(t) for t in texts]
        self.m = np.array([len(c) for c in self.codes])
        self.k = np.array([edits_of(m) for m in self.m])
        self.need = self.m - q + 1 - self.k * q
        self.wide = self.k + 1
        grams = [_grams(c, q) for c in self.codes]
        h = np.concatenate(grams)
        owner = np.repeat(np.arange(len(ids)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams])
        by = np.argsort(h, kind="stable")
        self.h, self.owner, self.place = h[by], owner[by], place[by]
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(self.h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, edits, start, end) of each item's best match in each normalised text."""
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) < CHUNK):
                size += len(texts[to]) + 1
                to += 1
            c = _codes("\0".join(texts[at:to]) + "\0")
            starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[at:to]])])
            yield from ((at + t, *rest) for t, *rest in self._chunk(c, starts))
            at = to

    def _chunk(self, c: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        g = _grams(c, self.q)
        pos = np.flatnonzero(self.table[(g >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        lo, hi = np.searchsorted(self.h, g[pos], "left"), np.searchsorted(self.h, g[pos], "right")
        n = hi - lo
        some = n > 0
        pos, lo, n = pos[some], lo[some], n[some]
        if not len(pos):
            return
        key, band, count = self._bands(pos, lo, n, starts)
        item = key % len(self.ids)
        live = count >= np.maximum(1, self.need[item])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for key, i, b in zip((key // len(self.ids))[live].tolist(), item[live].tolist(), band[live].tolist(), strict=True):
            m, k, w = int(self.m[i]), int(self.k[i]), int(self.wide[i])
            first = b * w - m - k  # the band's first diagonal, less the edits
            size = int(starts[key + 1] - starts[key]) - 1
            s, t = max(0, first), min(size, first + 2 * w + 2 * k + m)
            if t <= s or best.get((key, i), (1,))[0] == 0:
                continue
            left = min(k, max(0, -first))  # diagonals below 0: the item's first characters have no partner
            region = np.concatenate([np.full(left, _OUTSIDE), c[starts[key] + s : starts[key] + t]])
            found = best_alignment(self.codes[i], region, k)
            if found:
                new = (found[0], s - left + found[1], s)
                best[key, i] = min(best.get((key, i), new), new)
        for (key, i), (edits, end, _) in sorted(best.items()):
            yield key, i, edits, max(0, end - int(self.m[i])), end

    def _bands(self, pos: np.ndarray, lo: np.ndarray, n: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text * items + item, band, hits in it), sorted, of the q-grams at pos, each of which has n entries from lo on."""
        step = int(starts[-1] + self.m.max()) + 2  # more than there are bands
        done, held = np.concatenate([[0], np.cumsum(n)]), []
        cut = np.searchsorted(done, np.arange(0, done[-1], HITS))
        for a, b in zip(cut, [*cut[1:], len(pos)], strict=True):
            p, many = pos[a:b], n[a:b]
            text = np.repeat(np.searchsorted(starts, p, "right") - 1, many)
            e = np.repeat(lo[a:b] - (done[a:b] - done[a]), many) + np.arange(done[b] - done[a])
            item = self.owner[e]
            diag = np.repeat(p, many) - starts[text] - self.place[e] + self.m[item]  # made positive
            band = diag // self.wide[item]
            key = text * len(self.ids) + item
            names, code = np.unique(key, return_inverse=True)
            each, count = np.unique(np.concatenate([code * step + band, code * step + band - 1]) + 1, return_counts=True)
            held.append((names[each // step], each % step - 1, count))
        key, band, count = (np.concatenate(x) for x in zip(*held, strict=True))
        if len(held) > 1:
            names, code = np.unique(key, return_inverse=True)
            each, back = np.unique(code * step + band + 1, return_inverse=True)
            key, band, count = names[each // step], each % step - 1, np.bincount(back, count).astype(np.int64)
        return key, band, count


def item_blocks(bench: DataFrame) -> Iterator[Items]:
    """The benchmark, block by block; at most BLOCK_CHARS characters (or one item) are on the driver at once."""
    held: dict[int, tuple[list[int], list[str], list[int]]] = {}
    for r in bench.select("item_id", "text").where("text is not null").toLocalIterator():
        if not (t := normalise(r.text)):
            continue
        ids, texts, size = held.setdefault(gram_length(len(t)), ([], [], [0]))
        ids.append(r.item_id)
        texts.append(t)
        size[0] += len(t)
        if size[0] > BLOCK_CHARS:
            yield Items(ids, texts, gram_length(len(t)))
            del held[gram_length(len(t))]
    for q, (ids, texts, _) in sorted(held.items()):
        yield Items(ids, texts, q)


def leaks(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """docs: doc_id, text; bench: item_id, text. (doc_id, item_id, edits, start, end): characters of the normalised text."""
    spark, out = docs.sparkSession, None
    schema = "doc_id long, item_id long, edits int, start int, end int"
    kind = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    for items in item_blocks(bench):
        shared = spark.sparkContext.broadcast(items)  # bounded by BLOCK_CHARS

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for b in batches:
                for at in range(0, b.num_rows, ROWS):
                    ids, texts = (c.to_pylist() for c in b.slice(at, ROWS).columns)
                    found = [(ids[t], items.ids[i], e, s, n) for t, i, e, s, n in items.search([normalise(t) for t in texts])]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), kind, strict=True)], schema=kind)

        one = docs.select(F.col("doc_id").cast("long"), "text").where("text is not null").mapInArrow(run, schema)
        out = one if out is None else out.union(one)
    return out if out is not None else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """docs, as they are, without the rows in which some item is found: row by row, whatever their ids, without a shuffle."""
    at = docs.columns.index("text")
    for items in item_blocks(bench):
        shared = docs.sparkSession.sparkContext.broadcast(items)  # bounded by BLOCK_CHARS

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(0, b.num_rows, ROWS):
                    some = b.slice(k, ROWS)
                    clean = np.ones(some.num_rows, bool)
                    clean[[t for t, *_ in shared.value.search([normalise(t) for t in some.column(at).to_pylist()])]] = False
                    yield some.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
