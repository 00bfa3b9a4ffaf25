"""Token ids in checksummed binary blocks, and back.

Documents are range-partitioned and sorted by id; each task encodes its run with the tokenizers library, closes each
document with an end id, and packs whole documents into blocks of about BLOCK ids by the range coder. A block is a row of a
Parquet table in the shared folder: part and seq give its place, docs and lengths its documents, ids_before its offset
in its part, payload its bytes. Blocks are independent, so any of them can be read (and a lost task rerun) alone.

The ids are those of the library's plain call with add_special_tokens=False; a special token's string in a text gives
that token. A byte-level BPE tokenizer cuts a text into pieces by character classes and encodes each piece for itself. The
cuts are found for many texts at once; the library's model encodes a piece when a Python worker first meets it, and the
worker then knows it by 96 bits of hash, among PIECES at most. Texts with special tokens, rare white space or unassigned
characters, and all texts of other tokenizers, are encoded whole.

Null text counts as empty (the end id alone). Repeated ids keep an order by the text's hash; null ids come first.
Empty tables give empty files. A document is never split: the block in which it begins takes it whole. Columns other
than doc_id and text are not read.
"""
from __future__ import annotations

import contextlib
import ctypes
import itertools
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, stash
from .hashing import chunks, span_hashes
from .range_coder import decode_block, encode_block

#: Ids in a block; pieces that a worker remembers, and the slots for them.
BLOCK, PIECES, SLOT_BITS = 1 << 20, 1_000_000, 21
SLOTS = 1 << SLOT_BITS
_FILE = "part int, seq int, ids_before long, docs array<long>, lengths array<int>, payload binary"
_KIND = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("ids_before", pa.int64()), ("docs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("payload", pa.binary())])
#: Classes of characters: letters, numbers, other marks, plain white space, a text's end, and those of texts encoded whole.
LETTER, NUMBER, MARK, SPACE, END, UNSURE = range(6)
_CLASSES: list[np.ndarray] = []


def _class_of(i: int) -> int:
    c, kind = chr(i), unicodedata.category(chr(i))
    if c in " \t\n\r":
        return SPACE
    if c.isspace() or i < 32 or i == 127 or kind in ("Cn", "Cs"):
        return UNSURE
    return {"L": LETTER, "N": NUMBER}.get(kind[0], MARK)


def char_classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of UTF-8 is part of."""
    if not _CLASSES:
        _CLASSES.append(np.fromiter(map(_class_of, range(0x110000)), np.uint8, 0x110000))
    table = _CLASSES[0]
    out = table[np.minimum(data, 127)]
    at = np.flatnonzero(data >= 0xC0)
    if len(at):
        first = data[at].astype(np.int32)
        more = 1 + (first >= 0xE0) + (first >= 0xF0)
        code = (first & (63 >> more)) << 6 | data[at + 1] & 63
        for k in (2, 3):
            long = np.flatnonzero(more >= k)
            code[long] = code[long] << 6 | data[at[long] + k] & 63
        kind = table[code]
        out[at] = kind
        for k in (1, 2, 3):
            long = more >= k
            out[at[long] + k] = kind[long]
    return out


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of texts (as chunks joins them), and the texts that are better encoded whole.

    A piece is a run of letters, numbers or marks, with one space before it if there is one; an apostrophe with the letters
    of a contraction; or the rest of a run of white space.
    """
    k = char_classes(data)
    k[offsets[1:] - 1] = END
    new = np.empty(len(data), bool)
    new[0] = True
    np.not_equal(k[1:], k[:-1], out=new[1:])
    new[offsets[:-1]] = True
    after = np.flatnonzero((k[:-1] == SPACE) & (k[1:] < SPACE)) + 1
    new[after - 1] = True
    new[after] = data[after - 1] != 32
    quote = np.flatnonzero((data == 39) & new)
    a, b = data[quote + 1], data[np.minimum(quote + 2, len(data) - 1)]
    one = quote[np.isin(a, [ord(c) for c in "stmd"])]
    two = quote[np.isin(a.astype(np.int32) << 8 | b, [ord(x) << 8 | ord(y) for x, y in ("re", "ve", "ll")])]
    for at, n in ((one, 2), (two, 3)):
        new[at + 1] = False
        new[at + n] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(data))
    text = k[starts] != END
    odd = np.unique(np.searchsorted(offsets, np.flatnonzero(k == UNSURE), "right") - 1)
    return starts[text], ends[text], odd


class Encoder:
    """Ids of texts, by pieces that are known from before; arrays hold what is known, so it stays small."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks in parallel; threads would take memory of their own
        from tokenizers import Tokenizer

        self.tok = t = Tokenizer.from_file(path)
        self.size = t.get_vocab_size()
        pre = t.pre_tokenizer
        self.by_pieces = t.normalizer is None and type(pre).__name__ == "ByteLevel" and pre.use_regex and not pre.add_prefix_space and type(t.model).__name__ == "BPE" and t.truncation is None and t.padding is None
        self.special = [x.content for x in t.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.key, self.check = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint32)
        self.first, self.count = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.pool, self.used, self.known = np.zeros(1 << 20, np.uint32), 0, 0

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _slots(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 if it is not known."""
        at = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        found, todo = np.full(len(h), -1, np.int64), np.arange(len(h))
        while len(todo):
            k = self.key[at[todo]]
            hit = (k == h[todo]) & (self.check[at[todo]] == check[todo])
            found[todo[hit]] = at[todo[hit]]
            todo = todo[~hit & (k != 0)]
            at[todo] = (at[todo] + 1) & (SLOTS - 1)
        return found

    def _add(self, h: np.ndarray, check: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """Stores distinct new keys; ids of all in a row, n of each."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        first = self.used + np.cumsum(n) - n
        self.used, self.known = self.used + len(ids), self.known + len(h)
        at, todo = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64), np.arange(len(h))
        while len(todo):
            free = self.key[at[todo]] == 0
            slot, one = np.unique(at[todo[free]], return_index=True)
            take = todo[free][one]
            self.key[slot], self.check[slot], self.first[slot], self.count[slot] = h[take], check[take], first[take], n[take]
            todo = np.setdiff1d(todo, take, assume_unique=True)
            at[todo] = np.where(self.key[at[todo]] == 0, at[todo], (at[todo] + 1) & (SLOTS - 1))

    def _encoded(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces in a row, and how many each has, by the library's model."""
        n = ends - starts
        done = np.cumsum(n)
        chars = _BYTE_CHARS[data[np.repeat(starts - (done - n), n) + np.arange(done[-1])]].tobytes().decode("utf-32-le")
        tokenize, ids, count = self.tok.model.tokenize, [], []
        for a, b in itertools.pairwise([0, *done.tolist()]):
            found = tokenize(chars[a:b])
            count.append(len(found))
            ids += [t.id for t in found]
        return np.array(ids, np.uint32), np.array(count, np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        odd = {t for t, text in enumerate(texts) if any(s in text for s in self.special)} if self.by_pieces else set(range(len(texts)))
        ids, lengths = [], np.zeros(len(texts), np.int64)
        for a, b, data, offsets in chunks([t.encode("utf-8", "surrogatepass") for t in texts], 1 << 18):
            found, sizes = (np.zeros(0, np.uint32), np.zeros(b - a, np.int64)) if not self.by_pieces else self._chunk(data, offsets, a, odd)
            if some := [t for t in range(a, b) if t in odd]:
                parts = np.split(found, np.cumsum(sizes)[:-1])
                for t, whole in zip(some, self.whole([texts[t] for t in some]), strict=True):
                    parts[t - a] = np.array(whole, np.uint32)
                found, sizes = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
            ids.append(found)
            lengths[a:b] = sizes
        return (np.concatenate(ids) if ids else np.zeros(0, np.uint32)), lengths

    def _chunk(self, data: np.ndarray, offsets: np.ndarray, base: int, odd: set[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of one chunk's texts, by pieces; texts that the pieces do not fit are added to odd."""
        if self.known > PIECES:
            self._forget()
        starts, ends, unsure = pieces(data, offsets)
        odd.update((unsure + base).tolist())
        h = span_hashes(data, starts, ends) | np.uint64(1)
        total = np.empty(len(data) + 1, np.uint32)
        total[0] = 0
        np.cumsum(_CHECK[data], dtype=np.uint32, out=total[1:])
        check = total[ends] - total[starts]
        slots = self._slots(h, check)
        while (new := np.flatnonzero(slots < 0)).size:  # again only where equal hashes differ in their check
            one = new[np.unique(h[new], return_index=True)[1]]
            self._add(h[one], check[one], *self._encoded(data, starts[one], ends[one]))
            slots[new] = self._slots(h[new], check[new])
        n, first = self.count[slots].astype(np.int64), self.first[slots].astype(np.int64)
        done = np.concatenate([[0], np.cumsum(n)])
        ids = self.pool[np.repeat(first - done[:-1], n) + np.arange(done[-1])]
        return ids, np.diff(done[np.searchsorted(starts, offsets)])


_CHECK = np.random.default_rng(77).integers(0, 2**32, 256, dtype=np.uint32)
#: Byte-level tokenizers write a byte that is no printable Latin-1 character as the next unused one from 256 on.
_PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
_BYTE_CHARS = np.arange(256, dtype="<u4")
_BYTE_CHARS[np.setdiff1d(np.arange(256), _PRINTED)] = 256 + np.arange(256 - len(_PRINTED))
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This Python worker's encoder; its pieces stay known from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _forget_encoders() -> None:
    """Gives this Python worker's tables back to the system: workers live on and serve later stages."""
    _ENCODERS.clear()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 0, block: int = BLOCK) -> DataFrame:
    """docs: doc_id, text. Writes the block files and returns them as a table. tokenizer: a file on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq, before = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        held, docs, lengths, n = [], [], [], 0

        def out() -> pa.RecordBatch:
            row = (part, seq, before, docs, lengths, encode_block(np.concatenate(held), enc.size))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _KIND, strict=True)], schema=_KIND)

        for b in batches:
            for at in range(0, b.num_rows, 200):
                doc_ids, texts = (c.to_pylist() for c in b.slice(at, 200).columns)
                found, sizes = enc([t or "" for t in texts])
                found = np.insert(found, np.cumsum(sizes), end_id)
                begin = 0
                for i, size in zip(doc_ids, (sizes + 1).tolist(), strict=True):
                    held.append(found[begin : begin + size])
                    docs.append(i)
                    lengths.append(size)
                    begin, n = begin + size, n + size
                    if n >= block:
                        yield out()
                        held, docs, lengths, seq, before, n = [], [], [], seq + 1, before + n, 0
        if n:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return stash(ordered.mapInArrow(run, _FILE), "token-blocks")


def _offsets(files: DataFrame) -> DataFrame:
    """files with start: ids of all blocks before."""
    parts = files.select("part", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before = stash(parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start")), "parts")  # one row a task
    return join_small(files, before, "part").withColumn("start", F.col("part_start") + F.col("ids_before"))


def read_tokens(files: DataFrame, schema: str, each) -> DataFrame:
    """Decodes the blocks; each(doc_id, start, ids) makes a row of schema for each document."""
    kind = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget_encoders()
        for b in batches:
            for r in range(b.num_rows):
                docs, lengths, payload, start = (c[r].as_py() for c in b.columns)
                ids, at, rows = decode_block(payload), 0, []
                for d, n in zip(docs, lengths, strict=True):
                    rows.append(each(d, start + at, ids[at : at + n]))
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

    from pyspark.sql.pandas.types import to_arrow_schema

    table = _offsets(files).select("docs", "lengths", "payload", "start")
    kind = to_arrow_schema(files.sparkSession.createDataFrame([], schema).schema)
    return table.mapInArrow(run, schema)


def read_digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    return read_tokens(files, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda d, start, ids: (d, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
