"""Collocations by the stripes pattern: for each prefix an associative counter of the words that come next.

Words stand in pieces of a text; a phrase is up to `most` words in a row inside a piece. Each task counts blocks of texts
into stripes (language, prefix, next words, counts); stripes of a prefix are dealt by (language, prefix, segment of the next word),
so that the stripe of a frequent prefix is many rows, and merged element by element. The merged stripes are the one structure:
an entry is the count of a phrase, the entry of a prefix in its own prefix's stripe is that prefix's total, the entry of a
phrase without its first word is that of its rest, and a phrase's subsumption maximum is the largest entry of its stripe or of the
stripes' entries that end in it (a longer phrase cannot be more frequent than these).

Stripes of no word and of one word are counted in a first pass over all texts. A frequent phrase consists of frequent pairs,
so a second pass counts longer phrases only where all pairs are found in a blocked Bloom filter of the frequent pairs.
The filter is of fixed size (8 MB) and only spares work: what it lets through wrongly is too rare in the merged stripes.
Candidates occur at least `least` times; all counts are whole numbers, products are decimals of 38 digits.

Null texts are empty and null languages are `und`. Languages without candidates have no rows; empty tables give empty results.
Repeated rows count as often as they occur. Ties in score and count are ranked by phrase, in the order of UTF-8 bytes; phrases
of a language are distinct, so ranks are. Long texts are a block of their own. Columns other than text and lang are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, stash, unstash
from .hashing import mix, separators, span_hashes, words

#: Words of a phrase, its least count, and phrases returned for each language.
MOST, LEAST, TOP = 4, 30, 2000
#: Bytes of text that a Python worker counts at once; segments of a stripe (of that of no word); 64-bit blocks of the filter; rows of an Arrow batch.
BLOCK, SEGMENTS, WORDS, SLOTS, ROWS = 8 << 20, 16, 256, 1 << 20, 50_000
#: Lower-cases A-Z, makes ends of pieces line feeds and tabs spaces.
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
_SPLIT = separators()
_SCHEMA = "lang string, size int, prefix string, segment int, next array<string>, n array<long>"
_KIND = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("prefix", pa.string()), ("segment", pa.int32()), ("next", pa.list_(pa.string())), ("n", pa.list_(pa.int64()))])


def _hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each of some strings; the same in every process."""
    strings = pa.concat_arrays([strings.cast(pa.binary())])  # offsets from 0
    at = np.frombuffer(strings.buffers()[1], np.int32)[: len(strings) + 1].astype(np.int64)
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[: at[-1]]
    return span_hashes(data, at[:-1], at[1:])


class Block:
    """Words of some texts of one language: number of each, whether the next one is in the same piece, the distinct words."""

    def __init__(self, texts: list[str]):
        joined = b"\n".join(t.encode("utf-8", "surrogatepass").translate(_TABLE) for t in texts)
        data = np.frombuffer(joined, np.uint8)
        starts, _ = words(data, _SPLIT)
        coded = pa.array(joined.split(), pa.binary()).dictionary_encode()
        self.ids = coded.indices.to_numpy().astype(np.int64)
        self.words = coded.dictionary.cast(pa.string())
        piece = np.cumsum(data == 10, dtype=np.int32)[starts]
        self.tied = np.concatenate([piece[1:] == piece[:-1], [False]]) if len(starts) else np.zeros(0, bool)
        self.hashes = _hashes(self.words)

    def stripes(self, lang: str, size: int, prefix: np.ndarray, following: np.ndarray, n: np.ndarray, names: pa.Array) -> Iterator[pa.RecordBatch]:
        """Rows of stripes from (prefix, next word, count); prefix numbers the names."""
        segments = SEGMENTS if size else WORDS
        code = prefix * segments + (self.hashes[following] >> np.uint64(40)).astype(np.int64) % segments
        order = np.argsort(code, kind="stable")
        code = code[order]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
        ends = np.append(first[1:], len(code))
        following, n = self.words.take(pa.array(following[order])), n[order].astype(np.int64)
        for k in range(0, len(first), ROWS):
            a, b = first[k : k + ROWS], ends[k : k + ROWS]
            at = pa.array(np.append(a, b[-1]) - a[0], pa.int32())
            some = slice(int(a[0]), int(b[-1]))
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(lang, len(a)), pa.repeat(pa.scalar(size, pa.int32()), len(a)), names.take(pa.array(code[a] // segments)), pa.array(code[a] % segments, pa.int32()),
                 pa.ListArray.from_arrays(at, following[some]), pa.ListArray.from_arrays(at, pa.array(n[some]))], schema=_KIND)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Places whose next word is in the same piece, and the code of the two words."""
        at = np.flatnonzero(self.tied)
        return at, self.ids[at] * len(self.words) + self.ids[at + 1]

    def short(self, lang: str) -> Iterator[pa.RecordBatch]:
        """Stripes of no word (of size 0) and of one word; the number of all words has size -1."""
        if not len(self.ids):
            return
        one = np.zeros(1, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([-1], pa.int32()), pa.array([""]), pa.array([0], pa.int32()), pa.array([[""]], pa.list_(pa.string())), pa.array([[len(self.ids)]], pa.list_(pa.int64()))], schema=_KIND)
        count = np.bincount(self.ids)
        yield from self.stripes(lang, 0, np.repeat(one, len(count)), np.arange(len(count)), count, pa.array([""]))
        code, n = np.unique(self.pairs()[1], return_counts=True)
        yield from self.stripes(lang, 1, code // len(self.words), code % len(self.words), n, self.words)

    def long(self, lang: str, bits: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
        """Stripes of two words and more, where the filter has all pairs."""
        at, code = self.pairs()
        pair, back = np.unique(code, return_inverse=True)
        v = len(self.words)
        there = found(bits, pair_hashes(_hashes(pa.array([lang])), self.hashes[pair // v], self.hashes[pair % v]))
        starts, code = np.full(len(self.ids) + 1, -1), back  # number of the known pair that begins at each word
        starts[at] = np.where(there[back], code, -1)
        names = (pair // v, pair % v)
        names = pc.binary_join_element_wise(self.words.take(pa.array(names[0])), self.words.take(pa.array(names[1])), " ")
        held = starts  # number of the phrase of `size` words that begins at each word
        for size in range(2, most):
            at = np.flatnonzero((held[:-1] >= 0) & (starts[np.minimum(np.arange(len(self.ids)) + size - 1, len(self.ids))] >= 0))
            code, back, n = np.unique(held[at] * v + self.ids[at + size] if len(at) else np.zeros(0, np.int64), return_inverse=True, return_counts=True)
            yield from self.stripes(lang, size, code // v, code % v, n, names)
            names = pc.binary_join_element_wise(names.take(pa.array(code // v)), self.words.take(pa.array(code % v)), " ")
            held = np.full(len(self.ids) + 1, -1)
            held[at] = back


# the filter
def pair_hashes(lang: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(mix(first + lang) * np.uint64(3) + second)


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash, and its three bits there."""
    bits = np.zeros(len(h), np.uint64)
    for k in (0, 6, 12):
        bits |= np.uint64(1) << ((h >> np.uint64(k)) & np.uint64(63))
    return (h >> np.uint64(20)).astype(np.int64) % SLOTS, bits


def found(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at, mine = _places(h)
    return bits[at] & mine == mine


def pair_filter(pairs: DataFrame) -> np.ndarray:
    """pairs: lang, prefix, next. The blocks of the filter; they come to the driver, at most SLOTS numbers."""
    kind = pa.schema([("slot", pa.int64()), ("bits", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, bits = _places(pair_hashes(*(_hashes(c) for c in b.columns)))
            order = np.argsort(at, kind="stable")
            slots, first = np.unique(at[order], return_index=True)
            if len(slots):
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(np.bitwise_or.reduceat(bits[order], first).view(np.int64))], schema=kind)

    got = pairs.select("lang", "prefix", "next").mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(SLOTS, np.uint64)
    bits[got.column("slot").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return bits


# on Spark
def _counted(docs: DataFrame, of) -> DataFrame:
    """Stripes of blocks of texts, each block of one language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list[str], list[int]]] = {}
        total = 0
        for b in batches:
            for lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                texts, size = held.setdefault(lang, ([], [0]))
                texts.append(text)
                size[0] += len(text)
                total += len(text)
                if total >= BLOCK:  # the largest goes
                    lang = max(held, key=lambda g: held[g][1][0])
                    texts, size = held.pop(lang)
                    total -= size[0]
                    yield from of(Block(texts), lang)
        for lang in list(held):
            yield from of(Block(held.pop(lang)[0]), lang)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").where("text is not null")
    return rows.mapInArrow(run, _SCHEMA)


def merged(stripes: DataFrame, least: int) -> DataFrame:
    """Stripes of the same prefix added up element by element: (lang, size, prefix, next, n) of frequent entries and of totals."""
    dealt = stripes.repartition("lang", "prefix", "segment").select("lang", "size", "prefix", "segment", F.explode(F.arrays_zip("next", "n")).alias("x"))
    return dealt.groupBy("lang", "size", "prefix", "segment", F.col("x.next").alias("next")).agg(F.sum("x.n").alias("n")).where(f"n >= {least} or size < 0").drop("segment")


def phrase_counts(docs: DataFrame, most: int = MOST, least: int = LEAST) -> list[DataFrame]:
    """docs: text, lang. Merged stripes, as written tables: those of no and one word (and totals), and of more words."""
    low = stash(merged(_counted(docs, lambda block, lang: block.short(lang)), least), "stripes")
    bits = docs.sparkSession.sparkContext.broadcast(pair_filter(low.where("size = 1")))
    return [low, stash(merged(_counted(docs, lambda block, lang: block.long(lang, bits.value, most)), least), "stripes")]


def collocations(docs: DataFrame, most: int = MOST, least: int = LEAST, top: int = TOP, cover: int = 80) -> DataFrame:
    """docs: text, lang. lang, rank, phrase, a, l, r, n, score of each language's first phrases."""
    low, high = phrase_counts(docs, most, least)
    phrase = F.when(F.col("prefix") == "", F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next"))
    rest = F.expr("substring(phrase, instr(phrase, ' ') + 1)")
    rows = low.unionByName(high).withColumn("phrase", phrase)
    none = F.array().cast("array<long>")
    # ls: counts of a phrase's first 1, 2, .. words; rs: of its last 1, 2, .. words
    whole = rows.where("size = 0").select("lang", "phrase", "n", none.alias("ls"), none.alias("rs"))
    done, tables = [], [low, high]
    for size in range(1, most):
        longer = rows.where(f"size = {size}").select("lang", "phrase", "n", "prefix", rest.alias("rest"))
        ends = [longer.groupBy("lang", F.col(c).alias("phrase")).agg(F.count("*").alias(f"c_{c}"), F.max("n").alias(f"n_{c}")) for c in ("prefix", "rest")]
        whole = stash(whole.join(ends[0], ["lang", "phrase"], "left").join(ends[1], ["lang", "phrase"], "left").withColumn("over", F.greatest("n_prefix", "n_rest")), "phrases")
        tables.append(whole)
        done.append(whole)
        heads = whole.where("c_prefix > 0").select("lang", F.col("phrase").alias("prefix"), F.col("c_prefix").alias("c"), F.concat("ls", F.array("n")).alias("ls"))
        tails = whole.where("c_rest > 0").select("lang", F.col("phrase").alias("rest"), F.col("c_rest").alias("c"), F.concat("rs", F.array("n")).alias("rs"))
        both = join_counted(join_counted(longer, heads, ["lang", "prefix"]).drop("c"), tails, ["lang", "rest"])
        whole = both.select("lang", "phrase", "n", "ls", "rs")
    done.append(whole.withColumn("over", F.lit(None).cast("long")))
    cut = F.expr("array_min(transform(sequence(1, size(ls)), k -> named_struct('score', cast(2000000 * cast(n as decimal(20, 0)) as decimal(38, 0)) div cast(ls[k - 1] + rs[size(rs) - k] as decimal(20, 0)), 'k', k, 'l', ls[k - 1], 'r', rs[size(rs) - k])))")
    kept = [d.where("size(ls) > 0").where(f"over is null or 100 * cast(over as decimal(20, 0)) < {cover} * cast(n as decimal(20, 0))").select("lang", "phrase", F.col("n").alias("a"), cut.alias("cut")) for d in done[1:]]
    scored = kept[0]
    for k in kept[1:]:
        scored = scored.unionByName(k)
    scored = scored.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    nth = F.expr("row_number() over (partition by lang order by score desc, a desc, phrase)")
    first = stash(scored.withColumn("rank", nth.cast("long")).where(f"rank <= {top}"), "collocations")
    total = stash(low.where("size < 0").select("lang", "n"), "totals")
    unstash(*tables)
    return first.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
