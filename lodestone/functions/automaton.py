"""Matching of large lexicons: one Aho-Corasick automaton for all terms, in Arrow batches.

A text is read once whatever the number of terms. Texts and terms are lower-cased; positions are characters from 0. Null texts
have no matches; empty terms are left out, repeated ones count once.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_BUILT: dict[tuple[str, ...], object] = {}


def automaton(terms: tuple[str, ...]):
    """The automaton of some terms; a Python worker builds it once."""
    if terms not in _BUILT:
        import ahocorasick

        found = ahocorasick.Automaton()
        for t in terms:
            found.add_word(t, len(t))
        found.make_automaton()
        _BUILT.clear()
        _BUILT[terms] = found
    return _BUILT[terms]


def all_spans(terms: tuple[str, ...], text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of every occurrence of every term, overlapping ones too."""
    if terms and text:
        for last, n in automaton(terms).iter(text):
            yield last - n + 1, last + 1


def longest_spans(terms: tuple[str, ...], text: str) -> Iterator[tuple[int, int]]:
    """(start, end) from left to right: the longest term at the first place where any begins, and on from its end."""
    best: dict[int, int] = {}
    for s, e in all_spans(terms, text):
        if e > best.get(s, 0):
            best[s] = e
    at = 0
    for s in sorted(best):
        if s >= at:
            at = best[s]
            yield s, at


def _terms(terms: list[str]) -> tuple[str, ...]:
    return tuple(sorted({t.lower() for t in terms if t}))


def matched_terms(c: Column, terms: list[str]) -> Column:
    """Array of the non-overlapping terms of c, leftmost and longest, in order."""
    known = _terms(terms)

    @F.arrow_udf("array<string>")
    def found(text: pa.Array) -> pa.Array:
        return pa.array([[t[s:e] for s, e in longest_spans(known, t)] for t in text.to_pylist()], pa.list_(pa.string()))

    return found(F.lower(F.coalesce(c, F.lit(""))))


def contained_terms(c: Column, terms: list[str]) -> Column:
    """Array of the distinct terms that occur in c, overlapping ones too, in the lexicon's order."""
    known, order = _terms(terms), list(terms)

    @F.arrow_udf("array<string>")
    def found(text: pa.Array) -> pa.Array:
        out = []
        for t in text.to_pylist():
            here = {t[s:e] for s, e in all_spans(known, t)}
            out.append([x for x in order if not x or x.lower() in here] if len(here) * 8 > len(order) else [order[k] for k in sorted(k for x in here for k in places[x])])
        return pa.array(out, pa.list_(pa.string()))

    places: dict[str, list[int]] = {}
    for k, x in enumerate(order):
        places.setdefault(x.lower(), []).append(k)
    return found(F.lower(F.coalesce(c, F.lit(""))))


def term_positions(c: Column, terms: list[str]) -> Column:
    """Array of (start, end, match) of the non-overlapping terms of lower-cased c, leftmost and longest."""
    known = _terms(terms)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("match", pa.string())]))

    @F.arrow_udf("array<struct<start:int,end:int,match:string>>")
    def found(text: pa.Array) -> pa.Array:
        return pa.array([[{"start": s, "end": e, "match": t[s:e]} for s, e in longest_spans(known, t)] for t in text.to_pylist()], kind)

    return found(F.lower(F.coalesce(c, F.lit(""))))
