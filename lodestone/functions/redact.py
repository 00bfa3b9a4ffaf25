"""Sensitive strings of a text: where they are, and the text around each with all of them hidden."""
from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def spans(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, kind) of hits as stretches that do not overlap: what overlaps is one, of the kind that begins first."""
    out: list[list[int]] = []
    for s, e, kind in sorted(found, key=lambda h: (h[0], h[2], h[1])):
        if out and s < out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e, kind])
    return [tuple(x) for x in out]


def hits_of(text: str, kinds: list[tuple[str, re.Pattern]], width: int, cap: int | None) -> Iterator[tuple[str, int, int, str]]:
    """(kind, start, end, text around with every hit hidden whole, also one that the edge would cut), in order of kind and place."""
    found = [(m.start(), m.end(), k) for k, (_, p) in enumerate(kinds) for m in p.finditer(text) if m.end() > m.start()]
    merged = spans(found)
    starts = [s for s, _, _ in merged]
    for s, e, k in found[:cap]:
        lo, hi = max(0, s - width), min(len(text), e + width)
        i = max(0, bisect_right(starts, lo) - 1)
        at, parts = lo, []
        while i < len(merged) and merged[i][0] < hi:
            a, b, kind = merged[i]
            if b > lo:
                parts += [text[at : max(at, a)], f"<redacted:{kinds[kind][0]}>"]
                at = b
            i += 1
        yield kinds[k][0], s, e, "".join([*parts, text[at : max(at, hi)]])


def sensitive_hits(c: Column, kinds: list[tuple[str, str]], width: int, cap: int | None = None) -> Column:
    """Array of (kind, start, end, snippet) of a text's hits; kinds: names and patterns. Time follows the text and its hits."""
    row = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("snippet", pa.string())]))

    @F.arrow_udf("array<struct<kind:string,start:int,end:int,snippet:string>>")
    def found(text: pa.Array) -> pa.Array:
        known = [(n, re.compile(p)) for n, p in kinds]
        return pa.array([[dict(zip(("kind", "start", "end", "snippet"), h, strict=True)) for h in hits_of(t or "", known, width, cap)] for t in text.to_pylist()], row)

    return found(c)
