"""Lexicon matching as column expressions."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automaton import contained_terms, matched_terms, term_positions
from .text import text_blob, token_count

#: Above so many terms a lexicon is matched by an automaton; the result is the same.
LARGE = 64


def alternation(terms: list[str]) -> str:
    """One pattern for all terms, longest first, so that the leftmost-longest term matches."""
    return "|".join(re.escape(t) for t in sorted({t.lower() for t in terms if t}, key=lambda t: (-len(t), t)))


def count_terms(c: Column, terms: list[str]) -> tuple[Column, Column]:
    """How many non-overlapping terms c has, case aside, and the sorted distinct ones."""
    if len(terms) > LARGE:
        found = matched_terms(c, terms)
    else:  # one pass serves both
        found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(alternation(terms)), F.lit(0))
    return F.size(found), F.array_sort(F.array_distinct(found))


def hits(c: Column, terms: list[str]) -> Column:
    """Terms that are in c, overlapping ones too, in the lexicon's order."""
    if len(terms) > LARGE:
        return contained_terms(c, terms)
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(low, F.lower(t)))


def lexicon_score(df: DataFrame, text_cols: list[str], target: list[str], context: list[str], domains: dict[str, list[str]], script_cue: str | None = None) -> DataFrame:
    """Counts and densities for each domain, in one projection."""
    df = df.withColumn("analysis_text", text_blob(*[F.col(c) for c in text_cols])).withColumn("token_count", token_count(F.col("analysis_text")))
    text, out = F.col("analysis_text"), {}
    for name, terms in (("target_marker", target), ("context_marker", context)):
        out[f"{name}_count"], out[f"matched_{name}s"] = count_terms(text, terms)
    for name, terms in domains.items():
        out[f"{name}_count"], out[f"{name}_matched_terms"] = count_terms(text, terms)
        out[f"{name}_score"] = out[f"{name}_count"] / F.col("token_count")
    out["binding_present"] = (out["target_marker_count"] > 0) & (out["context_marker_count"] > 0)
    if script_cue:
        out["has_script_cue"] = text.rlike(script_cue)
    return df.withColumns(out)


def around(text: Column, start: Column, end: Column, width: int) -> Column:
    """The part of text from width characters before start to width characters after end."""
    return F.substring(text, F.greatest(start - width, F.lit(0)) + 1, F.least(end + width, F.length(text)) - F.greatest(start - width, F.lit(0)))


def kwic(df: DataFrame, text: str, target: list[str], context: list[str], width: int = 80) -> DataFrame:
    """One row for each target match: start, end, marker, window of width characters on each side, context hits in it."""
    found = term_positions(F.col(text), target)
    rows = df.select("*", F.posexplode(found).alias("hit", "_m"))
    start, end = F.col("_m.start"), F.col("_m.end")
    rows = rows.withColumns({"start": start, "end": end, "marker": F.col("_m.match"), "window": around(F.col(text), start, end, width)}).drop("_m")
    return rows.withColumn("context_hits", hits(F.col("window"), context))


def merge_windows(windows: DataFrame, keys: list[str], order: list[str], last: list[str] = ()) -> DataFrame:
    """One row for each key: ordered distinct markers, context hits and windows, the span's ends, the last row's metadata."""
    rows = F.array_sort(F.collect_list(F.struct(*order, "marker", "context_hits", "window")))
    out = windows.groupBy(*keys).agg(rows.alias("_r"), F.min("start").alias("window_start"), F.max("end").alias("window_end"), F.count("*").alias("windows"), *[F.max_by(c, F.struct(*order)).alias(c) for c in last])
    return out.withColumns({
        "markers": F.array_distinct(F.transform("_r", lambda r: r["marker"])),
        "contexts": F.array_distinct(F.flatten(F.transform("_r", lambda r: r["context_hits"]))),
        "window_text": F.array_join(F.array_distinct(F.transform("_r", lambda r: r["window"])), " "),
    }).drop("_r")
