"""Column functions: text normalisation, lenient parsing, labels, keys."""
from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Score maps
VERIFICATION = {"verified": 1.0, "probable": 0.7, "candidate": 0.3, "rejected": 0.0}
CONFIDENCE = {"high": 0.9, "medium": 0.65, "low": 0.3}
AUTHORITY_ANALYSIS = {"primary": 1.2, "secondary": 0.7, "tertiary": 0.2}
AUTHORITY_TREND = {"primary": 1.0, "secondary": 0.7, "tertiary": 0.4}
NULL_WORDS = ("nan", "NaN", "None", "none")


def strip(c: Column) -> Column:
    """Trims every white space, not only spaces."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


@F.arrow_udf(T.StringType())
def _nfkc(c: pa.Array) -> pa.Array:
    # a few rows at a time, so that little but the batch itself and its result is held
    parts = [pa.array([x and unicodedata.normalize("NFKC", x) for x in c.slice(k, 64).to_pylist()], pa.string()) for k in range(0, len(c), 64)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def nfkc(c: Column) -> Column:
    """NFKC; ASCII texts stand for themselves, only others pass through Python."""
    other = F.octet_length(c) > F.length(c)
    return F.when(other, _nfkc(F.when(other, c))).otherwise(c)


def normalize_text(df, cols: list[str]):
    """Adds normalized_<col>: NFKC, white space collapsed, lower case."""
    return df.withColumns({f"normalized_{c}": F.lower(collapse(nfkc(F.coalesce(F.col(c), F.lit(""))))) for c in cols})


def evidence_norm(c: Column, lower: bool = True) -> Column:
    c = collapse(F.regexp_replace(F.coalesce(c, F.lit("")), r"https?://\S+", " "))
    return F.lower(c) if lower else c


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def first_nonblank(*cols: Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in cols])


def to_double(c: Column, default: float | None = None) -> Column:
    x = c.try_cast("double")
    x = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    return x if default is None else F.coalesce(x, F.lit(default))


def to_year(c: Column) -> Column:
    return strip(c.cast("string")).try_cast("double").try_cast("int")


def clean(df, spec: dict[str, tuple[str, object]]):
    """spec: column -> (type, default). Missing columns are added; null words count as blank."""
    out = {}
    for name, (kind, default) in spec.items():
        if name not in df.columns:
            out[name] = F.lit(default).cast(kind)
        elif kind in ("double", "int"):
            out[name] = F.coalesce(to_double(F.col(name)).cast(kind), F.lit(default).cast(kind))
        else:
            c = blank_to_null(F.col(name).cast("string"))
            out[name] = F.coalesce(F.when(~c.isin(*NULL_WORDS), c), F.lit(default))
    return df.withColumns(out)


def score_map(c: Column, mapping: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    key = F.lower(strip(c))
    for k, v in mapping.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def clamp(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def text_blob(*cols: Column) -> Column:
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in cols])


CJK, LATIN = r"[\x{4e00}-\x{9fff}]", r"[A-Za-z0-9]+"


def token_count(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    return F.greatest(F.lit(1), F.regexp_count(c, F.lit(CJK)) + F.regexp_count(c, F.lit(LATIN)))


def stable_id(prefix: str, n: int, *cols: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])), 1, n))


def url_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), "/+$", "")


def is_direct_url(c: Column) -> Column:
    return F.coalesce(c.rlike("^https?://"), F.lit(False))


def encode_iri(c: Column) -> Column:
    """Percent-encodes what is not allowed in a URI, and leaves its structure and existing escapes."""
    parts = F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+|[^A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]"), p).otherwise(F.regexp_replace(F.url_encode(p), r"\+", "%20"))), "")


def extract_years(c: Column, lo: int, hi: int, eras: dict[str, tuple[int, int]] | None = None) -> Column:
    """Sorted distinct years in [lo, hi] that are named as numbers or by an era's phrase."""
    found = F.transform(F.regexp_extract_all(c, F.lit(r"(?<!\d)(?:1[89]|20)\d\d(?!\d)"), F.lit(0)), lambda y: y.cast("int"))
    for phrase, (a, b) in (eras or {}).items():
        found = F.when(F.contains(c, F.lit(phrase)), F.array_union(found, F.sequence(F.lit(a), F.lit(b)))).otherwise(found)
    return F.array_sort(F.array_distinct(F.filter(found, lambda y: y.between(lo, hi))))


def first_year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?:1[89]|20)\d\d", 0), F.lit("")).cast("int")


def year_bin(c: Column, k: int) -> Column:
    return (F.floor(c / k) * k).cast("int")


def label_ranges(c: Column, ranges: list[tuple[int, int, str]], default: str = "unknown") -> Column:
    """Label of the first range that holds c."""
    out = F.lit(default)
    for lo, hi, label in reversed(ranges):
        out = F.when(c.between(lo, hi), label).otherwise(out)
    return out


def period_matches(c: Column, wanted: str, year: Column | None = None, lo: int | None = None, hi: int | None = None) -> Column:
    c = F.coalesce(c, F.lit(""))
    hit = (c == wanted) | F.contains(c, F.lit(wanted)) | F.contains(F.lit(wanted), c)
    return hit | F.coalesce(year.between(lo, hi), F.lit(False)) if year is not None else hit


# Tokens that mark a collection batch in a group's name
BATCH_TOKENS = r"(?i)\b(?:batch|round|set|part)[ _-]*\d+\b"


def normalize_brand(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), BATCH_TOKENS, ""), r"^[ _/\-]+|[ _/\-]+$", "")


def split_markers(c: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"[;；,/、|]"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: (x != "") & ~x.isin(*NULL_WORDS))


def cut(c: Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the right-closed bin (edges[i], edges[i+1]] that holds c."""
    out = F.lit(None).cast("string")
    for lo, hi, label in zip(edges, edges[1:], labels, strict=False):
        out = F.when((c > lo) & (c <= hi), label).otherwise(out)
    return out


def band(c: Column, cuts: list[tuple[float, str]], default: str) -> Column:
    """Label of the first cut that c reaches."""
    out = F.lit(default)
    for at, label in reversed(cuts):
        out = F.when(c >= at, label).otherwise(out)
    return out


def marker_present(*cols: Column) -> Column:
    return first_nonblank(*cols).isNotNull()


def contains_any(c: Column, words: list[str]) -> Column:
    """Whether c has one of the words in it, case aside."""
    low, out = F.lower(F.coalesce(c, F.lit(""))), F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w.lower()))
    return out


def content_hash(c: Column) -> Column:
    return F.sha1(F.coalesce(c, F.lit("")))


def hash_rank(*parts) -> Column:
    """A reproducible pseudo-random integer below 2**32, the same in other SQL engines."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])), 1, 8), 16, 10).cast("long")
