"""Rule classifiers: ordered rules of words or patterns become one CASE expression."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import hits
from ..functions.redact import sensitive_hits
from ..functions.text import clamp, collapse, contains_any, text_blob

# Words in a source's type or address that tell its authority
TERTIARY_TYPE = ["blog", "review", "forum", "social", "retrospective", "official_tourism", "municipal_tourism", "tourism_profile"]
PRIMARY_TYPE = ["newspaper", "archive", "scan", "api", "advertisement", "registry", "trademark", "company_filing", "digitised_issue"]
SECONDARY_TYPE = ["official_event", "official_brand", "official_food", "official_itinerary", "municipal", "local_food_media", "food_media", "magazine", "news_article"]
TERTIARY_URL = ["tour", "travel", "blog", "wordpress", "facebook", "instagram"]
PRIMARY_URL = ["newspapers", "archive", "archives", "api", "gov.sg"]
SECONDARY_URL = ["official"]
# Discourse frames, by source type and (second) by any text
FRAMES = [("type", ["newspaper", "advertisement", "archive", "issue"], "archival_ad_or_news"), ("type", ["tourism", "municipal", "itinerary", "route"], "official_tourism_memory"), ("type", ["open_data", "event_page", "activity", "competition"], "official_event_or_open_data"), ("text", ["review", "blog", "consumer", "ugc", "social"], "consumer_or_retrospective_web"), ("type", ["brand", "corporate", "prospectus", "listing"], "brand_or_platform_listing")]
VOICES = [(["review", "comment", "social", "consumer", "ugc", "blog"], "consumer_or_ugc"), (["official", "brand", "listing", "merchant", "platform"], "merchant_or_platform")]


def first_rule(rules: list[tuple[Column, str]], default: str) -> Column:
    out = F.lit(default)
    for test, label in reversed(rules):
        out = F.when(test, label).otherwise(out)
    return out


def classify_first(text: Column, patterns: list[tuple[str, str]], default: str, before: list[tuple[Column, str]] = ()) -> Column:
    """Label of the first pattern found in text, case aside; rules of before come first."""
    return first_rule([*before, *[(F.coalesce(text, F.lit("")).rlike(f"(?iu){p}"), label) for label, p in patterns]], default)


def discourse_frame(source_type: Column, text: Column) -> Column:
    return first_rule([(contains_any(source_type if which == "type" else text_blob(source_type, text), words), label) for which, words, label in FRAMES], "other_discourse")


def platform_voice(*cols: Column) -> Column:
    return first_rule([(contains_any(text_blob(*cols), words), label) for words, label in VOICES], "other_voice")


def authority(source_type: Column, url: Column) -> tuple[Column, Column]:
    """Level and reason; tertiary is tested first."""
    rules = [("tertiary", TERTIARY_TYPE, TERTIARY_URL, "blog/review/social retrospective source"), ("primary", PRIMARY_TYPE, PRIMARY_URL, "dated archive/newspaper/registry-like source"), ("secondary", SECONDARY_TYPE, SECONDARY_URL, "official/media curated narrative source")]
    tests = [(contains_any(source_type, a) | contains_any(url, b), level, why) for level, a, b, why in rules]
    return first_rule([(t, level) for t, level, _ in tests], "secondary"), first_rule([(t, why) for t, _, why in tests], "default secondary classification")


# Words that tell the authority of a source whose level is not given; kinds of sources
INFERRED = [("type", ["newspaper", "archive", "scan", "advertisement", "ad"], "primary"), ("url", ["newspaper"], "primary"), ("url", ["blog"], "tertiary")]
SOURCE_BUCKETS = [(["newspaper", "archive", "scan"], "archive"), (["tourism", "municipal", "travel"], "retrospective"), (["blog", "review", "social"], "blog")]


def infer_authority(level: Column, source_type: Column, url: Column) -> Column:
    """The given level where it is one of the three, else one from type and address."""
    given = F.lower(F.trim(level))
    found = first_rule([(contains_any(source_type if where == "type" else url, words), label) for where, words, label in INFERRED], "secondary")
    return F.when(given.isin("primary", "secondary", "tertiary"), given).otherwise(found)


def source_bucket(source_type: Column) -> Column:
    return first_rule([(contains_any(source_type, words), label) for words, label in SOURCE_BUCKETS], "other")


def item_type(text: Column, groups: list[tuple[str, list[str]]]) -> Column:
    """The first group with a word in the text; 'other' for other texts, 'unknown' for blank ones."""
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    return first_rule([*[(contains_any(text, words), label) for label, words in groups], (~blank, "other")], "unknown")


def row_binding(raw: Column, weighted: Column, weight: Column, lexical: Column, branding: Column, ownership: Column) -> tuple[Column, Column]:
    """Binding of a row between 0 and 1, and which mode gave it.

    explicit: the raw value where there is one. deweighted: the weighted value over the weight that is in it, or as it is where
    it exceeds its weight or there is none. fallback: a blend of the three flags.
    """
    w, v = F.coalesce(weight, F.lit(0.0)), F.greatest(F.lit(0.0), weighted)
    undone = F.when((w > 0) & (v <= w), v / w).otherwise(v)
    value = F.when(raw.isNotNull(), raw).when(weighted.isNotNull(), undone).otherwise(0.5 * lexical + 0.25 * branding + 0.25 * ownership)
    return clamp(value), F.when(raw.isNotNull(), "explicit").when(weighted.isNotNull(), "deweighted").otherwise("fallback")


def rule_score(rules: list[tuple[Column, int, str]]) -> tuple[Column, Column]:
    """Sum of the points of the rules that hold, and their names in order."""
    score = F.lit(0)
    for test, points, _ in rules:
        score = score + F.when(test, points).otherwise(0)
    return score, F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, _, name in rules]))


def decide(score: Column, fired: Column, decisions: list[tuple[list[str], int | None, int | None, str]], default: str = "unknown") -> Column:
    """Label of the first decision that holds.

    A decision (names, least, under, label) holds where a fired rule's name contains one of names and the score is at least
    least and below under, where these are given.
    """
    def holds(names: list[str], least: int | None, under: int | None) -> Column:
        test = F.exists(fired, lambda r: contains_any(r, names))
        test = test if least is None else test & (score >= least)
        return test if under is None else test & (score < under)

    return first_rule([(holds(names, least, under), label) for names, least, under, label in decisions], default)


def stance(text: Column, producer_hits: Column, context: list[str], target: list[str], rejection: list[str], attribute: list[str]) -> tuple[Column, Column]:
    """0 to 4: none, reproduces, adds, shifts to an attribute, rejects; and the evidence."""
    c, t, r, a = (hits(text, words) for words in (context, target, rejection, attribute))
    overlap = F.array_sort(F.array_intersect(c, F.coalesce(producer_hits, F.array().cast("array<string>"))))
    some = lambda x: F.size(x) > 0
    code = F.when(some(r), 4).when(some(c) & some(a) & ~some(t), 3).when(some(overlap), 1).when(some(c), 2).otherwise(0)
    evidence = F.when(code == 4, r).when(code == 3, F.concat(c, a)).when(code == 1, overlap).when(code == 2, c).otherwise(F.array().cast("array<string>"))
    return code, evidence


def experimental_group(text: Column, target: list[str], context: list[str], other: list[str]) -> Column:
    t, c, o = (F.size(hits(text, words)) > 0 for words in (target, context, other))
    return F.when(t & c, "target").when(t, "control_same_target_no_context").when(c & o, "control_context_other_target")


def producer_category(text: Column, markers: list[str], nostalgia: str, style: str) -> Column:
    found = hits(text, markers)
    one = F.element_at(found, 1)
    return F.when(F.size(found) >= 2, "multiple_markers").when(F.size(found) == 0, "no_marker").when(one.rlike(f"(?i){nostalgia}"), "nostalgia_marker").when(one.rlike(f"(?i){style}"), "style_marker").otherwise("explicit_marker")


def response_category(text: Column, producer: Column, markers: list[str], value_words: list[str]) -> Column:
    some = F.size(hits(text, markers)) > 0
    return F.when(some & (producer != "no_marker"), "reproduces").when(some, "adds_new").when(F.size(hits(text, value_words)) > 0, "converted_to_value").otherwise("ignored_or_unmarked")


def evidence_type(found: Column, groups: list[tuple[str, list[str]]], default: str) -> Column:
    return first_rule([(F.arrays_overlap(found, F.array(*map(F.lit, words))), label) for label, words in groups], default)


def target_control(blob: Column, marker: Column, target_rx: str, context_words: list[str]) -> Column:
    """For rows with a context (a context marker, or one of the words in the blob): whether the target is in the blob. Null without a context."""
    context = (F.trim(F.coalesce(marker, F.lit(""))) != "") | contains_any(blob, context_words)
    hit = F.coalesce(blob, F.lit("")).rlike(f"(?iu){target_rx}")
    return F.when(context & hit, "target_positive").when(context, "target_absent_with_context")


# A marker holds letters, digits, white space and these marks only
MARKER_SPECIAL = r"[^\p{L}\p{N}\p{M}_\s;:：/、，。！？\-]"


def marker_issues(df: DataFrame, id_col: str, cols: list[str], short: int = 2, long: int = 200, special: str = MARKER_SPECIAL) -> DataFrame:
    """Values of marker columns that are too short, too long or hold a special character."""
    long_form = df.select(id_col, *cols).unpivot([id_col], cols, "field", "value").where(F.trim("value") != "")
    issue = F.when(F.length("value") < short, "too_short").when(F.length("value") > long, "too_long").when(F.col("value").rlike(special), "special_character")
    return long_form.withColumn("issue", issue).where("issue is not null")


# What a scan for sensitive strings looks for
SENSITIVE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "url": r"https?://[^\s\"'<>]+", "path": r"/(?:home|Users|root)/[A-Za-z0-9._/-]+"}


def sensitive_scan(df: DataFrame, id_col: str, text_col: str, patterns: dict[str, str] = SENSITIVE, terms: list[str] = (), width: int = 60, cap: int | None = None) -> DataFrame:
    """One row for each hit: kind, position among the text's hits, length, and the text around it with every hit redacted whole.

    Hits are redacted in the whole text before it is cut, so that none shows because the edge cuts it.

    terms: further strings to look for, case aside. cap: hits of a text to report, in order of kind and place.
    """
    kinds = [*patterns.items(), *[("term", f"(?i){re.escape(t)}") for t in terms if t.strip()]]
    found = sensitive_hits(F.col(text_col), kinds, width, cap)
    rows = df.where(F.col(text_col).isNotNull()).select(id_col, found.alias("_f")).where(F.size("_f") > 0)
    rows = rows.select(id_col, F.posexplode("_f").alias("hit_no", "_h"))
    return rows.select(id_col, F.col("_h.kind").alias("kind"), "hit_no", (F.col("_h.end") - F.col("_h.start")).alias("hit_length"), collapse(F.col("_h.snippet")).alias("snippet"))


def outlier_reason(raw: Column, weighted: Column, target: Column, context: Column, threshold: float) -> Column:
    """Why a row's binding is low; 'not_outlier' where it is not."""
    none = F.coalesce(raw, F.lit(0.0)) <= 0
    return F.when(none & target & ~context, "target_without_context").when(none & context & ~target, "context_without_target").when(none, "no_binding_control").when(F.coalesce(weighted, F.lit(0.0)) <= threshold, "positive_but_low_weight").otherwise("not_outlier")


def usable(df: DataFrame, level: str = "verification_level", blank_ok: bool = True) -> DataFrame:
    ok = F.lower(F.trim(F.coalesce(level, F.lit("")))).isin("verified", "probable", *([""] if blank_ok else []))
    return df.where(ok)


def unresolved_alerts(df: DataFrame, severity: str | None = None) -> DataFrame:
    out = df.where(~F.coalesce("acknowledged", F.lit(False)))
    return out.where(F.col("severity") == severity) if severity else out
