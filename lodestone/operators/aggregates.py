"""Weighted indices, audits and summaries over evidence rows."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import band, clamp, contains_any, cut
from ..sources.tables import cut_lineage
from .rules import marker_issues, outlier_reason

BOTH = "positive"


def weighted_index(value: str = "weighted_binding", weight: str = "analysis_weight") -> Column:
    """Sum of weighted values over sum of weights, 0 without weight."""
    return F.when(F.sum(weight) > 0, F.sum(value) / F.sum(weight)).otherwise(0.0)


def weighted_rate(test: Column, weight: str = "analysis_weight") -> Column:
    return F.when(F.sum(weight) > 0, F.sum(F.when(test, F.col(weight)).otherwise(0.0)) / F.sum(weight)).otherwise(0.0)


def share(test: Column) -> Column:
    return F.avg(F.when(test, 1.0).otherwise(0.0))


def metric_columns(distinct: str = "source_ref") -> list[Column]:
    pos = F.col("is_positive")
    level = lambda x: F.count_if(F.col("authority_level") == x).alias(f"{x}_rows")
    return [
        F.count("*").alias("row_count"), F.sum("analysis_weight").alias("weight_sum"), weighted_index().alias("binding_index"), weighted_rate(pos).alias("positive_rate_weighted"),
        share(pos).alias("positive_rate_rows"), level("primary"), level("secondary"), level("tertiary"), F.countDistinct(distinct).alias("unique_sources"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
    ]


def group_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*metric_columns())


def propagation_cube(df: DataFrame) -> DataFrame:
    """The finest grain over time, geography and meaning."""
    return group_metrics(df, ["period", "five_year_bin", "corridor", "family", "marker_frame", "discourse_frame"])


def weighted_mean_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and weighted mean for each key; blank keys are 'unknown'."""
    named = [F.coalesce(F.nullif(F.trim(F.col(k).cast("string")), F.lit("")), F.lit("unknown")).alias(k) for k in keys]
    return df.select(*named, "weighted_binding", "analysis_weight").groupBy(*keys).agg(F.count("*").alias("rows"), F.sum("analysis_weight").alias("weight_sum"), weighted_index().alias("index"))


def binding_flags(df: DataFrame, own: DataFrame, brand_words: list[str], owner: str) -> DataFrame:
    """df: target, context, brand; own: brand, ownership_category. Adds ownership_category and three flags of 0 or 1.

    lexical: both markers (times lexical_proximity where df has it). branding: a context marker and a brand that names it.
    ownership: the brand, case aside, belongs to owner.
    """
    b = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    near = F.coalesce(F.col("lexical_proximity"), F.lit(1.0)) if "lexical_proximity" in df.columns else F.lit(1.0)
    rows = df.withColumn("_b", F.lower(F.trim("brand"))).join(own.select(F.lower(F.trim("brand")).alias("_b"), "ownership_category"), "_b", "left").drop("_b")
    return rows.withColumns({"lexical": b(F.col("target") & F.col("context")) * near, "branding": b(F.col("context") & contains_any(F.col("brand"), brand_words)), "ownership": b(F.col("ownership_category") == owner)})


def binding_index(df: DataFrame, keys: list[str]) -> DataFrame:
    """df: lexical, branding, ownership flags. Their means and 0.5 / 0.25 / 0.25 blend."""
    out = df.groupBy(*keys).agg(F.count("*").alias("rows"), *[F.avg(c).alias(f"{c}_index") for c in ("lexical", "branding", "ownership")])
    return out.withColumn("historical_index", 0.5 * F.col("lexical_index") + 0.25 * F.col("branding_index") + 0.25 * F.col("ownership_index"))


def adjusted_binding(df: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted beside unweighted index, effective weight and their difference."""
    raw = 0.5 * F.col("lexical") + 0.25 * F.col("branding") + 0.25 * F.col("ownership")
    out = df.withColumn("_r", raw).groupBy(*keys).agg(F.count("*").alias("rows"), F.avg("_r").alias("unweighted_index"), F.sum("analysis_weight").alias("effective_weight"), F.when(F.sum("analysis_weight") > 0, F.sum(F.col("_r") * F.col("analysis_weight")) / F.sum("analysis_weight")).otherwise(0.0).alias("weighted_index"))
    return out.withColumn("delta", F.col("weighted_index") - F.col("unweighted_index"))


def semantic_summary(df: DataFrame, keys: list[str], scores: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), share(F.col("binding_present")).alias("binding_rate"), *[F.avg(s).alias(f"mean_{s}") for s in scores])


def value_counts(df: DataFrame, col: str, k: int | None = None) -> DataFrame:
    out = df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(k) if k else out


def top_markers(df: DataFrame, markers: str, k: int) -> DataFrame:
    return value_counts(df.select(F.explode(markers).alias("marker")), "marker", k)


def source_concentration(df: DataFrame, col: str, over: float) -> DataFrame:
    """Sources that hold more than a share of all rows."""
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # one row for each source
    return value_counts(df, col).withColumn("share", F.col("n") / total).where(F.col("share") > over)


def entropy_summary(df: DataFrame, keys: list[str], category: str) -> DataFrame:
    """For each key: volume, index, source mix, and entropy, dominance of a category's shares."""
    df = cut_lineage(df.select(*keys, category, "weighted_binding", "analysis_weight", "is_positive", "authority_level", "source_ref", "year"))
    base = group_metrics(df, keys)
    cells = df.groupBy(*keys, category).agg(F.count("*").alias("c"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy(*keys))
    cells = cells.withColumn("p", p)
    top = F.max_by(F.struct(category, "p"), F.struct("c", F.col(category)))
    mix = cells.groupBy(*keys).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"), F.count("*").alias("categories"), top.alias("t"))
    norm = F.when(F.col("categories") > 1, F.col("entropy") / F.log2("categories")).otherwise(0.0)
    return base.join(mix, keys).select(*keys, "row_count", "weight_sum", "binding_index", "positive_rate_weighted", (F.col("primary_rows") / F.col("row_count")).alias("primary_share"), (F.col("tertiary_rows") / F.col("row_count")).alias("tertiary_share"), "unique_sources", F.abs("entropy").alias("entropy"), F.abs(norm).alias("entropy_normalized"), F.col(f"t.{category}").alias("dominant"), F.col("t.p").alias("dominant_share"))


def first_appearance(df: DataFrame, keys: list[str], min_rows: int = 1) -> DataFrame:
    pos = F.col("is_positive")
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.min("year").alias("first_year"), F.min(F.when(pos, F.col("year"))).alias("first_positive_year"), F.min(F.when(~pos, F.col("year"))).alias("first_negative_year"), F.max("year").alias("last_year"), weighted_index().alias("binding_index")).where(F.col("rows") >= min_rows)


def low_pockets(df: DataFrame, sets: list[list[str]], min_rows: int = 3, gap: float = 0.02) -> DataFrame:
    """Group metrics over several grouping sets in one pass; cells whose index is under 1 by more than gap."""
    cols = sorted({c for s in sets for c in s})
    named = F.array_join(F.array_compact(F.array(*[F.when(F.grouping(c) == 0, F.lit(c)) for c in cols])), " + ")
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols]).agg(F.count("*").alias("row_count"), weighted_index().alias("binding_index"), named.alias("grouping"))
    return out.withColumn("binding_gap", 1 - F.col("binding_index")).where((F.col("row_count") >= min_rows) & (F.col("binding_gap") > gap))


def leave_one_out(df: DataFrame, col: str, min_rows: int = 5) -> DataFrame:
    """The index without each category, from one pass: totals less the category's own sums."""
    g = df.groupBy(F.col(col).alias("excluded")).agg(F.count("*").alias("excluded_rows"), F.sum("weighted_binding").alias("b"), F.sum("analysis_weight").alias("w"))
    t = Window.partitionBy(F.lit(0))  # one row for each category
    g = g.withColumns({"all_b": F.sum("b").over(t), "all_w": F.sum("w").over(t), "all_rows": F.sum("excluded_rows").over(t)})
    left = F.col("all_w") - F.col("w")
    rest = F.when(left > 1e-12, (F.col("all_b") - F.col("b")) / left).otherwise(0.0)
    out = g.select("excluded", "excluded_rows", (F.col("excluded_rows") / F.col("all_rows")).alias("excluded_share"), rest.alias("index_without"), (rest - F.col("all_b") / F.col("all_w")).alias("delta_from_full"))
    return out.where(F.col("excluded_rows") >= min_rows)


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-squared over the dense grid of levels, degrees of freedom and Cramer's V."""
    cells = df.groupBy(F.coalesce(F.col(a).cast("string"), F.lit("unknown")).alias("a"), F.coalesce(F.col(b).cast("string"), F.lit("unknown")).alias("b")).agg(F.count("*").alias("o"))
    rows, cols = cells.groupBy("a").agg(F.sum("o").alias("r")), cells.groupBy("b").agg(F.sum("o").alias("c"))
    grid = rows.join(cols, F.lit(True)).join(cells, ["a", "b"], "left").withColumn("n", F.sum("o").over(Window.partitionBy(F.lit(0))))
    e = F.col("r") * F.col("c") / F.col("n")
    out = grid.agg(F.sum((F.coalesce("o", F.lit(0)) - e) ** 2 / e).alias("chi2"), F.countDistinct("a").alias("levels_a"), F.countDistinct("b").alias("levels_b"), F.max("n").alias("n"))
    k = F.least("levels_a", "levels_b") - 1
    return out.select(F.lit(a).alias("variable"), "levels_a", "levels_b", "chi2", ((F.col("levels_a") - 1) * (F.col("levels_b") - 1)).alias("df"), F.when(k > 0, F.sqrt(F.col("chi2") / (F.col("n") * k))).otherwise(0.0).alias("cramers_v"))


def control_density(df: DataFrame, key: str, kind: str, values: list[str], positive: str) -> DataFrame:
    out = df.groupBy(key).pivot(kind, values).count().fillna(0)
    total = sum((F.col(v) for v in values), F.lit(0))
    return out.withColumn("total", total).withColumn("positive_share", F.when(total > 0, F.col(positive) / total))


def funnel(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """One row for each stage: how many rows satisfy it."""
    one = df.agg(*[F.count_if(test).alias(f"s{i}") for i, (_, test) in enumerate(stages)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("stage"), F.col(f"s{i}").alias("rows")) for i, (n, _) in enumerate(stages)])).alias("x")).select("x.*")


def corroboration(df: DataFrame, keys: list[str], source: str = "source_ref") -> DataFrame:
    """Adds corroborating_sources and corroborating_rows of a row's key."""
    per = df.groupBy(*keys).agg(F.countDistinct(source).alias("corroborating_sources"), F.count("*").alias("corroborating_rows"))
    return df.join(per, keys, "left")


# What a source beyond the first adds to corroboration, and the names of credibility bands
CORROBORATION = 0.35
CREDIBILITY_BANDS = [(0.75, "strong"), (0.65, "good"), (0.5, "moderate")]
COMPONENTS = ("verification", "authority", "novelty", "confidence_score", "corroboration")


def credibility(df: DataFrame) -> DataFrame:
    """df: verification, authority, novelty, confidence_score, corroborating_sources. Adds corroboration, credibility, band."""
    corr = F.least(F.lit(1.0), CORROBORATION * F.greatest(F.col("corroborating_sources") - 1, F.lit(0)))
    score = clamp(0.35 * F.col("verification") + 0.25 * F.col("authority") + 0.20 * clamp(F.col("novelty")) + 0.10 * F.col("confidence_score") + 0.10 * corr)
    return df.withColumns({"corroboration": corr, "credibility": score}).withColumn("band", band(F.col("credibility"), CREDIBILITY_BANDS, "low"))


def order_statistics(df: DataFrame, col: str, ranks: list[int], few: int = 10_000, parts: int = 1024) -> list[float]:
    """The values at the given ranks (from 0) of a numeric column, exactly.

    For each rank the range of values that holds it is narrowed by distributed histograms until few distinct values are left in it.
    """
    values = cut_lineage(df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("v")).agg(F.count("*").alias("n")))
    lo0, hi0 = values.agg(F.min("v"), F.max("v")).first()
    found = []
    for rank in ranks:
        lo, hi, below = lo0, hi0, 0
        while True:
            inner, step = values.where(F.col("v").between(lo, hi)), (hi - lo) / parts
            if step <= 0 or lo + step == lo or inner.limit(few + 1).count() <= few:
                break
            at = F.least(F.floor((F.col("v") - lo) / step), F.lit(parts - 1))
            for r in inner.groupBy(at.alias("p")).agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("p").collect():  # parts rows at most
                if below + r.n > rank:
                    lo, hi = r.lo, r.hi
                    break
                below += r.n
        for r in inner.orderBy("v").toLocalIterator():
            below += r.n
            if below > rank:
                found.append(r.v)
                break
    return found


def exact_quantile(df: DataFrame, col: str, q: float) -> float | None:
    """The q-quantile with linear interpolation between neighbours; null without values."""
    n = df.where(F.col(col).isNotNull()).count()
    if not n:
        return None
    at = q * (n - 1)
    a, b = order_statistics(df, col, [int(at), min(n - 1, int(at) + 1)])
    return a + (b - a) * (at - int(at))


def credibility_summary(df: DataFrame) -> DataFrame:
    """One row: mean, exact median, population deviation, high and low share, rows of each band, component means."""
    df = cut_lineage(df.select("credibility", "band", *COMPONENTS))
    c = F.col("credibility")
    bands = [name for _, name in CREDIBILITY_BANDS] + ["low"]
    return df.agg(
        F.count("*").alias("rows"), F.avg(c).alias("mean"), F.lit(exact_quantile(df, "credibility", 0.5)).cast("double").alias("median"), F.stddev_pop(c).alias("stdev"), share(c >= 0.7).alias("high_ratio"), share(c < 0.5).alias("low_ratio"),
        *[F.count_if(F.col("band") == b).alias(f"{b}_rows") for b in bands], *[F.avg(x).alias(f"mean_{x}") for x in COMPONENTS],
    )


# Targets of phases, full marks of counts, weights of the health score, and what each grade asks for (coverage
# of every phase, verification at least; duplicates less than)
HEALTH_TARGETS = {"1946_1987": 700, "1987_2015": 750, "2015_2025": 300}
HEALTH_FULL = {"sources": 300, "corridors": 12, "top_type_share": 40}
HEALTH_WEIGHTS = {"1946_1987_coverage": 0.20, "1987_2015_coverage": 0.15, "2015_2025_coverage": 0.10, "source_coverage": 0.15, "geographic_coverage": 0.10, "source_type_diversity": 0.10, "verification_quality": 0.10, "uniqueness": 0.05, "ownership_completeness": 0.05, "reproducibility": 0.05}
HEALTH_GRADES = [("A", 90, 85, 10), ("B", 70, 75, 15), ("C", 40, 60, 25)]


def _percent(part: Column, whole: Column) -> Column:
    return clamp(F.coalesce(100 * part / F.nullif(whole, F.lit(0)), F.lit(0.0)), 0.0, 100.0)


def negative_effort(df: DataFrame, searched: DataFrame, expected: list[str], thin: int = 30) -> DataFrame:
    """df: corridor of usable rows; searched: corridor. Corridors that are expected or thin, and whether their absence was searched for.

    effort is the share of all these corridors that were, in percent.
    """
    per = df.groupBy(F.coalesce("corridor", F.lit("UNKNOWN")).alias("corridor")).agg(F.count("*").alias("usable_records"))
    wanted = df.sparkSession.createDataFrame([(c,) for c in expected], "corridor string").join(per, "corridor", "full").fillna(0, ["usable_records"])
    wanted = wanted.where(F.col("corridor").isin(expected) | (F.col("usable_records") < thin))
    hit = searched.where(F.trim("corridor") != "").select(F.trim("corridor").alias("corridor")).distinct().withColumn("_hit", F.lit(True))
    rows = wanted.join(hit, "corridor", "left").withColumn("has_search_log", F.coalesce("_hit", F.lit(False))).drop("_hit")
    effort = 100 * F.avg(F.col("has_search_log").cast("double")).over(Window.partitionBy(F.lit(0)))  # one row for each corridor
    return rows.withColumns({"absence_claim_allowed": F.col("has_search_log"), "effort": effort})


def corpus_health(df: DataFrame, own: DataFrame, searched: DataFrame, expected: list[str], targets: dict[str, int] = HEALTH_TARGETS) -> DataFrame:
    """df: evidence; own: brand, ownership_category (one row a brand); searched: corridor. One row: coverage, quality, score, grade."""
    ok = F.lower(F.trim(F.coalesce("verification_level", F.lit("")))).isin("verified", "probable", "")
    df = cut_lineage(df.select("source_ref", "year", "brand", "corridor", "source_type", F.coalesce(F.lower("confidence"), F.lit("")).alias("confidence"), "period", ok.alias("ok")))
    use = df.where("ok")
    named = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    one = df.agg(F.count("*").alias("all_rows"), F.count_if("ok").alias("usable_records"), *[F.count_if(F.col("ok") & (F.col("period") == p)).alias(p) for p in targets], F.count_if(F.col("ok") & named("source_ref").isNotNull()).alias("referenced"), F.count_if(F.col("ok") & (F.col("confidence") == "low")).alias("low"))
    keys = use.where(F.coalesce(named("source_ref"), F.col("year").cast("string"), named("brand")).isNotNull()).groupBy("source_ref", "year", "brand").agg(F.count("*").alias("n"))
    key = keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("key_rows"), F.count("*").alias("keys"), F.count_if(F.col("n") > 1).alias("split_artifact_groups"))
    places = use.groupBy(F.coalesce(named("corridor"), F.lit("UNKNOWN")).alias("c")).agg(F.count("*").alias("n")).agg(F.count("*").alias("corridors"), F.coalesce(F.min("n"), F.lit(0)).alias("least_corridor"))
    sources = use.select(named("source_ref").alias("r")).where("r is not null").distinct().agg(F.count("*").alias("unique_sources"))
    types = use.groupBy("source_type").agg(F.count("*").alias("n")).agg((100 * F.max("n") / F.sum("n")).alias("top_type_share"))
    brands = use.select(F.lower(named("brand")).alias("b")).where("b is not null").distinct().join(own.select(F.lower(named("brand")).alias("b"), F.lit(1).alias("hit")).distinct(), "b", "left").agg(F.count("*").alias("brands"), F.count("hit").alias("owned"))
    owners = own.agg(F.count("*").alias("owners"), F.count_if(F.coalesce("ownership_category", F.lit("")).isin("", "unknown") == False).alias("known_owners"))  # noqa: E712
    effort = negative_effort(use, searched, expected).agg(F.coalesce(F.max("effort"), F.lit(0.0)).alias("negative_search_effort"))
    for other in (key, places, sources, types, brands, owners, effort):
        one = one.join(other, F.lit(True))  # rows of one
    c = F.col
    out = one.withColumns({
        **{f"{p}_coverage": _percent(c(p), F.lit(t)) for p, t in targets.items()},
        "source_coverage": _percent(c("unique_sources"), F.lit(HEALTH_FULL["sources"])), "geographic_coverage": _percent(c("corridors"), F.lit(HEALTH_FULL["corridors"])),
        "source_type_diversity": clamp(100 - F.greatest(F.lit(0.0), F.coalesce("top_type_share", F.lit(100.0)) - HEALTH_FULL["top_type_share"]), 0.0, 100.0),
        "verification_quality": _percent(c("usable_records"), c("all_rows")), "duplicate_rate": _percent(c("key_rows") - c("keys"), c("key_rows")), "ownership_completeness": _percent(c("known_owners"), c("owners")),
        "ownership_matching_rate": _percent(c("owned"), c("brands")), "low_confidence_probable_rate": _percent(c("low"), c("usable_records")), "reproducibility": _percent(c("referenced"), c("usable_records")),
    }).withColumn("uniqueness", 100 - c("duplicate_rate"))
    out = out.withColumn("health_score", sum((c(k) * w for k, w in HEALTH_WEIGHTS.items()), F.lit(0.0)))
    least = F.least(*[c(f"{p}_coverage") for p in targets])
    grade = F.when((c("all_rows") == 0) | (c("verification_quality") < 40), "F").otherwise("D")
    for g, cover, checked, twice in reversed(HEALTH_GRADES):
        grade = F.when((least >= cover) & (c("verification_quality") >= checked) & (c("duplicate_rate") < twice), g).otherwise(grade)
    names = ["health_score", "grade", "usable_records", "unique_sources", "verification_quality", "duplicate_rate", "split_artifact_groups", "low_confidence_probable_rate", "ownership_completeness", "ownership_matching_rate", "negative_search_effort", "source_coverage", "geographic_coverage", "source_type_diversity", "reproducibility", "least_corridor"]
    return out.withColumn("grade", grade).select(*names, *[f"{p}_coverage" for p in targets])


def claim_flags(health: DataFrame, targets: dict[str, int] = HEALTH_TARGETS) -> DataFrame:
    """health: of corpus_health. Which claims a corpus of this health supports."""
    c, last = F.col, list(targets)[-1]
    good = c("grade").isin("A", "B")
    return health.select(
        "health_score", "grade", good.alias("macro_historical_claims"), (c("least_corridor") >= 30).alias("compare_regions"), (F.least(*[c(f"{p}_coverage") for p in targets]) >= 70).alias("compare_periods"),
        ((c("ownership_completeness") >= 60) & (c("ownership_matching_rate") >= 70)).alias("ownership_shift"), (c(f"{last}_coverage") >= 60).alias("platformization"), (good & (c("health_score") >= 70)).alias("quantitative_tables"),
    )


# Weights of the transparency score; the share of attested pairs that were searched is reported, not weighted
TRANSPARENCY = {"source_traceable": 0.20, "process_log_ref": 0.12, "harvest_log_available": 0.08, "raw_capture_exists": 0.15, "verification_recorded": 0.18, "notes_recorded": 0.07, "expected_pairs_searched": 0.10, "documentation": 0.10}


def transparency(df: DataFrame, captures: DataFrame, searched: DataFrame, log: DataFrame, expected: DataFrame, documents: tuple[bool, bool, bool, bool] = (True, True, True, True)) -> DataFrame:
    """df: evidence with log_ref, capture_id, notes; captures: capture_id; searched, expected: corridor, period; log: the harvest log.

    documents: whether scripts, settings, an audit and documentation are there. One row of nine shares, and their weighted score (0 to 100).
    """
    some = lambda x: F.trim(F.coalesce(F.col(x).cast("string"), F.lit(""))) != ""
    df = cut_lineage(df.select(some("source_ref").alias("source"), (some("log_ref") & ~F.lower(F.coalesce("log_ref", F.lit(""))).startswith("manual")).alias("logged"), "capture_id", (~F.lower(F.trim(F.coalesce("verification_level", F.lit("")))).isin("", "unknown")).alias("verified"), some("notes").alias("noted"), F.trim("corridor").alias("corridor"), "period"))
    one = df.agg(share(F.col("source")).alias("source_traceable"), share(F.col("logged")).alias("process_log_ref"), share(F.col("verified")).alias("verification_recorded"), share(F.col("noted")).alias("notes_recorded"), F.count("*").alias("_n"))
    caught = df.join(captures.select("capture_id").distinct(), "capture_id", "left_semi").agg(F.count("*").alias("_caught"))
    has_log = log.limit(1).agg(F.count("*").cast("double").alias("harvest_log_available"))
    pairs = pair_coverage(df.where("corridor <> ''"), searched, ["corridor", "period"]).select(F.when(F.col("attested") > 0, F.col("coverage")).otherwise(1.0).alias("attested_pairs_searched"))
    hoped = pair_coverage(expected, searched, ["corridor", "period"]).select(F.when(F.col("attested") > 0, F.col("coverage")).otherwise(1.0).alias("expected_pairs_searched"))
    for other in (caught, has_log, pairs, hoped):
        one = one.join(other, F.lit(True))  # rows of one
    out = one.withColumns({"raw_capture_exists": F.when(F.col("_n") > 0, F.col("_caught") / F.col("_n")).otherwise(0.0), "documentation": F.lit(sum(documents) / 4)}).drop("_n", "_caught")
    return out.withColumn("transparency_score", 100 * sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in TRANSPARENCY.items()), F.lit(0.0)))


def pair_coverage(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """How many of df's distinct keys are in other."""
    mine = df.select(*keys).distinct()
    got = mine.join(other.select(*keys).distinct().withColumn("hit", F.lit(1)), keys, "left")
    return got.agg(F.count("*").alias("attested"), F.coalesce(F.sum("hit"), F.lit(0)).alias("covered")).withColumn("coverage", F.when(F.col("attested") > 0, F.col("covered") / F.col("attested")).otherwise(0.0))


def missing_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    blank = lambda c: F.count_if(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "")
    one = df.agg(F.count("*").alias("_n"), *[blank(c).alias(c) for c in cols])
    return one.unpivot(["_n"], cols, "field", "missing").select("field", "missing", F.when(F.col("_n") > 0, F.col("missing") / F.col("_n")).otherwise(0.0).alias("rate"))


def year_outliers(df: DataFrame, lo: int, hi: int) -> DataFrame:
    return df.where(F.col("year").isNull() | ~F.col("year").between(lo, hi))


def confidence_mismatch(df: DataFrame) -> DataFrame:
    """Verified rows of low confidence, and probable ones."""
    low = F.col("confidence_score") <= 0.3
    return df.withColumn("issue", F.when((F.col("verification_level") == "verified") & low, "verified_low_confidence").when((F.col("verification_level") == "probable") & low, "probable_low_confidence")).where("issue is not null")


def short_texts(df: DataFrame, col: str, n: int) -> DataFrame:
    return df.where(F.length(F.trim(F.coalesce(col, F.lit("")))) < n)


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.min("attestation_id").alias("first_id")).where("rows > 1")


def duplicate_rows(df: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Rows whose key occurs before in order of id: each copy but the first, with the size of its group."""
    w = Window.partitionBy(*keys)
    rows = df.withColumns({"group_rows": F.count("*").over(w), "copy": F.row_number().over(w.orderBy(id_col))})
    return rows.where("copy > 1")


def pair_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of each combination of keys, 'unknown' for blanks."""
    named = [F.coalesce(F.nullif(F.trim(F.col(k).cast("string")), F.lit("")), F.lit("unknown")) for k in keys]
    return df.groupBy(F.array_join(F.array(*named), " / ").alias("pair")).agg(F.count("*").alias("rows"))


# Which checks are critical and which are warnings
CRITICAL = ["exact_duplicate_rows", "suspicious_split_groups", "year_outliers", "marker_issues", "low_conf_verified_rows", "short_text_rows"]
WARNINGS = ["high_concentration_sources", "low_conf_probable_rows", "fuzzy_duplicate_pairs"]


def anomaly_report(df: DataFrame, exact: list[str], artifact: list[str], markers: list[str], lo: int, hi: int, short: int, share_over: float, fuzzy: DataFrame | None = None) -> DataFrame:
    """One row for each check: what it finds, and how serious that is.

    exact and artifact: keys of exact duplicates and of split artifacts; rows without the first of them do not count. markers:
    columns whose values are checked. fuzzy: near-duplicate pairs found elsewhere.
    """
    df = cut_lineage(df.select("attestation_id", *{*exact, *artifact, *markers, "year", "text_length", "verification_level", "confidence_score", "source_ref"}))
    level, low = F.lower(F.trim(F.coalesce("verification_level", F.lit("")))), F.col("confidence_score") < 0.5
    one = df.agg(F.count_if(F.col("year").isNull() | ~F.col("year").between(lo, hi)).alias("year_outliers"), F.count_if(F.coalesce("text_length", F.lit(0)) < short).alias("short_text_rows"), F.count_if((level == "verified") & low).alias("low_conf_verified_rows"), F.count_if(level.isin("verified", "probable") & low).alias("low_conf_probable_rows"))
    groups = lambda keys: df.where(F.coalesce(F.col(keys[0]).cast("string"), F.lit("")) != "").groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    parts = [groups(exact).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("exact_duplicate_rows")), groups(artifact).agg(F.count("*").alias("suspicious_split_groups")), marker_issues(df, "attestation_id", markers).agg(F.count("*").alias("marker_issues")), source_concentration(df.where("source_ref is not null"), "source_ref", share_over).agg(F.count("*").alias("high_concentration_sources"))]
    parts.append(fuzzy.agg(F.count("*").alias("fuzzy_duplicate_pairs")) if fuzzy is not None else df.sparkSession.range(1).select(F.lit(0).cast("long").alias("fuzzy_duplicate_pairs")))
    for other in parts:
        one = one.join(other, F.lit(True))  # rows of one
    out = one.unpivot([], CRITICAL + WARNINGS, "check", "found")
    return out.withColumn("severity", F.when(F.col("found") <= 0, "ok").when(F.col("check").isin(CRITICAL), "critical").otherwise("warning"))


def freeze_audit(df: DataFrame, required: list[str], markers: list[str], artifact: list[str], has_critical: bool = False, most_missing: float = 0.02, least_traceable: float = 0.95) -> DataFrame:
    """Whether evidence can be frozen, and why not.

    required and markers: columns of which blanks are counted; artifact: key of an artifact, of which there should be one row.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    df = cut_lineage(df.select(*{*required, *markers, *artifact, "attestation_id", "year", "source_ref", "authority_level"}))
    one = df.agg(
        F.count("*").alias("rows"), share(~blank("source_ref")).alias("traceability"), *[share(blank(c)).alias(f"missing_{c}") for c in (*required, *markers)],
        F.count_if(F.col("year").isNull()).alias("invalid_years"), F.count_if(F.col("authority_level") == "primary").alias("primary_rows"), share(F.col("authority_level") == "tertiary").alias("tertiary_ratio"),
    )
    extra = lambda keys, name, rows: rows.groupBy(*keys).agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name))
    one = one.join(extra(["attestation_id"], "duplicate_ids", df.where(~blank("attestation_id"))), F.lit(True)).join(extra(artifact, "duplicate_artifacts", df), F.lit(True))
    fine = F.lit(True)
    for c in required:
        fine = fine & (F.col(f"missing_{c}") <= most_missing)
    checks = {"structural_missing_ok": fine, "traceability_ok": F.col("traceability") >= least_traceable, "duplicate_free": (F.col("duplicate_ids") == 0) & (F.col("duplicate_artifacts") == 0), "valid_years": F.col("invalid_years") == 0, "no_critical_anomalies": F.lit(not has_critical)}
    ready = F.lit(True)
    for test in checks.values():
        ready = ready & test
    return one.withColumns({**checks, "ready_to_freeze": ready})


def record_quality(df: DataFrame, artifact: list[str], split: list[str], years: tuple[int, int] = (1940, 2026)) -> DataFrame:
    """Grade of a batch of records: C if a hard test fails, B if a warning stands, else A.

    Hard: more than a tenth of the years missing or invalid, two rows of one artifact, split artifacts over 5 % of the rows.
    Warnings: over 5 % of the addresses occur again, over a fifth of the texts are missing.
    """
    df = cut_lineage(df.select(*{*artifact, *split, "year", "text_length", "source_ref", "source_url"}))
    ref = F.regexp_replace(F.lower(F.trim(F.coalesce("source_url", F.lit("")))), "/+$", "")
    no_text = F.coalesce("text_length", F.lit(0)) == 0
    invalid = F.col("year").isNull() | ~F.col("year").between(*years)
    one = df.agg(F.count("*").alias("records"), F.count_if(F.col("year").isNull()).alias("missing_years"), F.count_if(invalid).alias("invalid_years"), F.count_if(no_text).alias("missing_texts"), F.count_if(F.coalesce("source_ref", F.lit("")) == "").alias("missing_sources"))
    urls = df.select(ref.alias("u")).where("u <> ''").groupBy("u").agg(F.count("*").alias("n")).agg(F.count("*").alias("unique_urls"), F.count_if(F.col("n") > 1).alias("duplicate_url_groups"))
    groups = lambda keys, name: df.where(F.coalesce("source_ref", F.lit("")) != "").groupBy(*keys).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias(name))
    for other in (urls, groups(artifact, "duplicate_artifact_groups"), groups(split, "suspicious_split_groups")):
        one = one.join(other, F.lit(True))  # rows of one
    c, n = F.col, F.col("records")
    again = F.when(c("unique_urls") > 0, c("duplicate_url_groups") / c("unique_urls")).otherwise(0.0)
    hard = (c("missing_years") > 0.1 * n) | (c("invalid_years") > 0.1 * n) | (c("duplicate_artifact_groups") > 0) | (c("suspicious_split_groups") > 0.05 * n)
    warning = (again > 0.05) | (c("missing_texts") > 0.2 * n)
    return one.withColumns({"duplicate_url_ratio": again, "grade": F.when(n == 0, "empty").when(hard, "C").when(warning, "B").otherwise("A")})


def milestones(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """metrics: metric, value; thresholds: milestone, metric, threshold. Which are met; a metric that is absent is not."""
    out = thresholds.join(metrics, "metric", "left")
    return out.select(*[c for c in thresholds.columns if c != "threshold"], "value", "threshold", F.coalesce(F.col("value") >= F.col("threshold"), F.lit(False)).alias("passed"))


def milestone_metrics(df: DataFrame, bins: dict[str, tuple[int, int]], phases: list[str], places: list[str]) -> DataFrame:
    """df: evidence with control_type and ownership_category. Long table of the measures that milestones ask for.

    bins: name -> first and last year; phases: of which rows, bins and corridors are counted; places: corridors to count.
    """
    ok = F.lower(F.trim(F.coalesce("verification_level", F.lit("")))).isin("verified", "probable", "")
    in_bin = F.lit(None).cast("string")
    for name, (lo, hi) in bins.items():
        in_bin = F.when(F.col("year").between(lo, hi), name).otherwise(in_bin)
    df = cut_lineage(df.select("source_ref", "brand", "ownership_category", "control_type", "corridor", "period", ok.alias("ok"), in_bin.alias("bin")))
    count = lambda test, name: F.count_if(test).cast("double").alias(name)
    one = df.agg((100 * share(F.col("ok"))).alias("verified_probable_share"), *[count(F.col("ok") & (F.col("period") == p), f"usable_{p}") for p in phases], *[count(F.col("ok") & (F.col("corridor") == p), f"{p}_records") for p in places], *[count(F.col("control_type") == k, f"{k}_rows") for k in ("target", "control_a", "control_b")])
    sources = df.select("source_ref").distinct().agg(F.count("source_ref").cast("double").alias("source_records"))
    full = df.where("ok and bin is not null").groupBy("bin").agg(F.count("*").alias("n")).agg(*[count(F.col("n") >= k, f"bins_ge_{k}") for k in (20, 100)])
    wide = df.where("ok").groupBy("corridor").agg(F.count("*").alias("n")).agg(count(F.col("n") >= 50, "corridors_ge_50"))
    owned = df.groupBy(F.lower("brand").alias("b")).agg(F.count("ownership_category").alias("k")).agg((100 * share(F.col("k") > 0)).alias("ownership_matching_rate"))
    for other in (sources, full, wide, owned):
        one = one.join(other, F.lit(True))  # rows of one
    return one.unpivot([], one.columns, "metric", "value")


def progress(log: DataFrame, wanted: int = 500) -> DataFrame:
    """log: task_id, ok, result_count, accepted_id. Distinct tasks run and done, failures, results and accepted records; what to do next."""
    ok = F.col("ok")
    out = log.agg(F.countDistinct("task_id").alias("tasks"), F.countDistinct(F.when(ok, F.col("task_id"))).alias("tasks_done"), F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"), share(~ok).alias("failure_ratio"), F.sum(F.when(ok, F.col("result_count"))).alias("results"), F.countDistinct(F.when(ok, F.col("accepted_id"))).alias("accepted"))
    out = out.withColumn("yield_rate", F.when(F.col("tasks_done") > 0, F.col("accepted") / F.col("tasks_done")).otherwise(0.0))
    advice = F.when(F.col("tasks") == 0, "stop_nothing_ran").when(F.col("failure_ratio") > 0.5, "stop_failures").when(F.col("accepted") < wanted, "continue_small_batches").otherwise("ready_for_review")
    return out.withColumn("recommendation", advice)


def failure_reasons(log: DataFrame, k: int) -> DataFrame:
    return value_counts(log.where(~F.col("ok")).select(F.coalesce(F.nullif(F.trim("failure_reason"), F.lit("")), F.lit("unknown")).alias("r")), "r", k)


def task_batch_audit(tasks: DataFrame, results: DataFrame, least_direct: float = 0.20, least_ok: float = 0.80) -> DataFrame:
    """tasks: url; results: of a sample of them, status ('ok', 'blocked', 'empty' or another failure). Rates, critical reasons, verdicts."""
    direct = F.coalesce(F.col("url").rlike("^https?://"), F.lit(False))
    one = tasks.agg(F.count("*").alias("tasks"), share(direct).alias("direct_ratio")).join(results.agg(F.count("*").alias("checked"), *[share(F.col("status") == s).alias(f"{s}_rate") for s in ("ok", "blocked", "empty")]), F.lit(True))
    one = one.fillna(0.0, ["direct_ratio", "ok_rate", "blocked_rate", "empty_rate"]).withColumn("failure_rate", F.when(F.col("checked") > 0, 1 - F.col("ok_rate")).otherwise(0.0))
    c, seen = F.col, F.col("checked") > 0
    reasons = F.array_compact(F.array(F.when(c("direct_ratio") == 0, F.lit("no_executable_urls")), F.when(c("direct_ratio") < least_direct, F.lit("direct_url_ratio_below_threshold")), F.when(seen & (c("ok_rate") < least_ok), F.lit("sampled_ok_rate_below_threshold")), F.when(seen & (c("ok_rate") == 0), F.lit("no_working_urls_in_sample"))))
    health = F.when(c("direct_ratio") < 0.05, "critical_queue_not_executable").when(seen & (c("failure_rate") > 0.3), "critical_url_failures").when(seen & (c("failure_rate") > 0.1), "warning_url_failures").otherwise("ok")
    return one.withColumns({"critical_reasons": reasons, "verdict": F.when(F.size(reasons) == 0, "pass").otherwise("fail"), "health": health})


def sample_gate(df: DataFrame) -> DataFrame:
    n, s = F.col("row_count"), F.col("unique_sources")
    return df.withColumn("gate", F.when((n >= 30) & (s >= 5), "quantitative").when((n >= 15) & (s >= 3), "cautious").when(n >= 5, "descriptive").otherwise("casebook"))


def outlier_threshold(df: DataFrame, col: str = "weighted_binding") -> float:
    """The 15 % quantile (exact, interpolated), 0.5 at most; 0.5 without values."""
    q = exact_quantile(df, col, 0.15)
    return 0.5 if q is None else min(0.5, q)


def low_outliers(df: DataFrame, sets: list[list[str]], threshold: float | None = None) -> DataFrame:
    """Rows of low binding by the reasons of outlier_reason, counted over several grouping sets in one pass."""
    cols = sorted({c for s in sets for c in s})
    df = cut_lineage(df.select(*{*cols, "target", "context", "raw_binding", "weighted_binding"} - {"reason"}))
    at = outlier_threshold(df) if threshold is None else threshold
    rows = df.withColumn("reason", outlier_reason(F.col("raw_binding"), F.col("weighted_binding"), F.col("target"), F.col("context"), at)).where("reason <> 'not_outlier'")
    named = F.array_join(F.array_compact(F.array(*[F.when(F.grouping(c) == 0, F.lit(c)) for c in cols])), " + ")
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols]).agg(F.count("*").alias("rows"), F.avg(1 - F.col("weighted_binding")).alias("mean_gap"), named.alias("grouping"))


EDGES, BUCKETS = [-0.01, 0.001, 0.5, 0.8, 1.2], ["zero", "weak", "middle", "strong"]


def bucket_shares(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Share of each value bucket in each key, empty buckets too."""
    cells = df.withColumn("bucket", cut(F.col(value), EDGES, BUCKETS)).where("bucket is not null").groupBy(*keys, "bucket").agg(F.count("*").alias("rows"))
    grid = df.select(*keys).distinct().withColumn("bucket", F.explode(F.array(*map(F.lit, BUCKETS))))
    out = grid.join(cells, [*keys, "bucket"], "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    total = F.sum("rows").over(Window.partitionBy(*keys))
    return out.withColumn("share", F.when(total > 0, F.col("rows") / total))


def binned_surface(df: DataFrame, x: str, y: str, value: str, k: int = 8) -> DataFrame:
    """Mean of value over a k by k grid of equal bins of x and y, with the bins' middles."""
    ends = df.agg(*[f(c).alias(f"{n}_{c}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max))])
    rows = df.join(F.broadcast(ends), F.lit(True))  # one row
    step = lambda c: (F.col(f"hi_{c}") - F.col(f"lo_{c}")) / k
    at = lambda c: F.least(F.floor((F.col(c) - F.col(f"lo_{c}")) / step(c)), F.lit(k - 1)).cast("int")
    mid = lambda c, b: F.col(f"lo_{c}") + (F.col(b) + 0.5) * step(c)
    rows = rows.withColumns({"x_bin": at(x), "y_bin": at(y)}).withColumns({"x_mid": mid(x, "x_bin"), "y_mid": mid(y, "y_bin")})
    return rows.groupBy("x_bin", "y_bin").agg(F.min("x_mid").alias("x_mid"), F.min("y_mid").alias("y_mid"), F.count("*").alias("rows"), F.avg(value).alias("mean_value"))


SURFACE = ("intercept", "x", "y", "xx", "xy", "yy")


def quadratic_surface(df: DataFrame, x: str, y: str, target: str, key: str | None = None, least: int = 20) -> DataFrame:
    """Least squares of target on 1, x, y, x*x, x*y, y*y: terms, coefficients, R squared, rows; overall, or for each key with enough rows.

    Spark sums the moments; only the 6 by 6 normal equations of each key are solved in Python. Where the terms depend on each
    other the shortest solution is given.
    """
    rows = df.select(F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias("key") if key else F.lit("all").alias("key"), F.lit(1.0).alias("t0"), F.col(x).cast("double").alias("t1"), F.col(y).cast("double").alias("t2"), F.col(target).cast("double").alias("t")).dropna()
    rows = rows.withColumns({"t3": F.col("t1") * F.col("t1"), "t4": F.col("t1") * F.col("t2"), "t5": F.col("t2") * F.col("t2")})
    pairs = [(i, j) for i in range(6) for j in range(i, 6)]
    products = {f"p{k}": F.col(f"t{i}") * F.col(f"t{j}") for k, (i, j) in enumerate(pairs)} | {f"q{i}": F.col(f"t{i}") * F.col("t") for i in range(6)} | {"tt": F.col("t") * F.col("t")}
    sums = rows.select("key", *[c.alias(n) for n, c in products.items()]).groupBy("key").agg(F.count("*").alias("n"), *[F.sum(n).alias(n) for n in products])
    sums = sums.select("key", "n", F.array(*[f"p{k}" for k in range(len(pairs))]).alias("xx"), F.array(*[f"q{i}" for i in range(6)]).alias("xt"), "tt")

    @F.pandas_udf("array<double>")
    def solved(xx: pd.Series, xt: pd.Series, tt: pd.Series) -> pd.Series:
        out = []
        for a, b, c in zip(xx, xt, tt, strict=True):
            m = np.zeros((6, 6))
            for (i, j), v in zip(pairs, a, strict=True):
                m[i, j] = m[j, i] = v
            b = np.asarray(b, float)
            scale = 1 / np.sqrt(np.maximum(np.diag(m), 1e-300))  # all terms of like size
            w = scale * np.linalg.lstsq(m * np.outer(scale, scale), b * scale, rcond=1e-13)[0]
            spread = c - b[0] ** 2 / m[0, 0]
            out.append([*w, 1 - (c - 2 * w @ b + w @ m @ w) / spread if spread > 0 else 0.0])
        return pd.Series(out)

    fit = sums.where(F.col("n") >= least).withColumn("w", solved("xx", "xt", "tt"))
    terms = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col("w")[i].alias("coefficient")) for i, t in enumerate(SURFACE)]))
    return fit.select("key", "n", F.col("w")[6].alias("r_squared"), terms.alias("e")).select("key", "e.term", "e.coefficient", "r_squared", F.col("n").alias("rows"))


def yearly_structure(df: DataFrame, keys: list[str]) -> DataFrame:
    """Source mix and index for each year."""
    st = F.col("source_type")
    return df.groupBy(*keys, "year").agg(F.count("*").alias("rows"), share(F.col("authority_level") == "tertiary").alias("tertiary_ratio"), share(F.col("authority_level") == "primary").alias("primary_ratio"), share(contains_any(st, ["tourism", "municipal", "itinerary", "route"])).alias("tourism_ratio"), share(contains_any(st, ["newspaper", "archive", "issue"])).alias("newspaper_ratio"), (F.sum("weighted_binding") / F.greatest(F.sum("analysis_weight"), F.lit(1e-9))).alias("binding_index"))


def casebook(df: DataFrame, test: Column, order: list, n: int) -> DataFrame:
    return df.where(test).orderBy(*order).limit(n)


def pattern_cooccurrence(df: DataFrame, text: str, families: dict[str, str]) -> DataFrame:
    """Rows, share and index of each pattern family; a row may be in several. One pass: every row is of the family null too."""
    labels = F.array(F.lit(None).cast("string"), *[F.when(F.col(text).rlike(f"(?i){p}"), F.lit(n)).otherwise("") for n, p in families.items()])
    out = df.select("weighted_binding", "analysis_weight", "is_positive", F.explode(labels).alias("family")).where("family is null or family <> ''")
    out = out.groupBy("family").agg(F.count("*").alias("rows"), weighted_index().alias("binding_index"), weighted_rate(F.col("is_positive")).alias("positive_rate_weighted"))
    total = F.max(F.when(F.col("family").isNull(), F.col("rows"))).over(Window.partitionBy(F.lit(0)))  # one row for each family
    return out.withColumn("share", F.col("rows") / total).where("family is not null")


def spatial_summary(presence: DataFrame, keys: list[str]) -> DataFrame:
    return presence.groupBy(*keys).agg(F.count("*").alias("records"), F.sum("open_count").alias("open"), F.sum("planned_count").alias("planned"), F.sum(F.col("open_count") + F.col("planned_count")).alias("total"), F.count_if(F.col("open_count") > 0).alias("present_records"), F.countDistinct("brand").alias("brands"))
