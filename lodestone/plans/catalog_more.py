"""Registered queries of dedupe, resampling and streaming operators."""
from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.lexicon import count_terms
from ..operators import aggregates as ag
from ..operators import dedupe as dd
from ..operators import joins as jn
from ..operators import resample as rs
from ..operators import rules as rl
from ..operators import similarity as sm
from ..operators import windows as wn
from ..sources import append_log
from ..sources.tables import cut_lineage, shared_folder
from ..streaming import keyed, logs
from .catalog import IDX, ITEMS
from .catalog import QUERIES as _ALL
from .catalog import SQL as _ALL_SQL
from .views import EV, LOG, evidence, execution_log, rounded, sql, texts

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = lambda spark, d: rounded(f(spark, d))
        if oracle:
            SQL[name] = oracle
        return f

    return keep


H32 = lambda *parts: f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


# dedupe and similarity
@query("d01_w05_dedupe", sql("SELECT dedupe_key, min(attestation_id) AS attestation_id, arg_min(verification_level, attestation_id) AS verification_level, count(*) AS merged_rows FROM ev GROUP BY dedupe_key", EV))
def _(s, d):
    df = evidence(s, d).select("attestation_id", "dedupe_key", "verification_level", "source_ref", "year")
    return dd.dedupe(df, ["source_ref", "year"], ["attestation_id"], ["verification_level"]).select("dedupe_key", "attestation_id", "verification_level", "merged_rows")


@query("d02_o04_merge_split", sql("""SELECT source_ref, year, brand, min(attestation_id) AS first_id, list_sort(list(attestation_id)) AS merged_ids, count(*) AS merged_row_count, list_sort(list_distinct(flatten(list(target_markers)))) AS targets,
 arg_max(verification_level, struct_pack(r := CASE verification_level WHEN 'verified' THEN 3 WHEN 'probable' THEN 2 ELSE 1 END, i := -attestation_id)) AS verification_level FROM ev GROUP BY source_ref, year, brand""", EV))  # fmt: skip
def _(s, d):
    out = dd.merge_split(evidence(s, d), ["source_ref", "year", "brand"], "attestation_id", ["target_markers"], {"verification_level": {"verified": 3, "probable": 2, "candidate": 1}})
    return out.select("source_ref", "year", "brand", "first_id", "merged_ids", "merged_row_count", F.array_sort("target_markers").alias("targets"), "verification_level")


def _words(s, d, *more):
    """Documents with the words of their whole text."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda x: x != "")
    return texts(s, d, "doc_id", "lang", "source", "text").select("doc_id", "lang", "source", words.alias("words"), *more)


def _word_sets(s, d, *more):
    """Documents with the set of their whole text's words as numbers."""
    return _words(s, d, *more).withColumn("words", F.transform(F.array_distinct("words"), lambda w: tx.hash_rank(w)))


WORDS = rf"""ws AS MATERIALIZED (SELECT doc_id, lang, source, list_transform(list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '')), lambda x: {H32('x')}) AS words FROM documents),
 wx AS MATERIALIZED (SELECT doc_id, lang, len(words) AS n, unnest(words) AS w FROM ws)"""


@query("d03_novelty", sql("""SELECT a.doc_id, a.lang, CASE WHEN len(a.words) = 0 THEN 0.5 WHEN m.s IS NULL THEN 1.0 ELSE 1 - m.s END AS novelty, m.s AS avg_similarity, coalesce(m.n, 0) AS peers FROM ws a LEFT JOIN (SELECT doc_id, avg(j) AS s, count(*) AS n FROM (SELECT a.doc_id, coalesce(c.c, 0) / (a.n + p.n - coalesce(c.c, 0)) AS j, row_number() OVER (PARTITION BY a.doc_id ORDER BY p.pos) AS rn FROM (SELECT doc_id, lang, len(words) AS n FROM ws WHERE len(words) > 0) a
 JOIN ps p ON a.lang = p.lang AND a.doc_id <> p.doc_id LEFT JOIN (SELECT x.doc_id, y.doc_id AS peer, count(*) AS c FROM wx x JOIN wx y ON x.w = y.w AND x.lang = y.lang JOIN ps ON ps.doc_id = y.doc_id GROUP BY 1, 2) c ON c.doc_id = a.doc_id AND c.peer = p.doc_id) WHERE rn <= 200 GROUP BY doc_id) m ON m.doc_id = a.doc_id""", WORDS + ", ps AS (SELECT * FROM (SELECT doc_id, lang, len(words) AS n, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS pos FROM ws WHERE len(words) > 0) WHERE pos <= 201)", "novelty avg_similarity"))  # fmt: skip
def _(s, d):
    return dd.novelty(_word_sets(s, d), "doc_id", "lang", "words")


PAIRS = WORDS + """, pr AS (SELECT p.a, p.b, c / (x.n + y.n - c) AS similarity, x.source AS source_a, y.source AS source_b FROM (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM wx a JOIN wx b ON a.w = b.w AND a.lang = b.lang AND a.doc_id < b.doc_id AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) GROUP BY 1, 2) p
 JOIN (SELECT doc_id, source, len(words) AS n FROM ws) x ON x.doc_id = a JOIN (SELECT doc_id, source, len(words) AS n FROM ws) y ON y.doc_id = b WHERE c / (x.n + y.n - c) >= 0.8)"""


@query("j08_d04_narrative_pairs", sql("SELECT a, b, similarity, source_a, source_b FROM pr WHERE source_a <> source_b", PAIRS, "similarity"))
def _(s, d):
    return dd.narrative_pairs(_word_sets(s, d), "doc_id", "lang", "source", "words", 0.8)


@query("d05_template_filter", f"WITH RECURSIVE {PAIRS}, e AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr), r AS (SELECT a AS node, a AS reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a), c AS (SELECT node, min(reach) AS c FROM r GROUP BY node), k AS (SELECT doc_id, coalesce(c, doc_id) AS component, len(words) AS n FROM ws LEFT JOIN c ON node = doc_id) SELECT doc_id, component, row_number() OVER w = 1 AS kept, CASE WHEN row_number() OVER w > 1 THEN 'template_duplicate' END AS reason, count(*) OVER (PARTITION BY component) AS component_rows FROM k WINDOW w AS (PARTITION BY component ORDER BY n DESC, doc_id)")
def _(s, d):
    return dd.template_filter(_word_sets(s, d), "doc_id", "lang", "words", 0.8, [F.size("words")])


@query("j08_refined_pairs")
def _(s, d):
    """Candidates by shared words, then the exact sequence similarity of the whole texts."""
    return sm.refined_pairs(_word_sets(s, d, "text"), "doc_id", ["lang"], "words", "text", 0.8, 0.9)


@query("j09_d06_source_overlap", sql("SELECT x.source AS a, y.source AS b, count(*) / (min(x.n) + min(y.n) - count(*)) AS overlap FROM (SELECT source, w, count(*) OVER (PARTITION BY source) AS n FROM (SELECT DISTINCT source, unnest(words) AS w FROM ws) WHERE source IN (SELECT source FROM ws GROUP BY source ORDER BY count(*) DESC, source LIMIT 200)) x JOIN (SELECT source, w, count(*) OVER (PARTITION BY source) AS n FROM (SELECT DISTINCT source, unnest(words) AS w FROM ws) WHERE source IN (SELECT source FROM ws GROUP BY source ORDER BY count(*) DESC, source LIMIT 200)) y ON x.w = y.w AND x.source < y.source GROUP BY 1, 2 HAVING count(*) / (min(x.n) + min(y.n) - count(*)) >= 0.05", WORDS, "overlap"))
def _(s, d):
    return dd.source_overlap(_words(s, d), "source", "words", 200, 0.05, tx.hash_rank)


@query("j10_d07_neighbours", sql("SELECT a, b, c / (na + nb - c) AS similarity FROM (SELECT a.doc_id AS a, b.doc_id AS b, len(a.words) AS na, len(b.words) AS nb, len(list_intersect(a.words, b.words)) AS c FROM nb a JOIN nb b ON b.pos BETWEEN a.pos + 1 AND a.pos + 99 WHERE least(len(a.words), len(b.words)) >= 0.7 * greatest(len(a.words), len(b.words))) WHERE c > 0 AND c / (na + nb - c) >= 0.7", WORDS + ", nb AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id) AS pos FROM ws ORDER BY doc_id LIMIT 2000)", "similarity"))
def _(s, d):
    return jn.neighbour_pairs(_word_sets(s, d), "doc_id", 99, 2000, "words", 0.7)


# samples and tests
@query("t01_sample_per_stratum", sql(f"SELECT attestation_id, corridor, family, available FROM (SELECT *, count(*) OVER (PARTITION BY corridor, family) AS available, row_number() OVER (PARTITION BY corridor, family ORDER BY {H32('7', 'attestation_id')}, attestation_id) AS rn FROM ev) WHERE rn <= 5", EV))
def _(s, d):
    return rs.sample_per_stratum(evidence(s, d), ["corridor", "family"], "attestation_id", 5, 7).select("attestation_id", "corridor", "family", "available")


@query("t02_balance_bins", sql(f"SELECT five_year_bin, five_year_bin + 2.5::DOUBLE AS midpoint, count(*) FILTER (is_positive) AS positives, max(ng) AS negatives_available, count(*) FILTER (NOT is_positive AND picked) AS negatives_sampled, count(*) FILTER (picked) AS sampled_rows, coalesce(sum(analysis_weight) FILTER (picked), 0) AS weight_sum, coalesce(sum(raw_binding * analysis_weight) FILTER (picked) / nullif(sum(analysis_weight) FILTER (picked), 0), 0) AS balanced_index, count(*) FILTER (is_positive) > 0 AND count(*) FILTER (NOT is_positive AND picked) > 0 AS usable FROM (SELECT *, is_positive OR rn <= round(p * 0.1) AS picked FROM (SELECT *, count(*) FILTER (is_positive) OVER (PARTITION BY five_year_bin) AS p, count(*) FILTER (NOT is_positive) OVER (PARTITION BY five_year_bin) AS ng, row_number() OVER (PARTITION BY five_year_bin, is_positive ORDER BY {H32('3', 'attestation_id')}, attestation_id) AS rn FROM ev)) GROUP BY five_year_bin", EV, "midpoint weight_sum balanced_index"))
def _(s, d):
    df = cut_lineage(evidence(s, d).select("attestation_id", "five_year_bin", "is_positive", "raw_binding", "analysis_weight"))
    return rs.balanced_index(df, rs.balance_bins(df, "five_year_bin", "is_positive", "attestation_id", 0.1, 3), "five_year_bin", "is_positive", "raw_binding", "analysis_weight", 5)


@query("t03_w11_audit_queue", sql(f"""SELECT attestation_id, priority, reasons FROM (SELECT attestation_id, greatest(10, CASE WHEN a THEN 90 ELSE 0 END, CASE WHEN b THEN 85 ELSE 0 END, CASE WHEN c THEN 70 ELSE 0 END, CASE WHEN e THEN 65 ELSE 0 END, CASE WHEN f THEN 55 ELSE 0 END) AS priority, CASE WHEN a OR b OR c OR e OR f THEN list_filter([CASE WHEN a THEN 'low_confidence' END, CASE WHEN b THEN 'verified_but_suspect_source_type' END, CASE WHEN c THEN 'rare_year' END, CASE WHEN f THEN 'single_record_brand' END, CASE WHEN e THEN 'highly_reused_source_artifact' END], lambda x: x IS NOT NULL) ELSE ['deterministic_random_sample'] END AS reasons, {H32('5', 'attestation_id')} AS h FROM
 (SELECT attestation_id, confidence_score < 0.5 AS a, verification_level = 'verified' AND source_type IN ('personal_blog', 'review_platform') AS b, count(*) OVER (PARTITION BY year) <= 2 AS c, count(*) OVER (PARTITION BY source_ref) >= 20 AS e, count(*) OVER (PARTITION BY brand) = 1 AS f FROM ev)) ORDER BY priority DESC, h, attestation_id LIMIT 80""", EV))
def _(s, d):
    df, rules = rs.audit_rules(cut_lineage(evidence(s, d).select("attestation_id", "confidence_score", "verification_level", "source_type", "year", "brand", "source_ref")))
    return rs.audit_queue(df, "attestation_id", rules, 80, 5).select("attestation_id", "priority", "reasons")


SERIES = EV + f", sr AS (SELECT corridor, five_year_bin AS bin, {IDX.replace('ELSE 0 END', 'END').replace('sum(weighted_binding)', 'sum(raw_binding * analysis_weight)')} AS index, sum(analysis_weight) AS weight_sum, count(*) AS rows FROM ev GROUP BY corridor, five_year_bin), sc AS (SELECT *, bin - avg(bin) OVER (PARTITION BY corridor) AS xc, row_number() OVER (PARTITION BY corridor ORDER BY bin) AS i, count(*) OVER (PARTITION BY corridor) AS n FROM sr)"
SLOPE = lambda x, y, w: f"CASE WHEN sum({w}) * sum({w} * {x} * {x}) - sum({w} * {x}) * sum({w} * {x}) > 1e-9 THEN (sum({w}) * sum({w} * {x} * {y}) - sum({w} * {x}) * sum({w} * {y})) / (sum({w}) * sum({w} * {x} * {x}) - sum({w} * {x}) * sum({w} * {x})) END"


def _series(s, d):
    return rs.trend_series(evidence(s, d), ["corridor"], "year", 5, "raw_binding", "analysis_weight")


@query("t04_t05_trend_series", sql(f"SELECT corridor, count(*) AS bins, {SLOPE('xc', 'index', 'weight_sum')} AS slope, regr_slope(index, xc) AS plain_slope FROM sc GROUP BY corridor", SERIES, "slope plain_slope"))
def _(s, d):
    pts = rs.numbered(_series(s, d), "corridor", "bin")
    return pts.groupBy("corridor").agg(F.count("*").alias("bins"), rs.weighted_slope("xc", "index", "weight_sum").alias("slope"), F.regr_slope("index", "xc").alias("plain_slope"))


#: Replicates of bootstraps and permutations, and of each sample size of the sufficiency curve.
REPS, CURVE_REPS, SIZES = 500, 300, list(range(50, 801, 50))
BOOT = SERIES + f""", dr AS (SELECT corridor, rep, {H32('11', 'corridor', 'rep', 'i')} % n + 1 AS i FROM sc CROSS JOIN (SELECT unnest(generate_series(0, 499)) AS rep)),
 bs AS (SELECT dr.corridor, rep, {SLOPE('xc', 'index', 'weight_sum')} AS s FROM dr JOIN sc ON sc.corridor = dr.corridor AND sc.i = dr.i GROUP BY dr.corridor, rep),
 br AS (SELECT *, row_number() OVER (PARTITION BY corridor ORDER BY s, rep) - 1 AS r, count(*) OVER (PARTITION BY corridor) AS m FROM bs WHERE s IS NOT NULL), ob AS (SELECT corridor, {SLOPE('xc', 'index', 'weight_sum')} AS slope, min(n) AS points FROM sc GROUP BY corridor)"""


@query("t06_bootstrap_trend", sql("SELECT corridor, points, slope, max(s) FILTER (r = floor(m * 0.025)) AS ci_low, max(s) FILTER (r = floor(m * 0.975)) AS ci_high, avg(CASE WHEN slope >= 0 THEN s < 0 ELSE s > 0 END::INT) AS p_value, CASE WHEN max(s) FILTER (r = floor(m * 0.975)) - max(s) FILTER (r = floor(m * 0.025)) < 0.1 THEN 'high' WHEN max(s) FILTER (r = floor(m * 0.975)) - max(s) FILTER (r = floor(m * 0.025)) < 0.2 THEN 'medium' ELSE 'low' END AS stability, avg(CASE WHEN slope >= 0 THEN s < 0 ELSE s > 0 END::INT) < 0.10 AS trend_emerged FROM br JOIN ob USING (corridor) GROUP BY corridor, points, slope", BOOT, "slope ci_low ci_high p_value"))
def _(s, d):
    return rs.bootstrap_trend(_series(s, d), "corridor", "bin", "index", "weight_sum", REPS, 11)


# trends over all rows, and by the item type of their markers
_TYPE = "CASE WHEN list_has_any(target_markers, ['thing', 'night']) THEN 'core' WHEN list_contains(target_markers, 'nicht') THEN 'negation' WHEN list_has_any(target_markers, ['queque', 'ouaux']) THEN 'doubled' ELSE 'unknown' END"
T5 = lambda ctes: ctes.replace(", sr AS (", f", evk AS (SELECT * REPLACE ('all' AS corridor) FROM ev UNION ALL SELECT * REPLACE ({_TYPE} AS corridor) FROM ev), sr AS (", 1).replace("FROM ev GROUP BY corridor, five_year_bin", "FROM evk GROUP BY corridor, five_year_bin", 1)
_EDGE = lambda q: f"max(s) FILTER (r = floor(m * {q}))"
_FLAT = lambda v, x: f"CASE WHEN abs(slope) < 1e-12 THEN {v}::DOUBLE ELSE {x} END"
_P = "avg(CASE WHEN slope >= 0 THEN s < 0 ELSE s > 0 END::INT)"


def _typed_series(s, d):
    rows = evidence(s, d).select("target_markers", "year", "raw_binding", "analysis_weight")
    kind = rl.item_type(F.array_join("target_markers", " "), ITEMS)
    rows = rows.withColumn("item_type", F.explode(F.array(F.lit("all"), kind)))
    return rs.trend_series(rows, ["item_type"], "year", 5, "raw_binding", "analysis_weight")


@query("t05_series", sql("SELECT corridor AS item_type, bin, index, weight_sum, rows FROM sr", T5(SERIES), "index weight_sum"))
def _(s, d):
    """The series of all rows and of each item type."""
    return _typed_series(s, d)


@query("t05_trends", sql(f"SELECT corridor AS item_type, points, slope, {_FLAT(0, _EDGE(0.025))} AS ci_low, {_FLAT(0, _EDGE(0.975))} AS ci_high, {_FLAT(1, _P)} AS p_value, CASE WHEN {_FLAT(0, f'{_EDGE(0.975)} - {_EDGE(0.025)}')} < 0.1 THEN 'high' WHEN {_EDGE(0.975)} - {_EDGE(0.025)} < 0.2 THEN 'medium' ELSE 'low' END AS stability, {_FLAT(1, _P)} < 0.10 AS trend_emerged FROM br JOIN ob USING (corridor) GROUP BY corridor, points, slope", T5(BOOT), "slope ci_low ci_high p_value"))
def _(s, d):
    """Slope, interval, p and stability of the trend of all rows and of each item type."""
    return rs.bootstrap_trend(_typed_series(s, d), "item_type", "bin", "index", "weight_sum", REPS, 11)


@query("t07_permutation_p", sql(f"""SELECT o.corridor, slope, avg((abs(s) >= abs(slope) - 1e-12)::INT) AS p_value FROM (SELECT k.corridor, rep, regr_slope(k.index, sc.xc) AS s FROM (SELECT corridor, rep, index, row_number() OVER (PARTITION BY corridor, rep ORDER BY {H32('13', 'corridor', 'rep', 'i')}, i) AS j FROM sc CROSS JOIN (SELECT unnest(generate_series(0, 499)) AS rep)) k
 JOIN sc ON sc.corridor = k.corridor AND sc.i = k.j GROUP BY k.corridor, rep) p JOIN (SELECT corridor, regr_slope(index, xc) AS slope FROM sc GROUP BY corridor) o ON o.corridor = p.corridor GROUP BY o.corridor, slope""", SERIES, "slope p_value"))  # fmt: skip
def _(s, d):
    return rs.permutation_p(_series(s, d), "corridor", "bin", "index", REPS, 13)


CURVE = EV + f""", dr AS (SELECT size, rep, {H32('17', 'size', 'rep', 'j')} % (SELECT count(*) FROM ev) + 1 AS i FROM (SELECT unnest(generate_series(50, 800, 50)) AS size) CROSS JOIN (SELECT unnest(generate_series(0, 299)) AS rep) CROSS JOIN (SELECT unnest(generate_series(1, 800)) AS j) WHERE j <= size),
 cu AS (SELECT CAST(size AS INT) AS size, stddev_samp(s) AS slope_se, count(s) AS replicates FROM (SELECT dr.size, dr.rep, regr_slope(raw_binding, xc) AS s FROM dr JOIN (SELECT raw_binding, year - avg(year) OVER () AS xc, row_number() OVER (ORDER BY attestation_id) AS i FROM ev) p ON p.i = dr.i GROUP BY dr.size, dr.rep) GROUP BY size)"""


def _curve(s, d):
    rows = cut_lineage(evidence(s, d).select("attestation_id", "year", "raw_binding"))
    # points are numbered by id; the years are centred by a mean that is one row
    mean = F.broadcast(rows.agg(F.avg("year").alias("_mean")))
    rows = cut_lineage(rows.join(mean, F.lit(True)).select((F.col("year") - F.col("_mean")).alias("x"), "raw_binding", "attestation_id"))
    return rs.sufficiency_curve(rows, "attestation_id", "raw_binding", SIZES, CURVE_REPS, 17, at="x")


@query("t08_sufficiency_curve", sql("SELECT * FROM cu", CURVE, "slope_se"))
def _(s, d):
    return _curve(s, d)


@query("t08_smallest_size", sql("SELECT min(size) FILTER (slope_se <= 0.0008) AS smallest_size FROM cu", CURVE))
def _(s, d):
    return rs.smallest_enough(_curve(s, d), 0.0008)


@query("t09_sample_sufficiency", sql("SELECT *, CASE WHEN additional_needed = 0 THEN 'sufficient' ELSE 'insufficient' END AS interpretation FROM (SELECT *, CAST(CASE WHEN ci_half_width <= 0.05 THEN 0 ELSE greatest(0, ceil(pow(1.96 * sd / 0.05, 2) - effective_n)) END AS BIGINT) AS additional_needed FROM (SELECT *, 1.96 * sd / sqrt(effective_n) AS ci_half_width FROM (SELECT corridor, sum(analysis_weight) * sum(analysis_weight) / sum(analysis_weight * analysis_weight) AS effective_n, sum(raw_binding * analysis_weight) / sum(analysis_weight) AS mean, stddev_samp(raw_binding) AS sd FROM ev GROUP BY corridor)))", EV, "effective_n mean sd ci_half_width"))
def _(s, d):
    return rs.sample_sufficiency(evidence(s, d), ["corridor"], "raw_binding", "analysis_weight", 0.05)


@query("t10_readiness", sql("""SELECT *, greatest(0, 350 - rows) AS records_needed, CASE WHEN p_value IS NULL THEN 'keep_collecting' WHEN rows >= 350 AND p_value < 0.10 AND stability IN ('high', 'medium') AND tourism_ratio <= 0.4 OR rows >= 350 AND p_value < 0.05 AND stability = 'high' THEN 'ready' WHEN rows >= 325 AND p_value < 0.10 AND stability IN ('high', 'medium') THEN 'almost_ready' ELSE 'keep_collecting' END AS status FROM
 (SELECT corridor, count(*) AS rows, avg((contains(source_type, 'tourism') OR contains(source_type, 'municipal') OR contains(source_type, 'travel'))::INT) AS tourism_ratio, sum(analysis_weight) * sum(analysis_weight) / sum(analysis_weight * analysis_weight) AS effective_n FROM us GROUP BY corridor) LEFT JOIN
 (SELECT corridor, slope AS slope_, avg(CASE WHEN slope >= 0 THEN s < 0 ELSE s > 0 END::INT) AS p_value, CASE WHEN max(s) FILTER (r = floor(m * 0.975)) - max(s) FILTER (r = floor(m * 0.025)) < 0.1 THEN 'high' WHEN max(s) FILTER (r = floor(m * 0.975)) - max(s) FILTER (r = floor(m * 0.025)) < 0.2 THEN 'medium' ELSE 'low' END AS stability FROM br JOIN ob USING (corridor) GROUP BY corridor, slope) USING (corridor)""", BOOT.replace(", sr AS (SELECT", ", us AS (SELECT * FROM ev WHERE verification_level IN ('verified', 'probable')), sr AS (SELECT").replace("FROM ev GROUP BY corridor, five_year_bin", "FROM us GROUP BY corridor, five_year_bin"), "tourism_ratio effective_n slope_ p_value").replace("FROM (WITH", "FROM (WITH"))  # fmt: skip
def _(s, d):
    """Usable rows of each corridor, their trend and mix of sources, and the verdict."""
    df = cut_lineage(rl.usable(evidence(s, d)).select("corridor", "year", "raw_binding", "analysis_weight", "source_type"))
    w = F.col("analysis_weight")
    n = df.groupBy("corridor").agg(F.count("*").alias("rows"), ag.share(rl.source_bucket(F.col("source_type")) == "retrospective").alias("tourism_ratio"), (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("effective_n"))
    series = rs.trend_series(df, ["corridor"], "year", 5, "raw_binding", "analysis_weight")
    trend = rs.bootstrap_trend(series, "corridor", "bin", "index", "weight_sum", REPS, 11).select("corridor", F.col("slope").alias("slope_"), "p_value", "stability")
    return rs.readiness(n.join(trend, "corridor", "left"))


_poisson = " ".join(f"WHEN h < {int(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * 2**32)} THEN {k}" for k in range(8))


@query("t11_bootstrap_index_ci", sql(f"""SELECT corridor, max(s) FILTER (r = floor(m * 0.025)) AS ci_low, max(s) FILTER (r = floor(m * 0.975)) AS ci_high FROM (SELECT corridor, s, row_number() OVER (PARTITION BY corridor ORDER BY s, rep) - 1 AS r, count(*) OVER (PARTITION BY corridor) AS m FROM
 (SELECT corridor, rep, sum(weighted_binding * k) / sum(analysis_weight * k) AS s FROM (SELECT corridor, rep, weighted_binding, analysis_weight, CASE {_poisson} ELSE 8 END AS k FROM (SELECT corridor, rep, weighted_binding, analysis_weight, {H32('19', 'rep', 'attestation_id')} AS h FROM pt CROSS JOIN (SELECT unnest(generate_series(0, 499)) AS rep))) GROUP BY corridor, rep)) GROUP BY corridor""", EV + ", pt AS (SELECT corridor, attestation_id, weighted_binding, analysis_weight FROM ev)", "ci_low ci_high"))  # fmt: skip
def _(s, d):
    return rs.bootstrap_index_ci(evidence(s, d), "corridor", "attestation_id", "weighted_binding", "analysis_weight", REPS, 19)


@query("t12_primary_balance")
def _(s, d):
    """Primary rows of each corridor's usable rows, and whether they alone show a trend; tested by brute force."""
    return rs.primary_balance(rl.usable(evidence(s, d)), "corridor", "raw_binding", REPS)


@query("t12_authority_counts", sql("SELECT corridor, authority_level, count(*) AS rows, count(*) / sum(count(*)) OVER (PARTITION BY corridor) AS share FROM ev WHERE verification_level IN ('verified', 'probable') GROUP BY corridor, authority_level", EV, "share"))
def _(s, d):
    return wn.share_within(rl.usable(evidence(s, d)).groupBy("corridor", "authority_level").agg(F.count("*").alias("rows")), "rows", ["corridor"])


# streams, drained over the whole table
def _stream(s, d, name: str = "events"):
    """The table as a stream of files."""
    src = s.read.parquet(f"{d}/{name}.parquet")
    rows = s.readStream.schema(src.schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/{name}.parquet" if _is_folder(s, f"{d}/{name}.parquet") else f"{d}/{name}*.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(s, path: str) -> bool:
    at = s._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(s._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def _drained(s, stream):
    at = f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"
    logs.drain(stream, f"{at}/out", f"{at}/checkpoint")
    out = s.read.schema(stream.schema).parquet(f"{at}/out")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in out.dtypes if kind == "timestamp"})


@query("x01_windowed_progress", sql("SELECT window_start, attempts, failures, failures / attempts AS failure_ratio, results FROM (SELECT date_trunc('day', ts) AS window_start, count(*) AS attempts, count(*) FILTER (NOT ok) AS failures, sum(result_count) AS results FROM log GROUP BY 1) WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM log)", LOG, "failure_ratio results", 4))
def _(s, d):
    log = _stream(s, d).select("ts", (F.col("event_type") != "error").alias("ok"), F.col("value").alias("result_count"))
    return rounded(_drained(s, logs.windowed_progress(log)), 4)


@query("x02_alerts_once", "SELECT concat('AL_', user_id) AS alert_id, count(DISTINCT event_type) AS times FROM events WHERE event_type = 'error' GROUP BY 1")
def _(s, d):
    """Alerts of the whole stream; each is in the table once."""
    alerts = _stream(s, d).where("event_type = 'error'").select(F.concat(F.lit("AL_"), F.col("user_id").cast("string")).alias("alert_id"), "ts")
    at = f"{shared_folder(s)}/alerts-{uuid.uuid4().hex}"
    logs.alerts_once(alerts, f"{at}/out", f"{at}/checkpoint")
    return s.read.schema("alert_id string").parquet(f"{at}/out").groupBy("alert_id").agg(F.count("*").alias("times"))


@query("x02_alerts_by_state", "SELECT concat('AL_', user_id) AS alert_id, count(DISTINCT event_type) AS times FROM events WHERE event_type = 'error' GROUP BY 1")
def _(s, d):
    """Alerts of the whole stream, each once by the state kept for its id."""
    alerts = _stream(s, d).where("event_type = 'error'").select(F.concat(F.lit("AL_"), F.col("user_id").cast("string")).alias("alert_id"), "ts", "event_id")
    with keyed.disk_state(s):
        return _drained(s, keyed.first_of_key(alerts, ["alert_id"], ["ts", "event_id"])).groupBy("alert_id").agg(F.count("*").alias("times"))


@query("x02_append_log", "SELECT concat('AL_', user_id) AS alert_id, count(DISTINCT event_type) AS times FROM events WHERE event_type = 'error' GROUP BY 1")
def _(s, d):
    """Alerts appended by two runs of a stream over the same events, through a log of commits."""
    alerts = _stream(s, d).where("event_type = 'error'").select(F.concat(F.lit("AL_"), F.col("user_id").cast("string")).alias("alert_id"))
    at = f"{shared_folder(s)}/alerts-{uuid.uuid4().hex}"
    for run in ("first", "second"):
        append_log.append_stream(alerts, f"{at}/log", f"{at}/{run}", run, "alert_id")
    return append_log.read_log(s, f"{at}/log", "alert_id string").groupBy("alert_id").agg(F.count("*").alias("times"))


@query("x03_score_arriving", "SELECT event_id, CAST(len(regexp_extract_all(props, '1|7')) AS INT) AS term_count FROM events")
def _(s, d):
    """Each event is scored once; a copy that comes within a day is dropped."""
    return _drained(s, logs.score_arriving(_stream(s, d), "props", ["1", "7"], ["event_id"], "ts", "1 day").select("event_id", "term_count"))


@query("x03_score_once", "SELECT event_id, CAST(len(regexp_extract_all(props, '1|7')) AS INT) AS term_count FROM events")
def _(s, d):
    """Each event is scored once, however late a copy of it comes: its id is kept on disk."""
    n, _ = count_terms(F.col("props"), ["1", "7"])
    with keyed.disk_state(s):
        return _drained(s, keyed.first_of_key(_stream(s, d).select("event_id", "ts", n.alias("term_count")), ["event_id"], ["ts"]).select("event_id", "term_count"))


@query("x04_w07_stream_diff", "SELECT user_id, ts, event_id, previous, props <> pp AS text_changed, CAST(len(regexp_extract_all(props, '1')) - len(regexp_extract_all(pp, '1')) AS BIGINT) AS delta_ones FROM (SELECT user_id, ts, event_id, props, lag(props) OVER w AS pp, lag(ts) OVER w AS previous FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE pp IS NOT NULL AND ts < (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def _(s, d):
    """Changes between an entity's captures, as the stream's watermark passes them."""
    with keyed.disk_state(s):
        return _drained(s, keyed.changes(_stream(s, d), "user_id", "ts", "event_id", "props", {"ones": F.regexp_count("props", F.lit("1"))}))


@query("x04_sessions", """SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS rows FROM (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS g FROM events))
 GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")  # fmt: skip
def _(s, d):
    return _drained(s, logs.sessions(_stream(s, d), "user_id"))


assert not QUERIES.keys() & _ALL.keys() and not SQL.keys() & _ALL_SQL.keys()
