"""Registered queries of the library's operators over the given tables, each with its SQL twin where SQL can say it."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..operators import aggregates as ag
from ..operators import joins as jn
from ..operators import rules as rl
from ..operators import windows as wn
from ..sources import tables as st
from .views import ATT, CONTEXT, DOMAINS, EV, LOG, METRIC_DOUBLES, METRICS, OWN, PC, PRES, SEARCHES, TARGET, attestations, consumers, evidence, execution_log, ownership, presence, producers, rounded, searches, sql, table, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = lambda spark, d: rounded(f(spark, d))
        if oracle:
            SQL[name] = oracle
        return f

    return keep


IDX = "CASE WHEN sum(analysis_weight) > 0 THEN sum(weighted_binding) / sum(analysis_weight) ELSE 0 END"


# sources
@query("s06_union_tables", "SELECT CAST(page_id AS BIGINT) AS id, url, NULL::VARCHAR AS source FROM pages UNION ALL SELECT doc_id, NULL, source FROM documents")
def _(s, d):
    return st.union_tables(table(s, d, "pages").select(F.col("page_id").alias("id"), "url"), table(s, d, "documents").select(F.col("doc_id").alias("id"), "source"))


def _alerts(s, d):
    return execution_log(s, d).where("not ok").select(F.concat(F.lit("AL_"), F.col("task_id").cast("string")).alias("alert_id"), "ts")


def _scratch(s, name: str) -> str:
    return f"{st.shared_folder(s)}/{name}-{uuid.uuid4().hex}"


@query("s09_new_alerts", "WITH n AS (SELECT DISTINCT concat('AL_', user_id) AS alert_id FROM events WHERE event_type = 'error'), o AS (SELECT DISTINCT concat('AL_', user_id) AS alert_id FROM events WHERE event_type = 'error' AND ts < TIMESTAMP '2024-01-03') SELECT alert_id FROM n WHERE alert_id NOT IN (SELECT alert_id FROM o)")
def _(s, d):
    new = _alerts(s, d)
    return st.new_alerts(new.select("alert_id"), new.where("ts < timestamp'2024-01-03'"))


@query("s09_append_alerts", "SELECT concat('AL_', user_id) AS alert_id, count(DISTINCT event_type) AS times FROM events WHERE event_type = 'error' GROUP BY 1")
def _(s, d):
    """Alerts appended in three overlapping runs; each is there once."""
    at, new = _scratch(s, "alerts"), _alerts(s, d)
    for part in (new.where("ts < timestamp'2024-01-03'"), new, new):
        st.append_alerts(part.select("alert_id"), at)
    return s.read.parquet(at).groupBy("alert_id").agg(F.count("*").alias("times"))


def _written(s, d, name: str, df, **how) -> str:
    """df as text files in the shared folder."""
    at = _scratch(s, name)
    st.write_table(df, at, **how)
    return at


@query("s01_csv_scan", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source, text FROM documents WHERE text <> ''")
def _(s, d):
    """Documents written as CSV and read back: all strings, line breaks and quotes inside cells kept."""
    docs = table(s, d, "documents").select("doc_id", "lang", "source", "text").where("text <> ''")
    return st.read_table(s, _written(s, d, "csv", docs, fmt="csv"))


@query("s02_ragged_rows", "SELECT CAST(page_id AS VARCHAR) AS page_id, url, CASE page_id % 3 WHEN 1 THEN 'more' WHEN 2 THEN 'more,even more' END AS _extra_fields FROM pages")
def _(s, d):
    """Lines with more cells than the header has."""
    url = F.concat(F.lit('"'), F.regexp_replace("url", '"', '""'), F.lit('"'))
    line = F.concat_ws(",", F.col("page_id").cast("string"), url, F.when(F.col("page_id") % 3 >= 1, "more"), F.when(F.col("page_id") % 3 == 2, "even more"))
    at = _scratch(s, "ragged")
    # Spark's text writer puts no header: one line of its own in a file of its own, for each file read
    table(s, d, "pages").select(line.alias("value")).write.text(at)
    return st.read_ragged(s, at, ["page_id", "url"], "_extra_fields")


@query("s04_jsonl_scan", "SELECT event_id, user_id, value FROM events WHERE event_id % 7 <> 0")
def _(s, d):
    """JSON lines, one in seven of them broken or blank."""
    rows = table(s, d, "events")
    good = F.to_json(F.struct("event_id", "user_id", "value"))
    at = _scratch(s, "jsonl")
    rows.select(F.when(F.col("event_id") % 7 != 0, good).when(F.col("event_id") % 14 == 0, F.lit("")).otherwise(F.concat(F.lit("{broken "), good)).alias("value")).write.text(at)
    return st.read_jsonl(s, at, "event_id long, user_id long, value double")


@query("s07_enrich_and_write", "SELECT page_id, url, regexp_replace(lower(url), '/+$', '') AS url_key FROM pages")
def _(s, d):
    rows = table(s, d, "pages").select("page_id", "url").withColumn("url_key", tx.url_key(F.col("url")))
    return s.read.parquet(_written(s, d, "enriched", rows))


@query("s08_append_log", "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'signup') UNION ALL SELECT event_id, event_type FROM events WHERE event_type = 'view'")
def _(s, d):
    """Two runs append to a log of JSON lines."""
    at, rows = _scratch(s, "log"), table(s, d, "events").select("event_id", "event_type")
    for kinds in (["error", "signup"], ["view"]):
        st.append_log(rows.where(F.col("event_type").isin(kinds)), at)
    return st.read_jsonl(s, at, "event_id long, event_type string")


@query("s12_lexicon", "SELECT DISTINCT 'target' AS \"group\", p_name AS term FROM part UNION SELECT 'context', p_type FROM part UNION SELECT d, p_brand FROM part, (SELECT unnest(['context', 'brands']) AS d)")
def _(s, d):
    """A lexicon in JSON: domain terms count as context terms too."""
    part = table(s, d, "part")
    one = part.agg(F.collect_set("p_name").alias("t"), F.collect_set("p_type").alias("c"), F.struct(F.collect_set("p_brand").alias("brands")).alias("domains"))
    at = _scratch(s, "lexicon")
    one.write.json(at)
    return st.load_lexicon(s, at, "t", "c")


@query("p28_snapshot_date", "SELECT DATE '2024-01-05' AS snapshot_date, count(*) AS rows FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT DATE '2024-02-29', count(*) FROM pages WHERE page_id % 2 = 1")
def _(s, d):
    """Snapshots whose folders carry a date."""
    at, rows = _scratch(s, "history"), table(s, d, "pages").select("page_id")
    for day, left in (("20240105", 0), ("20240229", 1)):
        st.write_table(rows.where(F.col("page_id") % 2 == left), f"{at}/attestations_{day}")
    return st.snapshot_date(s.read.option("recursiveFileLookup", True).parquet(at)).groupBy("snapshot_date").agg(F.count("*").alias("rows"))


@query("o01_sorted", "SELECT doc_id, lang, n_chars, rn AS place FROM (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC NULLS LAST, doc_id) AS rn FROM documents)")
def _(s, d):
    """Rows in order of several keys; the place within the first key makes the order visible in the rows."""
    return wn.ranked(table(s, d, "documents").select("doc_id", "lang", "n_chars"), ["lang"], [F.desc_nulls_last("n_chars"), "doc_id"], "place")


@query("u01_union_all", "SELECT CAST(doc_id AS VARCHAR) AS id, 'document' AS kind, lang FROM documents UNION ALL SELECT CAST(page_id AS VARCHAR), 'page', NULL FROM pages UNION ALL SELECT CAST(conv_id AS VARCHAR), 'conversation', NULL FROM conversations")
def _(s, d):
    part = lambda name, key, kind, *more: table(s, d, name).select(F.col(key).cast("string").alias("id"), F.lit(kind).alias("kind"), *more)
    return st.union_tables(part("documents", "doc_id", "document", "lang"), part("pages", "page_id", "page"), part("conversations", "conv_id", "conversation"))


@query("s10_freeze_manifest", sql("SELECT 'period' AS dimension, period AS key, count(*) AS n FROM ev GROUP BY period UNION ALL SELECT 'corridor', corridor, count(*) FROM ev GROUP BY corridor UNION ALL SELECT 'authority_level', authority_level, count(*) FROM ev GROUP BY authority_level", EV))
def _(s, d):
    return st.freeze(evidence(s, d), ["period", "corridor", "authority_level"], ag.weighted_mean_by)["manifest"]


@query("s11_metrics", sql("SELECT unnest(['rows', 'mean_weight', 'positives']) AS metric, unnest([count(*)::DOUBLE, avg(analysis_weight), count(*) FILTER (is_positive)::DOUBLE]) AS value FROM ev", EV, "value"))
def _(s, d):
    return st.to_metrics(evidence(s, d).agg(F.count("*").alias("rows"), F.avg("analysis_weight").alias("mean_weight"), F.count_if("is_positive").alias("positives")))


@query("s05_flatten_payload", "WITH g AS (SELECT conv_id, unnest(list(struct_pack(role := role, text := text) ORDER BY turn)) AS r FROM conversations GROUP BY conv_id) SELECT conv_id, concat_ws(' ', r.role, r.text) AS text_blob FROM g")
def _(s, d):
    packed = table(s, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("role", "text")).alias("rows"))
    return st.flatten_payload(packed, "rows", ["role", "text"])


# text functions
@query("p01_normalize_text", r"SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS normalized_text FROM documents")
def _(s, d):
    return tx.normalize_text(table(s, d, "documents"), ["text"]).select("doc_id", "normalized_text")


@query("p02_evidence_norm", r"SELECT doc_id, md5(lower(trim(regexp_replace(regexp_replace(text, 'https?://\S+', ' ', 'g'), '\s+', ' ', 'g')))) AS norm_md5 FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(tx.evidence_norm(F.col("text"))).alias("norm_md5"))


@query("p03_p04_parse", "SELECT doc_id, coalesce(source, 'none') AS ref, CAST(n_chars AS INT) AS year_like, CASE WHEN n_chars % 3 = 0 THEN n_chars::DOUBLE ELSE -1.0::DOUBLE END AS lenient FROM documents")
def _(s, d):
    messy = F.when(F.col("n_chars") % 3 == 0, F.col("n_chars").cast("string")).otherwise(F.lit("n/a"))
    return table(s, d, "documents").select("doc_id", tx.first_nonblank(F.lit("  "), F.col("source"), F.lit("none")).alias("ref"), tx.to_year(F.concat(F.lit(" "), F.col("n_chars").cast("string"), F.lit(".0 "))).alias("year_like"), tx.to_double(messy, -1.0).alias("lenient"))


@query("p05_clean", "SELECT doc_id, lang, coalesce(source, 'unknown') AS source, 0 AS year, n_chars::DOUBLE AS n_chars FROM documents")
def _(s, d):
    return tx.clean(table(s, d, "documents").drop("text"), {"source": ("string", "unknown"), "year": ("int", 0), "n_chars": ("double", 0.0)})


@query("p06_p07_p25_scores", sql("SELECT attestation_id, verification, confidence_score, least(1, greatest(0, analysis_weight)) AS clamped, CASE WHEN analysis_weight >= 0.75 THEN 'high' WHEN analysis_weight >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM ev", EV, "verification confidence_score clamped"))
def _(s, d):
    return evidence(s, d).select("attestation_id", "verification", "confidence_score", tx.clamp(F.col("analysis_weight")).alias("clamped"), tx.band(F.col("analysis_weight"), [(0.75, "high"), (0.5, "medium")], "low").alias("band"))


@query("p08_p09_tokens", "SELECT doc_id, greatest(1, len(regexp_extract_all(concat_ws(' ', lang, text), '[A-Za-z0-9]+'))) AS tokens FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", tx.token_count(tx.text_blob(F.col("lang"), F.col("text"))).alias("tokens"))


@query("p10_stable_id", "SELECT doc_id, concat('A_', substr(sha1(concat_ws('|', source, lang, doc_id)), 1, 12)) AS id FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", tx.stable_id("A_", 12, F.col("source"), F.col("lang"), F.col("doc_id")).alias("id"))


@query("p11_p12_urls", r"SELECT page_id, regexp_replace(lower(url), '/+$', '') AS url_key, regexp_matches(url, '^https?://') AS direct, url AS iri FROM pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", tx.url_key(F.col("url")).alias("url_key"), tx.is_direct_url(F.col("url")).alias("direct"), tx.encode_iri(F.col("url")).alias("iri"))


ERAS = {"nicht aus": (1950, 1952), "license": (1998, 1999)}
_years = "list_transform(list_filter(regexp_extract_all(t, '\\d+'), lambda x: length(x) = 4 AND x BETWEEN '1800' AND '2099'), lambda x: x::BIGINT)"


@query("p12_encode_iri", r"SELECT doc_id, concat('https://a.example/', url_encode(regexp_extract(coalesce(text, ''), '\p{L}*[^\x00-\x7F]\p{L}*'))) AS iri FROM documents")
def _(s, d):
    """Addresses with letters outside of ASCII."""
    word = F.regexp_extract(F.coalesce("text", F.lit("")), r"\p{L}*[^\x00-\x7F]\p{L}*", 0)
    return table(s, d, "documents").select("doc_id", tx.encode_iri(F.concat(F.lit("https://a.example/"), word)).alias("iri"))


@query("p13_p14_years", rf"""WITH y AS (SELECT doc_id, concat_ws(' ', text, n_chars, 'of', 1900 + doc_id % 150, source) AS t FROM documents)
 SELECT doc_id, list_sort(list_distinct(list_filter({_years} || CASE WHEN contains(t, 'nicht aus') THEN [1950::BIGINT, 1951, 1952] ELSE [] END || CASE WHEN contains(t, 'license') THEN [1998::BIGINT, 1999] ELSE [] END, lambda x: x BETWEEN 1940 AND 2030))) AS years, TRY_CAST(regexp_extract(t, '(?:1[89]|20)\d\d') AS INT) AS first_year FROM y""")
def _(s, d):
    """Years named in the whole text and its description, and the years of eras named there."""
    t = F.concat_ws(" ", "text", F.col("n_chars").cast("string"), F.lit("of"), (1900 + F.col("doc_id") % 150).cast("string"), "source")
    return table(s, d, "documents").select("doc_id", F.transform(tx.extract_years(t, 1940, 2030, ERAS), lambda y: y.cast("long")).alias("years"), tx.first_year(t).alias("first_year"))


@query("p15_p16_p17_periods", sql("SELECT year, five_year_bin, CASE WHEN year BETWEEN 1946 AND 1987 THEN 'early' WHEN year BETWEEN 1987 AND 2001 THEN 'middle' WHEN year BETWEEN 2002 AND 2025 THEN 'late' ELSE 'unknown' END AS phase, (period = '1987_2015' OR year BETWEEN 1990 AND 1995) AS wanted, count(*) AS n FROM ev GROUP BY ALL", EV))
def _(s, d):
    df = evidence(s, d).select("year", "five_year_bin", tx.label_ranges(F.col("year"), [(1946, 1987, "early"), (1987, 2001, "middle"), (2002, 2025, "late")]).alias("phase"), tx.period_matches(F.col("period"), "1987_2015", F.col("year"), 1990, 1995).alias("wanted"))
    return df.groupBy("year", "five_year_bin", "phase", "wanted").agg(F.count("*").alias("n"))


@query("p18_p19_p26_brands", "SELECT p_partkey, lower(p_brand) AS brand, list_filter(string_split(concat(p_type, ';', p_name), ';'), lambda x: x <> '') AS markers, contains(lower(p_name), 'ring') AS carries FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", tx.normalize_brand(F.concat(F.lit("_ "), F.col("p_brand"), F.lit(" batch 7 /"))).alias("brand"), tx.split_markers(F.concat_ws(";", "p_type", F.lit(" "), "p_name")).alias("markers"), tx.contains_any(F.col("p_name"), ["ring"]).alias("carries"))


@query("p26_marker_present", "SELECT p_partkey, trim(concat_ws('', CASE WHEN p_size % 3 = 0 THEN p_name END, CASE WHEN p_size % 5 = 0 THEN p_type END)) <> '' AS present, p_size % 3 = 0 AND contains(lower(p_brand), '#1') AS carries_context FROM part")
def _(s, d):
    """Whether one of two marker columns is filled, and whether the brand names the context where the first marker is."""
    name, kind = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise("  "), F.when(F.col("p_size") % 5 == 0, F.col("p_type"))
    return table(s, d, "part").select("p_partkey", tx.marker_present(name, kind).alias("present"), (tx.marker_present(name) & tx.contains_any(F.col("p_brand"), ["#1"])).alias("carries_context"))


@query("p20_cut", sql("SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN weighted_binding > -0.01 AND weighted_binding <= 0.001 THEN 'zero' WHEN weighted_binding > 0.001 AND weighted_binding <= 0.5 THEN 'weak' WHEN weighted_binding > 0.5 AND weighted_binding <= 0.8 THEN 'middle' WHEN weighted_binding > 0.8 AND weighted_binding <= 1.2 THEN 'strong' END AS bucket FROM ev) GROUP BY bucket", EV))
def _(s, d):
    return evidence(s, d).groupBy(tx.cut(F.col("weighted_binding"), ag.EDGES, ag.BUCKETS).alias("bucket")).agg(F.count("*").alias("n"))


@query("p21_p22_weights", sql("SELECT attestation_id, analysis_weight, raw_binding, weighted_binding FROM ev", EV, "analysis_weight raw_binding weighted_binding"))
def _(s, d):
    return evidence(s, d).select("attestation_id", "analysis_weight", "raw_binding", "weighted_binding")


@query("p22_row_binding", sql("SELECT attestation_id, least(1, greatest(0, CASE WHEN attestation_id % 3 = 0 THEN raw_binding WHEN attestation_id % 3 = 1 THEN CASE WHEN wt > 0 AND weighted_binding <= wt THEN weighted_binding / wt ELSE weighted_binding END ELSE 0.5 * (target AND context)::INT + 0.25 * context::INT + 0.25 * (authority_level = 'primary')::INT END)) AS binding, CASE attestation_id % 3 WHEN 0 THEN 'explicit' WHEN 1 THEN 'deweighted' ELSE 'fallback' END AS mode FROM (SELECT *, CASE WHEN attestation_id % 2 = 0 THEN analysis_weight END AS wt FROM ev)", EV, "binding"))
def _(s, d):
    """Rows with a raw value, with a weighted one (half of them with its weight), and with flags alone."""
    i, b = F.col("attestation_id"), lambda c: c.cast("double")
    value, mode = rl.row_binding(F.when(i % 3 == 0, F.col("raw_binding")), F.when(i % 3 == 1, F.col("weighted_binding")), F.when(i % 2 == 0, F.col("analysis_weight")), b(F.col("target") & F.col("context")), b(F.col("context")), b(F.col("authority_level") == "primary"))
    return evidence(s, d).select("attestation_id", value.alias("binding"), mode.alias("mode"))


@query("p24_p27_provenance", "SELECT page_id, concat('CAP_', substr(sha1(concat_ws('|', url, page_id)), 1, 12)) AS capture_id, concat('SRC_', substr(sha1(url), 1, 10)) AS source_id, sha1(html) AS content_hash FROM pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", tx.stable_id("CAP_", 12, F.col("url"), F.col("page_id")).alias("capture_id"), tx.stable_id("SRC_", 10, F.col("url")).alias("source_id"), tx.content_hash(F.col("html")).alias("content_hash"))


# lexicon and rules
@query("l01_count_terms", sql("SELECT attestation_id, CAST(target_count AS INT) AS n, target_markers AS matched FROM ev", EV))
def _(s, d):
    n, m = lx.count_terms(F.col("original_text"), TARGET)
    return attestations(s, d).select("attestation_id", n.alias("n"), m.alias("matched"))


@query("l02_lexicon_score", sql("""SELECT attestation_id, token_count, CAST(len(regexp_extract_all(t, 'tion|ing|the')) AS INT) AS english_count, len(regexp_extract_all(t, 'tion|ing|the')) / token_count AS english_score, len(regexp_extract_all(t, 'nicht|keit|ung')) / token_count AS german_score,
 len(regexp_extract_all(t, 'ción|ment|eau|que')) / token_count AS romance_score, len(regexp_extract_all(t, 'nicht|night|ouaux|queque|thing')) > 0 AND len(regexp_extract_all(t, 'license|anea|keit|ment|tion')) > 0 AS binding_present
 FROM (SELECT attestation_id, lower(original_text) AS t, greatest(1, len(regexp_extract_all(original_text, '[A-Za-z0-9]+'))) AS token_count FROM att)""", ATT, "english_score german_score romance_score"))  # fmt: skip
def _(s, d):
    return lx.lexicon_score(attestations(s, d), ["original_text"], TARGET, CONTEXT, DOMAINS).select("attestation_id", "token_count", "english_count", "english_score", "german_score", "romance_score", "binding_present")


@query("l01_large_lexicon", sql("SELECT attestation_id, CAST(len(m) AS INT) AS n, list_sort(list_distinct(m)) AS matched FROM (SELECT attestation_id, regexp_extract_all(lower(original_text), (SELECT string_agg(t, '|' ORDER BY length(t) DESC, t) FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS t FROM part UNION SELECT concat('w', range) FROM range(200)))) AS m FROM att)", ATT))
def _(s, d):
    """Counts of a lexicon of a few hundred terms (words of part names and more) by an automaton."""
    words = table(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("t")).distinct()
    n, m = lx.count_terms(F.col("original_text"), [*[r.t for r in words.collect()], *[f"w{i}" for i in range(200)]])  # a lexicon is part of the plan
    return attestations(s, d).select("attestation_id", n.alias("n"), m.alias("matched"))


@query("l03_hits", sql("SELECT attestation_id, list_filter(['the', 'he', 'ion', 'keit'], lambda x: contains(lower(original_text), x)) AS hits FROM att", ATT))
def _(s, d):
    return attestations(s, d).select("attestation_id", lx.hits(F.col("original_text"), ["the", "he", "ion", "keit"]).alias("hits"))


def _kwic(s, d):
    return lx.kwic(texts(s, d, "doc_id", "text"), "text", ["worthless", "nicht aus", "license"], ["the", "und"], 40)


KWIC = """k0 AS (SELECT doc_id, text, string_split_regex(lower(text), 'nicht aus|worthless|license') AS p, regexp_extract_all(lower(text), 'nicht aus|worthless|license') AS m FROM documents),
k1 AS (SELECT doc_id, text, p, m, unnest(generate_series(1, len(m))) AS i FROM k0 WHERE len(m) > 0),
k2 AS (SELECT doc_id, text, CAST(i - 1 AS INT) AS hit, m[i] AS marker, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INT) AS start FROM k1),
kw AS (SELECT doc_id, hit, marker, start, CAST(start + length(marker) AS INT) AS "end", substr(text, greatest(start - 40, 0) + 1, least(start + length(marker) + 40, length(text)) - greatest(start - 40, 0)) AS "window" FROM k2)"""


@query("l04_kwic", f"""WITH {KWIC} SELECT doc_id, hit, "start", "end", marker, "window", list_filter(['the', 'und'], lambda x: contains(lower("window"), x)) AS context_hits FROM kw""")
def _(s, d):
    return _kwic(s, d).drop("text")


@query("l05_merge_windows", f"""WITH {KWIC} SELECT doc_id, min("start") AS window_start, max("end") AS window_end, count(*) AS windows, string_agg(DISTINCT marker, ',' ORDER BY marker) AS marker_list FROM kw GROUP BY doc_id""")
def _(s, d):
    return lx.merge_windows(_kwic(s, d), ["doc_id"], ["start"]).select("doc_id", "window_start", "window_end", "windows", F.array_join(F.array_sort("markers"), ",").alias("marker_list"))


@query("l06_l07_classify", sql("SELECT attestation_id, family, marker_frame, discourse_frame FROM ev", EV))
def _(s, d):
    return evidence(s, d).select("attestation_id", "family", "marker_frame", "discourse_frame")


@query("l08_l12_buckets", sql("SELECT source_type, CASE WHEN source_type IN ('personal_blog', 'review_platform') THEN 'consumer_or_ugc' WHEN source_type LIKE 'official%' THEN 'merchant_or_platform' ELSE 'other_voice' END AS voice, CASE WHEN source_type = 'newspaper_archive' THEN 'archive' WHEN source_type = 'official_tourism_profile' THEN 'retrospective' WHEN source_type IN ('personal_blog', 'review_platform') THEN 'blog' ELSE 'other' END AS bucket, count(*) AS n FROM ev GROUP BY ALL", EV))
def _(s, d):
    df = evidence(s, d).select("source_type", rl.platform_voice(F.col("source_type")).alias("voice"), rl.source_bucket(F.col("source_type")).alias("bucket"))
    return df.groupBy("source_type", "voice", "bucket").agg(F.count("*").alias("n"))


ITEMS = [("core", ["thing", "night"]), ("negation", ["nicht"]), ("doubled", ["queque", "ouaux"])]


@query("l09_item_type", sql("SELECT attestation_id, CASE WHEN contains(t, 'thing') OR contains(t, 'night') THEN 'core' WHEN contains(t, 'nicht') THEN 'negation' WHEN contains(t, 'queque') OR contains(t, 'ouaux') THEN 'doubled' WHEN trim(t) <> '' THEN 'other' ELSE 'unknown' END AS item_type FROM (SELECT attestation_id, lower(coalesce(original_text, '')) AS t FROM att)", ATT))
def _(s, d):
    return attestations(s, d).select("attestation_id", rl.item_type(F.col("original_text"), ITEMS).alias("item_type"))


@query("l10_l11_authority", sql("SELECT source_type, authority_level, CASE authority_level WHEN 'tertiary' THEN 'blog/review/social retrospective source' WHEN 'primary' THEN 'dated archive/newspaper/registry-like source' ELSE 'official/media curated narrative source' END AS reason, CASE WHEN source_type IN ('newspaper_archive', 'advertisement') THEN 'primary' ELSE 'secondary' END AS inferred, count(*) AS n FROM ev GROUP BY ALL", EV))
def _(s, d):
    st_ = F.col("source_type")
    level, why = rl.authority(st_, F.lit(""))
    return evidence(s, d).select("source_type", level.alias("authority_level"), why.alias("reason"), rl.infer_authority(F.lit(""), st_, F.lit("")).alias("inferred")).groupBy("source_type", "authority_level", "reason", "inferred").agg(F.count("*").alias("n"))


# parts of this catalogue: rules' names, least score, score to stay below, decision
DECISIONS = [(["price", "bulk"], 60, None, "stock_closely"), (["worn", "hand"], 40, None, "sell_by_the_piece"), (["cheap"], None, 50, "sell_by_the_box")]


@query("l13_rule_score", """WITH r AS (SELECT p_partkey, (CASE WHEN p_type = 'ECONOMY' THEN 30 ELSE 0 END) + (CASE WHEN p_retailprice >= 950 THEN 50 ELSE 0 END) + (CASE WHEN p_size <= 10 THEN 20 ELSE 0 END) + (CASE WHEN p_size > 40 THEN 25 ELSE 0 END) + (CASE WHEN contains(p_name, 'ring') THEN 25 ELSE 0 END) AS score,
 list_filter([CASE WHEN p_type = 'ECONOMY' THEN 'cheap_line' END, CASE WHEN p_retailprice >= 950 THEN 'high_price' END, CASE WHEN p_size <= 10 THEN 'fits_in_hand' END, CASE WHEN p_size > 40 THEN 'in_bulk' END, CASE WHEN contains(p_name, 'ring') THEN 'is_worn' END], lambda x: x IS NOT NULL) AS fired FROM part)
 SELECT p_partkey, score, fired, CASE WHEN score >= 60 AND list_has_any(fired, ['high_price', 'in_bulk']) THEN 'stock_closely' WHEN score >= 40 AND list_has_any(fired, ['is_worn', 'fits_in_hand']) THEN 'sell_by_the_piece' WHEN list_contains(fired, 'cheap_line') AND score < 50 THEN 'sell_by_the_box' ELSE 'unknown' END AS decision FROM r""")
def _(s, d):
    size = F.col("p_size")
    rules = [(F.col("p_type") == "ECONOMY", 30, "cheap_line"), (F.col("p_retailprice") >= 950, 50, "high_price"), (size <= 10, 20, "fits_in_hand"), (size > 40, 25, "in_bulk"), (tx.contains_any(F.col("p_name"), ["ring"]), 25, "is_worn")]
    score, fired = rl.rule_score(rules)
    return table(s, d, "part").select("p_partkey", score.alias("score"), fired.alias("fired"), rl.decide(score, fired, DECISIONS).alias("decision"))


@query("l14_build_events", "SELECT concat('OWN_', printf('%06d', p_partkey + 1)) AS event_id, p_brand AS brand, CASE WHEN p_type = 'ECONOMY' THEN 'economy_line' WHEN contains(p_name, 'red') THEN 'named_by_colour' ELSE 'unknown' END AS category, coalesce(nullif(p_name, ''), p_type) AS evidence FROM part")
def _(s, d):
    cat = rl.first_rule([(F.col("p_type") == "ECONOMY", "economy_line"), (tx.contains_any(F.col("p_name"), ["red"]), "named_by_colour")], "unknown")
    return table(s, d, "part").select(F.format_string("OWN_%06d", F.col("p_partkey") + 1).alias("event_id"), F.col("p_brand").alias("brand"), cat.alias("category"), tx.first_nonblank(F.col("p_name"), F.col("p_type")).alias("evidence"))


STANCE_WORDS = {"context": ["tion", "keit", "ment", "anea"], "target": ["thing", "nicht"], "rejection": ["worthless", "moron"], "attribute": ["night", "license"]}


def _stances(s, d):
    prod = producers(s, d).select("conv_id", lx.hits(F.col("text"), STANCE_WORDS["context"]).alias("producer_hits"))
    rows = consumers(s, d).join(prod, "conv_id", "left")
    code, evid = rl.stance(F.col("text"), F.col("producer_hits"), **STANCE_WORDS)
    return rows.select("conv_id", "turn", code.alias("stance"), F.array_join(evid, "|").alias("evidence"))


STANCE = PC + """, h AS (SELECT c.conv_id, c.turn, list_filter(['tion', 'keit', 'ment', 'anea'], lambda x: contains(lower(c.text), x)) AS c, list_filter(['thing', 'nicht'], lambda x: contains(lower(c.text), x)) AS t, list_filter(['worthless', 'moron'], lambda x: contains(lower(c.text), x)) AS r, list_filter(['night', 'license'], lambda x: contains(lower(c.text), x)) AS a,
 list_filter(['tion', 'keit', 'ment', 'anea'], lambda x: contains(lower(p.text), x)) AS p FROM consumers c LEFT JOIN producers p USING (conv_id)),
 st AS (SELECT conv_id, turn, CASE WHEN len(r) > 0 THEN 4 WHEN len(c) > 0 AND len(a) > 0 AND len(t) = 0 THEN 3 WHEN len(list_intersect(c, coalesce(p, []))) > 0 THEN 1 WHEN len(c) > 0 THEN 2 ELSE 0 END AS stance,
 CASE WHEN len(r) > 0 THEN r WHEN len(c) > 0 AND len(a) > 0 AND len(t) = 0 THEN list_concat(c, a) WHEN len(list_intersect(c, coalesce(p, []))) > 0 THEN list_sort(list_intersect(c, p)) ELSE c END AS e FROM h)"""


@query("l15_j04_stance", f"WITH {STANCE} SELECT conv_id, turn, stance, array_to_string(e, '|') AS evidence FROM st")
def _(s, d):
    return _stances(s, d)


@query("l16_stance_rates", sql("SELECT conv_id, count(*) AS review_count, avg((stance = 0)::INT) AS no_mention_rate, avg((stance = 1)::INT) AS reproduction_rate, avg((stance IN (2, 3))::INT) AS transformation_rate, avg((stance = 4)::INT) AS rejection_rate FROM st GROUP BY conv_id", STANCE, "no_mention_rate reproduction_rate transformation_rate rejection_rate"))
def _(s, d):
    rate = lambda *c: F.avg(F.col("stance").isin(*c).cast("double"))
    return _stances(s, d).groupBy("conv_id").agg(F.count("*").alias("review_count"), rate(0).alias("no_mention_rate"), rate(1).alias("reproduction_rate"), rate(2, 3).alias("transformation_rate"), rate(4).alias("rejection_rate"))


@query("l17_l20_groups", sql("SELECT attestation_id, CASE WHEN target AND context THEN 'target' WHEN target THEN 'control_same_target_no_context' WHEN context AND list_has_any(ch, ['ment']) THEN 'control_context_other_target' END AS grp, CASE WHEN list_has_any(context_markers, ['license']) THEN 'legal' WHEN list_has_any(context_markers, ['tion', 'keit']) THEN 'noun' ELSE 'none' END AS evidence FROM ev", EV))
def _(s, d):
    df = attestations(s, d)
    _, found = lx.count_terms(F.col("original_text"), CONTEXT)
    return df.select("attestation_id", rl.experimental_group(F.col("original_text"), TARGET, CONTEXT, ["ment"]).alias("grp"), rl.evidence_type(found, [("legal", ["license"]), ("noun", ["tion", "keit"])], "none").alias("evidence"))


@query("l21_target_controls", sql("SELECT attestation_id, kind, CASE WHEN kind = 'target_positive' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS target_binding FROM (SELECT attestation_id, CASE WHEN regexp_matches(lower(original_text), 'thing|nicht') THEN 'target_positive' ELSE 'target_absent_with_context' END AS kind FROM att WHERE corridor = 'es' OR contains(lower(original_text), 'tion') OR contains(lower(original_text), 'keit'))", ATT))
def _(s, d):
    """Rows with a context marker or a context word, and whether the target is in their text."""
    kind = rl.target_control(F.col("original_text"), F.when(F.col("corridor") == "es", F.lit("marked")), "thing|nicht", ["tion", "keit"])
    rows = attestations(s, d).select("attestation_id", kind.alias("kind")).where("kind is not null")
    return rows.withColumn("target_binding", F.when(F.col("kind") == "target_positive", 1.0).otherwise(0.0))


@query("l18_l19_j05_categories", f"""WITH {PC}, p AS (SELECT conv_id, list_filter(['tion', 'keit', 'ment', 'anea'], lambda x: contains(lower(text), x)) AS f FROM producers),
 pc AS (SELECT conv_id, CASE WHEN len(f) >= 2 THEN 'multiple_markers' WHEN len(f) = 0 THEN 'no_marker' WHEN f[1] = 'anea' THEN 'nostalgia_marker' WHEN f[1] = 'tion' THEN 'style_marker' ELSE 'explicit_marker' END AS producer FROM p)
 SELECT producer, CASE WHEN regexp_matches(lower(text), 'tion|keit|ment|anea') AND producer <> 'no_marker' THEN 'reproduces' WHEN regexp_matches(lower(text), 'tion|keit|ment|anea') THEN 'adds_new' WHEN regexp_matches(lower(text), 'the|und') THEN 'converted_to_value' ELSE 'ignored_or_unmarked' END AS response, count(*) AS rows FROM consumers JOIN pc USING (conv_id) GROUP BY ALL""")
def _(s, d):
    w = STANCE_WORDS["context"]
    prod = producers(s, d).select("conv_id", rl.producer_category(F.col("text"), w, "anea", "tion").alias("producer"))
    return consumers(s, d).join(prod, "conv_id").select("producer", rl.response_category(F.col("text"), F.col("producer"), w, ["the", "und"]).alias("response")).groupBy("producer", "response").agg(F.count("*").alias("rows"))


@query("l22_negative_candidates", sql("SELECT attestation_id, kind FROM (SELECT attestation_id, kind, row_number() OVER (PARTITION BY kind ORDER BY attestation_id) AS rn FROM (SELECT attestation_id, CASE WHEN target AND NOT context THEN 'target_only' WHEN context AND NOT target THEN 'context_only' END AS kind, row_number() OVER (PARTITION BY dedupe_key, target, context ORDER BY attestation_id) AS dup FROM ev) WHERE kind IS NOT NULL AND dup = 1) WHERE rn <= 50", EV))
def _(s, d):
    df = evidence(s, d).select("attestation_id", "dedupe_key", F.when(F.col("target") & ~F.col("context"), "target_only").when(F.col("context") & ~F.col("target"), "context_only").alias("kind")).where("kind is not null")
    once = wn.top_per_group(df, ["dedupe_key", "kind"], ["attestation_id"], 1).drop("rank")
    return wn.top_per_group(once, ["kind"], ["attestation_id"], 50).select("attestation_id", "kind")


@query("l23_pattern_cooccurrence", sql("SELECT family, count(*) AS rows, CASE WHEN sum(analysis_weight) > 0 THEN sum(weighted_binding) / sum(analysis_weight) ELSE 0 END AS binding_index, sum(CASE WHEN is_positive THEN analysis_weight ELSE 0 END) / sum(analysis_weight) AS positive_rate_weighted, count(*) / (SELECT count(*) FROM ev) AS share FROM (SELECT analysis_weight, weighted_binding, is_positive, unnest(list_filter([CASE WHEN contains(source_type, 'blog') OR contains(source_type, 'review') THEN 'consumer' END, CASE WHEN contains(source_type, 'official') THEN 'official' END, CASE WHEN contains(source_type, 'e') THEN 'any_e' END], lambda x: x IS NOT NULL)) AS family FROM ev) GROUP BY family", EV, "binding_index positive_rate_weighted share"))
def _(s, d):
    return ag.pattern_cooccurrence(evidence(s, d), "source_type", {"consumer": "blog|review", "official": "official", "any_e": "e"})


@query("l24_marker_issues", "WITH u AS (SELECT p_partkey, 'p_name' AS field, p_name AS value FROM part UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part) SELECT * FROM (SELECT p_partkey, field, value, CASE WHEN length(value) < 8 THEN 'too_short' WHEN length(value) > 12 THEN 'too_long' WHEN contains(value, '#') THEN 'special_character' END AS issue FROM u WHERE trim(value) <> '') WHERE issue IS NOT NULL")
def _(s, d):
    return rl.marker_issues(table(s, d, "part"), "p_partkey", ["p_name", "p_brand"], 8, 12, "#")


_rx = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "url": r"https?://[^\s\"'<>]+".replace('\\"', '"').replace("'", "''"), "path": r"/(?:home|Users|root)/[A-Za-z0-9._/-]+", "term": "(?i)license"}
_found = " UNION ALL ".join(f"SELECT doc_id, text, {n} AS no, '{k}' AS kind, string_split_regex(text, '{p}') AS p, regexp_extract_all(text, '{p}') AS m FROM documents" for n, (k, p) in enumerate(_rx.items()))


@query("l25_sensitive_scan", rf"""WITH f AS ({_found}), g AS (SELECT doc_id, text, no, kind, p, m, unnest(generate_series(1, len(m))) AS i FROM f WHERE len(m) > 0),
 h AS (SELECT doc_id, text, kind, no, i, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INT) AS p0, length(m[i]) AS n0 FROM g),
 o AS (SELECT doc_id, no, kind, p0, p0 + n0 AS e0, n0, max(p0 + n0) OVER (PARTITION BY doc_id ORDER BY p0, no, n0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS me FROM h),
 q AS (SELECT *, sum(CASE WHEN me IS NULL OR p0 >= me THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p0, no, n0 ROWS UNBOUNDED PRECEDING) AS island FROM o),
 sp AS (SELECT doc_id, min(p0) AS s, max(e0) AS e, arg_min(kind, (p0, no)) AS sk FROM q GROUP BY doc_id, island),
 w AS (SELECT *, greatest(p0 - 60, 0) AS lo, least(p0 + n0 + 60, length(text)) AS hi FROM h),
 x AS (SELECT w.*, s, e, sk, coalesce(lag(e) OVER (PARTITION BY w.doc_id, no, i ORDER BY s), lo) AS a0 FROM w JOIN sp ON sp.doc_id = w.doc_id AND s < hi AND e > lo),
 y AS (SELECT doc_id, kind, no, i, any_value(n0) AS n0, string_agg(substr(text, a0 + 1, greatest(s - a0, 0)) || '<redacted:' || sk || '>', '' ORDER BY s) || substr(any_value(text), max(e) + 1, greatest(any_value(hi) - max(e), 0)) AS snip FROM x GROUP BY doc_id, kind, no, i)
 SELECT doc_id, kind, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY no, i) - 1 AS INT) AS hit_no, CAST(n0 AS INT) AS hit_length, trim(regexp_replace(snip, '\s+', ' ', 'g')) AS snippet FROM y""")
def _(s, d):
    return rl.sensitive_scan(texts(s, d, "doc_id", "text"), "doc_id", "text", terms=["license"])


QUOTAS = [("Q1", "en", 1946, 1969, 120), ("Q2", "en", 1965, 1999, 150), ("Q3", "de", 1946, 1999, 60), ("Q4", "fr", 1946, 2025, 90), ("Q5", "xx", 1946, 2025, 10)]
QUOTA_SQL = "q AS (SELECT * FROM (VALUES ('Q1', 'en', 1946, 1969, 120), ('Q2', 'en', 1965, 1999, 150), ('Q3', 'de', 1946, 1999, 60), ('Q4', 'fr', 1946, 2025, 90), ('Q5', 'xx', 1946, 2025, 10)) t(quota_id, region, lo, hi, target_records))"


def _quota_rows(s, d):
    """Each evidence row with the first quota that its region and year fit."""
    quotas = s.createDataFrame(QUOTAS, "quota_id string, region string, lo int, hi int, target_records int")
    hit = jn.range_join(evidence(s, d), quotas, "year", "lo", "hi").where(F.col("region") == F.col("corridor"))
    return hit.groupBy("attestation_id").agg(F.min("quota_id").alias("quota_id"), F.first("source_ref").alias("source_ref")), quotas


@query("l26_j07_assign_quota", sql("SELECT attestation_id, min(quota_id) AS quota_id FROM ev JOIN q ON region = corridor AND year BETWEEN lo AND hi GROUP BY attestation_id", EV + ", " + QUOTA_SQL))
def _(s, d):
    return _quota_rows(s, d)[0].select("attestation_id", "quota_id")


_reason = "CASE WHEN raw_binding <= 0 AND target AND NOT context THEN 'target_without_context' WHEN raw_binding <= 0 AND context AND NOT target THEN 'context_without_target' WHEN raw_binding <= 0 THEN 'no_binding_control' WHEN weighted_binding <= {} THEN 'positive_but_low_weight' ELSE 'not_outlier' END"


@query("l27_l28_outlier_reasons", sql(f"SELECT {_reason.format(0.4)} AS reason, count(*) AS rows FROM ev WHERE verification_level IN ('verified', 'probable') GROUP BY 1", EV))
def _(s, d):
    c = F.col
    return rl.usable(evidence(s, d)).groupBy(rl.outlier_reason(c("raw_binding"), c("weighted_binding"), c("target"), c("context"), 0.4).alias("reason")).agg(F.count("*").alias("rows"))


@query("l29_unresolved_alerts", "SELECT event_id FROM events WHERE event_type = 'error' AND user_id % 3 <> 0 AND value > 50")
def _(s, d):
    alerts = table(s, d, "events").where("event_type = 'error'").select("event_id", (F.col("user_id") % 3 == 0).alias("acknowledged"), F.when(F.col("value") > 50, "critical").otherwise("warning").alias("severity"))
    return rl.unresolved_alerts(alerts, "critical").select("event_id")


# joins
@query("j01_lookup", sql("SELECT brand, category, count(*) AS rows, sum(open_count) AS open FROM pres LEFT JOIN (SELECT p_brand, arg_min(p_type, p_partkey) AS category FROM part GROUP BY p_brand) ON p_brand = brand GROUP BY brand, category", PRES).replace("sum(open_count)", "CAST(sum(open_count) AS BIGINT)"))
def _(s, d):
    dim = table(s, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), "p_partkey")
    per = presence(s, d).groupBy("brand").agg(F.count("*").alias("rows"), F.sum("open_count").alias("open"))
    return jn.lookup(per, dim, "brand", ["p_partkey"]).select("brand", "category", "rows", "open")


@query("j02_a11_spatial", sql("SELECT corridor, coastal, count(*) AS records, CAST(sum(open_count) AS BIGINT) AS open, CAST(sum(planned_count) AS BIGINT) AS planned, CAST(sum(open_count + planned_count) AS BIGINT) AS total, count(*) FILTER (open_count > 0) AS present_records, count(DISTINCT brand) AS brands, sum(open_count) / sum(sum(open_count)) OVER () AS open_share FROM pres GROUP BY corridor, coastal", PRES, "open_share"))
def _(s, d):
    return wn.share_within(ag.spatial_summary(presence(s, d), ["corridor", "coastal"]).withColumn("_all", F.lit(1)), "open", ["_all"], "open_share").drop("_all")


def _gap(s, d):
    score = lambda df: lx.lexicon_score(df, ["text"], TARGET, CONTEXT, DOMAINS)
    prod = score(producers(s, d)).select("conv_id", F.col("english_score").alias("own_english"), F.col("romance_score").alias("own_romance"))
    cons = score(consumers(s, d)).groupBy("conv_id").agg(F.count("*").alias("review_count"), F.avg("english_score").alias("mean_english"), F.avg("romance_score").alias("mean_romance"))
    out = prod.join(cons, "conv_id", "left").fillna(0, ["review_count", "mean_english", "mean_romance"])
    return out.withColumns({"gap_english": F.col("own_english") - F.col("mean_english"), "gap_romance": F.col("own_romance") - F.col("mean_romance")})


_sc = "len(regexp_extract_all(lower(text), 'tion|ing|the')) / greatest(1, len(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS e, len(regexp_extract_all(lower(text), 'ción|ment|eau|que')) / greatest(1, len(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS r"


@query("j03_a10_consumer_gap", sql(f"SELECT p.conv_id, p.e AS own_english, p.r AS own_romance, coalesce(c.n, 0) AS review_count, coalesce(c.e, 0) AS mean_english, coalesce(c.r, 0) AS mean_romance, p.e - coalesce(c.e, 0) AS gap_english, p.r - coalesce(c.r, 0) AS gap_romance FROM (SELECT conv_id, {_sc} FROM producers) p LEFT JOIN (SELECT conv_id, count(*) AS n, avg(e) AS e, avg(r) AS r FROM (SELECT conv_id, {_sc} FROM consumers) GROUP BY conv_id) c USING (conv_id)", PC, "own_english own_romance mean_english mean_romance gap_english gap_romance"))
def _(s, d):
    return _gap(s, d)


@query("j06_a33_a34_plan_vs_actual", sql("""SELECT coalesce(q.quota_id, a.quota_id) AS quota_id, target_records, coalesce(n, 0) AS records, coalesce(src, 0) AS sources, coalesce(n, 0) >= target_records AS met, q.quota_id IS NOT NULL AS planned
 FROM q FULL JOIN (SELECT quota_id, count(*) AS n, count(DISTINCT source_ref) AS src FROM (SELECT attestation_id, source_ref, min(quota_id) AS quota_id FROM ev JOIN q ON region = corridor AND year BETWEEN lo AND hi GROUP BY ALL) GROUP BY quota_id) a ON a.quota_id = q.quota_id""", EV + ", " + QUOTA_SQL))  # fmt: skip
def _(s, d):
    rows, quotas = _quota_rows(s, d)
    out = jn.plan_vs_actual(quotas.select("quota_id", "target_records"), rows, ["quota_id"], [F.count("*").alias("records"), F.countDistinct("source_ref").alias("sources")])
    return out.withColumn("met", F.col("records") >= F.col("target_records"))


@query("w09_quota_examples", sql("SELECT quota_id, list_sort(list(attestation_id)) AS examples FROM (SELECT quota_id, attestation_id, row_number() OVER (PARTITION BY quota_id ORDER BY attestation_id) AS rn FROM (SELECT attestation_id, min(quota_id) AS quota_id FROM ev JOIN q ON region = corridor AND year BETWEEN lo AND hi GROUP BY attestation_id)) WHERE rn <= 5 GROUP BY quota_id", EV + ", " + QUOTA_SQL))
def _(s, d):
    return wn.examples(_quota_rows(s, d)[0], ["quota_id"], "attestation_id", 5)


@query("j11_j12_membership", "SELECT page_id, url IN (SELECT url FROM pages WHERE page_id % 2 = 0) AS captured FROM pages")
def _(s, d):
    pages = table(s, d, "pages").select("page_id", "url")
    seen = pages.where("page_id % 2 = 0").select("url").distinct()
    return pages.join(seen, "url", "left_semi").select("page_id", F.lit(True).alias("captured")).union(pages.join(seen, "url", "left_anti").select("page_id", F.lit(False)))


@query("j13_u02_pair_coverage", sql("SELECT count(*) AS attested, count(*) FILTER (h) AS covered, count(*) FILTER (h) / count(*) AS coverage FROM (SELECT period, corridor, bool_or(attestation_id % 50 = 3) AS h FROM ev GROUP BY period, corridor)", EV, "coverage"))
def _(s, d):
    df = evidence(s, d)
    return ag.pair_coverage(df, df.where("attestation_id % 50 = 3"), ["period", "corridor"])


@query("j14_complete_years", sql("""SELECT corridor, year, CASE WHEN v IS NOT NULL THEN v WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) * (year - py) / (ny - py) END AS v, v IS NOT NULL AS observed FROM
 (SELECT corridor, year, v, last_value(v IGNORE NULLS) OVER w1 AS pv, last_value(CASE WHEN v IS NOT NULL THEN year END IGNORE NULLS) OVER w1 AS py, first_value(v IGNORE NULLS) OVER w2 AS nv, first_value(CASE WHEN v IS NOT NULL THEN year END IGNORE NULLS) OVER w2 AS ny
 FROM (SELECT g.corridor, CAST(g.year AS INT) AS year, y.v FROM (SELECT corridor, unnest(generate_series(min(year), max(year))) AS year FROM yy GROUP BY corridor) g LEFT JOIN yy y ON y.corridor = g.corridor AND y.year = g.year)
 WINDOW w1 AS (PARTITION BY corridor ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), w2 AS (PARTITION BY corridor ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""", EV + ", yy AS (SELECT corridor, year, avg(weighted_binding) AS v FROM ev WHERE year % 3 <> 0 GROUP BY ALL)", "v"))  # fmt: skip
def _(s, d):
    # exact sums and 12 digits before the 6 of a report: no result hangs on the order in which rows are added
    mean = F.avg(F.col("weighted_binding").cast("decimal(28,12)")).cast("double")
    per = evidence(s, d).where("year % 3 <> 0").groupBy("corridor", "year").agg(mean.alias("v"))
    return jn.complete_years(per, "corridor", "v").withColumn("v", F.round("v", 12))


@query("j15_task_grid", "WITH k AS (SELECT DISTINCT p_type AS keyword FROM part), s AS (SELECT r_name AS source FROM region), g AS (SELECT unnest(generate_series(DATE '1950-01-01', DATE '1951-12-01', INTERVAL 6 MONTH))::DATE AS date_start) SELECT keyword, source, date_start, (date_start + INTERVAL 6 MONTH - INTERVAL 1 DAY)::DATE AS date_end, concat('https://', lower(source), '.example/search?q=', replace(keyword, ' ', '+'), '&from=', date_start) AS url FROM k, s, g")
def _(s, d):
    keys = table(s, d, "part").select(F.col("p_type").alias("keyword")).distinct()
    src = table(s, d, "region").select(F.col("r_name").alias("source"))
    return jn.task_grid(keys, src, "1950-01-01", "1951-12-01", 6, F.concat(F.lit("https://"), F.lower("source"), F.lit(".example/search?q="), F.url_encode("keyword"), F.lit("&from="), F.col("date_start").cast("string")))


# aggregations
def _metrics(name: str, keys: list[str]) -> None:
    voiced = EV + ", vo AS (SELECT *, CASE WHEN source_type IN ('personal_blog', 'review_platform') THEN 'consumer_or_ugc' WHEN source_type LIKE 'official%' THEN 'merchant_or_platform' ELSE 'other_voice' END AS voice FROM ev)"
    rows = lambda s, d: evidence(s, d).withColumn("voice", rl.platform_voice(F.col("source_type")))
    query(name, sql(f"SELECT {', '.join(keys)}, {METRICS} FROM vo GROUP BY {', '.join(keys)}", voiced, METRIC_DOUBLES))(lambda s, d: ag.group_metrics(rows(s, d), keys))


_metrics("a01_a02_a03_group_metrics", ["period", "corridor"])
_metrics("a04_propagation_cube", ["period", "five_year_bin", "corridor", "family", "marker_frame", "discourse_frame"])
_metrics("a53_authority_source_metrics", ["authority_level", "source_type"])


FLAGS = EV + ", " + OWN + ", fl AS (SELECT ev.*, coalesce(own.ownership_category, '') AS ownership_category, (target AND context)::INT::DOUBLE AS lexical, (context AND contains(ev.brand, 'brand_1'))::INT::DOUBLE AS branding, (coalesce(own.ownership_category, '') = 'economy')::INT::DOUBLE AS ownership FROM ev LEFT JOIN own ON own.brand = lower(ev.brand))"


@query("a05_binding_index", sql("SELECT period, corridor, count(*) AS rows, avg(lexical) AS lexical_index, avg(branding) AS branding_index, avg(ownership) AS ownership_index, 0.5 * avg(lexical) + 0.25 * avg(branding) + 0.25 * avg(ownership) AS historical_index FROM fl GROUP BY period, corridor", FLAGS, "lexical_index branding_index ownership_index historical_index"))
def _(s, d):
    return ag.binding_index(_flags(s, d), ["period", "corridor"])


def _flags(s, d):
    return ag.binding_flags(evidence(s, d), ownership(s, d), ["brand_1"], "economy")


@query("a06_adjusted_binding", sql("SELECT period, corridor, count(*) AS rows, avg(r) AS unweighted_index, sum(analysis_weight) AS effective_weight, sum(r * analysis_weight) / sum(analysis_weight) AS weighted_index, sum(r * analysis_weight) / sum(analysis_weight) - avg(r) AS delta FROM (SELECT *, 0.5 * lexical + 0.25 * branding + 0.25 * ownership AS r FROM fl WHERE verification_level <> 'candidate') GROUP BY period, corridor", FLAGS, "unweighted_index effective_weight weighted_index delta"))
def _(s, d):
    return ag.adjusted_binding(rl.usable(_flags(s, d)), ["period", "corridor"])


@query("a07_a56_weighted_mean_by", sql(f"SELECT CAST(year AS VARCHAR) AS year, corridor, count(*) AS rows, sum(analysis_weight) AS weight_sum, {IDX} AS index FROM ev GROUP BY ALL", EV, "weight_sum index"))
def _(s, d):
    return ag.weighted_mean_by(evidence(s, d), ["year", "corridor"])


@query("a56_control_index", sql(f"SELECT period, corridor, control_type, count(*) AS rows, sum(analysis_weight) AS weight_sum, {IDX} AS index FROM (SELECT *, CASE WHEN target THEN 'target_positive' ELSE 'target_absent_with_context' END AS control_type FROM ev WHERE context) GROUP BY ALL", EV, "weight_sum index"))
def _(s, d):
    """The index of L21's groups: rows with a context marker, by whether they name the target."""
    kind = rl.target_control(F.array_join("target_markers", " "), F.array_join("context_markers", " "), "\\S", [])
    return ag.weighted_mean_by(evidence(s, d).withColumn("control_type", kind).where("control_type is not null"), ["period", "corridor", "control_type"])


@query("a08_a09_semantic_summary", sql("SELECT period, corridor, source_type, count(*) AS rows, avg((target AND context)::INT) AS binding_rate, avg(novelty) AS mean_novelty, avg(confidence_score) AS mean_confidence_score FROM ev GROUP BY period, corridor, source_type", EV, "binding_rate mean_novelty mean_confidence_score"))
def _(s, d):
    return ag.semantic_summary(evidence(s, d).withColumn("binding_present", F.col("target") & F.col("context")), ["period", "corridor", "source_type"], ["novelty", "confidence_score"])


@query("a09_ownership_summary", sql("SELECT period, corridor, CASE WHEN ownership_category = '' THEN 'unknown' ELSE ownership_category END AS ownership_category, count(*) AS rows, avg((target AND context)::INT) AS binding_rate, avg(novelty) AS mean_novelty, avg(confidence_score) AS mean_confidence_score FROM fl GROUP BY ALL", FLAGS, "binding_rate mean_novelty mean_confidence_score"))
def _(s, d):
    rows = _flags(s, d).withColumns({"binding_present": F.col("target") & F.col("context"), "ownership_category": F.coalesce("ownership_category", F.lit("unknown"))})
    return ag.semantic_summary(rows, ["period", "corridor", "ownership_category"], ["novelty", "confidence_score"])


@query("a12_spatial_indices", sql("SELECT brand, min(year) AS first_year, sum(CASE WHEN NOT coastal THEN open_count ELSE 0 END) / sum(open_count) AS inland_penetration, max(c) / sum(open_count) AS gateway_concentration FROM pres JOIN (SELECT brand, max(o) AS c FROM (SELECT brand, city, sum(open_count) AS o FROM pres GROUP BY ALL) GROUP BY brand) USING (brand) GROUP BY brand", PRES, "inland_penetration gateway_concentration"))
def _(s, d):
    cells = presence(s, d).groupBy("brand", "city", "coastal").agg(F.sum("open_count").alias("o"), F.min("year").alias("y"))
    return cells.groupBy("brand").agg(F.min("y").alias("first_year"), (F.sum(F.when(~F.col("coastal"), F.col("o")).otherwise(0)) / F.sum("o")).alias("inland_penetration"), (F.max("o") / F.sum("o")).alias("gateway_concentration"))


@query("a12_w02_semantic_transition", sql(f"SELECT corridor, five_year_bin, index, index - lag(index) OVER (PARTITION BY corridor ORDER BY five_year_bin) AS delta_from_previous FROM (SELECT corridor, five_year_bin, {IDX} AS index FROM ev GROUP BY ALL)", EV, "index delta_from_previous"))
def _(s, d):
    per = evidence(s, d).groupBy("corridor", "five_year_bin").agg(ag.weighted_index().alias("index"))
    return wn.bin_delta(per, ["corridor"], "five_year_bin", "index")


@query("a13_value_counts", "SELECT source AS value, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, value LIMIT 10")
def _(s, d):
    return ag.value_counts(table(s, d, "documents"), "source", 10)


@query("a14_top_markers", sql("SELECT m AS value, count(*) AS n FROM (SELECT unnest(list_concat(target_markers, context_markers)) AS m FROM ev) GROUP BY m ORDER BY n DESC, m LIMIT 8", EV))
def _(s, d):
    return ag.top_markers(evidence(s, d).withColumn("m", F.concat("target_markers", "context_markers")), "m", 8)


@query("a15_source_concentration", sql("SELECT source AS value, count(*) AS n, count(*) / (SELECT count(*) FROM documents) AS share FROM documents GROUP BY source HAVING count(*) / (SELECT count(*) FROM documents) > 0.04", "", "share"))
def _(s, d):
    return ag.source_concentration(table(s, d, "documents"), "source", 0.04)


@query("a16_entropy_summary", sql("""SELECT b.corridor, b.five_year_bin, row_count, weight_sum, binding_index, positive_rate_weighted, primary_rows / row_count AS primary_share, tertiary_rows / row_count AS tertiary_share, unique_sources, abs(e) AS entropy, abs(CASE WHEN k > 1 THEN e / log2(k) ELSE 0 END) AS entropy_normalized, dominant, dominant_share
 FROM (SELECT corridor, five_year_bin, """ + METRICS + """ FROM ev GROUP BY corridor, five_year_bin) b JOIN (SELECT corridor, five_year_bin, -sum(p * log2(p)) AS e, count(*) AS k, arg_max(family, struct_pack(c := c, f := family)) AS dominant, arg_max(p, struct_pack(c := c, f := family)) AS dominant_share FROM (SELECT corridor, five_year_bin, family, count(*) AS c, count(*) / sum(count(*)) OVER (PARTITION BY corridor, five_year_bin) AS p FROM ev GROUP BY corridor, five_year_bin, family) GROUP BY corridor, five_year_bin) m USING (corridor, five_year_bin)""", EV, "weight_sum binding_index positive_rate_weighted primary_share tertiary_share entropy entropy_normalized dominant_share"))  # fmt: skip
def _(s, d):
    return ag.entropy_summary(evidence(s, d), ["corridor", "five_year_bin"], "family")


@query("a17_first_appearance", sql(f"SELECT corridor, family, count(*) AS rows, min(year) AS first_year, min(year) FILTER (is_positive) AS first_positive_year, min(year) FILTER (NOT is_positive) AS first_negative_year, max(year) AS last_year, {IDX} AS binding_index FROM ev GROUP BY corridor, family HAVING count(*) >= 2", EV, "binding_index"))
def _(s, d):
    return ag.first_appearance(evidence(s, d), ["corridor", "family"], 2)


@query("a18_low_pockets", sql(f"SELECT authority_level, corridor, period, row_count, binding_index, grouping, 1 - binding_index AS binding_gap FROM (SELECT authority_level, corridor, period, count(*) AS row_count, {IDX} AS binding_index, CASE WHEN grouping(authority_level) = 0 THEN 'authority_level + corridor' ELSE 'corridor + period' END AS grouping FROM ev GROUP BY GROUPING SETS ((period, corridor), (corridor, authority_level))) WHERE row_count >= 3 AND 1 - binding_index > 0.02", EV, "binding_index binding_gap"))
def _(s, d):
    return ag.low_pockets(evidence(s, d), [["period", "corridor"], ["corridor", "authority_level"]])


@query("a19_leave_one_out", sql("SELECT source_type AS excluded, n AS excluded_rows, n / sum(n) OVER () AS excluded_share, (sum(b) OVER () - b) / (sum(w) OVER () - w) AS index_without, (sum(b) OVER () - b) / (sum(w) OVER () - w) - sum(b) OVER () / sum(w) OVER () AS delta_from_full FROM (SELECT source_type, count(*) AS n, sum(weighted_binding) AS b, sum(analysis_weight) AS w FROM ev GROUP BY source_type)", EV, "excluded_share index_without delta_from_full"))
def _(s, d):
    return ag.leave_one_out(evidence(s, d), "source_type")


@query("a20_cramers_v", sql("""SELECT 'corridor' AS variable, count(DISTINCT corridor) AS levels_a, count(DISTINCT is_positive) AS levels_b, sum((o - e) * (o - e) / e) AS chi2, (count(DISTINCT corridor) - 1) * (count(DISTINCT is_positive) - 1) AS df, sqrt(sum((o - e) * (o - e) / e) / (max(n) * (least(count(DISTINCT corridor), count(DISTINCT is_positive)) - 1))) AS cramers_v
 FROM (SELECT r.corridor, c.is_positive, coalesce(x.o, 0) AS o, r.r * c.c / t.n AS e, t.n FROM (SELECT corridor, count(*) AS r FROM ev GROUP BY 1) r CROSS JOIN (SELECT is_positive, count(*) AS c FROM ev GROUP BY 1) c CROSS JOIN (SELECT count(*) AS n FROM ev) t LEFT JOIN (SELECT corridor, is_positive, count(*) AS o FROM ev GROUP BY ALL) x ON x.corridor = r.corridor AND x.is_positive = c.is_positive)""", EV, "chi2 cramers_v"))  # fmt: skip
def _(s, d):
    return ag.cramers_v(evidence(s, d), "corridor", "is_positive")


@query("a21_control_density", sql("SELECT corridor, count(*) FILTER (k = 'target') AS target, count(*) FILTER (k = 'control_a') AS control_a, count(*) FILTER (k = 'control_b') AS control_b, count(*) FILTER (k IS NOT NULL) AS total, count(*) FILTER (k = 'target') / nullif(count(*) FILTER (k IS NOT NULL), 0) AS positive_share FROM (SELECT corridor, CASE WHEN target AND context THEN 'target' WHEN target THEN 'control_a' WHEN context THEN 'control_b' END AS k FROM ev) GROUP BY corridor", EV, "positive_share"))
def _(s, d):
    kind = F.when(F.col("target") & F.col("context"), "target").when(F.col("target"), "control_a").when(F.col("context"), "control_b")
    return ag.control_density(evidence(s, d).withColumn("kind", kind), "corridor", "kind", ["target", "control_a", "control_b"], "target")


@query("a22_a23_transfer_funnel", f"""WITH {PC}, p AS (SELECT conv_id, len(list_filter(['tion', 'keit', 'ment', 'anea'], lambda x: contains(lower(text), x))) > 0 AS marked FROM producers), r AS (SELECT conv_id, regexp_matches(lower(text), 'tion|keit|ment|anea') AS again FROM consumers),
 c AS (SELECT (SELECT count(*) FROM p) AS a, (SELECT count(*) FROM p WHERE marked) AS b, (SELECT count(*) FROM r JOIN p USING (conv_id) WHERE marked) AS c, (SELECT count(*) FROM r JOIN p USING (conv_id) WHERE marked AND again) AS d)
 SELECT unnest([0, 1, 2, 3]) AS step, unnest(['producer_records', 'producers_with_marker', 'reviews_of_marked_producers', 'reviews_that_reproduce']) AS stage, unnest([a, b, c, d]) AS rows FROM c""")
def _(s, d):
    """How many producers use the marker, and how many of their reviews take it up."""
    w = STANCE_WORDS["context"]
    prod = producers(s, d).select("conv_id", rl.producer_category(F.col("text"), w, "anea", "tion").alias("producer"))
    rev = consumers(s, d).join(prod, "conv_id").select("producer", rl.response_category(F.col("text"), F.col("producer"), w, ["the", "und"]).alias("response"))
    rows = prod.select("producer", F.lit(None).cast("string").alias("response")).unionByName(rev)
    own, marked = F.col("response").isNull(), F.col("producer") != "no_marker"
    return ag.funnel(rows, [("producer_records", own), ("producers_with_marker", own & marked), ("reviews_of_marked_producers", ~own & marked), ("reviews_that_reproduce", ~own & marked & (F.col("response") == "reproduces"))])


@query("a22_flow_matrix", f"""WITH {STANCE} SELECT stance, len(p) > 0 AS marked_producer, count(*) AS rows FROM (SELECT st.stance, coalesce(h.p, []) AS p FROM st JOIN h ON h.conv_id = st.conv_id AND h.turn = st.turn) GROUP BY ALL""")
def _(s, d):
    prod = producers(s, d).select("conv_id", (F.size(lx.hits(F.col("text"), STANCE_WORDS["context"])) > 0).alias("marked_producer"))
    return _stances(s, d).join(prod, "conv_id", "left").groupBy("stance", F.coalesce("marked_producer", F.lit(False)).alias("marked_producer")).agg(F.count("*").alias("rows"))


CRED = EV + """, cr AS (SELECT ev.*, c.cs, c.n AS corroborating_rows FROM ev JOIN (SELECT brand, year, period, count(DISTINCT source_ref) AS cs, count(*) AS n FROM ev GROUP BY brand, year, period) c ON c.brand = ev.brand AND c.year = ev.year AND c.period = ev.period), c1 AS (SELECT *, least(1, 0.35::DOUBLE * greatest(cs - 1, 0)) AS corroboration FROM cr),
 cred AS (SELECT *, least(1, greatest(0, 0.35::DOUBLE * verification + 0.25::DOUBLE * authority_weight + 0.20::DOUBLE * novelty + 0.10::DOUBLE * confidence_score + 0.10::DOUBLE * corroboration)) AS credibility FROM c1), cb AS (SELECT *, CASE WHEN credibility >= 0.75 THEN 'strong' WHEN credibility >= 0.65 THEN 'good' WHEN credibility >= 0.5 THEN 'moderate' ELSE 'low' END AS band FROM cred)"""


def _credibility(s, d):
    return ag.credibility(ag.corroboration(evidence(s, d), ["brand", "year", "period"]).withColumn("authority", F.col("authority_weight")))


@query("a24_a25_credibility", sql("SELECT attestation_id, cs AS corroborating_sources, corroborating_rows, corroboration, credibility, band FROM cb", CRED, "corroboration credibility"))
def _(s, d):
    return _credibility(s, d).select("attestation_id", "corroborating_sources", "corroborating_rows", "corroboration", "credibility", "band")


@query("a26_credibility_summary", sql("SELECT count(*) AS rows, avg(credibility) AS mean, median(credibility) AS median, stddev_pop(credibility) AS stdev, avg((credibility >= 0.7)::INT) AS high_ratio, avg((credibility < 0.5)::INT) AS low_ratio, count(*) FILTER (band = 'strong') AS strong_rows, count(*) FILTER (band = 'good') AS good_rows, count(*) FILTER (band = 'moderate') AS moderate_rows, count(*) FILTER (band = 'low') AS low_rows, avg(verification) AS mean_verification, avg(authority_weight) AS mean_authority, avg(novelty) AS mean_novelty, avg(confidence_score) AS mean_confidence_score, avg(corroboration) AS mean_corroboration FROM cb", CRED, "mean median stdev high_ratio low_ratio mean_verification mean_authority mean_novelty mean_confidence_score mean_corroboration"))
def _(s, d):
    return ag.credibility_summary(_credibility(s, d))


PHASES = [("1946_1987", 400), ("1987_2015", 400), ("2015_2025", 150), ("2026_2030", 10)]


EXPECTED = ["es", "pt", "xx"]


def _health(s, d):
    return ag.corpus_health(evidence(s, d), ownership(s, d), searches(s, d), EXPECTED)


EFFORT = f"""{SEARCHES}, us AS (SELECT * FROM ev WHERE verification_level IN ('verified', 'probable')), ec AS (SELECT unnest(['es', 'pt', 'xx']) AS corridor), pc AS (SELECT corridor, count(*) AS n FROM us GROUP BY corridor),
 ef AS (SELECT coalesce(ec.corridor, pc.corridor) AS corridor, coalesce(n, 0) AS usable_records, coalesce(ec.corridor, pc.corridor) IN (SELECT corridor FROM neg) AS has_search_log FROM ec FULL JOIN pc ON pc.corridor = ec.corridor WHERE ec.corridor IS NOT NULL OR n < 30)"""
HEALTH = EV + ", " + OWN + ", " + EFFORT + """,
 g1 AS (SELECT count(*) AS n, count(*) FILTER (period = '1946_1987') AS a, count(*) FILTER (period = '1987_2015') AS b, count(*) FILTER (period = '2015_2025') AS c, count(DISTINCT source_ref) AS sources, count(*) FILTER (confidence = 'low') AS low, count(source_ref) AS refs, count(DISTINCT corridor) AS corridors FROM us),
 g2 AS (SELECT sum(n) AS rows, count(*) AS keys, count(*) FILTER (n > 1) AS split_artifact_groups FROM (SELECT count(*) AS n FROM us GROUP BY source_ref, year, brand)), g3 AS (SELECT 100 * max(n) / sum(n) AS top FROM (SELECT count(*) AS n FROM us GROUP BY source_type)),
 g4 AS (SELECT 100 * avg((b IN (SELECT brand FROM own))::INT) AS ownership_matching_rate FROM (SELECT DISTINCT lower(brand) AS b FROM us)), g5 AS (SELECT 100 * avg((ownership_category <> 'unknown')::INT) AS ownership_completeness FROM own), g6 AS (SELECT 100 * avg(has_search_log::INT) AS negative_search_effort FROM ef), g7 AS (SELECT min(n) AS least_corridor FROM pc),
 h1 AS (SELECT n AS usable_records, sources AS unique_sources, least(100, 100 * a / 700) AS p1, least(100, 100 * b / 750) AS p2, least(100, 100 * c / 300) AS p3, least(100, 100 * sources / 300) AS source_coverage, least(100, 100 * corridors / 12) AS geographic_coverage, 100 - greatest(0, top - 40) AS source_type_diversity, 100 * n / (SELECT count(*) FROM ev) AS verification_quality,
   100 * (rows - keys) / rows AS duplicate_rate, split_artifact_groups, ownership_completeness, ownership_matching_rate, negative_search_effort, 100 * low / n AS low_confidence_probable_rate, 100 * refs / n AS reproducibility, least_corridor FROM g1, g2, g3, g4, g5, g6, g7),
 hh AS (SELECT *, 0.2 * p1 + 0.15 * p2 + 0.1 * p3 + 0.15 * source_coverage + 0.1 * geographic_coverage + 0.1 * source_type_diversity + 0.1 * verification_quality + 0.05 * (100 - duplicate_rate) + 0.05 * ownership_completeness + 0.05 * reproducibility AS health_score,
   CASE WHEN least(p1, p2, p3) >= 90 AND verification_quality >= 85 AND duplicate_rate < 10 THEN 'A' WHEN least(p1, p2, p3) >= 70 AND verification_quality >= 75 AND duplicate_rate < 15 THEN 'B' WHEN least(p1, p2, p3) >= 40 AND verification_quality >= 60 AND duplicate_rate < 25 THEN 'C' WHEN verification_quality < 40 THEN 'F' ELSE 'D' END AS grade FROM h1)"""


@query("a27_corpus_health", sql('SELECT health_score, grade, usable_records, unique_sources, verification_quality, duplicate_rate, split_artifact_groups, low_confidence_probable_rate, ownership_completeness, ownership_matching_rate, negative_search_effort, source_coverage, geographic_coverage, source_type_diversity, reproducibility, least_corridor, p1 AS "1946_1987_coverage", p2 AS "1987_2015_coverage", p3 AS "2015_2025_coverage" FROM hh', HEALTH, 'health_score verification_quality duplicate_rate low_confidence_probable_rate ownership_completeness ownership_matching_rate negative_search_effort source_coverage geographic_coverage source_type_diversity reproducibility "1946_1987_coverage" "1987_2015_coverage" "2015_2025_coverage"'))
def _(s, d):
    return _health(s, d)


@query("a30_claim_flags", sql("SELECT health_score, grade, grade IN ('A', 'B') AS macro_historical_claims, least_corridor >= 30 AS compare_regions, least(p1, p2, p3) >= 70 AS compare_periods, ownership_completeness >= 60 AND ownership_matching_rate >= 70 AS ownership_shift, p3 >= 60 AS platformization, grade IN ('A', 'B') AND health_score >= 70 AS quantitative_tables FROM hh", HEALTH, "health_score"))
def _(s, d):
    return ag.claim_flags(_health(s, d))


@query("a28_temporal_distribution", sql("SELECT phase, target, coalesce(n, 0) AS rows FROM (VALUES ('1946_1987', 400), ('1987_2015', 400), ('2015_2025', 150), ('2026_2030', 10)) t(phase, target) LEFT JOIN (SELECT period, count(*) AS n FROM ev GROUP BY period) ON period = phase", EV))
def _(s, d):
    phases = s.createDataFrame(PHASES, "phase string, target int")
    return jn.left_counts(phases, evidence(s, d).withColumn("phase", F.col("period")), ["phase"], [F.count("*").alias("rows")], ["rows"])


@query("a29_negative_effort", sql("SELECT corridor, usable_records, has_search_log, has_search_log AS absence_claim_allowed, 100 * avg(has_search_log::INT) OVER () AS effort FROM ef", EV + ", " + EFFORT, "effort"))
def _(s, d):
    return ag.negative_effort(rl.usable(evidence(s, d)), searches(s, d), EXPECTED)


@query("a31_transparency", sql("""SELECT *, 100 * (source_traceable * 0.2 + process_log_ref * 0.12 + harvest_log_available * 0.08 + raw_capture_exists * 0.15 + verification_recorded * 0.18 + notes_recorded * 0.07 + expected_pairs_searched * 0.1 + documentation * 0.1) AS transparency_score FROM
 (SELECT avg((source_ref IS NOT NULL)::INT) AS source_traceable, avg((attestation_id % 5 < 3)::INT) AS process_log_ref, avg((verification_level NOT IN ('', 'unknown'))::INT) AS verification_recorded, avg((verification_level <> 'probable')::INT) AS notes_recorded, avg((attestation_id IN (SELECT page_id FROM pages))::INT) AS raw_capture_exists FROM ev), (SELECT (count(*) > 0)::INT::DOUBLE AS harvest_log_available FROM log),
 (SELECT avg(((corridor, period) IN (SELECT (corridor, period) FROM neg))::INT) AS attested_pairs_searched FROM (SELECT DISTINCT corridor, period FROM ev)), (SELECT avg(((corridor, '1946_1987') IN (SELECT (corridor, period) FROM neg))::INT) AS expected_pairs_searched FROM (SELECT unnest(['en', 'de', 'xx']) AS corridor)), (SELECT 0.75::DOUBLE AS documentation)""", EV + ", " + LOG + ", " + SEARCHES, "source_traceable process_log_ref verification_recorded notes_recorded raw_capture_exists harvest_log_available attested_pairs_searched expected_pairs_searched documentation transparency_score"))  # fmt: skip
def _(s, d):
    i = F.col("attestation_id")
    df = evidence(s, d).withColumns({"log_ref": F.when(i % 5 < 3, F.concat(F.lit("H_"), i.cast("string"))).when(i % 5 == 3, "manual_entry"), "capture_id": i, "notes": F.when(F.col("verification_level") != "probable", "noted")})
    expected = s.createDataFrame([(c, "1946_1987") for c in ("en", "de", "xx")], "corridor string, period string")
    return ag.transparency(df, table(s, d, "pages").select(F.col("page_id").alias("capture_id")), searches(s, d), execution_log(s, d), expected, (True, True, False, True))


@query("a32_quota_audit", sql("SELECT phase, target, coalesce(n, 0) AS rows, coalesce(n, 0) >= target AS full, coalesce(n, 0) * 2 >= target AS half FROM (VALUES ('1946_1987', 400), ('1987_2015', 400), ('2015_2025', 150), ('2026_2030', 10)) t(phase, target) LEFT JOIN (SELECT period, count(*) AS n FROM ev WHERE verification_level <> 'candidate' GROUP BY period) ON period = phase", EV))
def _(s, d):
    phases = s.createDataFrame(PHASES, "phase string, target int")
    out = jn.left_counts(phases, rl.usable(evidence(s, d)).withColumn("phase", F.col("period")), ["phase"], [F.count("*").alias("rows")], ["rows"])
    return out.withColumns({"full": F.col("rows") >= F.col("target"), "half": F.col("rows") * 2 >= F.col("target")})


@query("a35_missing_counts", sql("SELECT unnest(['lang', 'source', 'text']) AS field, unnest([count(*) FILTER (trim(coalesce(lang, '')) = ''), count(*) FILTER (trim(coalesce(source, '')) = ''), count(*) FILTER (trim(coalesce(text, '')) = '')]) AS missing, unnest([count(*) FILTER (trim(coalesce(lang, '')) = ''), count(*) FILTER (trim(coalesce(source, '')) = ''), count(*) FILTER (trim(coalesce(text, '')) = '')]) / count(*) AS rate FROM documents", "", "rate"))
def _(s, d):
    return ag.missing_counts(table(s, d, "documents"), ["lang", "source", "text"])


@query("a36_a37_outliers", sql("SELECT attestation_id, year, 'year' AS issue FROM ev WHERE NOT year BETWEEN 1950 AND 2020 UNION ALL SELECT attestation_id, year, CASE verification_level WHEN 'verified' THEN 'verified_low_confidence' ELSE 'probable_low_confidence' END FROM ev WHERE verification_level IN ('verified', 'probable') AND confidence_score <= 0.3 UNION ALL SELECT attestation_id, year, 'short' FROM ev WHERE text_length < 100", EV))
def _(s, d):
    df = st.cut_lineage(evidence(s, d).select("attestation_id", "year", "verification_level", "confidence_score", "text_length"))
    cols = ["attestation_id", "year"]
    a = ag.year_outliers(df, 1950, 2020).select(*cols, F.lit("year").alias("issue"))
    return a.union(ag.confidence_mismatch(df).select(*cols, "issue")).union(df.where("text_length < 100").select(*cols, F.lit("short")))


ARTIFACT = ["source_ref", "period", "source_type"]
EXACT = [*ARTIFACT, "corridor", "verification_level"]


@query("a38_a57_w04_duplicates", sql("SELECT 'exact' AS kind, concat_ws('|', source_ref, period, source_type, corridor, verification_level) AS key, count(*) AS rows, min(attestation_id) AS first_id FROM ev GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT 'split', concat_ws('|', source_ref, period, source_type), count(*), min(attestation_id) FROM ev GROUP BY ALL HAVING count(*) > 1", EV))
def _(s, d):
    """Groups that agree in all columns of a record, and groups of one artifact that is split over several records."""
    df = st.cut_lineage(evidence(s, d).select("attestation_id", *EXACT))
    part = lambda kind, keys: ag.duplicate_groups(df, keys).select(F.lit(kind).alias("kind"), F.concat_ws("|", *keys).alias("key"), "rows", "first_id")
    return part("exact", EXACT).union(part("split", ARTIFACT))


@query("w04_a57_duplicate_rows", sql("SELECT attestation_id, group_rows, CAST(copy AS INT) AS copy FROM (SELECT attestation_id, count(*) OVER (PARTITION BY source_ref, period, source_type) AS group_rows, row_number() OVER (PARTITION BY source_ref, period, source_type ORDER BY attestation_id) AS copy FROM ev) WHERE copy > 1", EV))
def _(s, d):
    return ag.duplicate_rows(evidence(s, d), ARTIFACT, "attestation_id").select("attestation_id", "group_rows", "copy")


@query("a57_pair_counts", sql("SELECT concat(period, ' / ', corridor) AS pair, count(*) AS rows FROM ev GROUP BY 1", EV))
def _(s, d):
    return ag.pair_counts(evidence(s, d), ["period", "corridor"])


ANOMALIES = EV + """, mk AS (SELECT unnest([array_to_string(target_markers, ';'), array_to_string(context_markers, '#')]) AS m FROM ev), an AS (SELECT unnest(['exact_duplicate_rows', 'suspicious_split_groups', 'year_outliers', 'marker_issues', 'low_conf_verified_rows', 'short_text_rows', 'high_concentration_sources', 'low_conf_probable_rows', 'fuzzy_duplicate_pairs']) AS k,
 unnest([(SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM ev GROUP BY source_ref, period, source_type, corridor, verification_level HAVING count(*) > 1)), (SELECT count(*) FROM (SELECT 1 FROM ev GROUP BY source_ref, period, source_type HAVING count(*) > 1)), count(*) FILTER (NOT year BETWEEN 1950 AND 2020), (SELECT count(*) FROM mk WHERE m <> '' AND (length(m) < 2 OR length(m) > 200 OR contains(m, '#'))),
  count(*) FILTER (verification_level = 'verified' AND confidence_score < 0.5), count(*) FILTER (coalesce(text_length, 0) < 100), (SELECT count(*) FROM (SELECT source_ref FROM ev WHERE source_ref IS NOT NULL GROUP BY 1 HAVING count(*) > 0.055 * (SELECT count(*) FROM ev WHERE source_ref IS NOT NULL))), count(*) FILTER (verification_level IN ('verified', 'probable') AND confidence_score < 0.5), 0]) AS found FROM ev)"""


def _anomalies(s, d):
    df = evidence(s, d).withColumns({"target_text": F.array_join("target_markers", ";"), "context_text": F.array_join("context_markers", "#")})
    return ag.anomaly_report(df, EXACT, ARTIFACT, ["target_text", "context_text"], 1950, 2020, 100, 0.055)


@query("a39_anomaly_report", sql("SELECT k AS check, found, CASE WHEN found <= 0 THEN 'ok' WHEN k IN ('high_concentration_sources', 'low_conf_probable_rows', 'fuzzy_duplicate_pairs') THEN 'warning' ELSE 'critical' END AS severity FROM an", ANOMALIES))
def _(s, d):
    return _anomalies(s, d)


@query("a40_freeze_audit", sql("""SELECT *, structural_missing_ok AND traceability_ok AND duplicate_free AND valid_years AND no_critical_anomalies AS ready_to_freeze FROM (SELECT *, missing_attestation_id <= 0.02 AND missing_year <= 0.02 AND missing_period <= 0.02 AND missing_corridor <= 0.02 AND missing_source_url <= 0.02 AS structural_missing_ok, traceability >= 0.95 AS traceability_ok, duplicate_ids = 0 AND duplicate_artifacts = 0 AS duplicate_free, invalid_years = 0 AS valid_years, false AS no_critical_anomalies FROM
 (SELECT count(*) AS rows, avg((source_ref IS NOT NULL)::INT) AS traceability, 0.0::DOUBLE AS missing_attestation_id, avg((year IS NULL)::INT) AS missing_year, avg((period IS NULL)::INT) AS missing_period, avg((coalesce(corridor, '') = '')::INT) AS missing_corridor, avg((source_url IS NULL)::INT) AS missing_source_url, avg((NOT target)::INT) AS missing_target_text, count(*) FILTER (year IS NULL) AS invalid_years, count(*) FILTER (authority_level = 'primary') AS primary_rows, avg((authority_level = 'tertiary')::INT) AS tertiary_ratio,
  count(attestation_id) - count(DISTINCT attestation_id) AS duplicate_ids FROM ev), (SELECT count(*) - count(DISTINCT (coalesce(source_ref, ''), year, brand)) AS duplicate_artifacts FROM ev))""", EV, "traceability missing_attestation_id missing_year missing_period missing_corridor missing_source_url missing_target_text tertiary_ratio"))  # fmt: skip
def _(s, d):
    critical = _anomalies(s, d).where("severity = 'critical'").limit(1).count() > 0
    df = evidence(s, d).withColumn("target_text", F.array_join("target_markers", ";"))
    return ag.freeze_audit(df, ["attestation_id", "year", "period", "corridor", "source_url"], ["target_text"], ["source_ref", "year", "brand"], critical)


@query("a41_record_quality", sql("""SELECT *, CASE WHEN missing_years > 0.1 * records OR invalid_years > 0.1 * records OR duplicate_artifact_groups > 0 OR suspicious_split_groups > 0.05 * records THEN 'C' WHEN duplicate_url_ratio > 0.05 OR missing_texts > 0.2 * records THEN 'B' ELSE 'A' END AS grade FROM
 (SELECT count(*) AS records, count(*) FILTER (year IS NULL) AS missing_years, count(*) FILTER (NOT year BETWEEN 1940 AND 2026) AS invalid_years, count(*) FILTER (coalesce(text_length, 0) = 0) AS missing_texts, count(*) FILTER (coalesce(source_ref, '') = '') AS missing_sources FROM ev), (SELECT count(*) AS unique_urls, count(*) FILTER (n > 1) AS duplicate_url_groups, coalesce(count(*) FILTER (n > 1) / nullif(count(*), 0), 0) AS duplicate_url_ratio FROM (SELECT lower(source_url) AS u, count(*) AS n FROM ev WHERE source_url IS NOT NULL GROUP BY 1)),
 (SELECT count(*) FILTER (n > 1) AS duplicate_artifact_groups FROM (SELECT count(*) AS n FROM ev WHERE source_ref IS NOT NULL GROUP BY source_ref, year, brand, source_type)), (SELECT count(*) FILTER (n > 1) AS suspicious_split_groups FROM (SELECT count(*) AS n FROM ev WHERE source_ref IS NOT NULL GROUP BY source_ref, period, source_type))""", EV, "duplicate_url_ratio"))  # fmt: skip
def _(s, d):
    return ag.record_quality(evidence(s, d), ["source_ref", "year", "brand", "source_type"], ARTIFACT)


TIME_BINS = {"1946-1959": (1946, 1959), "1960-1969": (1960, 1969), "1970-1979": (1970, 1979), "1980-1987": (1980, 1987)}
MILESTONES = [("method", "source_records", 15.0), ("early_exploratory", "usable_1946_1987", 350.0), ("early_exploratory", "verified_probable_share", 60.0), ("early_exploratory", "bins_ge_20", 3.0), ("early_exploratory", "en_records", 30.0), ("early_stronger", "usable_1946_1987", 600.0), ("early_stronger", "bins_ge_20", 4.0), ("middle_exploratory", "usable_1987_2015", 400.0), ("middle_exploratory", "corridors_ge_50", 3.0), ("platform", "target_rows", 60.0), ("platform", "control_a_rows", 30.0), ("platform", "control_b_rows", 30.0), ("platform", "ownership_matching_rate", 40.0), ("platform", "absent", 1.0)]
_stones = ", ".join(f"('{m}', '{k}', {t}::DOUBLE)" for m, k, t in MILESTONES)


@query("a42_milestones", sql(f"""SELECT milestone, metric, value, threshold, coalesce(value >= threshold, false) AS passed FROM (VALUES {_stones}) t(milestone, metric, threshold) LEFT JOIN (SELECT unnest(['source_records', 'usable_1946_1987', 'usable_1987_2015', 'verified_probable_share', 'bins_ge_20', 'en_records', 'corridors_ge_50', 'target_rows', 'control_a_rows', 'control_b_rows', 'ownership_matching_rate']) AS metric,
 unnest([count(DISTINCT source_ref)::DOUBLE, (count(*) FILTER (ok AND period = '1946_1987'))::DOUBLE, (count(*) FILTER (ok AND period = '1987_2015'))::DOUBLE, 100 * avg(ok::INT), (SELECT count(*) FROM (SELECT 1 FROM okd WHERE ok AND bin IS NOT NULL GROUP BY bin HAVING count(*) >= 20))::DOUBLE, (count(*) FILTER (ok AND corridor = 'en'))::DOUBLE, (SELECT count(*) FROM (SELECT 1 FROM okd WHERE ok GROUP BY corridor HAVING count(*) >= 50))::DOUBLE, (count(*) FILTER (target AND context))::DOUBLE, (count(*) FILTER (target AND NOT context))::DOUBLE, (count(*) FILTER (context AND NOT target))::DOUBLE, (SELECT 100 * avg((b IN (SELECT brand FROM own))::INT) FROM (SELECT DISTINCT lower(brand) AS b FROM okd))]) AS value FROM okd) USING (metric)""",
 FLAGS + ", okd AS (SELECT *, verification_level IN ('verified', 'probable') AS ok, CASE WHEN year BETWEEN 1946 AND 1959 THEN 'a' WHEN year BETWEEN 1960 AND 1969 THEN 'b' WHEN year BETWEEN 1970 AND 1979 THEN 'c' WHEN year BETWEEN 1980 AND 1987 THEN 'd' END AS bin FROM fl)", "value threshold"))
def _(s, d):
    kind = F.when(F.col("target") & F.col("context"), "target").when(F.col("target"), "control_a").when(F.col("context"), "control_b")
    m = ag.milestone_metrics(_flags(s, d).withColumn("control_type", kind), TIME_BINS, ["1946_1987", "1987_2015"], ["en"])
    return ag.milestones(m, s.createDataFrame(MILESTONES, "milestone string, metric string, threshold double"))


@query("a43_progress", sql("SELECT *, CASE WHEN tasks_done > 0 THEN accepted / tasks_done ELSE 0 END AS yield_rate, CASE WHEN tasks = 0 THEN 'stop_nothing_ran' WHEN failure_ratio > 0.5 THEN 'stop_failures' WHEN accepted < 500 THEN 'continue_small_batches' ELSE 'ready_for_review' END AS recommendation FROM (SELECT count(DISTINCT task_id) AS tasks, count(DISTINCT task_id) FILTER (ok) AS tasks_done, count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS failures, avg((NOT ok)::INT) AS failure_ratio, sum(result_count) FILTER (ok) AS results, count(DISTINCT accepted_id) FILTER (ok) AS accepted FROM log)", LOG, "failure_ratio results yield_rate", 4))
def _(s, d):
    return rounded(ag.progress(execution_log(s, d)), 4)


@query("a43_failure_reasons", sql("SELECT failure_reason AS value, count(*) AS n FROM log WHERE NOT ok GROUP BY 1 ORDER BY n DESC, value LIMIT 3", LOG))
def _(s, d):
    return ag.failure_reasons(execution_log(s, d), 3)


@query("a44_task_batch_audit", sql("""SELECT *, list_filter([CASE WHEN direct_ratio = 0 THEN 'no_executable_urls' END, CASE WHEN direct_ratio < 0.2 THEN 'direct_url_ratio_below_threshold' END, CASE WHEN ok_rate < 0.8 THEN 'sampled_ok_rate_below_threshold' END, CASE WHEN ok_rate = 0 THEN 'no_working_urls_in_sample' END], lambda x: x IS NOT NULL) AS critical_reasons, CASE WHEN direct_ratio < 0.2 OR ok_rate < 0.8 THEN 'fail' ELSE 'pass' END AS verdict, CASE WHEN direct_ratio < 0.05 THEN 'critical_queue_not_executable' WHEN failure_rate > 0.3 THEN 'critical_url_failures' WHEN failure_rate > 0.1 THEN 'warning_url_failures' ELSE 'ok' END AS health FROM
 (SELECT count(*) AS tasks, avg(regexp_matches(target, '^https?://')::INT) AS direct_ratio FROM tk), (SELECT count(*) AS checked, avg((s = 'ok')::INT) AS ok_rate, avg((s = 'blocked')::INT) AS blocked_rate, avg((s = 'empty')::INT) AS empty_rate, 1 - avg((s = 'ok')::INT) AS failure_rate FROM (SELECT CASE WHEN page_id % 9 = 0 THEN 'blocked' WHEN length(html) < 2000 THEN 'empty' ELSE 'ok' END AS s FROM tk WHERE regexp_matches(target, '^https?://')))""", "tk AS (SELECT *, CASE WHEN page_id % 4 = 0 THEN 'search: ' || url ELSE url END AS target FROM pages)", "direct_ratio ok_rate blocked_rate empty_rate failure_rate"))  # fmt: skip
def _(s, d):
    tasks = table(s, d, "pages").withColumn("url", F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("search: "), "url")).otherwise(F.col("url")))
    results = tasks.where(tx.is_direct_url(F.col("url"))).select(F.when(F.col("page_id") % 9 == 0, "blocked").when(F.length("html") < 2000, "empty").otherwise("ok").alias("status"))
    return ag.task_batch_audit(tasks.select("url"), results)


SNAPS = "sn AS (SELECT max(ts) AS snapshot_at, sum(count(*)) OVER (ORDER BY ts::DATE) AS rows FROM events GROUP BY ts::DATE), ve AS (SELECT snapshot_at, CAST(rows AS BIGINT) AS rows, CAST(rows - lag(rows) OVER (ORDER BY snapshot_at) AS BIGINT) AS gain, (epoch_us(snapshot_at) - epoch_us(lag(snapshot_at) OVER (ORDER BY snapshot_at))) / 86400000000 AS days FROM sn)"


def _snapshots(s, d):
    """What the table of events held at the end of each day."""
    per = table(s, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.max("ts").alias("snapshot_at"), F.count("*").alias("n"))
    return per.select("snapshot_at", F.sum("n").over(Window.orderBy("day")).alias("rows"))  # one row for each day


@query("a45_velocity", sql("SELECT rows, gain, days, gain / days AS daily_gain FROM ve", SNAPS, "days daily_gain", 4))
def _(s, d):
    return rounded(wn.velocity(_snapshots(s, d)).drop("snapshot_at"), 4)


@query("a45_stall", sql("SELECT *, snapshots < 2 AS insufficient_history, snapshots >= 2 AND ((recent_daily_gain < 5 AND days_since_previous >= 3) OR (gains >= 3 AND avg_daily_gain < 1)) AS stall_detected FROM (SELECT count(*) AS snapshots, arg_max(rows, snapshot_at) AS current_rows, avg(g) AS avg_daily_gain, count(g) AS gains, arg_max(g, snapshot_at) AS recent_daily_gain, arg_max(dd, snapshot_at) AS days_since_previous FROM (SELECT snapshot_at, rows, CASE WHEN rn > 1 THEN gain / days END AS g, CASE WHEN rn > 1 THEN days END AS dd FROM (SELECT *, row_number() OVER (ORDER BY snapshot_at) AS rn FROM (SELECT * FROM ve ORDER BY snapshot_at DESC LIMIT 6))))", SNAPS, "avg_daily_gain recent_daily_gain days_since_previous", 4))
def _(s, d):
    return rounded(wn.stall(_snapshots(s, d)), 4)


@query("a46_sample_gate", sql("SELECT corridor, five_year_bin, n AS row_count, u AS unique_sources, CASE WHEN n >= 30 AND u >= 5 THEN 'quantitative' WHEN n >= 15 AND u >= 3 THEN 'cautious' WHEN n >= 5 THEN 'descriptive' ELSE 'casebook' END AS gate FROM (SELECT corridor, five_year_bin, count(*) AS n, count(DISTINCT source_ref) AS u FROM ev GROUP BY ALL)", EV))
def _(s, d):
    return ag.sample_gate(ag.group_metrics(evidence(s, d), ["corridor", "five_year_bin"])).select("corridor", "five_year_bin", "row_count", "unique_sources", "gate")


@query("a47_a48_low_outliers", sql(f"SELECT source_type, reason, corridor, five_year_bin, count(*) AS rows, avg(1 - weighted_binding) AS mean_gap, CASE WHEN grouping(source_type) = 0 THEN 'source_type' WHEN grouping(reason) = 0 THEN 'reason' ELSE 'corridor + five_year_bin' END AS grouping FROM (SELECT *, {_reason.format('(SELECT least(0.5, quantile_cont(weighted_binding, 0.15)) FROM ev)')} AS reason FROM ev) WHERE reason <> 'not_outlier' GROUP BY GROUPING SETS ((source_type), (reason), (corridor, five_year_bin))", EV, "mean_gap"))
def _(s, d):
    return ag.low_outliers(evidence(s, d), [["source_type"], ["reason"], ["corridor", "five_year_bin"]])


@query("a49_bucket_shares", sql("""SELECT g.corridor, g.period, g.bucket, coalesce(n, 0) AS rows, coalesce(n, 0) / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY g.corridor, g.period), 0) AS share FROM (SELECT DISTINCT corridor, period, b AS bucket FROM ev CROSS JOIN (SELECT unnest(['zero', 'weak', 'middle', 'strong']) AS b)) g
 LEFT JOIN (SELECT corridor, period, CASE WHEN weighted_binding > -0.01 AND weighted_binding <= 0.001 THEN 'zero' WHEN weighted_binding > 0.001 AND weighted_binding <= 0.5 THEN 'weak' WHEN weighted_binding > 0.5 AND weighted_binding <= 0.8 THEN 'middle' WHEN weighted_binding > 0.8 AND weighted_binding <= 1.2 THEN 'strong' END AS bucket, count(*) AS n FROM ev GROUP BY ALL) c USING (corridor, period, bucket)""", EV, "share"))  # fmt: skip
def _(s, d):
    return ag.bucket_shares(evidence(s, d), ["corridor", "period"], "weighted_binding")


@query("a50_binned_surface", sql("""SELECT x_bin, y_bin, lx + (x_bin + 0.5) * sx AS x_mid, ly + (y_bin + 0.5) * sy AS y_mid, count(*) AS rows, avg(l_extendedprice) AS mean_value FROM (SELECT l_extendedprice, lx, ly, sx, sy, CAST(least(floor((l_quantity - lx) / sx), 7) AS INT) AS x_bin, CAST(least(floor((l_discount - ly) / sy), 7) AS INT) AS y_bin
 FROM lineitem, (SELECT min(l_quantity) AS lx, (max(l_quantity) - min(l_quantity)) / 8 AS sx, min(l_discount) AS ly, (max(l_discount) - min(l_discount)) / 8 AS sy FROM lineitem)) GROUP BY ALL""", "", "x_mid y_mid mean_value", 4))  # fmt: skip
def _(s, d):
    return rounded(ag.binned_surface(table(s, d, "lineitem"), "l_quantity", "l_discount", "l_extendedprice"), 4)


def _surface_sql(key: str) -> str:
    """Least squares in SQL: the terms are made orthogonal one after the other, then the coefficients follow from the last one back."""
    ctes = [f"r0 AS (SELECT {key} AS key, 1.0::DOUBLE AS t0, l_quantity::DOUBLE AS t1, l_discount::DOUBLE AS t2, (l_quantity * l_quantity)::DOUBLE AS t3, (l_quantity * l_discount)::DOUBLE AS t4, (l_discount * l_discount)::DOUBLE AS t5, l_extendedprice::DOUBLE AS t6, l_extendedprice::DOUBLE AS y FROM lineitem)"]
    for k in range(6):
        ctes.append(f"c{k} AS (SELECT key, {', '.join(f'sum(t{k} * t{j}) / sum(t{k} * t{k}) AS c{k}{j}' for j in range(k + 1, 7))} FROM r{k} GROUP BY key)")
        ctes.append(f"r{k + 1} AS (SELECT key, {', '.join(f't{j} - c{k}{j} * t{k} AS t{j}' for j in range(k + 1, 7))}, y FROM r{k} JOIN c{k} USING (key))")
    w = {}
    for k in reversed(range(6)):
        w[k] = f"(c{k}6 - ({' + '.join(f'c{k}{j} * w{j}' for j in range(k + 1, 6)) or '0'})) AS w{k}"
    solved = f"(SELECT * FROM {' JOIN '.join(f'c{k}' if k == 0 else f'c{k} USING (key)' for k in range(6))})"
    for k in reversed(range(6)):
        solved = f"(SELECT *, {w[k]} FROM {solved})"
    names = ", ".join(f"struct_pack(term := '{n}', coefficient := w{k})" for k, n in enumerate(ag.SURFACE))
    ctes.append("q AS (SELECT key, count(*) AS rows, 1 - sum(t6 * t6) / sum((y - m) * (y - m)) AS r_squared FROM r6 JOIN (SELECT key, avg(y) AS m FROM r6 GROUP BY key) USING (key) GROUP BY key)")
    return f"WITH {', '.join(ctes)} SELECT key, e.term AS term, round(e.coefficient, 3) AS coefficient, round(r_squared, 6) AS r_squared, rows FROM (SELECT key, unnest([{names}]) AS e FROM {solved}) JOIN q USING (key) WHERE rows >= 20"


@query("a51_quadratic_surface", _surface_sql("'all'"))
def _(s, d):
    return ag.quadratic_surface(table(s, d, "lineitem"), "l_quantity", "l_discount", "l_extendedprice").withColumn("coefficient", F.round("coefficient", 3))


@query("a51_surface_by_key", _surface_sql("coalesce(l_returnflag, 'unknown')"))
def _(s, d):
    return ag.quadratic_surface(table(s, d, "lineitem"), "l_quantity", "l_discount", "l_extendedprice", "l_returnflag").withColumn("coefficient", F.round("coefficient", 3))


@query("a52_yearly_structure", sql("SELECT corridor, year, count(*) AS rows, avg((authority_level = 'tertiary')::INT) AS tertiary_ratio, avg((authority_level = 'primary')::INT) AS primary_ratio, avg(contains(source_type, 'tourism')::INT) AS tourism_ratio, avg(contains(source_type, 'newspaper')::INT) AS newspaper_ratio, sum(weighted_binding) / greatest(sum(analysis_weight), 1e-9) AS binding_index FROM ev GROUP BY corridor, year", EV, "tertiary_ratio primary_ratio tourism_ratio newspaper_ratio binding_index"))
def _(s, d):
    return ag.yearly_structure(evidence(s, d), ["corridor"])


_metrics("a53_voice_metrics", ["voice"])
_metrics("a53_frame_family_metrics", ["discourse_frame", "family"])


@query("a54_overview", sql("SELECT unnest(['rows', 'sources', 'corridors', 'first_year', 'last_year', 'index']) AS metric, unnest([count(*)::DOUBLE, count(DISTINCT source_ref)::DOUBLE, count(DISTINCT corridor)::DOUBLE, min(year)::DOUBLE, max(year)::DOUBLE, sum(weighted_binding) / sum(analysis_weight)]) AS value FROM ev", EV, "value"))
def _(s, d):
    return st.to_metrics(evidence(s, d).agg(F.count("*").alias("rows"), F.countDistinct("source_ref").alias("sources"), F.countDistinct("corridor").alias("corridors"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), ag.weighted_index().alias("index")))


@query("a55_o02_casebook", sql("SELECT attestation_id, corridor, year, analysis_weight FROM ev WHERE weighted_binding <= 0.05 ORDER BY period, corridor, year, attestation_id LIMIT 40", EV, "analysis_weight"))
def _(s, d):
    return ag.casebook(evidence(s, d), F.col("weighted_binding") <= 0.05, ["period", "corridor", "year", "attestation_id"], 40).select("attestation_id", "corridor", "year", "analysis_weight")


# windows
@query("w01_share_within", sql("SELECT corridor, family, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY corridor) AS share FROM ev GROUP BY corridor, family", EV, "share"))
def _(s, d):
    return wn.share_within(evidence(s, d).groupBy("corridor", "family").agg(F.count("*").alias("n")), "n", ["corridor"])


@query("w03_top_per_group", sql("SELECT corridor, marker, n, n / t AS share, CAST(rn AS INT) AS rank FROM (SELECT corridor, marker, n, sum(n) OVER (PARTITION BY corridor) AS t, row_number() OVER (PARTITION BY corridor ORDER BY n DESC, marker) AS rn FROM (SELECT corridor, marker, count(*) AS n FROM (SELECT corridor, unnest(list_concat(target_markers, context_markers)) AS marker FROM ev) GROUP BY corridor, marker)) WHERE rn <= 3", EV, "share"))
def _(s, d):
    per = evidence(s, d).select("corridor", F.explode(F.concat("target_markers", "context_markers")).alias("marker")).groupBy("corridor", "marker").agg(F.count("*").alias("n"))
    return wn.top_per_group(wn.share_within(per, "n", ["corridor"]), ["corridor"], [F.desc("n"), "marker"], 3)


@query("o03_top_k_other", sql("SELECT corridor, source_type, n, n / sum(n) OVER (PARTITION BY corridor) AS share FROM (SELECT corridor, CASE WHEN source_type IN (SELECT source_type FROM ev GROUP BY 1 ORDER BY count(*) DESC, source_type LIMIT 3) THEN source_type ELSE 'other' END AS source_type, count(*) AS n FROM ev GROUP BY ALL)", EV, "share"))
def _(s, d):
    per = evidence(s, d).groupBy("corridor", "source_type").agg(F.count("*").alias("n"))
    return wn.top_k_other(per, ["corridor"], "source_type", "n", 3)


@query("w06_change_points", sql("""SELECT corridor, year, change_score, left_mean, right_mean, is_peak, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY corridor ORDER BY is_peak DESC, round(change_score, 9) DESC, year) AS rank FROM
 (SELECT *, coalesce(change_score >= lag(change_score) OVER w AND change_score >= lead(change_score) OVER w, false) AS is_peak FROM (SELECT *, abs(right_mean - left_mean) / sd + abs(rv - lv) / (sd * sd) AS change_score FROM
 (SELECT corridor, year, avg(v) OVER l AS left_mean, avg(v) OVER r AS right_mean, var_pop(v) OVER l AS lv, var_pop(v) OVER r AS rv, coalesce(nullif(stddev_pop(v) OVER (PARTITION BY corridor), 0), 1) AS sd, row_number() OVER (PARTITION BY corridor ORDER BY year) AS i, count(*) OVER (PARTITION BY corridor) AS n FROM (SELECT corridor, year, avg(weighted_binding) AS v FROM ev GROUP BY ALL)
 WINDOW l AS (PARTITION BY corridor ORDER BY year ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY corridor ORDER BY year ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE i > 5 AND i <= n - 5) WINDOW w AS (PARTITION BY corridor ORDER BY year))) WHERE rank <= 3""", EV, "change_score left_mean right_mean"))  # fmt: skip
def _(s, d):
    per = evidence(s, d).groupBy("corridor", "year").agg(F.avg("weighted_binding").alias("v"))
    return wn.change_points(per, "corridor", "year", "v")


@query("w07_longitudinal_diff", "SELECT user_id, ts, event_id, previous, props <> pp AS text_changed, CAST(len(regexp_extract_all(props, '1')) - len(regexp_extract_all(pp, '1')) AS INT) AS delta_ones FROM (SELECT user_id, ts, event_id, props, lag(props) OVER w AS pp, lag(ts) OVER w AS previous FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE pp IS NOT NULL")
def _(s, d):
    return wn.longitudinal_diff(table(s, d, "events"), "user_id", ["ts", "event_id"], "props", {"ones": F.regexp_count("props", F.lit("1"))})


@query("w08_round_robin", sql("SELECT attestation_id, corridor, five_year_bin, CAST(rn AS INT) AS round FROM (SELECT *, row_number() OVER (PARTITION BY corridor, five_year_bin ORDER BY analysis_weight DESC, attestation_id) AS rn FROM ev) ORDER BY rn, corridor, five_year_bin LIMIT 100", EV))
def _(s, d):
    return wn.stratified_round_robin(evidence(s, d), ["corridor", "five_year_bin"], [F.desc("analysis_weight"), "attestation_id"], 100).select("attestation_id", "corridor", "five_year_bin", "round")


@query("w10_temporal_coverage", sql("SELECT CAST(y.year AS INT) AS year, coalesce(n, 0) AS rows, CAST(floor(y.year / 5) * 5 AS INT) AS bin, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY floor(y.year / 5)) AS BIGINT) AS bin_rows, coalesce(n, 0) > 0 AS covered FROM (SELECT unnest(generate_series(1940, 2030)) AS year) y LEFT JOIN (SELECT year, count(*) AS n FROM ev GROUP BY year) e ON e.year = y.year", EV))
def _(s, d):
    return wn.temporal_coverage(evidence(s, d), 1940, 2030, 5)


@query("w12_early_links", sql(f"SELECT corridor, min(five_year_bin) AS first_bin, arg_min(index, five_year_bin) AS first_index, arg_min(n, five_year_bin) AS rows FROM (SELECT corridor, five_year_bin, {IDX} AS index, count(*) AS n FROM ev GROUP BY ALL) WHERE corridor <> 'en' AND five_year_bin <= 1970 AND index > 0.05 GROUP BY corridor", EV, "first_index"))
def _(s, d):
    per = evidence(s, d).groupBy("corridor", F.col("five_year_bin").alias("bin")).agg(ag.weighted_index().alias("index"), F.count("*").alias("rows"))
    return wn.early_links(per, "corridor", "en", 1970)
