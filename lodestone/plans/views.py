"""Views that bind the operators to the given tables, in Spark and as SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lexicon import count_terms
from ..functions.text import AUTHORITY_ANALYSIS, CONFIDENCE, VERIFICATION, score_map, year_bin
from ..operators.rules import authority, discourse_frame, first_rule

TARGET = ["thing", "nicht", "queque", "ouaux", "night"]
CONTEXT = ["license", "tion", "keit", "ment", "anea"]
DOMAINS = {"english": ["the", "tion", "ing"], "german": ["nicht", "ung", "keit"], "romance": ["ment", "que", "ción", "eau"]}
TYPES = ["newspaper_archive", "official_event_page", "official_tourism_profile", "personal_blog", "food_media", "advertisement", "review_platform"]
FAMILIES = [("core_thing", "thing|night"), ("negation", "nicht"), ("doubled", "queque|ouaux")]
FRAMES = [("license", "license"), ("abstract", "tion|keit"), ("manner", "ment")]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """A scan that fills fewer tasks than there are cores (one small file) is dealt to all of them, where each row costs much; else df."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def texts(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Documents, with these columns or all, whose texts will be searched."""
    docs = table(spark, d, "documents")
    return dealt(docs.select(*cols) if cols else docs)


def _attested(docs: DataFrame, labels: DataFrame, more: list[str]) -> DataFrame:
    rows = docs.join(labels.select("doc_id", "quality"), "doc_id", "left")
    year = (1946 + F.col("doc_id") % 80).cast("int")
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("doc_id") % 7 + 1).cast("int"))
    return rows.select(
        F.col("doc_id").alias("attestation_id"), F.col("source").alias("source_ref"), F.concat(F.lit("https://"), "source", F.lit(".example/"), F.col("doc_id").cast("string")).alias("source_url"), year.alias("year"),
        F.when(year <= 1987, "1946_1987").when(year <= 2014, "1987_2015").otherwise("2015_2025").alias("period"), F.col("lang").alias("corridor"), F.concat(F.lit("brand_"), (F.col("doc_id") % 37).cast("string")).alias("brand"), kind.alias("source_type"),
        F.when(F.col("quality") == 1, "verified").when(F.col("quality") == 0, "candidate").otherwise("probable").alias("verification_level"), F.when(F.col("n_chars") >= 2000, "high").when(F.col("n_chars") >= 500, "medium").otherwise("low").alias("confidence"),
        F.col("n_chars"), *more,
    )


def attestations(spark: SparkSession, d: str) -> DataFrame:
    """Evidence rows with their text."""
    return _attested(texts(spark, d), table(spark, d, "labels"), [F.col("text").alias("original_text")])


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """Scored evidence rows without their text: texts are scored first, so that only narrow rows are joined."""
    text = F.col("text")
    tn, t = count_terms(text, TARGET)
    cn, c = count_terms(text, CONTEXT)
    scored = {"target_count": tn, "context_count": cn, "target_markers": t, "context_markers": c, "text_length": F.length(text)}
    docs = texts(spark, d).withColumns(scored).drop("text")
    rows = _attested(docs, table(spark, d, "labels"), list(scored))
    level, _ = authority(F.col("source_type"), F.lit(""))
    rows = rows.withColumns({"target": F.col("target_count") > 0, "context": F.col("context_count") > 0, "authority_level": level, "five_year_bin": year_bin(F.col("year"), 5), "novelty": F.least(F.col("n_chars") / 5000.0, F.lit(1.0)), "dedupe_key": F.concat_ws("|", "source_ref", F.col("year").cast("string"), "brand")})
    rows = rows.withColumns({"authority_weight": score_map(F.col("authority_level"), AUTHORITY_ANALYSIS, 0.3), "verification": score_map(F.col("verification_level"), VERIFICATION, 0.5), "confidence_score": score_map(F.col("confidence"), CONFIDENCE, 0.5), "raw_binding": F.when(F.col("target") & F.col("context"), 1.0).otherwise(0.0)})
    rows = rows.withColumn("analysis_weight", 0.7 * F.col("novelty") + 0.3 * F.col("authority_weight"))
    rows = rows.withColumn("weighted_binding", F.col("raw_binding") * F.col("analysis_weight")).withColumn("is_positive", F.col("weighted_binding") > 1e-5)
    has = lambda col, p: F.exists(col, lambda x: x.rlike(p))
    family = first_rule([(~F.col("target") & F.col("context"), "context_without_target"), (F.col("target") & ~F.col("context"), "target_without_context"), *[(has("target_markers", p), n) for n, p in FAMILIES]], "other")
    frame = first_rule([(~F.col("context"), "no_context_marker"), *[(has("context_markers", p), n) for n, p in FRAMES]], "other_marker")
    return rows.withColumns({"family": family, "marker_frame": frame, "discourse_frame": discourse_frame(F.col("source_type"), F.lit(""))})


ATT = """att AS (SELECT d.doc_id AS attestation_id, d.source AS source_ref, concat('https://', d.source, '.example/', d.doc_id) AS source_url, CAST(1946 + d.doc_id % 80 AS INT) AS year,
  CASE WHEN 1946 + d.doc_id % 80 <= 1987 THEN '1946_1987' WHEN 1946 + d.doc_id % 80 <= 2014 THEN '1987_2015' ELSE '2015_2025' END AS period, d.lang AS corridor, concat('brand_', d.doc_id % 37) AS brand,
  CASE d.doc_id % 7 WHEN 0 THEN 'newspaper_archive' WHEN 1 THEN 'official_event_page' WHEN 2 THEN 'official_tourism_profile' WHEN 3 THEN 'personal_blog' WHEN 4 THEN 'food_media' WHEN 5 THEN 'advertisement' ELSE 'review_platform' END AS source_type,
  CASE WHEN l.quality = 1 THEN 'verified' WHEN l.quality = 0 THEN 'candidate' ELSE 'probable' END AS verification_level,
  CASE WHEN d.n_chars >= 2000 THEN 'high' WHEN d.n_chars >= 500 THEN 'medium' ELSE 'low' END AS confidence, d.n_chars, d.text AS original_text
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
EV = f"""{ATT},
ev0 AS (SELECT * EXCLUDE (original_text), regexp_extract_all(lower(original_text), 'nicht|night|ouaux|queque|thing') AS th, regexp_extract_all(lower(original_text), 'license|anea|keit|ment|tion') AS ch, length(original_text) AS text_length FROM att),
ev1 AS (SELECT *, len(th) AS target_count, len(ch) AS context_count, list_sort(list_distinct(th)) AS target_markers, list_sort(list_distinct(ch)) AS context_markers, len(th) > 0 AS target, len(ch) > 0 AS context,
  CASE WHEN source_type IN ('official_tourism_profile', 'personal_blog', 'review_platform') THEN 'tertiary' WHEN source_type IN ('newspaper_archive', 'advertisement') THEN 'primary' ELSE 'secondary' END AS authority_level,
  CAST(floor(year / 5) * 5 AS INT) AS five_year_bin, least(n_chars / 5000.0::DOUBLE, 1.0::DOUBLE) AS novelty, concat_ws('|', source_ref, year, brand) AS dedupe_key FROM ev0),
ev2 AS (SELECT *, CASE authority_level WHEN 'primary' THEN 1.2::DOUBLE WHEN 'secondary' THEN 0.7::DOUBLE ELSE 0.2::DOUBLE END AS authority_weight,
  CASE verification_level WHEN 'verified' THEN 1.0::DOUBLE WHEN 'probable' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END AS verification, CASE confidence WHEN 'high' THEN 0.9::DOUBLE WHEN 'medium' THEN 0.65::DOUBLE ELSE 0.3::DOUBLE END AS confidence_score,
  CASE WHEN target AND context THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS raw_binding FROM ev1),
ev3 AS (SELECT *, 0.7::DOUBLE * novelty + 0.3::DOUBLE * authority_weight AS analysis_weight FROM ev2),
ev AS (SELECT *, raw_binding * analysis_weight AS weighted_binding, raw_binding * analysis_weight > 1e-5 AS is_positive,
  CASE WHEN NOT target AND context THEN 'context_without_target' WHEN target AND NOT context THEN 'target_without_context' WHEN list_has_any(th, ['thing', 'night']) THEN 'core_thing' WHEN list_contains(th, 'nicht') THEN 'negation' WHEN list_has_any(th, ['queque', 'ouaux']) THEN 'doubled' ELSE 'other' END AS family,
  CASE WHEN NOT context THEN 'no_context_marker' WHEN list_contains(ch, 'license') THEN 'license' WHEN list_has_any(ch, ['tion', 'keit']) THEN 'abstract' WHEN list_contains(ch, 'ment') THEN 'manner' ELSE 'other_marker' END AS marker_frame,
  CASE WHEN source_type IN ('newspaper_archive', 'advertisement') THEN 'archival_ad_or_news' WHEN source_type = 'official_tourism_profile' THEN 'official_tourism_memory' WHEN source_type = 'official_event_page' THEN 'official_event_or_open_data' WHEN source_type IN ('personal_blog', 'review_platform') THEN 'consumer_or_retrospective_web' ELSE 'other_discourse' END AS discourse_frame FROM ev3)"""

def ownership(spark: SparkSession, d: str) -> DataFrame:
    """Owners of brands; where a brand repeats, its last row counts."""
    rows = table(spark, d, "part").withColumn("brand", F.regexp_replace(F.lower("p_brand"), "#", "_"))
    return rows.groupBy("brand").agg(F.max_by("p_type", "p_partkey").alias("owner")).select("brand", F.when(F.col("owner") == "PROMO", "unknown").otherwise(F.lower("owner")).alias("ownership_category"))


OWN = """own AS (SELECT brand, CASE WHEN owner = 'PROMO' THEN 'unknown' ELSE lower(owner) END AS ownership_category FROM (SELECT replace(lower(p_brand), '#', '_') AS brand, arg_max(p_type, p_partkey) AS owner FROM part GROUP BY 1))"""


def searches(spark: SparkSession, d: str) -> DataFrame:
    """Logged searches without a result: corridor, period."""
    return _attested(table(spark, d, "documents").drop("text"), table(spark, d, "labels"), []).where("attestation_id % 50 = 3 and corridor <> 'es'").select("corridor", "period").distinct()


SEARCHES = "neg AS (SELECT DISTINCT corridor, period FROM ev WHERE attestation_id % 50 = 3 AND corridor <> 'es')"


METRICS = """count(*) AS row_count, sum(analysis_weight) AS weight_sum, CASE WHEN sum(analysis_weight) > 0 THEN sum(weighted_binding) / sum(analysis_weight) ELSE 0 END AS binding_index,
 CASE WHEN sum(analysis_weight) > 0 THEN sum(CASE WHEN is_positive THEN analysis_weight ELSE 0 END) / sum(analysis_weight) ELSE 0 END AS positive_rate_weighted, avg(CASE WHEN is_positive THEN 1.0::DOUBLE ELSE 0 END) AS positive_rate_rows,
 count(*) FILTER (authority_level = 'primary') AS primary_rows, count(*) FILTER (authority_level = 'secondary') AS secondary_rows, count(*) FILTER (authority_level = 'tertiary') AS tertiary_rows, count(DISTINCT source_ref) AS unique_sources, min(year) AS first_year, max(year) AS last_year"""
METRIC_DOUBLES = "weight_sum binding_index positive_rate_weighted positive_rate_rows"


def producers(spark: SparkSession, d: str) -> DataFrame:
    """The first user turn of each conversation."""
    turns = table(spark, d, "conversations").where("role = 'user'")
    return turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))


def consumers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text")


PC = """producers AS (SELECT conv_id, min_by(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id), consumers AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant')"""


def presence(spark: SparkSession, d: str) -> DataFrame:
    """Brand presence by city and region."""
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_linestatus", "l_shipdate", "l_quantity")
    rows = li.join(table(spark, d, "part"), li["l_partkey"] == F.col("p_partkey")).join(table(spark, d, "supplier"), li["l_suppkey"] == F.col("s_suppkey"))
    rows = rows.join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.col("p_brand").alias("brand"), F.col("n_name").alias("city"), F.col("r_name").alias("corridor"), F.year("l_shipdate").alias("year"), F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("open_count"), F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("planned_count"), (F.col("n_nationkey") % 2 == 0).alias("coastal"))


PRES = """pres AS (SELECT p_brand AS brand, n_name AS city, r_name AS corridor, CAST(year(l_shipdate) AS INT) AS year, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS open_count, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS planned_count, n_nationkey % 2 = 0 AS coastal
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def execution_log(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("event_type") != "error"
    reason = F.when(~ok, F.concat(F.lit("status_"), (F.col("user_id") % 5 * 100).cast("string")))
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("task_id"), "ts", ok.alias("ok"), F.col("value").alias("result_count"), "event_type", F.when(ok & (F.col("value") > 40), F.col("event_id")).alias("accepted_id"), reason.alias("failure_reason"))


LOG = "log AS (SELECT event_id, user_id AS task_id, ts, event_type <> 'error' AS ok, value AS result_count, event_type, CASE WHEN event_type <> 'error' AND value > 40 THEN event_id END AS accepted_id, CASE WHEN event_type = 'error' THEN concat('status_', user_id % 5 * 100) END AS failure_reason FROM events)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as a report shows them."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(c, digits) for c in doubles}) if doubles else df


def sql(body: str, ctes: str, doubles: str = "", digits: int = 6) -> str:
    """A query over views' CTEs, with the named doubles rounded."""
    query = f"WITH {ctes} {body}" if ctes else body
    if not doubles:
        return query
    return f"SELECT * REPLACE ({', '.join(f'round({c}, {digits}) AS {c}' for c in doubles.split())}) FROM ({query})"
