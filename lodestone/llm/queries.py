"""Registered queries of the training-data operators, and their SQL twins."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_naming, decontam, jaccard_join, langid, line_chunks, line_windows, mixing, phrases, token_files, toxicity, url_rules, warc, word_runs, wrapper
from .common import crc, table

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), crc(F.col("doc_id")) % 4 != 2)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, learn = table(spark, sf_dir, "documents"), crc(F.col("doc_id")) % 3 != 1
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn)
    rows = docs.select("doc_id", F.coalesce(~learn, F.lit(False)).alias("held_out"), "text")
    return toxicity.score(rows, model).drop("text")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.exact_dedup(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.line_dedup(table(spark, sf_dir, "documents"))


def op3_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_windows.passage_dedup(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(table(spark, sf_dir, "pages"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    files = token_files.write_tokens(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"))
    return token_files.read_digests(files)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_components(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), url_rules.rule_table(spark, RULES))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.through_warc(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs.digests(word_runs.word_runs(word_runs.with_repeats(table(spark, sf_dir, "documents"))))


QUERIES = {"op1_language_id": op1_language_id, "op5_toxicity": op5_toxicity, "op2_exact_dedup": op2_exact_dedup, "op3_line_dedup": op3_line_dedup, "op3_passage_dedup": op3_passage_dedup, "op4_html_extraction": op4_html_extraction, "op6_token_files": op6_token_files, "op7_jaccard_join": op7_jaccard_join, "op8_decontaminate": op8_decontaminate, "op9_url_filter": op9_url_filter, "op10_mix_sources": op10_mix_sources, "op11_phrases": op11_phrases, "op12_arc_to_warc": op12_arc_to_warc, "op13_word_runs": op13_word_runs}

_fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v}|{h}{p}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
SQL = {
    "op2_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
     r AS (SELECT doc_id, t, row_number() OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS rn, count(*) OVER (PARTITION BY t) AS group_size,
                  first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(t) AS text_sha256 FROM r""",
    "op3_line_dedup": rf"""
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
     x AS MATERIALIZED (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM d),
     h AS MATERIALIZED (SELECT doc_id, line, i, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM x),
     r AS (SELECT doc_id, line, i, f, (h * a + lead(h) OVER w * b) % {line_chunks.PRIME} AS r FROM h, (VALUES {', '.join(f'({k}, {a}, {b})' for k, (a, b) in enumerate(line_chunks.FAMILIES))}) t(f, a, b) WINDOW w AS (PARTITION BY doc_id, f ORDER BY i)),
     e AS (SELECT doc_id, line, i, f, r, max(i) OVER (PARTITION BY doc_id, f) AS lines, lag(r) OVER w // {line_chunks.STARTS} % {line_chunks.ENDS} = 0 AS last FROM r WINDOW w AS (PARTITION BY doc_id, f ORDER BY i)),
     c AS (SELECT doc_id, i, f, r, lines, min(CASE WHEN last THEN i END) OVER (PARTITION BY doc_id, f ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS till FROM e),
     k AS (SELECT DISTINCT doc_id, i AS start, least(coalesce(till, lines), lines, i + {line_chunks.MOST - 1}) - i + 1 AS n FROM c WHERE i < lines AND r % {line_chunks.STARTS} = 0),
     u AS (SELECT k.doc_id, start, n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM k JOIN x ON x.doc_id = k.doc_id AND i BETWEEN start AND start + n - 1 GROUP BY k.doc_id, start, n),
     o AS (SELECT doc_id, start, n, first_value(doc_id) OVER w AS fd, first_value(start) OVER w AS fs FROM u WINDOW w AS (PARTITION BY chunk ORDER BY doc_id, start)),
     z AS (SELECT DISTINCT doc_id, unnest(generate_series(start, start + n - 1)) AS i FROM o WHERE doc_id <> fd OR start >= fs + n),
     y AS (SELECT x.doc_id, count(*) AS n_lines, count(z.i) AS n_removed, string_agg(x.line, chr(10) ORDER BY x.i) FILTER (z.i IS NULL) AS rest FROM x LEFT JOIN z ON z.doc_id = x.doc_id AND z.i = x.i GROUP BY x.doc_id)
SELECT d.doc_id, CASE WHEN n_removed > 0 THEN coalesce(rest, '') ELSE text END AS text, n_lines, n_removed FROM d JOIN y ON y.doc_id = d.doc_id""",
    "op7_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
           FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
     n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     k AS MATERIALIZED (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
     f AS MATERIALIZED (SELECT s.* FROM s SEMI JOIN k ON s.g = k.g),
     p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM f AS a JOIN f AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
     e AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN n AS x ON x.doc_id = p.a JOIN n AS y ON y.doc_id = p.b WHERE 100 * c >= 80 * (x.n + y.n - c)),
     r AS (SELECT a AS node, a AS reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.c, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT node, min(reach) AS c FROM r GROUP BY node) AS m ON m.node = d.doc_id""",
    "op9_url_filter": f"""
WITH u AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '') AS h,
                  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
     l AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
     f AS (SELECT *, CASE {_fits} END AS fit FROM l)
SELECT page_id, host, path, CASE WHEN fit IS NOT NULL THEN split_part(fit, '|', 2) END AS rule,
       CASE WHEN fit IS NULL THEN 'allow' ELSE split_part(fit, '|', 1) END AS verdict FROM f""",
    "op10_mix_sources": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  ('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 8))::BIGINT AS h FROM documents),
     s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
     r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk FROM s),
     w AS (SELECT *, CASE rnk % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS full_ FROM r),
     b AS (SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE AS budget FROM s),
     k AS (SELECT *, coalesce(sum(full_) OVER (ORDER BY full_ / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
                  sum(w) OVER (ORDER BY full_ / w, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM w),
     l AS (SELECT *, (budget - held) / free AS lev FROM k, b),
     t AS (SELECT rnk, source, source_size, budget, CASE WHEN full_ <= lev * w THEN full_
                  ELSE (SELECT max(lev) FROM l AS x WHERE x.full_ > x.lev * x.w) * w END AS target FROM l),
     c AS (SELECT d.doc_id, d.size, t.rnk, t.source_size, t.target, t.budget,
                  sum(d.size) OVER (PARTITION BY t.rnk ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS cum FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
     e AS (SELECT *, cum::DOUBLE / target AS f0, (source_size + cum)::DOUBLE / target AS f1 FROM c),
     v AS (SELECT f0 AS f, rnk, size, budget FROM e UNION ALL SELECT f1, rnk, size, budget FROM e),
     g AS (SELECT f, rnk, sum(sum(size)) OVER (ORDER BY f, rnk) AS run, min(budget) AS budget FROM v WHERE f IS NOT NULL GROUP BY f, rnk),
     z AS (SELECT f, rnk FROM g WHERE run <= budget ORDER BY f DESC, rnk DESC LIMIT 1)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * ((CASE WHEN f0 < z.f OR f0 = z.f AND e.rnk <= z.rnk THEN 1 ELSE 0 END) + (CASE WHEN f1 < z.f OR f1 = z.f AND e.rnk <= z.rnk THEN 1 ELSE 0 END)) AS BIGINT) AS taken
FROM e, z""",
    "op11_phrases": r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
     p AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
     g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM p, (VALUES (1), (2), (3), (4)) t(k) WHERE len(w) >= k)),
     f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30),
     n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
     c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
     s AS (SELECT lang, w, k, a, unnest(generate_series(1, k - 1)) AS cut FROM c),
     z AS (SELECT s.lang, array_to_string(s.w, ' ') AS phrase, s.a, x.a AS l, y.a AS r, CAST(2000000::HUGEINT * s.a // (x.a + y.a) AS BIGINT) AS score,
                  row_number() OVER (PARTITION BY s.lang, s.w ORDER BY 2000000::HUGEINT * s.a // (x.a + y.a), cut) AS nth
           FROM s JOIN f AS x ON x.lang = s.lang AND x.phrase = array_to_string(s.w[1:cut], ' ') JOIN f AS y ON y.lang = s.lang AND y.phrase = array_to_string(s.w[cut + 1:], ' ')),
     b AS (SELECT DISTINCT lang, phrase FROM (SELECT c.lang, c.a AS over, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM
               (SELECT lang, w, k, a, m, unnest(generate_series(1, k - m + 1)) AS i FROM c, (VALUES (2), (3)) t(m) WHERE m < k) AS c) AS o
           JOIN f USING (lang, phrase) WHERE 100::HUGEINT * over >= 80::HUGEINT * f.a),
     t AS (SELECT lang, phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
           FROM z WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM b WHERE b.lang = z.lang AND b.phrase = z.phrase))
SELECT lang, rank, phrase, a, l, r, n, score FROM t JOIN n USING (lang) WHERE rank <= 2000""",
    "op12_arc_to_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
     d AS (SELECT page_id, html, array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0],
                  lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(hex, 5 * i + 1, 5))::BIGINT >> s) & 31 AS INT) + 1, 1)), '')), '') AS payload_digest FROM p),
     r AS (SELECT *, row_number() OVER w AS nth, first_value(page_id) OVER w AS keep FROM d WINDOW w AS (PARTITION BY html ORDER BY page_id DESC NULLS LAST))
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN nth > 1 THEN keep END AS refers_to FROM r""",
    "op13_word_runs": r"""
WITH h AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                                  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295::BIGINT) AS h FROM documents),
     p AS (SELECT doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, (h // 10) % 8 AS g FROM h),
     x AS MATERIALIZED (SELECT doc_id, i, w[1 + CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g)) ELSE i END] AS word
           FROM (SELECT *, unnest(range(n)) AS i FROM p)),
     e AS (SELECT a.doc_id, b.i - a.i AS q, a.i, a.i - row_number() OVER (PARTITION BY a.doc_id, b.i - a.i ORDER BY a.i) AS island
           FROM x AS a JOIN x AS b ON a.doc_id = b.doc_id AND a.word = b.word AND a.i < b.i),
     s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM e GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
     r AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY doc_id, start, length),
     t AS (SELECT doc_id, count(*) AS n_runs, arg_max(r, (length::DOUBLE / period, -start, -period)) AS best,
                  string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM r GROUP BY doc_id),
     y AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY i) AS rest FROM x
           WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = x.doc_id AND x.i >= r.start + r.period AND x.i < r.start + r.length) GROUP BY x.doc_id)
SELECT p.doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, 1000 * best.length // best.period AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(rest, '')) AS collapsed_sha256
FROM p LEFT JOIN t ON t.doc_id = p.doc_id LEFT JOIN y ON y.doc_id = p.doc_id""",
}
