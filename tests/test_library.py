"""Golden values, edge cases and invariants of the library's operators."""
import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions import lexicon as lx
from lodestone.functions import text as tx
from lodestone.operators import aggregates as ag
from lodestone.operators import dedupe as dd
from lodestone.operators import joins as jn
from lodestone.operators import resample as rs
from lodestone.operators import rules as rl
from lodestone.operators import windows as wn
from lodestone.sources import tables as st

# A producer text and terms with published counts
MERCHANT = "宝岛台式卤肉饭 正宗台湾师傅古法慢炖，主打古早味台式便当 台湾卤肉饭;盐酥鸡;珍珠奶茶 卤肉饭套餐 台湾小吃;快餐"
TARGET = ["卤肉饭"]
CONTEXT = ["台式", "台湾", "台湾小吃", "宝岛"]
NOSTALGIA = ["古早味"]


def one(spark, text, *cols):
    return spark.createDataFrame([(text,)], "t string").select(*cols).first()


def test_published_counts(spark):
    n, matched = lx.count_terms(F.col("t"), TARGET)
    c, cm = lx.count_terms(F.col("t"), CONTEXT)
    r = one(spark, MERCHANT, tx.token_count(F.col("t")), n, matched, c, cm)
    assert (r[0], r[1], r[2], r[3]) == (49, 3, ["卤肉饭"], 6)
    assert r[4] == sorted(CONTEXT)
    s = lx.lexicon_score(spark.createDataFrame([(MERCHANT,)], "t string"), ["t"], TARGET, CONTEXT, {"nostalgia": NOSTALGIA}).first()
    assert round(s.nostalgia_score, 6) == 0.020408 and s.binding_present


def test_longest_term_wins_and_terms_do_not_overlap(spark):
    n, m = lx.count_terms(F.col("t"), ["ab", "abc", "c"])
    assert tuple(one(spark, "ABCabc abx", n, m)) == (3, ["ab", "abc"])


def test_normalisation(spark):
    df = spark.createDataFrame([("ＡＢ　ｃ\t ﬁ ",), (None,)], "t string")
    assert [r.normalized_t for r in tx.normalize_text(df, ["t"]).collect()] == ["ab c fi", ""]


def test_lenient_parse(spark):
    df = spark.createDataFrame([("1975.0",), ("",), ("abc",), (" 1980 ",), (None,), ("nan",)], "y string")
    assert [r[0] for r in df.select(tx.to_year(F.col("y"))).collect()][:5] == [1975, None, None, 1980, None]
    assert [r[0] for r in df.select(tx.to_double(F.col("y"), 0.0)).collect()] == [1975.0, 0.0, 0.0, 1980.0, 0.0, 0.0]


def test_years_and_eras(spark):
    eras = {"nineteen fifties": (1950, 1959)}
    r = one(spark, "In 1948 and the nineteen fifties, not 19481 or 1700", tx.extract_years(F.col("t"), 1946, 1987, eras))
    assert r[0] == [1948, *range(1950, 1960)]


def test_iri(spark):
    assert one(spark, "https://a.example/ä b?q=ü%20", tx.encode_iri(F.col("t")))[0] == "https://a.example/%C3%A4%20b?q=%C3%BC%20"


def test_kwic_positions(spark):
    df = spark.createDataFrame([(1, "xx Thing yy thing"), (2, None), (3, "none")], "id int, t string")
    rows = lx.kwic(df, "t", ["thing"], ["yy"], 3).orderBy("id", "hit").collect()
    assert [(r.start, r.end, r.window, r.context_hits) for r in rows] == [(3, 8, "xx Thing yy", ["yy"]), (12, 17, "yy thing", ["yy"])]


def test_shares_and_index_bounds(spark):
    df = spark.createDataFrame([("a", "x", 1.0, 1.0), ("a", "y", 0.0, 2.0), ("b", "x", 0.5, 0.5)], "k string, c string, weighted_binding double, analysis_weight double")
    rows = df.groupBy("k").agg(ag.weighted_index().alias("i")).collect()
    assert all(0 <= r.i <= 1 for r in rows)
    shares = wn.share_within(df.groupBy("k", "c").count(), "count", ["k"]).groupBy("k").agg(F.sum("share").alias("s")).collect()
    assert all(math.isclose(r.s, 1) for r in shares)


def test_leave_one_out_equals_refiltering(spark):
    df = spark.createDataFrame([(c, float(i % 3), 1.0 + i % 2) for i, c in enumerate("aabbbcccdd" * 3)], "c string, weighted_binding double, analysis_weight double")
    got = {r.excluded: r.index_without for r in ag.leave_one_out(df, "c").collect()}
    for c, v in got.items():
        rest = df.where(F.col("c") != c).agg(ag.weighted_index().alias("i")).first().i
        assert math.isclose(v, rest)


def test_dedupe_is_idempotent_and_merge_keeps_counts(spark):
    df = spark.createDataFrame([(i, f"s{i % 3}", i % 2 + 1950, ["m"] if i % 2 else [], None if i < 3 else "v") for i in range(12)], "id int, s string, y int, m array<string>, v string")
    one_ = dd.dedupe(df, ["s", "y"], ["id"], ["v"]).drop("merged_rows")
    assert one_.count() == 6 and dd.dedupe(one_, ["s", "y"], ["id"], ["v"]).drop("merged_rows").exceptAll(one_).count() == 0
    merged = dd.merge_split(df, ["s", "y"], "id", ["m"], {"v": {"v": 1}})
    assert merged.agg(F.sum("merged_row_count")).first()[0] == 12


def test_components_partition_rows(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 103), (103, 101)], "a long, b long")
    got = {r.node: r.component for r in dd.connected(edges).collect()}
    assert {v for k, v in got.items() if k < 50} == {0} and {got[k] for k in (100, 101, 103)} == {100}


def test_similar_pairs_equal_brute_force(spark):
    import itertools
    import random

    random.seed(2)
    base = [random.sample(range(60), 12) for _ in range(6)]
    sets = [sorted(set(b[: 12 - k] + [99 + k])) for b in base for k in range(4)]
    df = spark.createDataFrame([(i, "g", s) for i, s in enumerate(sets)] + [(999, "g", [])], "id int, g string, s array<int>")
    got = {(r.a, r.b) for r in jn.similar_pairs(df, "id", ["g"], "s", 0.7).collect()}
    want = {(i, j) for (i, x), (j, y) in itertools.combinations(enumerate(sets), 2) if len(set(x) & set(y)) >= 0.7 * len(set(x) | set(y))}
    assert got == want


def test_slopes(spark):
    df = spark.createDataFrame([("k", float(x), 2.0 * x + 1, 1.0 + x) for x in range(5)], "k string, x double, y double, w double")
    pts = rs.numbered(df, "k", "x")
    assert math.isclose(pts.agg(rs.weighted_slope("xc", "y", "w")).first()[0], 2.0)
    r = rs.bootstrap_trend(df, "k", "x", "y", "w", 30, 1).first()
    assert math.isclose(r.slope, 2.0) and r.p_value == 0 and r.trend_emerged


def test_kish_size_is_at_most_the_rows(spark):
    df = spark.createDataFrame([("k", float(i % 2), 1.0 + i) for i in range(10)], "k string, v double, w double")
    assert rs.sample_sufficiency(df, ["k"], "v", "w", 0.05).first().effective_n <= 10


def test_interpolation_holds_edges(spark):
    df = spark.createDataFrame([("k", 2000, None), ("k", 2001, 1.0), ("k", 2004, 4.0)], "k string, year int, v double")
    assert [r.v for r in jn.complete_years(df, "k", "v").orderBy("year").collect()] == [1.0, 1.0, 2.0, 3.0, 4.0]


def test_csv_with_mark_and_surplus_cells(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("﻿id,name\n1,x\n2,y,z,w\n", encoding="utf-8")
    assert st.read_table(spark, str(p)).columns == ["id", "name"]
    rows = st.read_table(spark, str(p), extra="_extra_fields").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("1", "x", None), ("2", "y", "z,w")]


def test_jsonl_drops_broken_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1}\n\n{broken\n{"a": 2}\n')
    assert sorted(r.a for r in st.read_jsonl(spark, str(p), "a int").collect()) == [1, 2]


def test_lexicon_and_alerts(spark, tmp_path):
    p = tmp_path / "l.json"
    p.write_text('{"t": ["x"], "c": ["y"], "domains": {"d": ["z"]}}')
    lex = st.load_lexicon(spark, str(p), "t", "c")
    assert st.terms_of(lex, "context") == ["y", "z"]
    new = spark.createDataFrame([("a",), ("b",), ("b",)], "alert_id string")
    assert [r[0] for r in st.new_alerts(new, spark.createDataFrame([("a",)], "alert_id string")).collect()] == ["b"]


def test_conform_takes_the_first_alias(spark):
    df = spark.createDataFrame([(" ", "r1", "b")], "source_url string, source_id string, brand string")
    r = st.conform(df).first()
    assert (r.source_ref, r.brand, r.target_marker) == ("r1", "b", None)


def test_write_read_snapshot(spark, tmp_path):
    st.write_table(spark.range(3), str(tmp_path / "t_20240105"))
    df = spark.read.parquet(str(tmp_path / "t_20240105"))
    assert st.snapshot_date(df).where("snapshot_date is not null").count() == 3


@pytest.mark.parametrize("f", [lambda e: ag.group_metrics(e, ["period"]), lambda e: ag.leave_one_out(e, "source_type"), lambda e: ag.first_appearance(e, ["corridor"])])
def test_empty_tables(spark, f):
    from lodestone.plans.views import evidence

    assert f(evidence(spark, "/root/testdata/sf0.001").limit(0)).count() == 0


def test_sufficiency_curve_has_no_window_of_all_rows(spark):
    from lodestone.plans import catalog_more

    plan = catalog_more.QUERIES["t08_sufficiency_curve"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not any("avg(year" in line and "windowspecdefinition" in line for line in plan.splitlines())


# A published corpus health report (rows, coverage and rates), which the fixture below reproduces
HEALTH = {"health_score": 87.37, "usable_records": 1426, "unique_sources": 350, "verification_quality": 94.75, "duplicate_rate": 0.0, "split_artifact_groups": 0, "low_confidence_probable_rate": 0.07, "ownership_completeness": 93.75, "ownership_matching_rate": 0.73, "negative_search_effort": 30.0, "1946_1987_coverage": 42.29, "1987_2015_coverage": 70.53, "2015_2025_coverage": 100.0}


def test_published_corpus_health(spark):
    rows = []
    for i in range(1505):
        period, year = ("1946_1987", 1950) if i < 296 else ("1987_2015", 2000) if i < 825 else ("2015_2025", 2020)
        corridor = f"thin{i // 10}" if i < 70 else f"wide{i % 5}"
        rows.append((f"s{i % 350}", year, f"b{i % 137}", corridor, "main" if i < 689 else f"t{i % 4}", "low" if i == 7 else "high", period, "verified" if i < 1426 else "candidate"))
    df = spark.createDataFrame(rows, "source_ref string, year int, brand string, corridor string, source_type string, confidence string, period string, verification_level string")
    own = spark.createDataFrame([("B0", "a")] + [(f"x{k}", "unknown" if k == 1 else "a") for k in range(1, 16)], "brand string, ownership_category string")
    searched = spark.createDataFrame([("thin1",), ("thin2",), ("e1",), ("other",)], "corridor string")
    health = ag.corpus_health(df, own, searched, ["e1", "e2", "e3"])
    r = health.first()
    assert {k: round(r[k], 2) for k in HEALTH} == HEALTH and r.grade == "C"
    f = ag.claim_flags(health).first()
    assert (f.macro_historical_claims, f.compare_regions, f.compare_periods, f.ownership_shift, f.platformization, f.quantitative_tables) == (False, False, False, False, True, False)
    none = ag.corpus_health(df.limit(0), own, searched, ["e1"]).first()
    assert none.grade == "F" and none.usable_records == 0


def test_credibility_by_hand(spark):
    rows = [(1, 1.0, 0.7, 0.5, 0.9, 3), (2, 0.3, 0.4, 2.0, 0.3, 1), (3, 1.0, 1.2, 1.0, 0.9, 9)]
    got = {r.id: (round(r.corroboration, 4), round(r.credibility, 4), r.band) for r in ag.credibility(spark.createDataFrame(rows, "id int, verification double, authority double, novelty double, confidence_score double, corroborating_sources long")).collect()}
    assert got == {1: (0.7, 0.785, "strong"), 2: (0.0, 0.435, "low"), 3: (1.0, 1.0, "strong")}


def test_transparency_by_hand(spark):
    df = spark.createDataFrame([("s", "H_1", 1, "verified", "n", "en", "p"), ("s", "manual_2", 2, "unknown", None, "de", "p"), (None, None, 9, "probable", " ", "", "q"), ("t", "H_4", None, "", "n", "en", "q")], "source_ref string, log_ref string, capture_id long, verification_level string, notes string, corridor string, period string")
    caps = spark.createDataFrame([(1,), (2,), (7,)], "capture_id long")
    pairs = spark.createDataFrame([("en", "p"), ("x", "p")], "corridor string, period string")
    r = ag.transparency(df, caps, pairs, spark.range(1), spark.createDataFrame([("x", "p"), ("y", "p")], pairs.schema), (True, True, False, True)).first()
    assert (r.source_traceable, r.process_log_ref, r.raw_capture_exists, r.verification_recorded, r.notes_recorded, r.expected_pairs_searched) == (0.75, 0.5, 0.5, 0.5, 0.5, 0.5)
    assert math.isclose(r.attested_pairs_searched, 1 / 3) and r.harvest_log_available == 1.0
    assert math.isclose(r.transparency_score, 100 * (0.75 * 0.2 + 0.5 * 0.12 + 0.08 + 0.5 * (0.15 + 0.18 + 0.07 + 0.1) + 0.75 * 0.1))


def test_rules_by_hand(spark):
    reason = rl.outlier_reason(F.col("raw"), F.col("v"), F.col("t"), F.col("c"), 0.3)
    rows = [(0.0, 0.0, True, False), (0.0, 0.0, False, True), (0.0, 0.0, True, True), (1.0, 0.3, True, True), (1.0, 0.4, True, True), (None, None, False, False)]
    got = [r[0] for r in spark.createDataFrame(rows, "raw double, v double, t boolean, c boolean").select(reason).collect()]
    assert got == ["target_without_context", "context_without_target", "no_binding_control", "positive_but_low_weight", "not_outlier", "no_binding_control"]
    kinds = [("Newspaper_scan", "archive"), ("municipal_page", "retrospective"), ("social_media", "blog"), ("advertisement", "other"), (None, "other")]
    assert [r[0] for r in spark.createDataFrame(kinds, "t string, w string").select(rl.source_bucket(F.col("t"))).collect()] == [w for _, w in kinds]
    items = [("A Thing", "core"), ("nicht thing", "core"), ("nicht", "negation"), ("else", "other"), (" ", "unknown"), (None, "unknown")]
    assert [r[0] for r in spark.createDataFrame(items, "t string, w string").select(rl.item_type(F.col("t"), [("core", ["thing"]), ("negation", ["nicht"])])).collect()] == [w for _, w in items]
    value, mode = rl.row_binding(F.col("r"), F.col("v"), F.col("w"), F.lit(1.0), F.lit(1.0), F.lit(0.0))
    got = [tuple(r) for r in spark.createDataFrame([(1.4, None, None), (None, 0.3, 0.6), (None, 0.3, None), (None, 0.9, 0.6), (None, -1.0, 1.0), (None, None, 1.0)], "r double, v double, w double").select(value, mode).collect()]
    assert got == [(1.0, "explicit"), (0.5, "deweighted"), (0.3, "deweighted"), (0.9, "deweighted"), (0.0, "deweighted"), (0.75, "fallback")]
    control = rl.target_control(F.col("b"), F.col("m"), "rice|bowl", ["island"])
    got = [r[0] for r in spark.createDataFrame([("Rice of the Island", None), ("noodles", "m"), ("rice", " "), (None, "m"), (None, None)], "b string, m string").select(control).collect()]
    assert got == ["target_positive", "target_absent_with_context", None, "target_absent_with_context", None]


def test_sensitive_hits_are_redacted(spark):
    df = spark.createDataFrame([(1, "write to a.b@c.example or Bob, see /home/bob/x"), (2, None), (3, "clean")], "id int, t string")
    got = rl.sensitive_scan(df, "id", "t", terms=["bob"]).orderBy("hit_no").collect()
    assert [r.kind for r in got] == ["email", "path", "term", "term"]
    assert all(not any(x in r.snippet.lower() for x in ("bob", "a.b@")) for r in got)
    assert "<redacted:email>" in got[0].snippet and [r.kind for r in rl.sensitive_scan(df, "id", "t", terms=["bob"], cap=2).orderBy("hit_no").collect()] == ["email", "path"]


def test_freeze_quality_and_anomalies_by_hand(spark):
    cols = "attestation_id string, year int, period string, corridor string, source_url string, source_ref string, brand string, source_type string, authority_level string, m string, text_length int, verification_level string, confidence_score double"
    row = lambda i, **k: tuple(({"attestation_id": str(i), "year": 1950, "period": "p", "corridor": "c", "source_url": f"http://x/{i}", "source_ref": f"r{i}", "brand": "b", "source_type": "t", "authority_level": "primary", "m": "mark", "text_length": 500, "verification_level": "verified", "confidence_score": 0.9} | k).values())
    good = spark.createDataFrame([row(i) for i in range(20)], cols)
    audit = lambda df: ag.freeze_audit(df, ["attestation_id", "year", "period", "corridor", "source_url"], ["m"], ["source_ref", "year", "brand"]).first()
    assert audit(good).ready_to_freeze
    bad = good.union(spark.createDataFrame([row(20, source_ref="r1"), row(20, year=None)], cols))
    r = audit(bad)
    assert (r.duplicate_ids, r.duplicate_artifacts, r.invalid_years, r.structural_missing_ok, r.duplicate_free, r.ready_to_freeze) == (1, 1, 1, False, False, False)
    grade = lambda df: ag.record_quality(df, ["source_ref", "year", "brand", "source_type"], ["source_ref", "year", "brand"]).first().grade
    assert grade(good) == "A" and grade(bad) == "C" and grade(good.limit(0)) == "empty"
    assert grade(good.withColumn("source_url", F.when(F.col("attestation_id") < 4, "http://x/0/").otherwise(F.col("source_url")))) == "B"
    rep = {r.check: (r.found, r.severity) for r in ag.anomaly_report(bad.union(spark.createDataFrame([row(30, m="x"), row(31, m="a#b", confidence_score=0.3, text_length=None)], cols)), ["source_ref", "year", "brand"], ["source_ref", "year"], ["m"], 1940, 2026, 100, 0.05).collect()}
    assert rep == {"exact_duplicate_rows": (2, "critical"), "suspicious_split_groups": (1, "critical"), "year_outliers": (1, "critical"), "marker_issues": (2, "critical"), "low_conf_verified_rows": (1, "critical"), "short_text_rows": (1, "critical"), "high_concentration_sources": (1, "warning"), "low_conf_probable_rows": (1, "warning"), "fuzzy_duplicate_pairs": (0, "ok")}


def test_batches_progress_and_stalls_by_hand(spark):
    tasks = spark.createDataFrame([("http://a",), ("search x",), (None,), ("https://b",)], "url string")
    r = ag.task_batch_audit(tasks, spark.createDataFrame([("ok",), ("blocked",)], "status string")).first()
    assert (r.direct_ratio, r.ok_rate, r.critical_reasons, r.verdict, r.health) == (0.5, 0.5, ["sampled_ok_rate_below_threshold"], "fail", "critical_url_failures")
    none = ag.task_batch_audit(tasks.where("url like 's%'"), spark.createDataFrame([], "status string")).first()
    assert none.critical_reasons == ["no_executable_urls", "direct_url_ratio_below_threshold"] and none.health == "critical_queue_not_executable"
    log = spark.createDataFrame([("a", True, 3, "x", None), ("a", True, 2, "x", None), ("b", False, 9, None, " "), ("c", True, 1, None, None)], "task_id string, ok boolean, result_count int, accepted_id string, failure_reason string")
    p = ag.progress(log, 1).first()
    assert (p.tasks, p.tasks_done, p.failure_ratio, p.results, p.accepted, p.yield_rate, p.recommendation) == (3, 2, 0.25, 6, 1, 0.5, "ready_for_review")
    assert [tuple(r) for r in ag.failure_reasons(log, 5).collect()] == [("unknown", 1)]
    snaps = spark.createDataFrame([("2024-01-01", 10), ("2024-01-02", 30), ("2024-01-06", 34)], "snapshot_at string, rows long").withColumn("snapshot_at", F.col("snapshot_at").cast("timestamp"))
    r = wn.stall(snaps).first()
    assert (r.recent_daily_gain, r.avg_daily_gain, r.days_since_previous, r.stall_detected, r.insufficient_history) == (1.0, 10.5, 4.0, True, False)
    assert wn.stall(snaps.limit(1)).first().insufficient_history and not wn.stall(snaps.where("rows < 31")).first().stall_detected


def test_readiness_by_hand(spark):
    rows = [(400, 0.08, "medium", 0.3, "ready"), (400, 0.08, "medium", 0.5, "almost_ready"), (400, 0.04, "high", 0.9, "ready"), (330, 0.08, "high", 0.9, "almost_ready"), (324, 0.01, "high", 0.0, "keep_collecting"), (400, 0.2, "high", 0.0, "keep_collecting"), (400, None, None, 0.0, "keep_collecting")]
    got = rs.readiness(spark.createDataFrame(rows, "rows long, p_value double, stability string, tourism_ratio double, want string")).collect()
    assert all(r.status == r.want for r in got) and [r.records_needed for r in got][3] == 20


def test_order_statistics_and_quantiles(spark):
    import random

    import numpy as np

    r = random.Random(3)
    x = [r.gauss(0, 1) ** 3 for _ in range(3000)] + [0.5] * 500 + [None] * 20
    df = spark.createDataFrame([(v,) for v in x], "v double")
    s = sorted(v for v in x if v is not None)
    assert ag.order_statistics(df, "v", [0, 17, 1700, 3499], few=50, parts=16) == [s[0], s[17], s[1700], s[3499]]
    for q in (0.15, 0.5, 1.0):
        assert math.isclose(ag.exact_quantile(df, "v", q), float(np.quantile(s, q)))
    assert ag.exact_quantile(df.limit(0), "v", 0.5) is None and ag.outlier_threshold(df.limit(0), "v") == 0.5


def test_surface_equals_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x, y = rng.uniform(1, 50, 300), rng.uniform(0, 0.1, 300)
    t = 3 + 2 * x - 40 * y + 0.1 * x * x + x * y - 9 * y * y + rng.normal(0, 1, 300)
    df = spark.createDataFrame([(float(a), float(b), float(c), "ab"[i % 2] if i < 290 else "c") for i, (a, b, c) in enumerate(zip(x, y, t, strict=True))], "x double, y double, t double, k string")
    for key, part in ((None, slice(0, 300)), ("a", slice(0, 290, 2))):
        a, b, c = x[part], y[part], t[part]
        m = np.stack([np.ones_like(a), a, b, a * a, a * b, b * b], 1)
        want = np.linalg.lstsq(m, c, rcond=None)[0]
        got = [r for r in ag.quadratic_surface(df, "x", "y", "t", "k" if key else None).collect() if r.key == (key or "all")]
        by = {r.term: r.coefficient for r in got}
        assert np.allclose([by[k] for k in ag.SURFACE], want, rtol=1e-5, atol=1e-4)
        assert math.isclose(got[0].r_squared, 1 - ((c - m @ want) ** 2).sum() / ((c - c.mean()) ** 2).sum(), rel_tol=1e-6)
    assert {r.key for r in ag.quadratic_surface(df, "x", "y", "t", "k").collect()} == {"a", "b"}


def test_permutations_of_cells_equal_permutations_of_rows(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.integers(1950, 1960, 60)
    y = (rng.random(60) < (x - 1945) / 20).astype(float)
    seen, extreme = abs(((x - x.mean()) * y).sum()), 0
    for _ in range(4000):
        extreme += abs(((x - x.mean()) * rng.permutation(y)).sum()) >= seen - 1e-9
    df = spark.createDataFrame([("k", int(a), "primary", float(b)) for a, b in zip(x, y, strict=True)] + [("k", 1950, "tertiary", 1.0), ("few", 1950, "primary", 1.0)] + [("flat", 1950 + i % 3, "primary", 1.0) for i in range(30)], "key string, year int, authority_level string, v double")
    got = {r.key: r for r in rs.primary_balance(df, "key", "v", 4000).collect()}
    assert abs(got["k"].p_value - extreme / 4000) < 0.03 and (got["k"].rows, got["k"].primary_rows) == (61, 60)
    assert got["few"].p_value is None and got["flat"].p_value == 1.0


def test_poisson_bootstrap_covers_the_ratio(spark):
    df = spark.createDataFrame([("k", i, float(i % 4 == 0), 1.0) for i in range(400)], "k string, id long, v double, w double")
    r = rs.bootstrap_index_ci(df, "k", "id", "v", "w", 300, 1).first()
    assert 0.19 < r.ci_low < 0.25 < r.ci_high < 0.31 and 0.06 < r.ci_high - r.ci_low < 0.11


def test_audit_reasons_by_hand(spark):
    rows = [(i, 0.9, "verified", "archive", 1950, "b", "s") for i in range(20)] + [(30, 0.3, "verified", "blog", 1960, "one", "r")]
    df, rules = rs.audit_rules(spark.createDataFrame(rows, "id long, confidence_score double, verification_level string, source_type string, year int, brand string, source_ref string"))
    got = {r.id: (r.priority, r.reasons) for r in rs.audit_queue(df, "id", rules, 30, 1).collect()}
    assert got[30] == (90, ["low_confidence", "verified_but_suspect_source_type", "rare_year", "single_record_brand"]) and got[0] == (65, ["highly_reused_source_artifact"])


def test_alerts_are_appended_once(spark, tmp_path):
    new = lambda *ids: spark.createDataFrame([(i,) for i in ids], "alert_id string")
    for part in (new("a", "a"), new("a", "b"), new("b")):
        st.append_alerts(part, f"file://{tmp_path}/alerts")
    assert sorted(r[0] for r in spark.read.parquet(f"file://{tmp_path}/alerts").collect()) == ["a", "b"]
