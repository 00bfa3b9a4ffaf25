"""Sequence similarity against all pairs by difflib, stars against union-find."""
import difflib
import functools
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import dedupe as dd
from lodestone.operators import joins as jn
from lodestone.operators import similarity as sm
from lodestone.plans import catalog_sequence

WORDS = "the of and in that was for on with as his they be at one have this from".split()
Q = catalog_sequence.QUERIES
ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()


def texts(r, n):
    base = [" ".join(r.choice(WORDS) for _ in range(r.randint(1, 70))) for _ in range(n // 6)]
    out = []
    for _ in range(n):
        t = list(r.choice(base))
        for _ in range(int(len(t) * r.choice([0, 0, 0.05, 0.1, 0.2, 0.4]))):
            k = r.randrange(len(t))
            t[k : k + 1] = r.choice(["", "x", t[k] + "é", "😀"])
        out.append("".join(t))
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    found = [(i, r.choice("aab"), r.choice(["s0", "s1", "s2", "", None]), t) for i, t in enumerate(texts(r, 500))]
    return [*found, (900, "a", "s1", None), (901, "a", "s1", ""), (902, None, "s1", found[0][3]), (903, "c", "s1", "alone"), (904, "b", None, "x" * 9000), (905, "b", "s9", "x" * 9001)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, g string, src string, text string").withColumns({"k": F.lit(1), "band": F.lit("clash"), "d": F.lit(2)}).repartition(3)


@functools.cache
def known_ratio(x, y):
    return ratio(x, y)


def pairs_of(rows, t):
    return {(x[0], y[0]): q for x, y in itertools.combinations(rows, 2) if x[1] is not None and x[1] == y[1] and x[3] and y[3] and (q := known_ratio(x[3], y[3])) >= t}


@pytest.mark.parametrize(("t", "block"), [(0.85, 1000), (0.85, 50), (0.6, 64), (0.97, 20)])
def test_no_pair_is_lost(df, rows, t, block):
    got = {(r.a, r.b): r.similarity for r in sm.sequence_pairs(df, "id", "g", "text", t, block=block).collect()}
    assert got == pytest.approx(pairs_of(rows, t)) and len(got) > 50


def test_common_subsequence_bound():
    r = random.Random(1)
    for _ in range(300):
        x, y = ("".join(r.choice("abcd") for _ in range(r.randint(0, 90))) for _ in range(2))
        prev = [0] * (len(y) + 1)
        for c in x:
            row = [0]
            for j, e in enumerate(y):
                row.append(prev[j] + 1 if c == e else max(prev[j + 1], row[j]))
            prev = row
        for need in (prev[-1], prev[-1] + 1):
            assert sm.Pattern(x).common(y, need) or need > prev[-1]  # False only if it has not
        assert ratio(x, y) * (len(x) + len(y)) / 2 <= prev[-1] + 1e-9


def test_narratives_differ_in_source(df, rows):
    capped = {}
    for x in rows:
        if x[1] is not None and x[3]:
            capped.setdefault(x[1], []).append(x)
    some = [x for v in capped.values() for x in sorted(v)[:60]]
    src = {x[0]: x[2] for x in some}
    want = {p for p in pairs_of(sorted(some), 0.85) if not (src[p[0]] and src[p[0]] == src[p[1]])}
    # pairs are reported where both sources are known to differ
    want = {p for p in want if src[p[0]] is not None and src[p[1]] is not None} | {p for p in want if src[p[0]] is None or src[p[1]] is None}
    assert {(r.a, r.b) for r in sm.sequence_narratives(df, "id", "g", "src", "text", 0.85, 60).collect()} == want and want


def test_templates_keep_the_best(spark, df, rows):
    score = [(F.col("id") % 3), F.length("text")]
    got = {r.id: r for r in sm.sequence_templates(df, "id", "g", "text", score, 0.85).collect()}
    parent = {x[0]: x[0] for x in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs_of(rows, 0.85):
        parent[max(root(a), root(b))] = min(root(a), root(b))
    groups = {}
    for x in rows:
        groups.setdefault(root(x[0]), []).append(x)
    assert {i: r.component for i, r in got.items()} == {x[0]: c for c, v in groups.items() for x in v}
    for v in groups.values():
        best = max(v, key=lambda x: (x[0] % 3, len(x[3] or ""), -x[0]))[0]
        assert all(got[x[0]].kept == (x[0] == best) and got[x[0]].kept_id == (None if x[0] == best else best) and got[x[0]].component_rows == len(v) for x in v)


def test_representatives_and_their_overlap(spark):
    r = random.Random(5)
    rows = [(i, f"s{i % 9}" if i % 11 else None, t) for i, t in enumerate(texts(r, 120))] + [(500 + i, "few", t) for i, t in enumerate(texts(r, 6)[:2])] + [(600, "none", None)]
    by = {}
    for i, s, t in rows:
        if s and t:
            by.setdefault(s, []).append((i, t))
    top = sorted(by, key=lambda s: (-len(by[s]), s))[:8]
    rep = {s: " ".join(t for _, t in sorted(by[s])[:3]) for s in top}
    df = spark.createDataFrame(rows, "id long, src string, text string").repartition(4)
    assert {x.src: (x.rows, x.text) for x in sm.representatives(df, "id", "src", "text", 8, 3).collect()} == {s: (len(by[s]), rep[s]) for s in top}
    got = {(x.a, x.b): x.similarity for x in sm.representative_overlap(df, "id", "src", "text", 0.1, 8, 3).collect()}
    assert got == pytest.approx({(a, b): q for a, b in itertools.combinations(sorted(top), 2) if (q := ratio(rep[a], rep[b])) >= 0.1})


@pytest.mark.parametrize(("span", "first", "block"), [(7, 200, 16), (99, None, 256), (3, None, 1)])
def test_neighbours_of_any_number_of_rows(df, rows, span, first, block):
    some = sorted(rows)[:first]
    want = {(x[0], y[0]): q for i, x in enumerate(some) for y in some[i + 1 : i + 1 + span] if x[3] and y[3] and (q := ratio(x[3], y[3])) >= 0.8}
    got = {(r.a, r.b): r.similarity for r in sm.sequence_neighbours(df, "id", "text", span, first, 0.8, block).collect()}
    assert got == pytest.approx(want) and got


def test_positions(spark):
    df = spark.range(1000).repartition(7).select((F.col("id") * 3).alias("id"))
    assert all(r.pos == r.id // 3 for r in sm.positions(df, "id").collect())


def test_sequence_novelty(df, rows):
    got = {r.id: r for r in sm.sequence_novelty(df, "id", "g", "text", 20, 30).collect()}
    for i, g, _, t in rows[::7] + rows[-6:]:
        near = [x[3] for x in sorted(rows) if x[1] == g and g is not None and x[0] != i and x[3]][:20]
        if not t:
            assert (got[i].novelty, got[i].peers) == (0.5, 0)
        elif not near:
            assert (got[i].novelty, got[i].peers) == (1.0, 0)
        else:
            mean = sum(ratio(t, p) for p in near) / len(near)
            assert got[i].avg_similarity == pytest.approx(mean) and got[i].novelty == pytest.approx(max(0, 1 - mean)) and got[i].peers == len(near)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, g string, src string, text string")
    assert sm.sequence_pairs(none, "id", "g", "text", 0.9).count() == 0
    assert sm.sequence_templates(none, "id", "g", "text", []).count() == 0
    assert sm.sequence_neighbours(none, "id", "text").count() == 0
    assert sm.sequence_novelty(none, "id", "g", "text").count() == 0
    assert sm.representative_overlap(none, "id", "src", "text").count() == 0


def test_components_of_hubs_paths_and_loops(spark):
    r = random.Random(7)
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(150)] + [(5000, 5000)] + [(2000 + r.randrange(90), 2000 + r.randrange(90)) for _ in range(70)] + [(0, 1), (1, 0)]
    got = {x.node: x.component for x in dd.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert got == {i: root(i) for i in parent}
    assert dd.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_counted_join_of_hot_keys(spark):
    rows = [("hot" if i % 3 else f"k{i}", i) for i in range(3000)] + [(None, -1)]
    df = spark.createDataFrame(rows, "k string, v long")
    other = df.groupBy("k").agg(F.count("*").alias("c"), F.min("v").alias("m"))
    least = {}
    for k, v in rows:
        least[k] = min(v, least.get(k, v))
    inner = jn.join_counted(df, other, ["k"], parts=50)
    assert sorted((r.k, r.v, r.m) for r in inner.collect()) == sorted((k, v, least[k]) for k, v in rows if k is not None)
    left = jn.join_counted(df, other.where("k = 'hot'"), ["k"], "left", parts=50)
    assert left.count() == len(rows)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables whose brands (id modulo 37) and neighbours hold near copies."""
    r = random.Random(12)
    found = texts(r, 170)
    docs = []
    for i in range(170):
        t = found[i % 37] if i >= 37 and r.random() < 0.6 else found[i]
        t = t if r.random() < 0.5 else t.replace(" as ", " so ", 1).capitalize() + "  https://x.example/a "
        docs.append((i, None if i % 41 == 3 else t, r.choice(["en", "de"]), f"src{r.randrange(6)}", len(t)))
    at = str(tmp_path_factory.mktemp("sequence"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 170, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    norm = lambda t: " ".join(re.sub(r"https?://\S+", " ", t or "").split()).lower()
    return at, [(i, f"brand_{i % 37}", s, norm(t), (t or "").strip()) for i, t, _, s, _ in docs]


def test_queries_of_pairs(spark, folder):
    at, docs = folder
    same = {(x[0], y[0]): q for x, y in itertools.combinations(docs, 2) if x[1] == y[1] and x[3] and y[3] and (q := ratio(x[3], y[3])) >= 0.85}
    src = {x[0]: x[2] for x in docs}
    got = {(r.a, r.b): r.similarity for r in Q["d04_sequence_narratives"](spark, at).collect()}
    assert got == pytest.approx({p: q for p, q in same.items() if src[p[0]] != src[p[1]]}, abs=1e-6) and len(got) > 20
    got = {(r.a, r.b): r.similarity for r in Q["j08_sequence_pairs"](spark, at).collect()}
    assert got == pytest.approx({p: q for p, q in same.items() if q >= 0.9}, abs=1e-6)
    rows = {r.attestation_id: r for r in Q["d05_sequence_templates"](spark, at).collect()}
    assert len(rows) == len(docs) and all(rows[a].component == rows[b].component for a, b in same)
    assert {r.component for r in rows.values() if r.component_rows > 1} == {rows[a].component for a, _ in same}


def test_queries_of_neighbours_and_sources(spark, folder):
    at, docs = folder
    near = {(x[0], y[0]): q for i, x in enumerate(docs) for y in docs[i + 1 : i + 100] if x[4] and y[4] and (q := ratio(x[4], y[4])) >= 0.95}
    for name in ("j10_d07_sequence_neighbours", "d07_all_neighbours"):
        assert {(r.a, r.b): r.similarity for r in Q[name](spark, at).collect()} == pytest.approx(near, abs=1e-6) and near
    assert {r.check: r.found for r in Q["a39_fuzzy_anomalies"](spark, at).collect()}["fuzzy_duplicate_pairs"] == len(near)
    by = {}
    for i, _, s, t, _ in docs:
        if t:
            by.setdefault(s, []).append(t)
    rep = {s: " ".join(v[:3]) for s, v in by.items()}
    want = {(a, b): q for a, b in itertools.combinations(sorted(rep), 2) if (q := ratio(rep[a], rep[b])) >= 0.3}
    assert {(r.a, r.b): r.similarity for r in Q["j09_d06_representative_overlap"](spark, at).collect()} == pytest.approx(want, abs=1e-6)


def test_query_of_part_names(spark):
    d = "/root/testdata/sf0.001"
    parts = sorted((r.p_partkey, r.p_brand, r.p_name) for r in spark.read.parquet(f"{d}/part.parquet").collect())
    got = {r.p_partkey: r.novelty for r in Q["d03_sequence_novelty"](spark, d).collect()}
    for i, g, t in parts[::17]:
        near = [n for k, b, n in parts if b == g and k != i][:200]
        assert got[i] == pytest.approx(1 - sum(ratio(t, n) for n in near) / len(near), abs=1e-6)
