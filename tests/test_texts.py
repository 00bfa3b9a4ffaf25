"""Similarity of whole texts against brute force."""
import difflib
import itertools

import pytest

from lodestone.plans import catalog_more

QUERIES = catalog_more.QUERIES


@pytest.fixture(scope="module")
def texts():
    body = [" ".join(f"w{k}x{i}" for i in range(30)) for k in range(4)]
    rows = [(1, "Same title here\n" + body[0]), (2, "Same title here\n" + body[1]), (3, "One\n" + body[2]), (4, "Another head\n" + body[2]), (5, "No\n" + body[3]), (6, "No\n" + body[3] + " more"), (7, None), (8, ""), (9, "Same title here\n" + body[0])]
    return [(i, t, "en" if i < 9 else "fr", "ab"[i % 2]) for i, t in rows]


@pytest.fixture(scope="module")
def folder(spark, texts, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").write.parquet(f"{at}/documents.parquet")
    return at


def words(text):
    return set((text or "").lower().split())


def similar(texts, t):
    for (i, x, g, a), (j, y, h, b) in itertools.combinations(texts, 2):
        u = words(x) | words(y)
        if words(x) and words(y) and g == h and len(words(x) & words(y)) >= t * len(u):
            yield i, j, x, y, a, b


def test_refined_pairs_compare_whole_texts(spark, folder, texts):
    got = {(r.a, r.b) for r in QUERIES["j08_refined_pairs"](spark, folder).collect()}
    assert got == {(i, j) for i, j, x, y, *_ in similar(texts, 0.8) if difflib.SequenceMatcher(None, x, y).ratio() >= 0.9} and (5, 6) in got


def test_narrative_pairs_templates_and_neighbours_of_whole_texts(spark, folder, texts):
    assert {(r.a, r.b) for r in QUERIES["j08_d04_narrative_pairs"](spark, folder).collect()} == {(i, j) for i, j, _, _, a, b in similar(texts, 0.8) if a != b}
    got = {r.doc_id: (r.component, r.kept) for r in QUERIES["d05_template_filter"](spark, folder).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (3, False), 4: (3, True), 5: (5, False), 6: (5, True), 7: (7, True), 8: (8, True), 9: (9, True)}
    near = {(r.a, r.b) if r.a < r.b else (r.b, r.a) for r in QUERIES["j10_d07_neighbours"](spark, folder).collect()}
    assert near == {(1, 9), (3, 4), (5, 6)}


def test_overlap_of_sources_by_whole_texts(spark, folder, texts):
    a, b = (set().union(*(words(t) for _, t, _, s in texts if s == x)) for x in "ab")
    (got,) = QUERIES["j09_d06_source_overlap"](spark, folder).collect()
    assert (got.a, got.b) == ("a", "b") and got.overlap == pytest.approx(len(a & b) / len(a | b), abs=1e-5)


def test_novelty_takes_200_peers(spark, tmp_path):
    rows = [(i, "Title\n" + " ".join(f"w{(i * k) % 23}" for k in range(1, 9)), "en", "a") for i in range(230)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.peers, r.novelty) for r in QUERIES["d03_novelty"](spark, str(tmp_path)).collect()}
    sets = {i: words(t) for i, t, *_ in rows}
    for i in sets:
        peers = [j for j in sets if j != i][:200]
        want = 1 - sum(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in peers) / len(peers)
        assert got[i] == (200, pytest.approx(want, abs=1e-4))


def test_novelty_without_text_or_peers(spark):
    from lodestone.operators import dedupe as dd

    rows = [(1, "a", [1, 2]), (2, "a", [2, 3]), (3, "a", []), (4, "b", [1]), (5, None, [1]), (6, "a", None)]
    got = {r.id: (r.novelty, r.peers) for r in dd.novelty(spark.createDataFrame(rows, "id long, g string, s array<long>"), "id", "g", "s", 1).collect()}
    assert got == {1: (pytest.approx(2 / 3), 1), 2: (pytest.approx(2 / 3), 1), 3: (0.5, 0), 4: (1.0, 0), 5: (1.0, 0), 6: (0.5, 0)}
    assert dd.novelty(spark.createDataFrame([], "id long, g string, s array<long>"), "id", "g", "s").count() == 0


def test_copies_cost_no_pairs_in_the_template_filter(spark):
    from lodestone.operators import dedupe as dd

    rows = [(i, "g", [1, 2, 3, 4, 5]) for i in range(50)] + [(60, "g", [1, 2, 3, 4, 5, 6]), (61, "h", [1, 2, 3, 4, 5]), (62, "g", [9])]
    got = {r.id: (r.component, r.kept, r.component_rows) for r in dd.template_filter(spark.createDataFrame(rows, "id long, g string, s array<long>"), "id", "g", "s", 0.8, []).collect()}
    assert got == {i: (0, i == 0, 51) for i in [*range(50), 60]} | {61: (61, True, 1), 62: (62, True, 1)}
