"""Overlap of sources against its SQL twin and against plain sets."""
import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.operators import dedupe as dd
from lodestone.plans import catalog_more


def test_more_sources_than_are_compared(spark, tmp_path):
    """210 sources, many of a size, and documents without one; words differ in case and repeat."""
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["w", "W"]) + str(int(r.paretovariate(0.4)) % 300) for _ in range(r.choice([0, 3, 40]))), "en", f"s{i % 210}" if i % 210 else None) for i in range(1, 700)]
    rows += [(i, text, "en", "s7") for i, text in [(701, None), (702, " \n "), (703, "w1 w1")]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = {(a, b): v for a, b, v in con.sql(f"SELECT a, b, overlap FROM ({catalog_more.SQL['j09_d06_source_overlap']})").fetchall()}
    got = catalog_more.QUERIES["j09_d06_source_overlap"](spark, str(tmp_path)).collect()
    assert {(p.a, p.b): p.overlap for p in got} == pytest.approx(want, abs=2e-6) and len(got) == len(want) > 1000


def test_sources_of_a_tie_without_a_name_come_last(spark):
    rows = [(None, [1, 2]), ("a", [1, 2]), ("b", [1, 3]), ("c", [1])]
    df = spark.createDataFrame(rows, "s string, e array<int>")
    assert [tuple(p) for p in dd.source_overlap(df, "s", "e", 2, 0.0).collect()] == [("a", "b", pytest.approx(1 / 3))]
    assert dd.source_overlap(df.limit(0), "s", "e", 2, 0.0).collect() == []


def test_each_distinct_element_is_computed_once(spark):
    """Not for each row that holds it, nor in a filter and again for each side of a join."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def first(e):
        seen.add(1)
        return e[:1]

    sets = {s: {f"{random.Random(s + str(k)).choice('abcdef')}{k}" for k in range(4)} for s in ("x", "y", "z")}
    rows = [(s, sorted(sets[s])) for s in sets for _ in range(100)]
    df = spark.createDataFrame(rows, "s string, e array<string>").repartition(4)
    got = {(p.a, p.b): p.overlap for p in dd.source_overlap(df, "s", "e", 200, 0.0, first).collect()}
    cut = {s: {e[0] for e in sets[s]} for s in sets}
    assert got == pytest.approx({(a, b): len(cut[a] & cut[b]) / len(cut[a] | cut[b]) for a, b in itertools.combinations(sorted(sets), 2) if cut[a] & cut[b]}) and got
    assert seen.value == len(set().union(*sets.values()))
