"""Every registered query of the library against its SQL twin on the smallest tables."""
import glob
import os

import duckdb
import pytest

from lodestone.plans import catalog, catalog_more, catalog_sequence

D = "/root/testdata/sf0.001"
QUERIES = catalog.QUERIES | catalog_more.QUERIES | catalog_sequence.QUERIES
SQL = catalog.SQL | catalog_more.SQL


def canon(rows):
    def text(v):
        if v is None:
            return "null"
        if isinstance(v, float):
            return f"{v + 0.0:.9g}"
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(map(text, v)) + "]"
        return str(v)

    return sorted(tuple(map(text, r)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{D}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, D)
    cols = sorted(df.columns)
    rel = duck.sql(SQL[name])
    assert cols == sorted(rel.columns)
    want = [tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall()]
    assert canon([tuple(r[c] for c in cols) for r in df.collect()]) == canon(want)


# queries of sequence similarity are held against difflib in test_similarity.py
@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys() - catalog_sequence.QUERIES.keys()))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, D).count() > 0
