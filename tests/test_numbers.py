"""Numbering of rows and ids that outgrow their padding."""
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import resample as rs
from lodestone.plans import catalog


def test_ids_of_more_digits_are_not_cut(spark, tmp_path):
    rows = [(k, f"name {k}", "Brand#1", "SMALL") for k in (0, 998, 999998, 999999, 1000009, 12345678)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    got = catalog.QUERIES["l14_build_events"](spark, str(tmp_path))
    rel = con.sql(catalog.SQL["l14_build_events"])
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[rel.columns.index(c)] for c in got.columns) for r in rel.fetchall())


def test_drawn_rows_do_not_depend_on_how_ranges_are_merged(spark):
    """Partitions are merged by size, in the rows' own reading otherwise than where they are counted."""
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    was = {k: spark.conf.get(k) for k in conf}
    n = 30000
    rows = spark.range(n).select("id", ((F.col("id") * 7919) % 101).cast("double").alias("x"), F.pmod(F.xxhash64("id"), F.lit(2)).cast("double").alias("y"), F.repeat(F.lit("x"), 50).alias("z"))
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {r.size: r.slope_se for r in rs.sufficiency_curve(rows, "id", "y", [50, 100], 20, 17, at="x").collect()}
        at = sorted((r.id, r.x, r.y) for r in rows.collect())
        draws = spark.createDataFrame([(s, r, j) for s in (50, 100) for r in range(20) for j in range(1, s + 1)], "size int, rep long, j int")
        picked = draws.select("size", "rep", (tx.hash_rank(17, *[F.col(c).cast("string") for c in ("size", "rep", "j")]) % n).alias("i")).collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    for size in (50, 100):
        slopes = [np.polyfit(*zip(*[at[p.i][1:] for p in picked if p.size == size and p.rep == r]), 1)[0] for r in range(20)]
        assert got[size] == pytest.approx(np.std(slopes, ddof=1), rel=1e-6)


def test_means_on_the_edge_of_rounding_are_rounded_up(spark):
    """Means that end in 5 at the seventh digit: a sum in doubles may fall short of it."""
    from decimal import ROUND_HALF_UP, Decimal

    from lodestone.plans.views import evidence

    d = "/root/testdata/sf0.01"
    per = {}
    for r in evidence(spark, d).where("year % 3 <> 0").select("corridor", "year", "weighted_binding").collect():
        per.setdefault((r.corridor, r.year), []).append(Decimal(f"{r.weighted_binding:.12f}"))
    got = {(r.corridor, r.year): r.v for r in catalog.QUERIES["j14_complete_years"](spark, d).collect() if r.observed}
    want = {k: float((sum(v) / len(v)).quantize(Decimal("1e-6"), ROUND_HALF_UP)) for k, v in per.items()}
    assert got == want
