"""Pairs of similar sets against all pairs."""
import itertools
import random

import numpy as np
import pytest

from lodestone.operators import dedupe as dd
from lodestone.operators import joins as jn


@pytest.mark.parametrize("t", [0.5, 0.8, 1.0])
def test_similar_sets_against_all_pairs(spark, t):
    r = random.Random(5)
    base = [r.sample(range(400), r.choice([1, 2, 4, 5, 9, 10, 25, 60, 140])) for _ in range(40)]
    rows = []
    for i in range(400):
        s = set(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 5, 12])):
            s ^= {r.randrange(400)}
        rows.append((i, r.choice(["a", "b", None]), [str(x) for x in s]))
    want = {}
    for (i, g, x), (j, f, y) in itertools.combinations(rows, 2):
        x, y = set(x), set(y)
        if g == f and g and x and y and len(x & y) / len(x | y) >= t:
            want[i, j] = len(x & y) / len(x | y)
    got = jn.similar_pairs(spark.createDataFrame(rows, "id long, g string, s array<string>"), "id", ["g"], "s", t).collect()
    assert {(p.a, p.b): p.similarity for p in got} == pytest.approx(want) and len(got) == len(want) > 30


def family(r, n, words=60, changed=3):
    """Sets of one family: most are similar, some only by others between them."""
    base = r.sample(range(10**6), words)
    return [sorted({*r.sample(base, words - changed), *r.sample(range(10**6), changed)}) for _ in range(n)]


@pytest.mark.parametrize(("block", "part"), [(7, 5)])
def test_blocks_and_parts_lose_no_pair(spark, block, part):
    r = random.Random(11)
    sets = family(r, 60) + family(r, 25, 9, 1) + family(r, 12, 300, 20) + [[1], [1, 2], [1, 2, 3, 4, 5], [1, 2, 3, 4]]
    rows = [(i, "ab"[i % 7 == 0], f"s{r.randrange(3)}" if i % 11 else None, s) for i, s in enumerate(sets + [r.choice(sets) for _ in range(40)])]
    df = spark.createDataFrame(rows, "id long, g string, src string, s array<long>")
    want = {}
    for (i, g, p, x), (j, f, q, y) in itertools.combinations(rows, 2):
        if g == f and (share := len({*x} & {*y}) / len({*x} | {*y})) >= 0.8:
            want[i, j] = share, p, q
    got = jn.similar_pairs(df, "id", ["g"], "s", 0.8, block=block, part=part).collect()
    assert {(p.a, p.b): p.similarity for p in got} == pytest.approx({k: v[0] for k, v in want.items()}) and len(got) == len(want) > 500
    got = jn.similar_pairs(df, "id", ["g"], "s", 0.8, "src", block, part).collect()
    assert {(p.a, p.b): (p.da, p.db) for p in got} == {k: v[1:] for k, v in want.items() if None not in v[1:] and v[1] != v[2]}
    links = dd.connected(jn.similar_links(df, "id", ["g"], "s", 0.8, block, part))
    assert {(x.node, x.component) for x in links.collect()} == {(x.node, x.component) for x in dd.connected(spark.createDataFrame(list(want), "a long, b long")).collect()}


@pytest.mark.parametrize("t", [0.3, 0.8, 0.95])
def test_bits_bound_what_differs(t):
    r = random.Random(12)
    sets = [s for k in (1, 3, 20, 90, 700, 9000) for s in family(r, 12, k, max(1, k // 15))]
    n, h = np.array([len(s) for s in sets]), np.array([x * 0x9E3779B97F4A7C15 % 2**64 for s in sets for x in s], np.uint64)
    bits = jn.odd_bits(n, h)
    found = {frozenset((int(i), j)) for some, j in jn.near_sets(jn.OddBits(n, bits), None, t) for i in some}
    two = {frozenset((int(i), j + 30)) for some, j in jn.near_sets(jn.OddBits(n[:30], bits[:30]), jn.OddBits(n[30:], bits[30:]), t) for i in some}
    for (i, x), (j, y) in itertools.combinations(enumerate(sets), 2):
        if len({*x} & {*y}) >= t * len({*x} | {*y}):
            assert frozenset((i, j)) in found and (not i < 30 <= j or frozenset((i, j)) in two)


def test_pairs_are_made_in_the_last_step(spark):
    """No join or shuffle carries the pairs of rows: they appear behind all of them."""
    rows = [(i, "g", f"s{i % 3}", s) for i, s in enumerate(family(random.Random(13), 30))]
    plan = dd.narrative_pairs(spark.createDataFrame(rows, "id long, g string, src string, s array<long>"), "id", "g", "src", "s", 0.8)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and "Join" not in plan.split("Generate")[0]
