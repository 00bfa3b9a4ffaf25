"""Large lexicons against regular expressions, redaction across edges, ragged lines."""
import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lodestone.functions import automaton as am
from lodestone.functions import lexicon as lx
from lodestone.functions import redact
from lodestone.operators import rules as rl
from lodestone.sources import tables as st


def brute_longest(terms, text):
    known, i = {t.lower() for t in terms if t}, 0
    while i < len(text):
        n = max((len(t) for t in known if text.startswith(t, i)), default=0)
        if n:
            yield i, i + n
        i += n or 1


def test_spans_equal_brute_force():
    r = random.Random(4)
    for _ in range(400):
        terms = ["".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(r.randint(0, 12))]
        text = "".join(r.choice("abcd") for _ in range(r.randint(0, 60)))
        known = am._terms(terms)
        assert list(am.longest_spans(known, text)) == list(brute_longest(terms, text))
        assert sorted(am.all_spans(known, text)) == sorted((i, i + len(t)) for t in known for i in range(len(text)) if text.startswith(t, i))


def test_automaton_equals_regular_expressions(spark, monkeypatch):
    r = random.Random(5)
    terms = ["".join(r.choice("abéß.*") for _ in range(r.randint(1, 4))) for _ in range(150)]
    texts = [(i, "".join(r.choice("ABaébß.* ") for _ in range(r.randint(0, 200)))) for i in range(60)] + [(90, None), (91, "")]
    df = spark.createDataFrame(texts, "id int, t string")

    def read():
        n, m = lx.count_terms(F.col("t"), terms)
        return [tuple(x) for x in df.select("id", n, m, lx.hits(F.col("t"), [*terms, "zz", "É"])).orderBy("id").collect()]

    big = read()
    monkeypatch.setattr(lx, "LARGE", 10**9)
    assert read() == big and sum(x[1] for x in big) > 500


def test_time_does_not_follow_the_number_of_terms():
    r = random.Random(6)
    words = ["".join(r.choice("abcdefghij") for _ in range(8)) for _ in range(100_000)]
    text = " ".join(r.choice(words) for _ in range(20_000))
    took = []
    for n in (10, 100_000):
        known = am._terms(words[:n])
        am.automaton(known)
        t = time.perf_counter()
        found = len(list(am.longest_spans(known, text)))
        took.append(time.perf_counter() - t)
    assert found >= 20_000 and took[1] < 30 * took[0] + 1


def test_many_hits_in_one_text(spark):
    df = spark.createDataFrame([(1, "Thing yy " * 100_000)], "id int, t string")
    t = time.perf_counter()
    rows = lx.kwic(df, "t", ["thing"], ["yy"], 3)
    assert rows.agg(F.count("*"), F.max("end")).first()[:] == (100_000, 9 * 99_999 + 5) and time.perf_counter() - t < 60
    mails = spark.createDataFrame([(1, "a.b@c.example " * 100_000)], "id int, t string")
    got = rl.sensitive_scan(mails, "id", "t").agg(F.count("*"), F.count_if(F.col("snippet").contains("@"))).first()
    assert got[:] == (100_000, 0)


def test_hits_across_the_edges_do_not_show(spark):
    text = "x@y.org" + " " + "a" * 49 + " secretname@corp.example " + "b" * 50 + " x@y.org http://u.example/?m=some.one@else.example&k=v"
    df = spark.createDataFrame([(1, text)], "id int, t string")
    got = rl.sensitive_scan(df, "id", "t", terms=["b" * 50 + " x"]).orderBy("hit_no").collect()
    assert [r.kind for r in got] == ["email"] * 4 + ["url", "term"]
    for r in got:
        assert not any(x in r.snippet for x in ("secret", "corp", "some.one", "else", "u.example", "@", "bbbb"))
    assert got[0].snippet == f"<redacted:email> {'a' * 49} <redacted:email>"


@pytest.mark.parametrize("width", [0, 3, 60])
def test_redaction_equals_brute_force(width):
    r = random.Random(width)
    kinds = [("one", re.compile("a+b")), ("two", re.compile("ba")), ("three", re.compile("c.c"))]
    for _ in range(300):
        text = "".join(r.choice("abcx") for _ in range(r.randint(0, 40)))
        hidden = [False] * len(text)
        for _, p in kinds:
            for m in p.finditer(text):
                hidden[m.start() : m.end()] = [True] * (m.end() - m.start())
        for _, s, e, snippet in redact.hits_of(text, kinds, width, None):
            lo, hi = max(0, s - width), min(len(text), e + width)
            plain = "".join(text[i] for i in range(lo, hi) if not hidden[i])
            assert re.sub("<redacted:[a-z]+>", "", snippet) == plain and "<redacted:" in snippet


def test_ragged_lines(spark, tmp_path):
    lines = ["a,b", "1,2", '"q,uo ""te""",x', "3,4,5", '6,"7,7","8 ""8""",,9', ",,", "only", '"",y', "", "10,11" + ",z" * 1_000_000, "12,13,"]
    (tmp_path / "x.csv").write_text("﻿" + "\n".join(lines) + "\n")
    got = {tuple(r) for r in st.read_ragged(spark, f"file://{tmp_path}/x.csv", ["a", "b"], "more", header=True).collect()}
    want = {("1", "2", None), ('q,uo "te"', "x", None), ("3", "4", "5"), ("6", "7,7", '8 "8",,9'), (None, None, ""), ("only", None, None), (None, "y", None), ("10", "11", ",".join("z" * 1_000_000)), ("12", "13", "")}
    assert got == want
    assert st.read_table(spark, f"file://{tmp_path}/x.csv", extra="more").columns == ["a", "b", "more"]


def test_steps_are_deleted_on_request(spark):
    out = st.cut_lineage(spark.range(5))
    assert out.count() == 5
    path = spark._lodestone_steps[-1].removeprefix("file://")
    assert os.path.isdir(path)
    st.drop_steps(spark)
    assert not os.path.exists(path) and spark._lodestone_steps == []
