"""The training-data operators against brute force, round trips and held-out labels, with awkward rows."""
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import block_naming, decontam, dom, jaccard_join, langid, line_chunks, line_windows, mixing, queries, range_coder, token_files, toxicity, url_rules, wrapper

D = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it".split()


def word(r):
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3)))


def prose(r, n):
    return " ".join(word(r) for _ in range(n))


@pytest.fixture(scope="module")
def awkward():
    """Nulls, empty and long texts, copies, near copies, repeated rows."""
    r = random.Random(5)
    base = [prose(r, 60) for _ in range(12)]
    rows = [(i, t, "en", "a" if i % 3 else "b") for i, t in enumerate(base)]
    rows += [(20, None, None, None), (21, "", "en", "a"), (22, " \n\t", "en", "c"), (23, "one two", "en", "a"), (24, "One  two", "en", "c"), (25, prose(r, 6000), "en", "b"), (26, base[0] + " \n", "en", "a"), (27, base[0].replace(" ", "  "), "en", "a")]
    for k in range(6):  # a family of near copies
        w = base[1].split(" ")
        for _ in range(k):
            w[r.randrange(len(w))] = word(r)
        rows.append((30 + k, " ".join(w), "en", "d"))
    rows += [(5, base[5], "en", "a"), (None, "null id " + base[2], "en", "a")]  # a repeated row, a null id
    return [(i, t, g, s, None if t is None else len(t)) for i, t, g, s in rows]


@pytest.fixture(scope="module")
def docs(spark, awkward):
    return spark.createDataFrame(awkward, DOCS).withColumns({"score": F.lit("clash"), "size": F.lit(1), "rid": F.lit(2), "kept": F.lit(3)}).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# exact dedup
def test_block_naming_equals_grouping_by_text(docs, awkward, spark):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t, *_ in awkward:
        groups.setdefault(norm(t), []).append((len(t or ""), i))
    got = block_naming.exact_dedup(docs).collect()
    assert len(got) == len(awkward) and sum(r.kept for r in got) == len(groups)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        v = by_sha[r.text_sha256]
        assert r.group_size == len(v)
        best = max(v, key=lambda x: (x[0], -(x[1] if x[1] is not None else 1 << 60)))
        assert r.keep_id == best[1]
    assert block_naming.exact_dedup(empty(spark)).count() == 0


def test_long_texts_that_differ_in_one_block(spark):
    a = "x" * 50_000
    rows = [(1, a), (2, a[:30_000] + "y" + a[30_001:]), (3, a + "z"), (4, a)]
    got = {r.doc_id: r.keep_id for r in block_naming.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 1}


# line dedup
def places(lines, a, b):
    """(start, n) of one rolling hash's chunks, by the stated rule."""
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    r = [(x * a + y * b) % line_chunks.PRIME for x, y in itertools.pairwise(h)]
    for i, x in enumerate(r):
        if x % line_chunks.STARTS == 0:
            last = min([i + line_chunks.MOST - 1, len(lines) - 1, *(k for k in range(i + 1, len(lines)) if r[k - 1] // line_chunks.STARTS % line_chunks.ENDS == 0)])
            yield i, last - i + 1


def brute_chunks(rows):
    """rows in order of doc_id: (doc_id, kept text, lines, removed)."""
    first, out = {}, []
    for d, (i, t) in enumerate(rows):
        lines, gone = (t or "").split("\n"), set()
        for k, n in sorted({p for a, b in line_chunks.FAMILIES for p in places(lines, a, b) if p[1] > 1}):
            f = first.setdefault(tuple(lines[k : k + n]), (d, k))
            if f[0] != d or k >= f[1] + n:
                gone |= set(range(k, k + n))
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else t, len(lines), len(gone)))
    return out


def test_chunks_have_two_lines_at_least_and_depend_on_their_lines_alone(spark):
    lines = [f"line {i}" for i in range(40)]
    got = spark.createDataFrame([(lines,)], "l array<string>").select(line_chunks.chunk_places(F.col("l")).alias("c")).first().c
    assert sorted((r.start, r.n) for r in got) == sorted({p for a, b in line_chunks.FAMILIES for p in places(lines, a, b)})
    assert min(r.n for r in got) >= 2 and max(r.n for r in got) <= line_chunks.MOST
    inside = {(r.start, r.n) for r in got if r.start + r.n <= 36}
    more = spark.createDataFrame([(["other"] * 3 + lines[:36] + ["end"],)], "l array<string>").select(line_chunks.chunk_places(F.col("l")).alias("c")).first().c
    assert {(k + 3, n) for k, n in inside if n < line_chunks.MOST} <= {(r.start, r.n) for r in more}


def test_line_dedup_equals_brute_force(spark, monkeypatch):
    r = random.Random(12)
    passages = [[prose(r, 9) for _ in range(n)] for n in (3, 5, 8, 20)]
    rows = [(i, "\n".join([prose(r, 4) for _ in range(i % 3)] + p + [prose(r, 4) for _ in range(i % 4)])) for i, p in enumerate(passages * 5)]
    rows += [(30, None), (31, ""), (32, "x\nx\nx\nx\nx"), (33, "one\n\n\ntwo"), (34, "a\nb\na\nb\nc"), (35, "a\nb"), (36, "a\nb"), (37, "\n".join(f"l{i % 7}" for i in range(5000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"rid": F.lit("clash"), "chunk": F.lit(1), "h": F.lit(2), "gone": F.lit(3)})
    for h in (line_chunks._hash, lambda c: F.pmod(F.length(c), F.lit(7)).cast("long")):  # the second one has collisions
        monkeypatch.setattr(line_chunks, "_hash", h)
        got = sorted(tuple(x) for x in line_chunks.line_dedup(df.repartition(3)).select("doc_id", "text", "n_lines", "n_removed").collect())
        assert got == brute_chunks(rows)
    # of the copies of a passage of eight lines or more, nearly all lines go
    assert sum(x[3] for x in got[4:20]) >= 0.9 * 4 * sum(map(len, passages))


def test_line_dedup_of_repeated_rows_and_empty_tables(spark):
    rows = [(1, "a\nb\nc\nd"), (1, "a\nb\nc\nd"), (None, "a\nb\nc\nd")]
    for f in (line_chunks.line_dedup, line_windows.passage_dedup):
        got = f(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(x.n_removed for x in got) == [0, 4, 4]
        assert f(empty(spark)).count() == 0


def brute_passages(rows):
    """rows in order of doc_id: (doc_id, kept text, lines, removed) with windows of two lines."""
    first, out = {}, []
    for d, (i, t) in enumerate(rows):
        lines, gone = (t or "").split("\n"), set()
        for k in range(len(lines) - 1):
            f = first.setdefault((lines[k], lines[k + 1]), (d, k))
            if f[0] != d or k > f[1] + 1:
                gone |= {k, k + 1}
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else t, len(lines), len(gone)))
    return out


def test_all_lines_of_repeated_passages_go(spark):
    r = random.Random(6)
    passages = [[prose(r, 9) for _ in range(n)] for n in (2, 3, 5, 8, 20)]
    rows = [(i, "\n".join(["top %d" % i, *p, "end %d" % i])) for i, p in enumerate(passages * 4)]
    rows += [(30, None), (31, ""), (32, "x\nx\nx\nx\nx"), (33, "one\n\n\ntwo"), (34, "a\nb\na\nb\nc"), (35, "x\nx\nb")]
    got = sorted(tuple(x) for x in line_windows.passage_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("doc_id", "text", "n_lines", "n_removed").collect())
    assert got == brute_passages(rows)
    assert all(t == f"top {i}\nend {i}" for i, t, *_ in got if 5 <= i < 20)
    assert got[22][1] == "x\nx"


def test_passages_of_the_documents_equal_brute_force(spark):
    t = spark.read.parquet(f"{D}/documents.parquet")
    rows = sorted((x.doc_id, x.text) for x in t.select("doc_id", "text").collect())
    got = sorted(tuple(x) for x in line_windows.passage_dedup(t).select("doc_id", "text", "n_lines", "n_removed").collect())
    assert got == brute_passages(rows) and sum(x[3] for x in got) > 0


# url rules
def test_url_rules_equal_brute_force(spark):
    rules = queries.RULES
    urls = [None, "", "no scheme", "http://", "https://Example.COM/en/x?y#z", "http://www.example.com/en/", "http://a.www.example.com/en/q", "http://x.net/es/1", "http://net/fr/", "http://net/fr", "http://notnet.org/es/", "http://example.com", "http://example.com/", "ftp://a.b.c.d.net/es/a/b?c://d.net/fr/", "http://com/", "http://xcom/"]

    def judge(u):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")

    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(4, urls[4])], "page_id long, url string")
    got = url_rules.judge_urls(df, url_rules.rule_table(spark, rules)).collect()
    assert len(got) == len(urls) + 1
    assert all((r.host, r.path, r.rule, r.verdict) == judge(urls[r.page_id]) for r in got)
    assert {r.verdict for r in url_rules.judge_urls(df, url_rules.rule_table(spark, rules).limit(0)).collect()} == {"allow"}


def test_url_rules_with_ties_capitals_and_hot_urls(spark, monkeypatch):
    from lodestone.llm import common

    rules = spark.createDataFrame([("allow", "A.example", "/x"), ("block", "a.example", "/x"), ("allow", "example", None), ("block", "b.com", "b"), ("block", None, "/"), (None, "c.com", "/")], "verdict string, host string, path string")
    df = spark.createDataFrame([(i, "http://w.a.example/xy") for i in range(40)] + [(50, "http://b.example/"), (51, "http://b.comb"), (52, None), (53, "http://c.com/")], "page_id long, url string").withColumns({"host": F.lit("clash"), "key": F.lit(1), "rule": F.lit(2)})
    for rows in (200_000, 0):  # 0: nothing is small enough to broadcast
        monkeypatch.setattr(common.join_salted, "__defaults__", ("inner", rows, 16))
        got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge_urls(df, rules).collect()}
        assert got == {i: ("a.example/x", "block") for i in range(40)} | {50: ("example", "allow"), 51: (None, "allow"), 52: (None, "allow"), 53: (None, "allow")}
    assert url_rules.judge_urls(df.limit(0), rules).count() == 0


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("h"), F.col("id").cast("string"), F.lit("/")).alias("key"))
    n = 3000 * 16 // 256
    blocks = url_rules.bloom_blocks(keys, n)
    assert url_rules.bloom_pass(keys, blocks, n).count() == 3000
    others = spark.range(3000).select(F.concat(F.lit("o"), F.col("id").cast("string"), F.lit("/")).alias("key"))
    assert url_rules.bloom_pass(others, blocks, n).count() < 60


# html
def marked(page):
    return [b["text"] for b in wrapper.page_blocks(page, None)[0] if b["main"]]


def test_article_text_and_comments():
    page = """<!DOCTYPE html><html><head><title>no</title><script>var a="</p>";</script></head><body><header>Site</header><nav><a>menu</a></nav>
    <div class="cookie-notice">accept</div><article><header><h1>Head &amp; line</h1></header><p>One<br>two <b>bold</b><p>Three &#233;<ul><li>a<li>b</ul><div class="comments"><p>reader</p></div><aside>x</aside></article><footer>f</footer></body>"""
    assert marked(page) == ["Head & line", "One two bold", "Three é", "a", "b"]
    assert marked(None) == [] and marked("<<<>>><p") is not None
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    assert marked(deep) == ["deep"]


def test_tree_matching_aligns_inserted_nodes():
    a, b = (dom.parse(f"<body><div><p>1</p><ul><li>x</li></ul>{more}<p>2</p></div></body>") for more in ("", "<table><tr><td>t</td></tr></table>"))
    pairs = []
    dom.match(a, b, pairs)
    assert [(x.text, y.text) for x, y in pairs if x.tag == "#text"] == [("1", "1"), ("x", "x"), ("2", "2")]


def simple_matching(a, b):
    """The plain recursion for the size of the largest match."""
    if a.tag != b.tag:
        return 0
    t = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids):
        for j, y in enumerate(b.kids):
            t[i + 1][j + 1] = max(t[i][j + 1], t[i + 1][j], t[i][j] + simple_matching(x, y))
    return 1 + t[-1][-1]


def test_tree_matching_equals_the_plain_recursion():
    r = random.Random(1)

    def tree(depth):
        if not depth or r.random() < 0.2:
            return r.choice(["x", "<p>y</p>", ""])
        tag = r.choice(["div", "section", "table"])
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(r.randint(0, 4))) + f"</{tag}>"

    for _ in range(150):
        a, b, pairs = dom.parse(tree(4)), dom.parse(tree(4)), []
        dom.match(a, b, pairs)
        assert len(pairs) == simple_matching(a, b) and all(x.tag == y.tag for x, y in pairs)


def test_wide_and_deep_pages_are_aligned_whole():
    n = 3000
    a, b, pairs = dom.parse("<div>" * n + "x" + "</div>" * n), dom.parse("<div>" * (n - 3) + "<p>y</p>x" + "</div>" * (n - 3)), []
    dom.match(a, b, pairs)
    assert len(pairs) == n - 2
    # over a million pairs of children, shifted by far more than fifty places
    a, b, pairs = dom.parse("".join(f"<div><p>{i}</p></div>" for i in range(1200))), dom.parse("<table></table>" * 1000 + "".join(f"<div><p>{i}</p></div><ul></ul>" for i in range(1200))), []
    dom.match(a, b, pairs)
    assert [(x.text, y.text) for x, y in pairs if x.tag == "#text"] == [(str(i), str(i)) for i in range(1200)]


SITE = "<body><div class='{m}'><ul><li>{a}</li><li>{b}</li></ul></div><div><div>{ad}</div><div class='{c}'><h1>{t}</h1><div>{p}</div></div><div><p>{ad} {b}</p></div></div><div>Copyright {a}</div></body>"


def test_alignment_alone_finds_the_region(spark):
    """Menus, adverts and footers differ from page to page and carry no mark; the region that holds most of what varies is the article."""
    r = random.Random(7)
    pages, want = [], {}
    for i in range(40):
        title, body = prose(r, 6), [prose(r, 30) for _ in range(r.randint(1, 6))]
        html = SITE.format(m=f"x{i}", a=word(r), b=word(r), ad=prose(r, 4), c=f"y{i}", t=title, p="".join(f"<p>{b}</p>" for b in body))
        pages.append((i, f"http://{'big' if i < 32 else 'small' if i < 36 else ''}.example/{i}", html))
        want[i] = "\n\n".join([title, *body])
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"host": F.lit("clash"), "layout": F.lit(1), "text": F.lit(2), "c": F.lit(3)})
    for marks in (True, False):
        got = {x.page_id: (x.text, x.decided_by) for x in wrapper.extract(df, marks).collect()}
        assert len(got) == 40 and all(got[i] == (want[i], "alignment") for i in range(32))
        assert {got[i][1] for i in range(32, 36)} == {"marks"}  # a host of four pages has no wrapper
    assert wrapper.extract(df.limit(0)).count() == 0


def test_alignment_decides_alike_without_marks(spark):
    """On the given pages the alignment alone gives the same article texts, where it decides."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    a, b = ({x.page_id: x for x in wrapper.extract(pages, m).collect()} for m in (True, False))
    decided = [i for i in a if a[i].decided_by == "alignment"]
    assert len(decided) > 60 and sum(a[i].text == b[i].text for i in decided) >= 0.9 * len(decided)
    article = lambda h: "\n\n".join(marked(h))
    htmls = {x.page_id: x.html for x in pages.select("page_id", "html").collect()}
    assert all(a[i].text == article(htmls[i]) for i in a)


def test_constant_nodes_are_template(spark):
    pages = [(i, f"http://h.example/{i}", f"<body><div><p>About this site</p><p>Story {i} text</p><p>Contact us</p></div></body>") for i in range(8)]
    pages += [(100, None, None), (101, "http://other.example/", "<body><p>only</p></body>"), (3, "http://h.example/3", pages[3][2])]
    got = sorted((r.page_id, r.text, r.n_chars) for r in wrapper.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect())
    assert got == sorted([(i, f"Story {i} text", len(f"Story {i} text")) for i in [*range(8), 3]] + [(100, "", 0), (101, "only", 4)])


# language
def test_language_held_out(spark):
    df = queries.op1_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert df.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_language_of_awkward_rows(spark, docs):
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, F.lit(True)).collect()}
    assert got[20] == got[21] == got[22] == ("und", 0.0) and got[1][0] == "en" and 0 <= got[1][1] <= 1
    assert {r.lang_pred for r in langid.identify(docs, F.lit(False)).collect()} == {"und"}
    assert langid.identify(empty(spark), F.lit(True)).count() == 0


def test_rare_labels_are_learned(spark):
    r = random.Random(2)
    rows = [(i, prose(r, 12), "en") for i in range(3000)] + [(5000 + i, " ".join(r.choice(["zug", "wolk", "qux", "vim"]) + r.choice(["zz", "kk"]) for _ in range(12)), "xx") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df, F.col("doc_id") % 3 != 0, sample=200).where("held_out and doc_id >= 5000").collect()
    assert len(got) == 10 and {x.lang_pred for x in got} == {"xx"}


# toxicity
def test_toxicity_learns_a_pair(spark):
    r = random.Random(1)
    rows = []
    for i in range(1200):
        w = [word(r) for _ in range(20)]
        a, b = r.random() < 0.5, r.random() < 0.5
        w += ["grumbo"] * a + ["zelnik"] * b
        r.shuffle(w)
        rows.append((i, " ".join(w), int(a and b)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.drop("toxic"), df.drop("text"), F.col("doc_id") < 800)
    got = toxicity.score(df.where("doc_id >= 800"), model).collect()
    assert np.mean([(x.score >= 0.5) == x.toxic for x in got]) > 0.95


def test_toxicity_of_awkward_rows(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(13, None)], "doc_id long, toxic int")
    got = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels, F.lit(True))).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    none = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels.limit(0), F.lit(True))).collect()
    assert {r.score for r in none} == {0.0}


def test_toxicity_with_clashing_columns_and_empty_tables(spark, docs):
    import corpus_pipeline as cp

    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    mine = docs.withColumn("predicted", F.lit("clash"))
    got = toxicity.score(mine, model)
    assert got.columns == mine.columns and dict(got.dtypes)["score"] == "double" and got.count() == docs.count()
    want = {(r.doc_id, r.text) for r in got.collect() if r.score < 0.7}
    left = toxicity.without_toxic(mine, model)
    assert left.columns == mine.columns and {(r.doc_id, r.text) for r in left.collect()} == want and {r.score for r in left.collect()} <= {"clash"}
    assert toxicity.score(empty(spark), model).count() == 0 and toxicity.fit(empty(spark), labels, F.lit(True)) == {"keys": None}
    assert cp.drop_toxic(spark, mine, D).columns == mine.columns


# token files
@pytest.mark.parametrize("n,alphabet", [(0, 10), (1, 10), (63, 2), (1000, 50257), (70_000, 50257)])
def test_range_coder_round_trip(n, alphabet):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, alphabet, n), np.minimum(rng.zipf(1.3, n), alphabet) - 1, np.zeros(n, int), np.arange(n) % alphabet):
        raw = range_coder.encode_block(np.asarray(ids, np.uint32), alphabet)
        assert (range_coder.decode_block(raw) == ids).all()


def test_repetition_compresses_and_damage_is_seen():
    ids = np.tile(np.random.default_rng(1).integers(0, 5000, 500), 200).astype(np.uint32)
    raw = range_coder.encode_block(ids, 5000)
    assert len(raw) < len(ids) * 2 / 4
    with pytest.raises(ValueError):
        range_coder.decode_block(raw[:3000] + bytes([raw[3000] ^ 255]) + raw[3001:])


def test_token_files_hold_the_ids(spark, docs, awkward):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    texts = [(i, t or "") for i, t, *_ in awkward] + [(90, "a  b"), (91, " \n x"), (92, "it's 1,000 <|endoftext|> ünïcode\u3000x"), (93, "a\u00a0b ,c"), (94, "a <|endoftext|> b"), (95, "we've 'style ( 's 12³ x\n\n\nyou'll \n z  ")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = token_files.read_digests(token_files.write_tokens(df, path("byte_bpe_50k.json"), block=500)).orderBy("start").collect()
    ids = {t: np.array(tok.encode(t, add_special_tokens=False).ids + [0], "<u4") for _, t in texts}
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == sorted((len(ids[t]), zlib.crc32(ids[t].tobytes())) for _, t in texts)
    assert [r.start for r in got] == list(itertools.accumulate([0] + [r.n_tokens for r in got]))[:-1]
    order = [r.doc_id for r in got if r.doc_id is not None]
    assert order == sorted(order)
    assert token_files.read_digests(token_files.write_tokens(df.limit(0), path("byte_bpe_50k.json"))).count() == 0


def test_ids_of_random_strings_equal_the_library():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    r = random.Random(3)
    parts = [*"ab'sstrevldm 1² \t\n\r..,-_!—“”éß中文ｱ٣Ⅷ😀\x0b\x1c\u200b\ufeff\U000e0101", "'s", "'re", "'ll", "'ve", "<|endoftext|>", "  ", "\n\n", " '", "'t ", "\u0378"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(6000)]
    tok, enc = Tokenizer.from_file(path("byte_bpe_50k.json")), token_files.Encoder(path("byte_bpe_50k.json"))
    for at in range(0, len(texts), 300):
        some = texts[at : at + 300]
        ids, n = enc(some)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [e.ids for e in tok.encode_batch(some, add_special_tokens=False)]


def test_too_large_an_alphabet_is_refused():
    with pytest.raises(ValueError):
        range_coder.encode_block(np.zeros(5, np.uint32), (1 << 19) + 1)


# similarity join
def brute_components(texts):
    sets = []
    for _, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    at = list(range(len(texts)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            at[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(texts):
        least[root(i)] = min(x for x in (least.get(root(i)), d) if x is not None) if d is not None or root(i) in least else None
    return sorted((str(d), len(sets[i]), str(least[root(i)])) for i, (d, _) in enumerate(texts))


def test_components_equal_brute_force(spark, docs, awkward):
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join.link_components(docs).collect())
    assert got == brute_components([(i, t) for i, t, *_ in awkward])
    assert jaccard_join.link_components(empty(spark)).count() == 0


def test_large_family_equals_brute_force(spark, monkeypatch):
    """Near copies around the threshold that share long lists, so the block products are needed."""
    r = random.Random(9)
    base = [word(r) + str(i) for i in range(90)]
    texts = []
    for i in range(90):
        w = list(base)
        for _ in range(r.choice([1, 2, 3, 4])):
            w[r.randrange(len(w))] = f"new{r.random()}"
        texts.append((i, " ".join(w)))
    texts += [(100 + i, " ".join(base[20:60]) + " " + prose(r, 60)) for i in range(30)]  # one common passage
    monkeypatch.setattr(jaccard_join, "ROUNDS", 1)
    monkeypatch.setattr(jaccard_join, "PART", 16)
    got = sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in jaccard_join.link_components(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).collect())
    assert got == brute_components(texts)


def test_keep_one_of_each_group(spark, docs):
    comps = jaccard_join.link_components(docs).where("doc_id is not null")
    want = {r.doc_id for r in comps.where("doc_id = component_id").collect()}
    kept = jaccard_join.keep_one(docs)
    assert {r.doc_id for r in kept.where("doc_id is not null").collect()} == want and kept.columns == docs.columns


def test_only_the_constant_text_of_a_slot_is_template(spark):
    def page(i, story):
        return (i, f"http://h.example/{i}", f"<body><div><p>About this site</p><p>{story}</p><p>More of {story}</p><p>Note {i}</p></div></body>")

    pages = [page(i, "the copied story") for i in range(18)] + [page(i, f"story {i}") for i in (18, 19)]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {i: got[i] for i in (18, 19)} == {i: f"story {i}\n\nMore of story {i}\n\nNote {i}" for i in (18, 19)}


def test_each_layout_of_a_host_has_its_template(spark):
    kinds = ["<div><p>First house</p><p>Story {0}</p><p>Call us</p></div>", "<section><table><tr><td>Second house</td></tr><tr><td>Tale {0}</td></tr></table></section>", "<ul><li>Third house</li><li>Item {0}</li></ul>"]
    pages = [(i, f"http://h.example/{i}", f"<body>{kinds[i % 3].format(i)}</body>") for i in range(24)] + [(99, "http://h.example/99", "<body><dl><dt>alone</dt></dl></body>")]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: f"{('Story', 'Tale', 'Item')[i % 3]} {i}" for i in range(24)} | {99: "alone"}


# decontamination
def edit_distance_within(item, text, k):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row) <= k


def test_leaks_equal_brute_force(spark):
    r = random.Random(4)
    items = [(i, prose(r, 14)) for i in range(6)] + [(6, None), (7, ""), (8, "short one!"), (9, "2+2=4?"), (10, "zq")]
    rows = [(100, None), (101, "")]
    for d in range(40):
        t = items[r.randrange(6)][1]
        c = list(t.upper() if d % 5 == 0 else t)
        for _ in range(r.randint(0, 2 * decontam.edits_of(len(t)))):
            k, o = r.randrange(len(c)), r.random()
            if o < 0.4:
                c[k] = "z"
            elif o < 0.7:
                del c[k]
            else:
                c.insert(k, "q")
        rows.append((d, prose(r, 25) + "\n " + ("".join(c) if d % 4 else "is 2+2=4? ZQ" if d % 8 else "") + " \n" + prose(r, 10)))
    got = {(x.doc_id, x.item_id) for x in decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set()
    for d, t in rows:
        for i, x in items:
            x = decontam.normalise(x)
            if x and edit_distance_within(x, decontam.normalise(t), decontam.edits_of(len(x))):
                want.add((d, i))
    assert got == want


def test_leaks_at_the_edges_of_documents_equal_brute_force(spark):
    r = random.Random(8)
    items = [(i, prose(r, 14)) for i in range(4)] + [(4, "fourteen chars")]
    rows = []
    for i, t in items:
        k = decontam.edits_of(len(t))
        for n in {1, k // 2, k, k + 1}:
            for c in (t[n:], t[:-n or None], t[:1] + t[1 + n :], t[n // 2 : len(t) - (n - n // 2)], t[: len(t) // 2] + t[len(t) // 2 + n :]):
                for whole in (c, c + " " + prose(r, 20), prose(r, 20) + " " + c):
                    rows.append((len(rows), whole))
    found = decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    texts = {d: decontam.normalise(t) for d, t in rows}
    assert {(x.doc_id, x.item_id) for x in found} == {(d, i) for d, t in texts.items() for i, x in items if edit_distance_within(x, t, decontam.edits_of(len(x)))}
    assert all(0 <= x.start < x.end <= len(texts[x.doc_id]) for x in found)


def test_repeated_grams_and_very_long_texts(monkeypatch):
    texts = ["ab" * 400 + "c" * 300, "", "x", "c" * 99 + "d" + "ab" * 60, "ab" * 45 + "ba" + "ab" * 40]
    things = [(1, "c" * 120), (2, "ab" * 70), (3, "c" * 100), (4, "aabb")]
    want = {(t, i) for t, x in enumerate(texts) for i, y in things if edit_distance_within(y, x, decontam.edits_of(len(y)))}
    for hits in (1 << 22, 500):
        monkeypatch.setattr(decontam, "HITS", hits)
        got = set()
        for q in {decontam.gram_length(len(y)) for _, y in things}:
            some = [(i, y) for i, y in things if decontam.gram_length(len(y)) == q]
            got |= {(t, some[k][0]) for t, k, *_ in decontam.Items([i for i, _ in some], [y for _, y in some], q).search(texts)}
        assert got == want
    far = "y" * 17_200_000 + "needle is h"
    assert [x[:3] for x in decontam.Items([7], ["needle is h"], 10).search(["zz", far, "a needle is here"])] == [(1, 0, 0), (2, 0, 0)]


def test_decontaminate_keeps_the_rest(spark, docs):
    bench = spark.createDataFrame([(1, prose(random.Random(5), 60)[:120])], "item_id long, text string")
    assert decontam.decontaminate(docs, bench.limit(0)).count() == docs.count()
    left = decontam.decontaminate(docs, bench)
    assert left.columns == docs.columns and left.count() < docs.count()


# mixing
def test_targets_stop_at_twice_the_source(spark):
    rows = [(i, "w " * 10, s) for i, s in enumerate("a" * 5 + "b" * 50 + "c" * 100)] + [(500, None, None)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), keep=("doc_id", "source")).collect()
    target = {r.source: r.target for r in got}
    total = 1550 * 1.5
    assert target["a"] == 100 and abs(sum(target.values()) - total) < 1e-6 and target[None] == 0
    for s in "abc":
        taken = sum(r.taken for r in got if r.source == s)
        assert abs(taken - target[s]) <= 20 and all(r.taken <= 2 * r.size for r in got)


def test_mix_repeats_and_is_stable(spark, docs):
    a, b = (sorted(map(str, mixing.mix_sources(docs).collect())) for _ in range(2))
    assert a == b and len(a) == docs.count()
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    # null ids are dealt by their texts
    nulls = spark.createDataFrame([(None, f"w{i} " * 3, "a") for i in range(40)], "doc_id long, text string, source string")
    assert len({r.finish for r in mixing.mix_sources(nulls, share=0.5).collect()}) == 40
    assert mixing.mix_sources(empty(spark)).count() == 0


# pipeline
def test_pipeline_stages_chain(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{D}/documents.parquet")
    n = []
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, D)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        n.append(docs.count())
    ids = {r.doc_id for r in docs.collect()}
    tokens = cp.STAGES[-1][1](spark, docs, D).collect()
    assert {r.doc_id for r in tokens} == ids and len(tokens) == docs.count()
    assert n[0] >= n[1] >= n[2]


def plain_scores(model, texts):
    """The factorization machine's score by a loop over all pairs of a text's terms."""
    at = {int(k): i for i, k in enumerate(model["keys"])}
    for t in texts:
        found = sorted({at[int(h)] for _, _, hs, _ in toxicity.terms([t]) for h in hs if int(h) in at})
        x = model["b"] + sum(model["w"][i] for i in found) + sum(float(model["v"][i] @ model["v"][j]) for i, j in itertools.combinations(found, 2))
        yield 1 / (1 + np.exp(-x))


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline as cp
    import duckdb
    from public_tokenizers import path
    from tokenizers import Tokenizer

    r = random.Random(21)
    items = [(i, prose(r, 12)) for i in range(4)]
    rows = []
    for i in range(260):
        w = [word(r) for _ in range(30)]
        if i % 4 == 0:
            w[i % 30] = "grumbo"
        if i % 17 == 3:
            w[5:5] = items[i % 4][1].split(" ")
        rows.append((i, " ".join(w), "abc"[i % 3] if i % 5 else None))
    rows += [(300 + k, " ".join(rows[1 + k % 3][1].split(" ")[: 30 - k % 2]), "a") for k in range(9)]
    rows += [(400, None, "a"), (401, "", None), (402, "one", "b"), (2, rows[2][1], rows[2][2])]
    rows = [(i, t, "en", c, None if t is None else len(t), f"x{i}", 7) for i, t, c in rows]
    spark.createDataFrame(rows, DOCS + ", score string, size int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = cp.run(spark, str(tmp_path)).collect()
    # toxicity
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    left = [x for x, p in zip(rows, plain_scores(model, [x[1] for x in rows]), strict=True) if p < 0.7]
    assert not any("grumbo" in (x[1] or "") for x in left) and len(left) > 190
    # near copies: one of each group, and one of equal rows
    comp = {}
    for d, _, c in brute_components([(x[0], x[1]) for x in left]):
        comp.setdefault(d, c)
    left = [x for k, x in enumerate(left) if comp[str(x[0])] == str(x[0]) and (x[0], x[1]) not in {(y[0], y[1]) for y in left[:k]}]
    assert sum(300 <= x[0] < 309 for x in left) < 3
    # leaks
    hit = lambda t: any(edit_distance_within(decontam.normalise(y), decontam.normalise(t), decontam.edits_of(len(decontam.normalise(y)))) for _, y in items)
    left = [x for x in left if not hit(x[1])]
    # the mix, by the operator's SQL
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(x[0], x[1], x[3]) for x in left])
    taken = con.execute(f"SELECT doc_id, size, taken FROM ({queries.SQL['op10_mix_sources']})").fetchall()
    texts = {x[0]: x[1] or "" for x in left}
    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    ids = lambda t: np.array(tok.encode(t, add_special_tokens=False).ids + [0], "<u4")
    want = sorted((d, len(ids(texts[d])), zlib.crc32(ids(texts[d]).tobytes())) for d, size, n in taken if size for _ in range(n // size))
    found = sorted((x.doc_id, x.n_tokens, x.ids_crc32) for x in got)
    # documents without words weigh nothing: the mix may take them any number of times
    assert [x for x in found if texts[x[0]].split()] == want
    assert sorted(x.start for x in got) == list(itertools.accumulate([0] + [n for _, n, _ in found]))[:-1]


def test_decontaminate_removes_rows_not_ids(spark):
    item = "a benchmark passage of some length that nobody would write by chance"
    rows = [(-1, f"x {item} y"), (None, "clean"), (5, f"{item} z"), (5, "clean too"), (5, "clean too"), (None, item), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_hit", F.lit("clash")).repartition(2)
    bench = spark.createDataFrame([(1, item), (1, item), (None, item), (2, None), (3, "qq")], "item_id long, text string")
    left = decontam.decontaminate(docs, bench)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted([(None, "clean"), (5, "clean too"), (5, "clean too"), (7, None), (8, "")], key=repr)
    # repeated ids are reported for each row and item
    assert sorted(((r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()), key=repr) == sorted([(d, i) for d in (-1, 5, None) for i in (1, 1, None)], key=repr)
    assert decontam.leaks(docs.limit(0), bench).count() == 0 and decontam.decontaminate(docs.limit(0), bench).count() == 0


def test_pipeline_of_empty_documents(spark, tmp_path):
    import corpus_pipeline as cp

    for name, ddl in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op5_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("toxic is not null")
    r = got.agg(F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("caught"), F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("wrong")).first()
    assert r.caught > 0.8 and r.wrong < 0.02


def test_long_texts_of_many_lines_are_deduplicated_in_linear_time(spark):
    import time

    lines = [f"line {i} of a text with {i * 7919 % 1000} words" for i in range(50_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["own first", *lines[:30_000], "own last"])), (3, "\n".join(["x", "y"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for dedup in (line_chunks.line_dedup, line_windows.passage_dedup):
        t = time.perf_counter()
        got = {r.doc_id: r for r in dedup(docs).collect()}
        assert time.perf_counter() - t < 200
        assert got[1].n_removed == got[3].n_removed == 0 and got[1].text == rows[0][1] and got[1].n_lines == 50_000
        assert 27_500 < got[2].n_removed <= 30_000 and got[2].text.startswith("own first") and got[2].text.endswith("own last")


def test_passages_of_texts_with_clashing_columns(spark):
    rows = [(1, "a b\nc d\ne f"), (2, "x\na b\nc d"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("rid", "window", "h", "gone", "pos", "line", "count", "_l")})
    got = {r.doc_id: (r.text, r.n_removed) for r in line_windows.passage_dedup(docs).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("x", 2), None: (None, 0)}


def test_hosts_of_long_pages_only_have_a_reference(spark):
    r = random.Random(8)
    filler = "".join(f"<li><a href='/{k}'>menu entry number {k} of this site</a></li>" for k in range(3000))
    page = lambda host, k, menu: (k, f"http://{host}/{k}", f"<html><body><div><ul>{menu}</ul></div><div><p>{prose(r, 60)}</p><p>{prose(r, 40)}</p></div></body></html>")
    rows = [page("long.example", k, filler) for k in range(7)] + [page("short.example", 100 + k, "<li>home</li><li>news</li>") for k in range(7)]
    assert all(len(x[2]) > wrapper.REFERENCE for x in rows[:7])
    got = {x.page_id: x for x in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), marks=False).collect()}
    for k, _, html in rows:
        assert got[k].decided_by == "alignment"
        assert got[k].text == "\n\n".join(re.findall("<p>(.*?)</p>", html))
