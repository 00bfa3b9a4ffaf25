"""Phrases, web archives and periodic runs against brute force and round trips, with awkward rows."""
import base64
import gzip
import hashlib
import random
import re
import uuid
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import phrases, warc, word_runs
from lodestone.llm.common import shared_dir


# phrases
def brute_phrases(rows, most, least, top, cover):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(table)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    count[lang, tuple(w[i : i + k])] += 1
    cand = {p: a for p, a in count.items() if len(p[1]) > 1 and a >= least}
    inside = set()
    for (lang, w), a in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if 100 * a >= cover * cand[lang, w[i : i + k]]:
                    inside.add((lang, w[i : i + k]))
    out = {}
    for (lang, w), a in cand.items():
        if (lang, w) not in inside:
            score, _, l, r = min((2000000 * a // (count[lang, w[:k]] + count[lang, w[k:]]), k, count[lang, w[:k]], count[lang, w[k:]]) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for k, (s, a, p, l, r) in enumerate(sorted(found)[:top]))


def sentences(r, n):
    words = [f"{x}{'é' if i % 3 else ''}" for i, x in enumerate("ab cd ef gh ij kl mn op qr st uv wx".split())]
    fixed = ["the Quick brown FOX", "in spite of", "ab cd ef gh"]
    out = []
    for _ in range(n):
        out.append(r.choice(fixed) if r.random() < 0.3 else " ".join(r.choice(words) for _ in range(r.randint(1, 6))))
        out.append(r.choice([" ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", " \x1c ", " "]))
    return "".join(out)


@pytest.mark.parametrize(("least", "top", "block"), [(3, 2000, 1 << 23), (5, 7, 200)])
def test_phrases_equal_brute_force(spark, monkeypatch, least, top, block):
    monkeypatch.setattr(phrases, "BLOCK", block)
    r = random.Random(3)
    rows = [(sentences(r, 40), r.choice(["en", "de", None])) for _ in range(40)]
    rows += [(None, "en"), ("", "fr"), (" .. , \n", "fr"), ("one", "fr"), *[rows[0]] * 4, (sentences(r, 3000), "en"), ("und und und " * 9, "und")]
    docs = spark.createDataFrame([(*x, 1, "clash", 2) for x in rows], "text string, lang string, n int, prefix string, size int").repartition(3)
    got = sorted(tuple(x) for x in phrases.collocations(docs, least=least, top=top).collect())
    assert got == brute_phrases(rows, 4, least, top, 80)
    assert len(got) > 20


def test_phrases_of_no_rows(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).count() == 0


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    r = random.Random(4)
    rows = [(sentences(r, 40), "en") for _ in range(20)]
    monkeypatch.setattr(phrases, "pair_filter", lambda pairs: np.full(phrases.SLOTS, 2**64 - 1, np.uint64))
    got = sorted(tuple(x) for x in phrases.collocations(spark.createDataFrame(rows, "text string, lang string"), least=4).collect())
    assert got == brute_phrases(rows, 4, 4, 2000, 80)


# web archives
PAGES = [
    (1, "http://a.example/x?y=1", "<p>one</p>"), (2, "http://b.example/with space\nand line", "<p>one</p>"), (3, None, None), (4, "", ""), (5, "http://é.example/", "né\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nx\r\n\r\n"),
    (None, "http://n.example/", "<p>one</p>"), (7, "http://l.example/", "long " * 40_000), (8, "http://a.example/", "<p>two</p>"), (8, "http://a.example/", "<p>two</p>"), (8, "http://a.example/", "<p>two</p>"), (None, None, "nobody"), (None, None, "nobody"),
]


def wanted(rows, least):
    groups = {}
    for page, _, html in rows:
        groups.setdefault(html or "", []).append(page)
    out = []
    for html, pages in groups.items():
        data = html.encode()
        pages = sorted(pages, key=lambda p: (p is None, -(p or 0)))
        for k, p in enumerate(pages):
            again = k > 0 and len(data) >= least
            out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", pages[0] if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 1, 10])
def test_pages_through_archives(spark, monkeypatch, least):
    pages = spark.createDataFrame([(*x, "clash", b"c") for x in PAGES], "page_id long, url string, html string, path string, content binary").repartition(3)
    got = warc.through_warc(pages, least).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == wanted(PAGES, least)
    ids = {r.record_id: r for r in got}
    assert len(ids) == len(PAGES)
    assert all(ids[r.refers_to_record].record_type == "response" and ids[r.refers_to_record].page_id == r.refers_to for r in got if r.record_type == "revisit")
    urls = {r.page_id: r.url for r in got}
    assert urls[2] == "http://b.example/with%20space%0Aand%20line" and urls[3] is None and urls[4] is None


def test_many_archives_of_both_versions(spark):
    r = random.Random(1)
    rows = [(i, f"http://h.example/{i}", "%x" % r.getrandbits(8000)) for i in range(60)]
    at = f"{shared_dir(spark)}/web-{uuid.uuid4().hex}"
    warc.write_arc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), f"{at}/arc", most=9000)
    files = warc.archives(spark, f"{at}/arc").collect()
    assert len(files) > 8
    heads = [next(iter(warc.read_arc(bytes(f.content), f.path)))[0]["version"] for f in files]
    assert set(heads) == {"1", "2"}
    for f in files:  # one member a record, no byte outside of them
        assert gzip.decompress(bytes(f.content)).count(b"HTTP/1.1 200 OK") == len(list(warc.read_arc(bytes(f.content), f.path))) - 1
    warc.convert(spark, f"{at}/arc", f"{at}/warc")
    assert sorted((x.page_id, x.payload_bytes) for x in warc.read_warc(spark, f"{at}/warc").collect()) == [(i, len(h)) for i, _, h in rows]


def test_no_pages(spark):
    assert warc.through_warc(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def plain_arc(version, records, date="19961015000000"):
    return warc.arc_head(version, "old.arc", date) + b"".join(b"\n" + warc.arc_line(version, url, "192.0.2.7", d, kind, len(c), "200", 0, "old.arc") + c for url, d, kind, c in records)


@pytest.mark.parametrize("version", [1, 2])
def test_plain_archives_of_each_version(version):
    content = warc.http(9, b"\nbody\n\n")
    raw = plain_arc(version, [(b"http://a/b c", "19961015", "text/html", content), (b"dns:a", "199610151530", "text/dns", b"a 1 IN A 192.0.2.7\n")])
    got = list(warc.read_records(warc.to_warc(raw, "old.arc", {}), "old.warc"))
    assert [f["warc-type"] for f, _ in got] == ["warcinfo", "response", "resource"]
    assert got[1][0]["warc-target-uri"] == "http://a/b%20c" and got[1][0]["warc-date"] == "1996-10-15T00:00:00Z" and got[1][0]["warc-ip-address"] == "192.0.2.7" and got[1][1] == content
    assert got[2][0]["warc-date"] == "1996-10-15T15:30:00Z" and got[2][0]["content-type"] == "text/dns"
    assert warc.row_of(*got[1], "x")["payload_bytes"] == 7


def test_broken_archives_are_named():
    raw = plain_arc(1, [(b"http://a/", "19961015", "text/html", warc.http(1, b"body"))])
    for bad in (raw[:-2], raw.replace(b"text/html", b"text html html html html"[:9] + b"\n"), b"no archive at all\n", raw.replace(b"1 0 lodestone", b"7 0 lodestone")):
        with pytest.raises(ValueError, match="old.arc"):
            warc.to_warc(bad, "old.arc", {})
    good = warc.warc_record({"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:1>", "WARC-Target-URI": "http://a/", "WARC-Date": "x", "WARC-Payload-Digest": f"sha1:{warc.digest(b'body')}"}, warc.http(1, b"body"))
    assert [warc.row_of(f, b, "w")["page_id"] for f, b in warc.read_records(good, "w")] == [1]
    with pytest.raises(ValueError, match="digest"):
        [warc.row_of(f, b, "w") for f, b in warc.read_records(good.replace(b"\r\n\r\nbody", b"\r\n\r\nbodz"), "w")]
    with pytest.raises(ValueError, match="ends"):
        list(warc.read_records(good[:-3], "w"))


def test_long_records_end_in_a_zero_byte():
    data = random.Random(2).randbytes(1 << 20) * 40
    raw = warc.members(data)
    assert raw[-1] == 0 and gzip.decompress(raw) == data


# periodic runs
def brute_runs(w, least, times):
    out = set()
    for q in range(1, len(w) // times + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(least, times * q) and not any(all(w[k] == w[k + r] for k in range(i, i + n - r)) for r in range(1, q)):
                out.add((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("least", "times"), [(24, 3), (6, 3), (4, 4), (1, 3)])
def test_runs_equal_brute_force(least, times):
    r = random.Random(least)
    for _ in range(1500):
        n, letters = r.randint(0, 60), r.randint(1, 4)
        w = [r.randrange(letters) for _ in range(n)]
        for _ in range(r.randint(0, 2) if n else 0):
            a, p = r.randrange(n), r.randint(1, 8)
            for i in range(a, min(n, a + r.randint(3, 40))):
                w[i] = w[a + (i - a) % p]
        assert word_runs.runs_of(np.array(w, np.int64), least, times) == brute_runs(w, least, times)


def test_groups_are_lyndon_words():
    r = random.Random(9)
    lyndon = lambda x: all(x < x[k:] for k in range(1, len(x)))
    for _ in range(400):
        w = [r.randrange(3) for _ in range(r.randint(1, 25))]
        group, length = word_runs.lyndon_groups(w, 3)
        want = [max(k for k in range(1, len(w) - i + 1) if lyndon(w[i : i + k])) for i in range(len(w))]
        assert [length[g] for g in group] == want
        assert all((group[i] == group[j]) == (w[i : i + want[i]] == w[j : j + want[j]]) for i in range(len(w)) for j in range(i))


def test_runs_of_long_texts_of_few_words():
    text = "a " * 60_000 + "b a " * 30_000 + "c"
    found, kept = word_runs.collapse(text)
    assert found == [(0, 60_000, 1), (59_999, 60_002, 2)] or [f[2] for f in found] == [1, 2]
    assert len(kept.split()) < 10


def test_run_digests_equal_brute_force(spark):
    r = random.Random(6)
    texts = [(i, " ".join(f"w{r.randrange(30 if i % 2 else 4)}" for _ in range(r.randint(0, 300)))) for i in range(60)]
    texts += [(100, None), (110, ""), (120, " \n\t"), (130, "x y " * 30), (None, "z " * 50), (5, texts[5][1]), (200, "ab cd\n" * 40 + "ab"), (201, "no run at all")]
    docs = spark.createDataFrame([(*x, "clash", 1) for x in texts], "doc_id long, text string, runs string, start int").repartition(3)
    want = []
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n, h = len(w), None if i is None else zlib.crc32(str(i).encode())
        if h is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (k - a) % p] if k >= a else w[k] for k in range(n)]
        runs = brute_runs(w, 24, 3)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2])) if runs else None
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    got = word_runs.digests(word_runs.word_runs(word_runs.with_repeats(docs)))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(x[1] > 0 for x in want) > 5


def test_runs_of_no_rows(spark):
    assert word_runs.digests(word_runs.word_runs(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
