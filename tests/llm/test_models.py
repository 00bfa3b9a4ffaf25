"""The learned models against plain Python: n-grams, TF-IDF, FTRL steps, temperature, softmax, pairwise interactions."""
import math
import random
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import langid, toxicity

M = 1 << 32


def plain_ngrams(text):
    """Runs of letters in single spaces, n-grams of 1 to 3 of these characters as 16-bit numbers."""
    low = text.lower()
    if not any(c.isalpha() for c in low):
        return []
    s = [ord(c) for c in " " + " ".join("".join(c if c.isalpha() else " " for c in low).split()) + " "]
    if not low[0].isalpha():  # what stands before the first letter is a space of its own
        s = [32, *s]
    if not low[-1].isalpha():
        s = [*s, 32]
    out = []
    for n in (1, 2, 3):
        for i in range(len(s) - n + 1):
            h = 0
            for c in s[i : i + n]:
                h = (h * 0x9E3779B1 + c) * 0x85EBCA6B % M
            out.append((h ^ (n * 0x27D4EB2F % M)) >> 16)
    return out


TEXTS = ["the cat sat", "Der Hund, der lief!", "  le chat dort 12", "x", "ÉTÉ à Paris", "9 lives 9", "and the dog ran", "und die Katze", "et le chien", "the end", "das Ende", "la fin", "a\n\nb", "über"]
LABELS = ["en", "de", "fr", "en", "fr", "en", "en", "de", "fr", "en", "de", "fr", "en", "de"]


def test_ngrams():
    for t in [*TEXTS, "", " ", "123", "日本 語", "a" * 500]:
        assert Counter(langid.ngrams(t).tolist()) == Counter(plain_ngrams(t))


def test_document_frequencies(spark):
    rows = [*TEXTS, None, "", "12", TEXTS[0]]
    got = langid.idf_table(spark.createDataFrame([(t,) for t in rows], "text string").repartition(3))
    some = [set(g) for t in rows if (g := plain_ngrams(t or ""))]
    df = Counter(h for g in some for h in g)
    want = np.array([math.log((1 + len(some)) / (1 + df[h])) + 1 for h in range(langid.DIMS)])
    assert np.allclose(got, want)


def plain_fit(texts, labels, held, idf):
    """FTRL-proximal, one coordinate at a time."""
    classes = sorted(set(labels))
    x = [{h: langid.SCALE * c / len(g) * idf[h] for h, c in Counter(g).items()} | {"bias": 1.0} for g in map(plain_ngrams, texts)]
    z, n, w = {}, {}, {}
    key = lambda h, c: w.get((h, c), 0.0)
    train = np.array([r for r in range(len(texts)) if not held[r]])
    rng = np.random.default_rng(1)

    def scores(r):
        return [sum(v * key(h, c) for h, v in x[r].items()) for c in range(len(classes))]

    for _ in range(langid.EPOCHS):
        rng.shuffle(train)
        for at in range(0, len(train), langid.BATCH):
            which = train[at : at + langid.BATCH]
            g = Counter()
            for r in which:
                s = scores(r)
                e = [math.exp(v - max(s)) for v in s]
                for c in range(len(classes)):
                    err = (e[c] / sum(e) - (classes[c] == labels[r])) / len(which)
                    for h, v in x[r].items():
                        g[h, c] += v * err
            for k, d in g.items():
                sigma = (math.sqrt(n.get(k, 0) + d * d) - math.sqrt(n.get(k, 0))) / langid.ALPHA
                z[k] = z.get(k, 0) + d - sigma * w.get(k, 0)
                n[k] = n.get(k, 0) + d * d
                w[k] = 0.0 if abs(z[k]) <= langid.L1 else -(z[k] - math.copysign(langid.L1, z[k])) / ((langid.BETA + math.sqrt(n[k])) / langid.ALPHA + langid.L2)
    return classes, w, [scores(r) for r in range(len(texts)) if held[r]]


def test_fit_and_prediction_of_languages():
    r = random.Random(3)
    idf = np.array([1 + r.random() for _ in range(langid.DIMS)])
    held = [k % 5 == 0 for k in range(len(TEXTS))]
    model = langid.fit_ftrl(TEXTS, LABELS, np.array(held), idf)
    classes, w, s = plain_fit(TEXTS, LABELS, held, idf)
    assert model["classes"] == classes
    want = np.zeros((langid.DIMS, len(classes)))
    for (h, c), v in w.items():
        if h != "bias":
            want[h, c] = v * langid.SCALE * idf[h]
    assert np.allclose(model["w"], want, rtol=1e-4, atol=1e-5) and (want == 0).mean() > 0.9
    assert np.allclose(model["b"], [w.get(("bias", c), 0.0) for c in range(len(classes))])
    # no temperature of a fine grid has a smaller loss on the rows that stayed out
    y = [classes.index(LABELS[k]) for k in range(len(TEXTS)) if held[k]]
    loss = lambda t: -sum(v[c] / t - math.log(sum(math.exp(u / t) for u in v)) for v, c in zip(s, y, strict=True))
    assert loss(model["t"]) <= min(loss(0.06 * 1.05**k) for k in range(110)) + 1e-3
    for t in [*TEXTS, "neither", "   ", None, ""]:
        g = plain_ngrams(t or "")
        lang, score = langid.predict(model, t)
        if not g:
            assert (lang, score) == ("und", 0.0)
            continue
        v = [(sum(model["w"][h, c] for h in g) / len(g) + model["b"][c]) / model["t"] for c in range(len(classes))]
        e = [math.exp(u - max(v)) for u in v]
        assert lang == classes[e.index(max(e))] and score == pytest.approx(max(e) / sum(e), rel=1e-4)


def test_factorization_machine_scores_pairs():
    r = random.Random(5)
    words = ["idiot", "fool", "group", "tree", "house", "walks", "talks"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 6))) for _ in range(300)]
    y = np.array([float("idiot" in t and "group" in t) for t in texts])
    model = toxicity.fit_fm(texts, y, (1.0, 1.0))
    place = {int(k): i for i, k in enumerate(model["keys"])}
    for t in [*texts[:40], "", None, "nothing known"]:
        live = sorted({place[int(h)] for _, _, hs, _ in toxicity.terms([t]) for h in hs if int(h) in place})
        raw = model["b"] + sum(model["w"][i] for i in live)
        raw += sum(float(model["v"][a] @ model["v"][b]) for k, a in enumerate(live) for b in live[k + 1 :])
        assert toxicity.predict(model, [t])[0] == pytest.approx(1 / (1 + math.exp(-raw)), rel=1e-9)
    # neither word alone is enough
    both, one, other = toxicity.predict(model, ["idiot group", "idiot tree", "group tree"])
    assert both > 0.7 and one < 0.5 and other < 0.5
