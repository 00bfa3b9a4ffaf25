"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: n-grams of 1 to 3 characters of the lower-cased text, other characters than letters as one space, hashed to
65,536 columns; term frequency is the share of a text's n-grams. Document frequencies are counted over all training
rows. Follow-the-regularised-leader with elastic-net penalties is fitted on a hashed sample of at most about SAMPLE
training rows, and of rare labels up to about LEAST rows each (documented bounds), one in five of which is kept for the
temperature of the softmax; the biases are corrected for the share of each label's rows in the sample.

Null and empty texts and texts without a letter get 'und' with score 0. Ties go to the first class in code-point order.
Rows without a label are not learned from; without any training row every text is 'und'. Repeated rows are scored alike.
Empty tables give empty results. Only doc_id, text and the label are read, whatever other columns are called.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS, ORDERS, SAMPLE, LEAST, SCALE = 1 << 16, 3, 4096, 200, 30.0
ALPHA, BETA, L1, L2, EPOCHS, BATCH = 0.5, 0.1, 0.02, 0.02, 3, 16
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTERS[0]


def ngrams(text: str) -> np.ndarray:
    """Hashed n-grams of the text; empty if it has no letter."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[cp]
    if not letter.any():
        return np.zeros(0, np.uint16)
    # a run of other characters is one space
    c = np.where(letter, cp, 32).astype(np.uint32)
    c = np.concatenate([[32], c[letter | np.concatenate([[True], letter[:-1]])], [32]]).astype(np.uint32)
    out, h = [], np.zeros(len(c), np.uint32)
    for n in range(1, ORDERS + 1):
        m = len(c) - n + 1
        h = (h[:m] * np.uint32(0x9E3779B1) + c[n - 1 : n - 1 + m]) * np.uint32(0x85EBCA6B)
        out.append(((h ^ np.uint32(n * 0x27D4EB2F)) >> np.uint32(16)).astype(np.uint16))
    return np.concatenate(out)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(DIMS, np.int64), 0
    for b in batches:
        for t in b.column(0):
            if len(g := ngrams(t.as_py() or "")):
                seen = np.zeros(DIMS, bool)
                seen[g] = True
                df += seen
                n += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(df[at], n))], names=["h", "n"])


def idf_table(train: DataFrame) -> np.ndarray:
    """train: text. Inverse document frequency of each column, over all rows."""
    counts = train.select("text").mapInArrow(_frequencies, "h int, n long").groupBy("h").agg(F.sum("n").alias("n")).collect()  # DIMS + 1 rows at most
    df, n = np.zeros(DIMS), 0
    for h, c in counts:
        if h < 0:
            n = c
        else:
            df[h] = c
    return np.log((1 + n) / (1 + df)) + 1


def fit_ftrl(texts: list[str], labels: list[str], calibrate: np.ndarray, idf: np.ndarray) -> dict:
    """The model: classes, weights (DIMS x classes, idf and scale multiplied in), bias, temperature."""
    rows = [(g, y, bool(c)) for t, y, c in zip(texts, labels, calibrate, strict=True) if len(g := ngrams(t))]
    classes = sorted({y for _, y, _ in rows})
    k = len(classes)
    x = [(*(u := np.unique(g, return_counts=True)), len(g)) for g, _, _ in rows]
    x = [(i.astype(np.int64), SCALE * c / n * idf[i]) for i, c, n in x]
    y = np.array([classes.index(c) for _, c, _ in rows], int)
    held = np.array([c for _, _, c in rows], bool)
    if held.all() or not held.any():
        held = np.zeros(len(rows), bool)
    z, n2 = np.zeros((DIMS + 1, k)), np.zeros((DIMS + 1, k))
    weights = lambda: np.where(np.abs(z) <= L1, 0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n2)) / ALPHA + L2))
    w = weights()
    train = np.flatnonzero(~held)
    rng = np.random.default_rng(1)

    def logits(which: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.array([v @ w[i] + w[DIMS] for i, v in (x[r] for r in which)]).reshape(len(which), k)

    for _ in range(EPOCHS):
        rng.shuffle(train)
        for at in range(0, len(train), BATCH):
            which = train[at : at + BATCH]
            s = logits(which, w)
            p = np.exp(s - s.max(1, keepdims=True))
            e = p / p.sum(1, keepdims=True)
            e[np.arange(len(which)), y[which]] -= 1
            e /= len(which)
            i = np.concatenate([x[r][0] for r in which] + [[DIMS]])
            v = np.concatenate([x[r][1][:, None] * e[j] for j, r in enumerate(which)] + [e.sum(0, keepdims=True)])
            at_i, inv = np.unique(i, return_inverse=True)
            g = np.stack([np.bincount(inv, v[:, c], len(at_i)) for c in range(k)], 1)
            sigma = (np.sqrt(n2[at_i] + g * g) - np.sqrt(n2[at_i])) / ALPHA
            z[at_i] += g - sigma * w[at_i]
            n2[at_i] += g * g
            zi = z[at_i]
            w[at_i] = np.where(np.abs(zi) <= L1, 0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n2[at_i])) / ALPHA + L2))
    # temperature: golden-section search of the held rows' log loss
    temperature, which = 1.0, np.flatnonzero(held)
    if len(which) and k > 1:
        s = logits(which, w)

        def loss(u: float) -> float:
            q = s / math.exp(u)
            q = q - q.max(1, keepdims=True)
            return float(-(q[np.arange(len(which)), y[which]] - np.log(np.exp(q).sum(1))).mean())

        lo, hi, r = math.log(0.05), math.log(20), (math.sqrt(5) - 1) / 2
        for _ in range(40):
            a, b = hi - r * (hi - lo), lo + r * (hi - lo)
            lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
        temperature = math.exp((lo + hi) / 2)
    return {"classes": classes, "w": (w[:DIMS] * (SCALE * idf)[:, None]).astype(np.float32), "b": w[DIMS], "t": temperature}


def predict(model: dict, text: str | None) -> tuple[str, float]:
    if not model["classes"] or not text or not len(g := ngrams(text)):
        return "und", 0.0
    s = (np.take(model["w"], g, 0).sum(0, dtype=np.float64) / len(g) + model["b"]) / model["t"]
    p = np.exp(s - s.max())
    k = int(p.argmax())
    return model["classes"][k], float(p[k] / p.sum())


def identify(docs: DataFrame, learn: Column, label: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """docs: doc_id, text, label; learn: whether a row's label may be learned. Adds nothing: doc_id, held_out, lang_pred, score."""
    spark = docs.sparkSession
    train = docs.where(learn & F.col(label).isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col(label).alias("label"))
    idf = idf_table(train)
    n = {r.label: r.n for r in docs.where(learn & F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")).collect()}  # a row for each language
    share = {c: min(1.0, max(sample / max(1, sum(n.values())), LEAST / m)) for c, m in n.items()}
    key = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << 30))
    some = train.withColumn("k", key)
    if share:
        most = F.element_at(F.create_map(*[F.lit(x) for c, r in share.items() for x in (c, int(r * (1 << 30)) + 1)]), F.col("label"))
        some = some.where(F.col("k") < most)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k", "doc_id", "text", "label"], kind="stable")
        m = fit_ftrl(list(pdf.text), list(pdf.label), (pdf.k.to_numpy() % 5) == 0, idf)
        top = max(share.values())
        b = [float(x) + m["t"] * math.log(top / share[c]) for c, x in zip(m["classes"], m["b"], strict=True)]
        return pd.DataFrame({"classes": [m["classes"]], "w": [m["w"].tobytes()], "b": [b], "t": [m["t"]]})

    rows = some.groupBy(F.lit(0).alias("one")).applyInPandas(fit, "classes array<string>, w binary, b array<double>, t double").collect()
    model = {"classes": [], "w": None}
    if rows:
        r = rows[0]
        model = {"classes": list(r.classes), "w": np.frombuffer(bytes(r.w), np.float32).reshape(DIMS, -1), "b": np.array(r.b), "t": r.t}
    shared = spark.sparkContext.broadcast(model)  # DIMS floats for each language

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [predict(shared.value, t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", F.coalesce(~learn, F.lit(False)).alias("held_out"), "text").mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double")
