"""Toxicity: a factorization machine over hashed terms.

Terms of a text are its distinct lower-cased words (runs of letters) and their beginnings of 3 to 8 bytes, hashed.
The score is the logistic of  bias + sum of w_i + sum over pairs of <v_i, v_j>:  the pairs catch what single weights
miss, such as an insult that counts only beside another term. First a linear model with an L1 penalty picks the terms
that may matter, then weights and factors are fitted together on these by AdaGrad, for as many epochs as serve a fifth of
the sample best that stayed out of a first fit.

Labels are learned from a hashed sample of at most about SAMPLE rows of each class (documented bound); the bias is
corrected for the share of each class in the sample. Scoring reads whole texts. Null and empty texts have no term
and get the bias; without labelled rows all scores are 0. Repeated labelled rows count as often as they occur. Ties do
not matter: a text's score depends on that text and the model alone. Empty tables give empty results. Input columns other
than those named are not read; of input columns called score or predicted, score() puts its own in their place.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_small, stash
from .hashing import NON_LETTERS, chunks, span_hashes, words

#: Rows of each class to learn from; bits of a hashed term; terms rarer than this in the sample are left out.
SAMPLE, BITS, RARE = 4000, 26, 4
RANK, EPOCHS, BATCH, RATE, DECAY = 6, 20, 64, 0.1, 1e-5
LINEAR_L1, LINEAR_EPOCHS = 8.0, 3
STEMS = (3, 4, 5, 6, 7, 8)
#: Texts that a Python worker holds at once.
ROWS = 1000


def terms(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of texts: first, last + 1, hashed terms, and the text that each is of."""
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    for a, b, data, offsets in chunks(raw):
        s, e = words(data, NON_LETTERS)
        spans = [(s, e)] + [(s[long], s[long] + k) for k in STEMS for long in [e - s >= k]]
        s, e = np.concatenate([x for x, _ in spans]), np.concatenate([x for _, x in spans])
        # a whole word and a stem of the same bytes are different terms
        kind = np.concatenate([np.full(len(x), i, np.uint64) for i, (x, _) in enumerate(spans)])
        h = (span_hashes(data, s, e) + kind * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
        yield a, b, h.astype(np.int64), np.searchsorted(offsets, s, "right") - 1


def _distinct(texts: list[str | None], keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) of all texts, each pair once, sorted; keep: sorted terms to stay with."""
    docs, found = [], []
    for a, _, h, d in terms(texts):
        if keep is not None:
            i = np.searchsorted(keep, h)
            i[i == len(keep)] = 0
            hit = keep[i] == h if len(keep) else np.zeros(len(h), bool)
            h, d = i[hit], d[hit]
        u = np.unique(((d + a) << BITS) | h)
        docs.append(u >> BITS)
        found.append(u & ((1 << BITS) - 1))
    return (np.concatenate(docs), np.concatenate(found)) if docs else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _raw(m: dict, d: np.ndarray, f: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores before the logistic, and each text's sum of factors."""
    s = np.stack([np.bincount(d, m["v"][f, k], n) for k in range(m["v"].shape[1])], 1)
    sq = np.bincount(d, (m["v"][f] ** 2).sum(1), n)
    return m["b"] + np.bincount(d, m["w"][f], n) + 0.5 * ((s * s).sum(1) - sq), s


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_fm(texts: list[str], y: np.ndarray, share: tuple[float, float]) -> dict:
    """share: of each class's rows, the part that is in the sample."""
    n = len(y)
    d, t = _distinct(texts)
    keys, inv, count = np.unique(t, return_inverse=True, return_counts=True)
    often = count >= RARE
    keys, new = keys[often], np.cumsum(often) - 1
    d, f = d[often[inv]], new[inv[often[inv]]]
    at = np.searchsorted(d, np.arange(n + 1))
    rng = np.random.default_rng(1)
    # linear: follow the regularised leader, L1
    z, n2, w, b, zb = np.zeros(len(keys)), np.zeros(len(keys)), np.zeros(len(keys)), float(np.log((y.sum() + 1) / (n - y.sum() + 1))), 0.0
    for _ in range(LINEAR_EPOCHS):
        for r in rng.permutation(n):
            i = f[at[r] : at[r + 1]]
            g = 1 / (1 + np.exp(-min(40, max(-40, b + w[i].sum())))) - y[r]
            root = np.sqrt(n2[i])
            n2[i] += g * g
            new_root = np.sqrt(n2[i])
            z[i] += g - (new_root - root) * w[i] / 0.1
            w[i] = np.where(np.abs(z[i]) <= LINEAR_L1, 0, -(z[i] - np.sign(z[i]) * LINEAR_L1) / ((1 + new_root) / 0.1))
            b -= 0.01 * g
    live = w != 0
    keys, new = keys[live], np.cumsum(live) - 1
    d, f = d[live[f]], new[f[live[f]]]
    at = np.searchsorted(d, np.arange(n + 1))
    start = {"keys": keys, "w": w[live], "b": b}
    out = rng.permutation(n) < n // 5
    losses = []
    if 0 < out.sum() and len(set(y[~out])) == 2:
        hd, hf = d[out[d]], f[out[d]]
        for m in _epochs(start, y, f, at, np.flatnonzero(~out)):
            p = _sigmoid(_raw(m, hd, hf, n)[0])[out]
            losses.append(-np.log(np.where(y[out] > 0, p, 1 - p) + 1e-9).mean())
    best = int(np.argmin(losses)) + 1 if losses else 1
    for _, m in zip(range(best), _epochs(start, y, f, at, np.arange(n)), strict=False):
        pass
    if n:  # the sample holds each class at its own rate
        m["b"] += float(np.log(share[0] / share[1]))
    return m


def _epochs(start: dict, y: np.ndarray, f: np.ndarray, at: np.ndarray, some: np.ndarray) -> Iterator[dict]:
    """The model after each epoch of AdaGrad over some rows; row r has the terms f[at[r]:at[r + 1]]."""
    rng = np.random.default_rng(2)
    m = start | {"w": start["w"].copy(), "v": rng.normal(0, 0.05, (len(start["w"]), RANK))}
    gw, gv, gb = np.full(len(m["w"]), 1e-8), np.full(m["v"].shape, 1e-8), 1e-8
    for _ in range(EPOCHS):
        order = rng.permutation(some)
        for k in range(0, len(order), BATCH):
            rows = order[k : k + BATCH]
            size = at[rows + 1] - at[rows]
            rd = np.repeat(np.arange(len(rows)), size)
            i = f[np.repeat(at[rows], size) + np.arange(len(rd)) - np.repeat(np.cumsum(size) - size, size)]
            s, sums = _raw(m, rd, i, len(rows))
            e = (_sigmoid(s) - y[rows]) / len(rows)
            gb += e.sum() ** 2
            m["b"] -= RATE * e.sum() / np.sqrt(gb)
            if not len(i):
                continue
            u, j = np.unique(i, return_inverse=True)
            dw = np.bincount(j, e[rd], len(u)) + DECAY * m["w"][u]
            part = e[rd][:, None] * (sums[rd] - m["v"][i])
            dv = np.stack([np.bincount(j, part[:, c], len(u)) for c in range(RANK)], 1) + DECAY * m["v"][u]
            gw[u] += dw**2
            gv[u] += dv**2
            m["w"][u] -= RATE * dw / np.sqrt(gw[u])
            m["v"][u] -= RATE * dv / np.sqrt(gv[u])
        yield m


def predict(m: dict, texts: list[str | None]) -> np.ndarray:
    if m["keys"] is None:
        return np.zeros(len(texts))
    return _sigmoid(_raw(m, *_distinct(texts, m["keys"]), len(texts))[0])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", sample: int = SAMPLE) -> dict:
    """docs: doc_id, text; labels: doc_id, label (0 or 1); learn: which labels, by doc_id. The model; its size follows the sample."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & learn)
    n = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = tuple(min(1.0, sample / max(1, n.get(k, 0))) for k in (0, 1))
    key = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1 << 30))
    some = known.withColumn("k", key).where(" or ".join(f"y = {c} and k < {int(share[c] * (1 << 30)) + 1}" for c in (0, 1)))
    some = join_small(docs.select("doc_id", "text"), stash(some, "labels"), "doc_id")  # about 2 * sample rows of numbers

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k", "doc_id", "y"], kind="stable")
        m = fit_fm(list(pdf.text.where(pdf.text.notna(), "")), pdf.y.to_numpy(float), share)
        return pd.DataFrame({"keys": [m["keys"].tobytes()], "w": [m["w"].tobytes()], "v": [m["v"].tobytes()], "b": [float(m["b"])]})

    rows = some.groupBy(F.lit(0).alias("one")).applyInPandas(learn, "keys binary, w binary, v binary, b double").collect()
    if not rows:
        return {"keys": None}
    r = rows[0]
    return {"keys": np.frombuffer(bytes(r.keys), np.int64), "w": np.frombuffer(bytes(r.w)), "v": np.frombuffer(bytes(r.v)).reshape(-1, RANK), "b": r.b}


def score_of(docs: DataFrame, model: dict) -> Column:
    """The score of the text column of docs; only that column goes to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([predict(shared.value, text.slice(k, ROWS).to_pylist()) for k in range(0, max(1, len(text)), ROWS)]), pa.float64())

    return scored(docs["text"])


def score(docs: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """docs: doc_id, text, and more. All columns, score, predicted."""
    return docs.withColumn("score", score_of(docs, model)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, as they are, whose score is under the threshold.

    Whole rows pass through Python, ROWS of them at a time: texts are most of a row, and for a column alone the JVM would
    keep all rows of a batch in memory meanwhile.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                some = b.slice(k, ROWS)
                yield some.filter(pa.array(predict(shared.value, some.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)
