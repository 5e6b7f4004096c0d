"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1- to ``N``-grams of the lower-cased letters are hashed into ``BUCKETS`` columns. Document
frequencies come from every training document (a Spark aggregate of at most BUCKETS rows). The
weights are fitted by follow-the-regularised-leader with elastic-net penalties on a bounded sample,
``PER_LANGUAGE`` documents of each language; a fifth of the sample sets the softmax temperature.

Sampling is by hash of the text; a text counts once a language, and languages beyond ``MOST_LANGUAGES`` (the rarest) aren't learned.

Cases: very long texts are read whole; of equally likely languages the first by name is predicted; a null text or one without a letter is ``und`` with score 0; a null language or id never
trains (a null id is in no test fold); repeated rows are each predicted; without any training
document everything is ``und``; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, held_out, read, slices

#: n-gram length, hashed columns, documents of each language that train the weights at most, and languages.
N, BUCKETS, PER_LANGUAGE, MOST_LANGUAGES = 3, 1 << 15, 800, 400
#: FTRL-proximal: step size and smoothing, the two penalties, passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 1e-3, 1e-4, 4


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-grams of a text (bucket, count); none if it has no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.where(letter, codes, np.uint64(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after each word
    codes = np.concatenate([[np.uint64(32)], codes[keep]])
    counts, gram = np.zeros(BUCKETS, np.int64), np.zeros(len(codes), np.uint64)
    for n in range(1, N + 1):
        if len(codes) < n:
            break
        gram = gram[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(n)
        mixed = (gram ^ (gram >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        counts += np.bincount((mixed >> np.uint64(64 - 15)).astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def weigh(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[at]
    return x / np.sqrt(x @ x)


class Ftrl:
    """Multinomial logistic regression, one coordinate-wise learning rate for each weight."""

    def __init__(self, classes: int, size: int = BUCKETS):
        self.z, self.n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)  # the last row is the intercept
        w = self.weights(at)
        g = x[:, None] * (softmax(x @ w) - np.eye(w.shape[1])[y])[None, :]
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The softmax temperature of the least negative log likelihood, by golden-section search."""
    if not len(y):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean()

    lo, hi, r = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The number of documents with a letter, and in how many of them each bucket occurs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(BUCKETS + 1, np.int64)
        for b in batches:
            for t in b["text"]:
                at, _ = gram_counts(t)
                if len(at):
                    seen[at] += 1
                    seen[BUCKETS] += 1
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"bucket": at, "n": seen[at]})

    rows = docs.select(F.col("text").cast("string")).mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS + 1, np.int64)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return int(out[BUCKETS]), out[:BUCKETS]


def train(labelled: DataFrame) -> dict:
    """The model from rows (doc_id, text, lang)."""
    labelled = labelled.where("lang is not null and text is not null").select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string"))
    most = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    sizes = {r["lang"]: r["n"] for r in most.collect()}
    classes = sorted(sizes)
    if not classes:
        return {"classes": []}
    n, df = document_frequencies(labelled)
    idf = np.log((1 + n) / (1 + df)) + 1
    every = F.create_map(*[F.lit(x) for c in classes for x in (c, max(1, sizes[c] // PER_LANGUAGE))])
    drawn = F.xxhash64("text", F.lit(5)).alias("drawn")
    chosen = labelled.where(F.pmod(drawn, F.try_element_at(every, F.col("lang"))) == 0).select("text", "lang", drawn)

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            found = [gram_counts(t) for t in b["text"]]
            yield pd.DataFrame({"drawn": b["drawn"], "lang": b["lang"], "at": [a.astype(np.int32) for a, _ in found], "c": [c.astype(np.int32) for _, c in found]})

    # About PER_LANGUAGE rows a language, of at most BUCKETS entries; a text that recurs is one row of them.
    rows = chosen.mapInPandas(grams, "drawn long, lang string, at array<int>, c array<int>").dropDuplicates(["drawn", "lang"])
    sample = rows.orderBy("drawn", "lang").limit(2 * PER_LANGUAGE * len(classes)).toPandas()
    sample = sample[sample["at"].map(len) > 0]
    xs = [(np.asarray(a, np.int64), weigh(np.asarray(a, np.int64), np.asarray(c), idf)) for a, c in zip(sample["at"], sample["c"], strict=True)]
    ys = [classes.index(x) for x in sample["lang"]]
    order = np.random.default_rng(17).permutation(len(xs))
    tune, fit = order[: len(order) // 5], order[len(order) // 5 :]
    model = Ftrl(len(classes))
    for _ in range(EPOCHS):
        for i in fit:
            model.learn(*xs[i], ys[i])
    w = model.weights()
    logits = np.array([xs[i][1] @ w[xs[i][0]] + w[-1] for i in tune]).reshape(len(tune), len(classes))
    t = temperature(logits, np.array([ys[i] for i in tune], np.int64))
    return {"classes": classes, "w": w.astype(np.float32), "idf": idf.astype(np.float32), "t": t}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row (doc_id, text)."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list) -> list:
        m, lang, score = known.value, [], []
        for text in texts:
            at, counts = gram_counts(text) if m["classes"] else (np.zeros(0, np.int64),) * 2
            if not len(at):
                lang.append("und")
                score.append(0.0)
                continue
            p = softmax((weigh(at, counts, m["idf"]) @ m["w"][at] + m["w"][-1]).astype(np.float64) / m["t"])
            lang.append(m["classes"][int(p.argmax())])
            score.append(float(p.max()))
        return [lang, score]

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return add_columns(rows, "text", "lang_pred string, score double", run).drop("text")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(docs, train(docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())))
