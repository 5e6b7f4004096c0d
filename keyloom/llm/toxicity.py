"""Toxicity of texts, read through their disguises by a noisy channel.

Writers hide words by look-alike characters (``1d10t``), by spacing letters out (``i d i o t``,
``i.d.i.o.t``), by masking (``id*ot``) and by repetition (``idiooot``). A suspicious token, or a stretch of
spaced-out letters, becomes a lattice: each character offers the letters it may stand for, at a channel cost; a
separator may stand for nothing or end a word; a run may stand for fewer letters. Viterbi finds the best path
under a character trigram model, which is counted over all documents; so a spaced-out sentence falls into its
words. It takes time in proportion to the token's length, however long. Words without any such sign have one
path, themselves.

The restored words feed a sparse logistic regression. Its vocabulary is what a chi-square test over
the labelled sample links to either label; weights come from follow-the-regularised-leader steps.
The sample is bounded by ``TRAIN_ROWS``; everything else is counted over all rows.

Cases: very long texts and tokens are read whole; of equally likely readings the first found counts, of equally
telling words the first by name enters the vocabulary; a null text counts as empty; an empty text gets the intercept's score; rows with a null id or
a null label train nothing (a null id is in no test fold); repeated rows are each scored; unless both labels
occur nothing can be learned and every score is (next to) 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, held_out, read, slices, staged

#: Labelled documents that train at most (about), words in the vocabulary at most, least document
#: frequency of a word, least chi-square, and passes over the sample.
TRAIN_ROWS, VOCABULARY, MIN_DOCS, MIN_CHI2, EPOCHS = 16000, 20000, 5, 20.0, 12
#: FTRL-proximal: step size and smoothing, the two penalties; the share of a text's words seen in a pass.
ALPHA, BETA, L1, L2, KEEP = 0.5, 1.0, 0.6, 1e-4, 0.5

# What a character may stand for.
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "tl", "8": "b", "9": "gq", "2": "z", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "aeiou", "%": "aeiou"}
SEPARATORS = frozenset(" .-_*~'·")
_STRIP = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "«»„“”‘’…–—¿¡"
_GAP = re.compile(r"[ .\-_*~'·]+")
_LETTER = r"[^\W_]|[@$!|+€£¡]"
_SPACED = re.compile(rf"(?<![^\W_])(?:(?:{_LETTER})[ .\-_*~·]{{1,4}}){{2,}}(?:{_LETTER})(?![^\W_])")
#: Costs of the channel: a look-alike, a mark that means nothing, a word's end at a usual gap, none at a wide one.
LOOK, DUST, SPLIT, WIDE = 1.5, 2.0, 2.0, 3.0
_RUN = re.compile(r"(.)\1\1")
_WORDS = re.compile(r"[^\W\d_]+")

#: Symbols of the language model: 0 is the word's edge, 1-26 a-z, the others share 37 classes.
SYMBOLS = 64


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 37 if c.isalpha() else 0


_TABLE = None


def _symbols(text: str) -> np.ndarray:
    """The text's symbols, two edges before each word."""
    global _TABLE
    if _TABLE is None:
        _TABLE = np.array([symbol(chr(c)) for c in range(0x3000)] + [0], np.int64)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[np.minimum(codes, 0x3000)]


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """How often each symbol follows each pair, over all texts; at most SYMBOLS ** 3 rows reach the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(SYMBOLS**3, np.int64)
        for b in batches:
            for text in b["text"]:
                s = _symbols(text or "")
                if len(s):
                    s = np.concatenate([[0, 0], s, [0]])
                    first = s[:-2].copy()
                    first[s[1:-1] == 0] = 0  # nothing is remembered across a word's edge
                    np.add.at(seen, (first * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], 1) if len(s) < 64 else seen.__iadd__(np.bincount((first * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3))
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"gram": at, "n": seen[at]})

    rows = docs.select(F.col("text").cast("string")).mapInPandas(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SYMBOLS**3, np.int64)
    out[rows["gram"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def language_model(counts: np.ndarray) -> np.ndarray:
    """log P(symbol | two before), interpolated with the pair and the single symbol."""
    tri = counts.astype(np.float64)
    bi, uni = tri.sum(0), tri.sum((0, 1))
    p1 = (uni + 1) / (uni.sum() + SYMBOLS)
    p2 = (bi + 20 * p1) / (bi.sum(1, keepdims=True) + 20)
    p3 = (tri + 10 * p2[None]) / (tri.sum(2, keepdims=True) + 10)
    return np.log(p3).astype(np.float32)


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of equal characters (and of separators), the strings it may stand for with their costs.

    In a spaced-out stretch the usual gap between letters is dropped, or is a word's end at a cost;
    a wider gap is a word's end, or is dropped at a cost. Elsewhere marks inside a word may be dust.
    """
    gaps = [len(g) for g in _GAP.findall(token)]
    spaced = len(gaps) >= 2
    usual = min(gaps, default=0)
    out, i = [], 0
    while i < len(token):
        c, n = token[i], 1
        if c in SEPARATORS:
            while i + n < len(token) and token[i + n] in SEPARATORS:
                n += 1
            edge = i == 0 or i + n == len(token)
            if not spaced:
                choices = [("", DUST)] + [(x, LOOK) for x in LOOKS.get(c, "") if n == 1]
            elif n > usual and not edge:
                choices = [(" ", 0.0), ("", WIDE)]
            else:
                choices = [("", 0.0), (" ", SPLIT)] + [(x, LOOK) for x in LOOKS.get(c, "") if n == 1]
        else:
            while i + n < len(token) and token[i + n] == c:
                n += 1
            letters = (c,) if c.isalpha() else ()
            choices = [(x * k, (0.0 if x == c else LOOK) + (0.0 if k == n else 0.5 * (n - k) ** 0.5 if n < 9 else 1.4)) for x in (*letters, *LOOKS.get(c, "")) for k in sorted({1, min(n, 2)})]
            if not choices:
                choices.append(("", DUST))
        out.append(choices)
        i += n
    return out


def decode(token: str, lm: list) -> str:
    """The likeliest plain words for a token or a spaced-out stretch, by Viterbi over (two last letters); linear in its length."""
    states: dict[tuple[int, int], float] = {(0, 0): 0.0}
    trail: list[dict[tuple[int, int], tuple[tuple[int, int], str]]] = []
    for choices in lattice(token):
        step: dict[tuple[int, int], float] = {}
        came: dict[tuple[int, int], tuple[tuple[int, int], str]] = {}
        for (a, b), score in states.items():
            for text, cost in choices:
                s, x, y = score - cost, a, b
                for c in text:
                    z = symbol(c)
                    s += lm[x][y][z]
                    x, y = (y, z) if z else (0, 0)
                if (x, y) not in step or s > step[x, y]:
                    step[x, y], came[x, y] = s, ((a, b), text)
        states = step
        trail.append(came)
    at = max(states, key=lambda k: states[k] + (lm[k[0]][k[1]][0] if k != (0, 0) else 0.0))
    out = []
    for came in reversed(trail):
        at, text = came[at]
        out.append(text)
    return "".join(reversed(out)).strip()


def restored_words(text: str | None, lm: list, known: dict[str, tuple[str, ...]]) -> set[str]:
    """The distinct words of a text with disguises undone. ``known`` keeps what tokens became."""
    low = (text or "").lower()
    out: set[str] = set()
    for m in _SPACED.finditer(low):
        # A one-letter word may stand before or after the spaced-out one.
        letters = [i for i, c in enumerate(m[0]) if c not in SEPARATORS]
        for lo, hi in {(0, len(m[0])), (letters[1], len(m[0])), (0, letters[-2] + 1)}:
            out.update(decode(m[0][lo:hi], lm).split())
    if len(known) > 50_000:
        known.clear()
    for token in set(low.split()):
        got = known.get(token)
        if got is None:
            core = token.strip(_STRIP)
            if core.isalpha() and not _RUN.search(core):
                got = (core,)
            elif not any(c.isalpha() for c in core):
                got = ()
            else:
                got = (*decode(core, lm).split(), *_WORDS.findall(core))
            # What stands at the edge may be part of the disguise ($tupid), so both are read.
            if core and len(token) - len(core) in (1, 2) and (token[0] in LOOKS or token[-1] in "$@"):
                got = (*got, *decode(token, lm).split())
            known[token] = got
        out.update(got)
    out.discard("")
    return out


class _Model(dict):
    """lm, weights (word -> weight), bias."""


def train(docs: DataFrame, labels: DataFrame) -> _Model:
    """The model from all texts (doc_id, text) and the labels that may train (doc_id, toxic)."""
    spark = docs.sparkSession
    lm = language_model(trigram_counts(docs))
    labels = labels.where("doc_id is not null and toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    every = max(1, labels.count() // TRAIN_ROWS)
    few = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(every)) == 0).select(F.col("doc_id").alias("id"), "toxic")
    shared = spark.sparkContext.broadcast(lm)

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, logs = {}, shared.value.tolist()
        for b in slices(batches):
            yield pd.DataFrame({"toxic": b["toxic"], "ws": [sorted(features(restored_words(t, logs, known))) for t in b["text"]]})

    # The sample of labels has about TRAIN_ROWS rows at most: broadcasting it spares the texts a shuffle.
    met = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(few), F.col("doc_id") == F.col("id"))
    rows = staged(met.select("toxic", "text").mapInPandas(featured, "toxic int, ws array<string>"), "labelled")
    n1, n = rows.agg(F.sum("toxic"), F.count("*")).first()
    if not n or n1 in (0, n):
        return _Model(lm=lm, weights={}, bias=-30.0)
    counts = rows.select("toxic", F.explode("ws").alias("word")).groupBy("word").agg(F.sum("toxic").alias("a"), F.count("*").alias("m"))
    a, m, p = F.col("a"), F.col("m"), n1 / n
    chi2 = (a - m * p) * (a - m * p) / (m * p * (1 - p)) / F.greatest(F.lit(1e-6), 1 - m / n)
    top = counts.where(m >= MIN_DOCS).withColumn("chi2", chi2).where(F.col("chi2") >= MIN_CHI2).orderBy(F.desc("chi2"), "word").limit(VOCABULARY)
    vocabulary = {w: i for i, w in enumerate(r["word"] for r in top.collect())}
    words = spark.sparkContext.broadcast(vocabulary)

    def indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"toxic": b["toxic"], "at": [sorted(words.value[w] for w in ws if w in words.value) for ws in b["ws"]]})

    sample = rows.mapInPandas(indexed, "toxic int, at array<int>").toPandas()
    sample["key"] = sample["at"].map(lambda x: tuple(x))
    sample = sample.sort_values(["toxic", "key"], kind="stable")
    xs, ys = [np.append(np.asarray(x, np.int64), len(vocabulary)) for x in sample["at"]], sample["toxic"].to_numpy(float)
    z, s = np.zeros(len(vocabulary) + 1), np.zeros(len(vocabulary) + 1)

    def weights(at=slice(None)) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(s[at])) / ALPHA + L2)
        return np.where(np.abs(z[at]) <= L1, 0.0, w)

    rng = np.random.default_rng(23)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(xs)):
            at = xs[i]
            if len(at) > 2:
                # Each pass hides about half of a text's words: one that says enough must say it alone.
                kept = rng.random(len(at) - 1) < KEEP
                at = np.append(at[:-1][kept] if kept.any() else at[:1], at[-1])
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - ys[i]
            old = s[at]
            z[at] += g - (np.sqrt(old + g * g) - np.sqrt(old)) / ALPHA * w
            s[at] = old + g * g
    w = weights()
    return _Model(lm=lm, weights={t: float(w[i]) for t, i in vocabulary.items() if w[i]}, bias=float(w[-1]))


def features(words: set[str]) -> set[str]:
    """The words and their stems of four and six letters: inflected insults share them."""
    return words | {w[:n] + "~" for w in words for n in (4, 6) if len(w) > n}


def text_scores(texts: list, model: _Model, lm: list, known: dict) -> np.ndarray:
    """The scores (0 to 1) of some texts; ``lm`` is the model's as nested lists, ``known`` keeps what tokens became."""
    weights = model["weights"]
    logits = [model["bias"] + sum(sorted(weights[w] for w in weights.keys() & features(restored_words(t, lm, known)))) for t in texts]
    return 1 / (1 + np.exp(-np.clip(np.array(logits, float), -30, 30)))


def score(docs: DataFrame, model: _Model, name: str = "toxicity") -> DataFrame:
    """Every row of ``docs`` with a column ``name`` (0 to 1); the other columns stay."""
    known_model = docs.sparkSession.sparkContext.broadcast(model)
    held: list = []

    def run(texts: list) -> list:
        held[:] = held or [known_model.value["lm"].tolist(), {}]
        return [text_scores(texts, known_model.value, *held)]

    return add_columns(docs, "text", f"`{name}` double", run)


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels outside the test fold."""
    return labels.select("doc_id", "toxic").where(~held_out(F.col("doc_id")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, training_labels(read(spark, sf_dir, "labels"))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
