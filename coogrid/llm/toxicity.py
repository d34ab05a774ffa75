"""Toxicity by multiple-instance learning.

A document is a bag of sentences of which only the bag is labelled.  A sentence
has probability sigmoid(bias + sum of its feature weights), a document the
noisy-or of its sentences; the likelihood of the document labels is maximised
directly, so the weights end up locating the offending sentences.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, fold, keep_rows, labelled_sample

#: Labelled documents that the model is fitted on, at most (give or take a square root).
SAMPLE_DOCS = 8_000
#: Features kept (a bound on the size of the model): the most telling ones of those in enough sampled documents and with enough evidence.
FEATURES, LEAST_DOCS, LEAST_G = 4096, 3, 10.0
#: A document is toxic from this probability on, a sentence is reported from this one on.
THRESHOLD, SENTENCE_THRESHOLD = 0.7, 0.5
#: Lengths of the word beginnings that are features beside the word itself.
PREFIXES = (4, 5, 6, 7)
EPOCHS, RATE, RIDGE = 200, 0.15, 1e-5
_CACHE = 200_000

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans (start, end) in code points, cut after runs of ``. ! ?`` and line ends."""
    return [m.span() for m in _SENTENCE.finditer(text)]


def features(word: str) -> list[str]:
    """A lower-case word and its beginnings (marked with a caret)."""
    return [word, *("^" + word[:n] for n in PREFIXES if len(word) > n)]


def sentence_features(words: list[str]) -> set[str]:
    """Features of the words of a sentence; a beginning that two words or more share is one more (marked with a 2)."""
    found = Counter(f for w in words for f in features(w))
    return set(found) | {"2" + f for f, n in found.items() if n > 1 and f[0] == "^"}


@dataclass(frozen=True)
class ToxicityModel:
    bias: float
    weights: dict[str, float]


def fit(docs: DataFrame, labels: DataFrame, held: tuple[int, int] | None = None) -> ToxicityModel:
    """Learn from about ``SAMPLE_DOCS`` labelled documents; ids in the fold ``held`` take no part.

    Without labels of both kinds the model is constant: the share of toxic labels
    (or nearly 0 where there are none).
    """
    chosen = labelled_sample(labels, "toxic", SAMPLE_DOCS, held)
    plain = docs.select("doc_id", F.col("text").cast("string").alias("t"))
    # At most SAMPLE_DOCS ids: small enough to send to every task, and no text is shuffled.
    sample = plain.join(F.broadcast(chosen), "doc_id").select("y", "t")

    def count():
        def kernel(ys: list, texts: list):
            found = {0: Counter(), 1: Counter()}
            for y, t in zip(ys, texts, strict=True):
                lines = map(_WORD.findall, _SENTENCE.findall((t or "").lower()))
                found[y].update(set().union(*map(sentence_features, lines)))
                found[y][""] += 1
            for y in (0, 1):
                yield from ((f, y, n) for f, n in found[y].items())

        return kernel

    counts = arrow_map(sample, count, "f string, y int, n long", rows=64).groupBy("f").agg(
        F.sum(F.col("n") * F.col("y")).alias("bad"), F.sum(F.col("n") * (1 - F.col("y"))).alias("good")
    )
    total = counts.where(F.col("f") == "").first()
    bad, good = (total["bad"], total["good"]) if total else (0, 0)
    if not bad or not good:
        share = (bad + 0.01) / (bad + good + 1)
        return ToxicityModel(math.log(share / (1 - share)), {})
    # Likelihood ratio (G) of the two-by-two table of feature and label: what chance alone rarely gives.
    seen = F.col("bad") + F.col("good")
    cells = [F.col("bad"), F.col("good"), bad - F.col("bad"), good - F.col("good")]
    margins = [seen, bad + good - seen, F.lit(bad), F.lit(good)]
    ratio = 2 * (sum(map(_xlogx, cells)) - sum(map(_xlogx, margins)) + _xlogx(F.lit(bad + good)))
    kept = counts.where((F.col("f") != "") & (seen >= LEAST_DOCS)).withColumn("g", ratio).where(F.col("g") >= LEAST_G)
    names = [r["f"] for r in kept.orderBy(F.desc("g"), "f").limit(FEATURES).collect()]
    index = {f: i for i, f in enumerate(names)}

    def rows():
        def kernel(ys: list, texts: list):
            for y, t in zip(ys, texts, strict=True):
                bags: Counter = Counter()
                for words in map(_WORD.findall, _SENTENCE.findall((t or "").lower())):
                    bags[tuple(sorted(index[f] for f in sentence_features(words) if f in index))] += 1
                # Like sentences weigh alike: a bag of features and how often it occurs.
                cells = [np.array([n, len(b), *b], np.int32) for b, n in sorted(bags.items())]
                yield y, np.concatenate(cells).tobytes() if cells else b""

        return kernel

    bags = [(r[0], bytes(r[1])) for r in arrow_map(sample, rows, "y int, bags binary").collect()]
    return _train(sorted(bags), names)


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.ln(x.cast("double"))).otherwise(0.0)


def _train(bags: list[tuple[int, bytes]], names: list[str]) -> ToxicityModel:
    """Gradient ascent (Adam) on the noisy-or likelihood, with a small ridge."""
    doc, times, cell, at = [], [], [], []
    y = np.array([b[0] for b in bags], float)
    for d, (_, content) in enumerate(bags):
        values, i = np.frombuffer(content, np.int32), 0
        while i < len(values):
            n, width = values[i], values[i + 1]
            cell.append(values[i + 2 : i + 2 + width])
            at.append(np.full(width, len(doc)))
            doc.append(d)
            times.append(n)
            i += 2 + width
    doc, times = np.array(doc, int), np.array(times, float)
    cell = np.concatenate(cell) if cell else np.zeros(0, int)
    at = np.concatenate(at) if at else np.zeros(0, int)
    w = np.zeros(len(names) + 1)
    w[-1] = -6.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, EPOCHS + 1):
        z = w[-1] + np.bincount(at, w[cell], len(doc))
        z = np.clip(z, -30, 30)
        p = 1 / (1 + np.exp(-z))
        none = np.bincount(doc, times * np.logaddexp(0, z), len(y))  # minus the log that no sentence offends
        pull = np.where(y > 0, 1 / np.expm1(np.maximum(none, 1e-9)), -1.0)
        g = pull[doc] * times * p / len(y)
        grad = np.append(np.bincount(cell, g[at], len(names)), g.sum()) - RIDGE * np.append(w[:-1], 0.0)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return ToxicityModel(float(w[-1]), {f: float(x) for f, x in zip(names, w[:-1], strict=True) if abs(x) > 1e-3})


def scorer(model: ToxicityModel) -> Callable[[str | None], tuple[float, list[tuple[int, int, float]]]]:
    """Kernel: the document's probability and its offending sentences (start, end, probability).

    A null or empty text has no sentence and scores 0.
    """
    weights, bias = model.weights, model.bias
    # Most words have no weight: those that begin as no weighted feature does are passed over at once.
    least = min(PREFIXES)
    starts = {f.lstrip("2^")[:least] for f in weights}
    telling = {f.removeprefix("2") for f in weights}

    class Words(dict):
        def __missing__(self, word: str) -> tuple[str, ...]:
            if len(self) > _CACHE:
                self.clear()
            value = self[word] = tuple(f for f in features(word) if f in telling)
            return value

    words = Words()
    plain = math.log1p(math.exp(bias))
    cut = math.log(SENTENCE_THRESHOLD / (1 - SENTENCE_THRESHOLD))

    def score(text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        if not text:
            return 0.0, []
        met = {w: v for w in set(_WORD.findall(text.lower())) if w[:least] in starts and (v := words[w])}
        if not met:
            return -math.expm1(-plain * len(_SENTENCE.findall(text))), []
        none, found = 0.0, []
        for m in _SENTENCE.finditer(text):
            lower = m[0].lower()
            # With few weighted words most sentences hold none of them, which is soon seen.
            look = len(met) > 4 or any(map(lower.__contains__, met))
            here = [w for w in _WORD.findall(lower) if w in met] if look else ()
            if here:
                # As learnt: a feature counts once in a sentence, whichever words share it, and that they share it once more.
                seen = Counter(f for w in here for f in met[w])
                z = bias + sum(weights.get(f, 0.0) + (weights.get("2" + f, 0.0) if n > 1 else 0.0) for f, n in sorted(seen.items()))
                z = max(-30.0, min(30.0, z))
                none += math.log1p(math.exp(z))
                if z >= cut:
                    found.append((*m.span(), 1 / (1 + math.exp(-z))))
            else:
                none += plain
        return -math.expm1(-none), found

    return score


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, score, predicted, sentences`` for every row; ``sentences`` is start:end:probability, comma-joined."""

    def make():
        score = scorer(model)

        def kernel(ids: list, texts: list):
            for i, t in zip(ids, texts, strict=True):
                p, found = score(t)
                yield i, p, int(p >= THRESHOLD), ",".join(f"{a}:{b}:{x:.3f}" for a, b, x in found)

        return kernel

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("t"))
    return arrow_map(plain, make, "doc_id long, score double, predicted int, sentences string")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below ``THRESHOLD``, with the columns they came with."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))

    def make():
        score = scorer(model)
        return lambda texts: [score(t)[0] < THRESHOLD for t in texts]

    return keep_rows(docs, "text", make)


def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from labels of ids whose crc32 mod 3 is not 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = score_toxicity(docs, fit(docs, labels, held=(3, 1)))
    return found.select("doc_id", fold("doc_id", 3, 1).alias("held_out"), "score", "predicted", "sentences")
