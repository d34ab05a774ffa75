"""Quality classifier: a factorisation machine.

Features are hashed words, structure statistics in bins and metadata in bins; their
pairwise interactions have rank ``FACTORS`` and are scored in linear time, since the
sum over pairs is half of the square of the sum minus the sum of the squares.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, fold, labelled_sample

#: Labelled documents that the machine is fitted on, about, at most.
SAMPLE_DOCS = 8000
WORD_BITS, BINS, FACTORS = 14, 16, 8
THRESHOLD = 0.3
EPOCHS, BATCH, RATE, RIDGE, SEED = 12, 128, 0.08, 2e-5, 7
_CACHE = 200_000

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS = bytes(range(48, 58))
_SPACES = b" \t\n\r\x0b\x0c"
_STOPS = b".,;:'\"()-"


def _share(part: float, whole: float) -> int:
    return min(BINS - 1, int(BINS * part / whole)) if whole > 0 else 0


def _fine(part: float, whole: float) -> int:
    """A bin that tells small shares apart."""
    return min(BINS - 1, int(BINS * math.sqrt(part / whole))) if whole > 0 else 0


def _log(n: float) -> int:
    return min(BINS - 1, int(math.log2(n + 1)))


def structure(text: str, words: list[str], n_chars: int | None) -> list[int]:
    """Bins of the structure statistics and of the recorded length, in fixed order."""
    content = text.encode("utf-8", "replace")
    size = len(content)
    count = lambda kind: size - len(content.translate(None, kind))
    letters, upper, digits, spaces, stops = map(count, (_LETTERS, _UPPER, _DIGITS, _SPACES, _STOPS))
    marks = size - letters - digits - spaces - stops
    n = len(words)
    tally = Counter(words)
    lines = text.split("\n")
    return [
        _fine(marks, size), _share(upper, letters), _fine(digits, size), _share(spaces, size), _fine(stops, size),
        _share(letters, size), _log(n), _share(len(tally), n), _fine(max(tally.values(), default=0), n),
        _fine(sum(map(operator.eq, words, words[1:])), n), _log(size / n if n else 0), _share(len(set(lines)), len(lines)),
        _log(len(lines)), _log(n_chars if n_chars is not None and n_chars > 0 else 0), _fine(text.count("|"), n or 1),
        _fine(len(text.split(".")) - 1, n),
    ]


_STATISTICS = 16
SIZE = (1 << WORD_BITS) + _STATISTICS * BINS


def extractor() -> Callable[[str | None, int | None], tuple[np.ndarray, np.ndarray]]:
    """Kernel: indices and values of a document's features; a null text is empty."""

    class Buckets(dict):
        def __missing__(self, word: str) -> int:
            if len(self) > _CACHE:
                self.clear()
            at = self[word] = zlib.crc32(word.lower().encode("utf-8", "replace")) & ((1 << WORD_BITS) - 1)
            return at

    bucket = Buckets()
    base = (1 << WORD_BITS) + np.arange(_STATISTICS) * BINS

    def extract(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        words = text.split()
        hashed = list({*map(bucket.__getitem__, set(words))})
        at = np.concatenate((np.array(sorted(hashed), np.int32), (base + structure(text, words, n_chars)).astype(np.int32)))
        values = np.ones(len(at), np.float32)
        values[: len(hashed)] = 1 / math.sqrt(max(1, len(hashed)))
        return at, values

    return extract


@dataclass(frozen=True)
class QualityModel:
    """Bias, linear weights and factors (float32 bytes)."""

    bias: float
    linear: bytes
    factors: bytes


def fit(docs: DataFrame, labels: DataFrame, held: tuple[int, int] | None = None) -> QualityModel:
    """Learn from about ``SAMPLE_DOCS`` labelled documents; ids in the fold ``held`` take no part.

    Without labels of both kinds every document scores the share of good labels
    (a half where there are none).
    """
    chosen = labelled_sample(labels, "quality", SAMPLE_DOCS, held)
    # At most SAMPLE_DOCS ids go to every task; no text is shuffled.
    sample = _plain(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "t", "n")

    def make():
        extract = extractor()

        def kernel(ids: list, ys: list, texts: list, sizes: list):
            for i, y, t, n in zip(ids, ys, texts, sizes, strict=True):
                yield i, y, extract(t, n)[0].tobytes()

        return kernel

    rows = sorted((r[0], r[1], bytes(r[2])) for r in arrow_map(sample, make, "doc_id long, y int, f binary").collect())
    return _train([np.frombuffer(f, np.int32) for _, _, f in rows], np.array([y for _, y, _ in rows], float))


def _values(at: np.ndarray) -> np.ndarray:
    n = len(at) - _STATISTICS
    return np.concatenate((np.full(n, 1 / math.sqrt(max(1, n))), np.ones(_STATISTICS)))


def _train(rows: list[np.ndarray], y: np.ndarray) -> QualityModel:
    """Adagrad over small batches, in an order fixed by the seed."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias, w, v = math.log(share / (1 - share)), np.zeros(SIZE), np.zeros((SIZE, FACTORS))
    if len(y) and 0 < y.sum() < len(y):
        random = np.random.default_rng(SEED)
        v = random.normal(0, 0.05, (SIZE, FACTORS))
        seen_b, seen_w, seen_v = 1e-8, np.full(SIZE, 1e-8), np.full((SIZE, FACTORS), 1e-8)
        values = [_values(r) for r in rows]
        for _ in range(EPOCHS):
            order = random.permutation(len(y))
            for start in range(0, len(y), BATCH):
                take = order[start : start + BATCH]
                at = np.concatenate([rows[i] for i in take])
                x = np.concatenate([values[i] for i in take])
                doc = np.repeat(np.arange(len(take)), [len(rows[i]) for i in take])
                begin = np.concatenate(([0], np.cumsum([len(rows[i]) for i in take])[:-1]))
                vx = v[at] * x[:, None]
                total = np.add.reduceat(vx, begin)
                z = bias + np.bincount(doc, w[at] * x, len(take))
                z += 0.5 * ((total**2).sum(1) - np.add.reduceat((vx**2).sum(1), begin))
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[take]) / len(take)
                cell = g[doc] * x
                cells, inverse = np.unique(at, return_inverse=True)
                grad_w = np.bincount(inverse, cell) + RIDGE * w[cells]
                pull = cell[:, None] * (total[doc] - vx)
                grad_v = np.stack([np.bincount(inverse, pull[:, f]) for f in range(FACTORS)], 1) + RIDGE * v[cells]
                seen_b += g.sum() ** 2
                bias -= RATE * g.sum() / math.sqrt(seen_b)
                seen_w[cells] += grad_w**2
                w[cells] -= RATE * grad_w / np.sqrt(seen_w[cells])
                seen_v[cells] += grad_v**2
                v[cells] -= RATE / 4 * grad_v / np.sqrt(seen_v[cells])
    return QualityModel(float(bias), w.astype(np.float32).tobytes(), v.astype(np.float32).tobytes())


def scorer(model: QualityModel) -> Callable[[str | None, int | None], float]:
    """Kernel: the probability of label 1, by the sum-of-squares identity."""
    w = np.frombuffer(model.linear, np.float32)
    v = np.frombuffer(model.factors, np.float32).reshape(-1, FACTORS)
    extract = extractor()

    def score(text: str | None, n_chars: int | None) -> float:
        at, x = extract(text, n_chars)
        vx = v[at] * x[:, None]
        z = model.bias + float(w[at] @ x) + 0.5 * float((vx.sum(0) ** 2).sum() - (vx * vx).sum())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    return score


def _plain(docs: DataFrame) -> DataFrame:
    n = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("t"), n.alias("n"))


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id, score, predicted`` for every row; empty and null texts are scored by their structure."""

    def make():
        score = scorer(model)

        def kernel(ids: list, texts: list, sizes: list):
            for i, t, n in zip(ids, texts, sizes, strict=True):
                p = score(t, n)
                yield i, p, int(p >= THRESHOLD)

        return kernel

    return arrow_map(_plain(docs), make, "doc_id long, score double, predicted int")


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from labels of ids whose crc32 mod 5 is not 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = score_quality(docs, fit(docs, labels, held=(5, 0)))
    return found.select("doc_id", fold("doc_id", 5, 0).alias("held_out"), "score", "predicted")
