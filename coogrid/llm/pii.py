"""Personal data by weak supervision.

Four base kinds are exact patterns.  Beyond them, candidates (marked tokens and
number runs) get votes of regex, gazetteer and context labelers; expectation
maximisation over the counts of vote patterns of the whole corpus estimates how far
each labeler can be trusted, and a span classifier is trained on the resulting
probabilities and decides which candidates are spans.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import materialize
from .common import arrow_map, slices, small_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "contact", "number", "secret")
#: Candidates the classifier is trained on, about, and the probability from which a candidate is a span.
SAMPLE_CANDIDATES, THRESHOLD = 20_000, 0.8
FEATURE_BITS = 12
#: Characters before and after a candidate that labelers and features see.
CONTEXT = 24

Span = tuple[str, int, int]

# Base patterns.  Possessive runs and starts at the first digit of a run match what the plain patterns match, in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield "email", start, end
            at = text.find("@", end)
        else:
            # The next local part can't reach over this mark.
            end, at = max(end, at), text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """Spans of the base kinds, by kind as listed and then start; code points, end exclusive."""
    found = list(_emails(text)) if "@" in text else []
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found.append(("phone", *m.span()))
    return found


# Candidates: tokens with a digit or an at sign, and runs of digits with separators.
_MARK = re.compile(r"[0-9@]\S*")
_NUMBER = re.compile(r"\(?[0-9](?:[ ().-]{0,2}[0-9]){6,}")
_EDGE = "\"'`.,;:!?()[]{}<>|#$%&*=/"


def candidates(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Spans worth a vote that do not touch a span already taken, by start."""
    if not text or not ("@" in text or _DIGIT.search(text)):
        return []
    found: list[tuple[int, int]] = [m.span() for m in _NUMBER.finditer(text)]
    end = 0
    for m in _MARK.finditer(text):
        start, stop = m.span()
        while start > end and not text[start - 1].isspace():
            start -= 1
        end = stop
        # A token such as token="abc" is cut at its last quote or equals sign before the mark.
        inner = max(text.rfind(c, start, m.start()) for c in "\"'=") + 1
        start = max(start, inner)
        while start < stop and text[start] in _EDGE:
            start += 1
        while stop > start and text[stop - 1] in _EDGE:
            stop -= 1
        for c in "\"'":
            cut = text.find(c, start, stop)
            stop = cut if cut >= 0 else stop
        if stop - start > 2:
            found.append((start, stop))
    busy = sorted((a, b) for _, a, b in taken)
    kept: list[tuple[int, int]] = []
    i, last = 0, 0
    for a, b in sorted(found, key=lambda s: (s[0], -s[1])):
        while i < len(busy) and busy[i][1] <= a:
            i += 1
        if a >= last and not (i < len(busy) and busy[i][0] < b):
            kept.append((a, b))
            last = b
    return kept


# Words that stand before personal data, and words that stand before other numbers.
_PERSONAL = re.compile(
    r"token|passw|secret|api.?key|\bkey\b|bearer|auth|\bpin\b|iban|\bssn\b|account|\btel|phone|mobile|\bfax\b|e-?mail"
    r"|contact|\bcall\b|konto|cuenta|compte|téléphone|teléfono|\bhandy\b",
    re.IGNORECASE,
)
_IMPERSONAL = re.compile(
    r"version|chapter|\bpage|section|licen[cs]e|figure|\bisbn\b|\byear\b|\bv\.?$|\bno\.?$|by-nc|\bpart\b", re.IGNORECASE
)
_HEX = re.compile(r"[0-9a-fA-F]{32,}")
_PLAIN_NUMBER = re.compile(r"(?:v?\d{1,4}(?:[.,]\d{1,3}){0,2}%?|\d{4}-\d\d-\d\d|\d\d?:\d\d(?::\d\d)?)")


@dataclass(frozen=True)
class Seen:
    """A candidate with what stands around it."""

    token: str
    before: str
    after: str

    @property
    def digits(self) -> int:
        return sum("0" <= c <= "9" for c in self.token)

    @property
    def letters(self) -> int:
        return sum(map(str.isalpha, self.token))


def _vote(yes: bool, no: bool = False) -> int:
    return 1 if yes else -1 if no else 0


#: Labelers by name: 1 personal, -1 not, 0 abstains.
LABELERS: dict[str, Callable[[Seen], int]] = {
    "regex_hex": lambda s: _vote(bool(_HEX.fullmatch(s.token))),
    "regex_mixed": lambda s: _vote(len(s.token) >= 20 and s.digits >= 3 and s.letters >= 3, len(s.token) < 6),
    "regex_phone": lambda s: _vote(9 <= s.digits <= 12 and not s.letters and any(c in s.token for c in " ()-.")),
    "regex_address": lambda s: _vote("@" in s.token[1:-1]),
    "regex_plain": lambda s: _vote(False, bool(_PLAIN_NUMBER.fullmatch(s.token))),
    "regex_checksum": lambda s: _vote(False, not s.letters and 13 <= s.digits <= 19),
    "gazetteer_personal": lambda s: _vote(bool(_PERSONAL.search(s.before))),
    "gazetteer_other": lambda s: _vote(False, bool(_IMPERSONAL.search(s.before))),
    "context_assigned": lambda s: _vote(s.before.rstrip(" \"'")[-1:] in ("=", ":") and s.before != ""),
    "context_spread": lambda s: _vote(len(s.token) >= 16 and len(set(s.token)) >= 10, len(set(s.token)) <= 3),
}


def _seen(text: str, a: int, b: int) -> Seen:
    return Seen(text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT])


def votes(s: Seen) -> str:
    """The vote pattern: one of ``+ - 0`` per labeler."""
    return "".join("0+-"[f(s)] for f in LABELERS.values())


def features(s: Seen) -> list[int]:
    """Hashed features of a candidate: shape, length, mixture, neighbours."""
    shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", s.token[:256])))[:8]
    n = max(1, len(s.token))
    words = [
        f"shape {shape}", f"length {min(20, n // 3)}", f"digits {10 * s.digits // n}", f"letters {10 * s.letters // n}",
        f"before {s.before[-1:]}", f"after {s.after[:1]}", f"hex {bool(_HEX.fullmatch(s.token))}",
        f"word {(re.findall(r'[^\W\d_]+', s.before.lower()) or [''])[-1]}", f"spread {min(12, len(set(s.token)))}",
        f"at {'@' in s.token}",
    ]
    return sorted({zlib.crc32(w.encode()) & ((1 << FEATURE_BITS) - 1) for w in words})


def reliabilities(counts: dict[str, int], rounds: int = 100) -> tuple[float, np.ndarray, dict[str, float]]:
    """Expectation maximisation over vote patterns.

    Gives the share of personal candidates, per labeler the distribution of its votes
    (abstain, for, against) in either class, and the probability of each pattern.
    It starts from the majority of votes; a pattern of abstentions starts low.
    """
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    v = np.array([["0+-".index(c) for c in p] for p in patterns])
    net = (v == 1).sum(1) - (v == 2).sum(1)
    q = np.where(net > 0, 0.9, 0.1)
    prior, table = 0.5, np.zeros((v.shape[1], 2, 3))
    for _ in range(rounds):
        weight = np.stack([n * (1 - q), n * q])
        prior = (weight[1].sum() + 1) / (n.sum() + 2)
        for j in range(v.shape[1]):
            for y in (0, 1):
                table[j, y] = np.bincount(v[:, j], weight[y], 3) + 0.5
        table /= table.sum(2, keepdims=True)
        score = np.log(prior / (1 - prior)) + sum(
            np.log(table[j, 1, v[:, j]] / table[j, 0, v[:, j]]) for j in range(v.shape[1])
        )
        q = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return prior, table, dict(zip(patterns, q.tolist(), strict=True))


def _train(rows: list[list[int]], y: np.ndarray, n: np.ndarray, steps: int = 300) -> np.ndarray:
    """Logistic regression on probabilities, each row with its weight ``n``; the last weight of the model is the bias."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    cell = np.array([f for r in rows for f in r], int)
    w = np.zeros((1 << FEATURE_BITS) + 1)
    total = np.full_like(w, 1e-8)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(w[-1] + np.bincount(at, w[cell], len(rows)), -30, 30)))
        g = n * (y - p) / n.sum()
        grad = np.append(np.bincount(cell, g[at], len(w) - 1), g.sum()) - 1e-5 * w
        total += grad * grad
        w += 0.3 * grad / np.sqrt(total)
    return w


@dataclass(frozen=True)
class SpanModel:
    """Classifier weights (none: no candidate is a span) and the labelers' estimated votes."""

    weights: bytes
    reliability: tuple[tuple[str, float, float], ...]


def fit(docs: DataFrame, text: str = "text") -> SpanModel:
    """Reliabilities from the vote patterns of all documents, the classifier from a sample of their candidates.

    There are at most ``3 ** len(LABELERS)`` patterns, so their counts are few
    whatever the corpus.  Without candidates the model adds nothing.

    Candidates with equal votes and features are one row with their number n.  With
    s the share that ``SAMPLE_CANDIDATES`` are of all candidates, a row is drawn with
    probability s n by the hash of its content: always from n = 1 / s on, with weight
    n, else with weight 1 / s.  So about ``SAMPLE_CANDIDATES`` rows at most are drawn,
    and the weights stand for all candidates however often one repeats.
    """

    def make():
        def kernel(texts: list) -> Iterator[tuple]:
            for t in texts:
                if t:
                    for a, b in candidates(t, base_spans(t)):
                        s = _seen(t, a, b)
                        yield votes(s), np.array(features(s), np.int16).tobytes()

        return kernel

    plain = docs.select(F.col(text).cast("string").alias("t"))
    found = materialize(arrow_map(plain, make, "pattern string, features binary"))
    counts = {r[0]: r[1] for r in found.groupBy("pattern").count().collect()}
    if not counts:
        return SpanModel(b"", ())
    _, table, belief = reliabilities(counts)
    share = min(1.0, SAMPLE_CANDIDATES / sum(counts.values()))
    place = F.pmod(F.xxhash64("pattern", "features"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    grouped = found.groupBy("pattern", "features").agg(F.count("*").alias("n")).where(place < F.col("n") * F.lit(share))
    sample = sorted((r[0], bytes(r[1]), r[2]) for r in grouped.collect())
    cells = [np.frombuffer(r[1], np.int16).tolist() for r in sample]
    y = np.array([belief[r[0]] for r in sample])
    w = _train(cells, y, np.maximum(np.array([r[2] for r in sample], float), 1 / share))
    trust = tuple((n, float(table[j, 1, 1]), float(table[j, 0, 2])) for j, n in enumerate(LABELERS))
    return SpanModel(w.astype(np.float32).tobytes(), trust)


def finder(model: SpanModel) -> Callable[[str | None], tuple[list[Span], list[Span]]]:
    """Kernel: base spans and added spans of a text; a null text has none."""
    w = np.frombuffer(model.weights, np.float32)
    cut = float(np.log(THRESHOLD / (1 - THRESHOLD)))

    def kind(s: Seen) -> str:
        return "contact" if "@" in s.token else "secret" if s.letters else "number"

    def find(text: str | None) -> tuple[list[Span], list[Span]]:
        if not text:
            return [], []
        base = base_spans(text)
        if not len(w):
            return base, []
        added = []
        for a, b in candidates(text, base):
            s = _seen(text, a, b)
            if w[-1] + w[features(s)].sum() >= cut:
                added.append((kind(s), a, b))
        return base, added

    return find


def _joined(spans: list[Span]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1])))


def find_spans(docs: DataFrame, model: SpanModel, text: str = "text") -> DataFrame:
    """Counts, digest and spans of every row; ids repeat as given."""

    def make():
        find = finder(model)

        def kernel(ids: list, texts: list) -> Iterator[tuple]:
            for i, t in zip(ids, texts, strict=True):
                base, added = find(t)
                counts = [sum(s[0] == k for s in base) for k in BASE_KINDS]
                yield i, *counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + added)

        return kernel

    plain = docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias("t"))
    columns = [f"n_{k} long" for k in BASE_KINDS]
    return arrow_map(plain, make, ", ".join(["doc_id long", *columns, "base_sha256 string", "spans string"]))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; of overlapping spans the first one's kind stands for all."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their spans redacted, with the columns they came with; ``n_chars`` follows the text."""
    model = fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(model)
        for part in slices(batches):
            names = part.schema.names
            texts = part.column(names.index("text")).to_pylist()
            spans = [sum(find(t), []) for t in texts]
            new = [redacted(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
            columns = list(part.columns)
            columns[names.index("text")] = pa.array(new, part.schema.field("text").type)
            if "n_chars" in names:
                at = names.index("n_chars")
                kept = [len(n) if s else c for n, s, c in zip(new, spans, columns[at].to_pylist(), strict=True)]
                columns[at] = pa.array(kept, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return small_batches(docs).mapInArrow(run, docs.schema)


def pii_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_spans(docs, fit(docs))
