"""Importance resampling towards a target distribution.

Hashed word and word-pair counts of the corpus and of the target give every bucket a
gain, the log of the ratio of its two smoothed shares; a document weighs the mean
gain of its features.  Weights plus Gumbel noise from the id rank the documents, and
the highest are drawn without replacement.

The cutoff is found by weighted median of medians: every partition gives the median
of the keys it has left, the median of these weighted by the keys left is the pivot,
and at least a quarter of all keys lies on each side of it, so each round discards a
guaranteed fraction, until the cutoff is one exact key.  Only the winners are sorted.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import drop_cut, materialize
from ..plans.ordered import ranked
from .common import slices

#: Buckets of hashed features, words that a drawable document has at least, share drawn in percent, salt of the noise.
BUCKETS, LEAST_WORDS, PERCENT, SALT = 10_000, 20, 25, "7"
#: Keys among which the cutoff is picked directly, and keys of a partition when the rest is written anew.
LAST_KEYS, PART_KEYS = 1024, 1 << 18
#: Bytes of a text taken apart at a time.
_BLOCK = 1 << 20
_CACHE = 200_000


def _letters() -> bytes:
    """Byte table: A-Z become a-z, digits, a-z and all bytes beyond ASCII stay, the rest is a space."""
    table = bytearray(range(256))
    for c in range(128):
        low = c + 32 if 0x41 <= c <= 0x5A else c
        table[c] = low if 0x30 <= low <= 0x39 or 0x61 <= low <= 0x7A else 0x20
    return bytes(table)


_TABLE = _letters()


class _Crcs(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHE:
            self.clear()
        value = self[word] = crc32(word)
        return value


def hashed(text: bytes | None, crcs: dict[bytes, int]) -> Iterator[np.ndarray]:
    """CRCs of the words and of the pairs of neighbours of a text, block by block; words come before pairs."""
    data = (text or b"").translate(_TABLE)
    at, before = 0, None
    while at < len(data):
        end = data.find(b" ", at + _BLOCK)
        end = len(data) if end < 0 else end
        words = data[at:end].split()
        at = end
        if words:
            own = [crcs[w] for w in words]
            # A CRC goes on from that of the word before.
            first = own if before is not None else own[:-1]
            left = first if before is None else [before, *own[:-1]]
            right = words if before is not None else words[1:]
            pairs = list(map(crc32, [b" " + w for w in right], left))
            before = own[-1]
            yield np.array(own + pairs, np.uint32)


def bucket_counts(docs: DataFrame, column: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows; a task sends one number per bucket it met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crcs, total = _Crcs(), np.zeros(buckets, np.int64)
        for part in slices(batches):
            for text in part.column(0).to_pylist():
                for codes in hashed(text, crcs):
                    total += np.bincount(codes % buckets, minlength=buckets)
        met = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], names=["bucket", "n"])

    found = np.zeros(buckets, np.int64)
    parts = docs.select(_utf8(column)).mapInArrow(count, "bucket int, n long")
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # ``buckets`` rows at most
        found[row["bucket"]] = row["n"]
    return found


def _utf8(column: str) -> Column:
    return F.col(column).cast("string").cast("binary")


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of the smoothed shares of each bucket."""
    n = len(corpus)
    up, down = float(corpus.sum() + n), float(target.sum() + n)
    ratios = zip(corpus.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((t + 1.0) * up / ((s + 1.0) * down))) for s, t in ratios], np.int64)


def noise(doc_id: int | None, salt: str = SALT) -> int:
    """Gumbel noise in thousandths, from the id alone; a null id counts as an empty one."""
    digest = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return math.floor(-1000 * math.log(-math.log((int(digest[:8], 16) + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, column: str = "text", salt: str = SALT) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row: one pass, an array lookup per feature."""
    names = ["doc_id", "n_words", "n_features", "weight", "score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crcs = _Crcs()
        for part in slices(batches):
            ids, rows = part.column(0).to_pylist(), []
            for doc_id, text in zip(ids, part.column(1).to_pylist(), strict=True):
                total = n = 0
                for codes in hashed(text, crcs):
                    n += len(codes)
                    total += int(gain[codes % len(gain)].sum())
                weight = total // n if n else 0
                rows.append((doc_id, (n + 1) // 2, n, weight, weight + noise(doc_id, salt)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _utf8(column))
    return plain.mapInArrow(score, ", ".join(f"{n} long" for n in names))


# A key is (-score, whether the id is null, id or 0, number of the row): the smallest are drawn.
_KEY = ["a", "b", "c", "d"]
Key = tuple[int, int, int, int]


def _keys() -> list[Column]:
    return [
        (-F.col("score")).alias("a"),
        F.col("doc_id").isNull().cast("long").alias("b"),
        F.coalesce("doc_id", F.lit(0)).cast("long").alias("c"),
        F.col("__row").alias("d"),
    ]


def _below(key: Key, strict: bool) -> Column:
    """Whether a row of keys lies before ``key``, or at it."""
    last = F.col("d") < key[3] if strict else F.col("d") <= key[3]
    for name, value in list(zip(_KEY, key, strict=True))[2::-1]:
        last = (F.col(name) < value) | ((F.col(name) == value) & last)
    return last


def _halves(keys: DataFrame, pivot: Key | None) -> list[tuple[int, int, Key]]:
    """Per partition and side of the pivot that has keys: side (0 before, 1 after), their number, their median."""

    def medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([c.to_numpy() for c in b.columns], 1) for b in batches if b.num_rows]
        k = np.concatenate(held) if held else np.zeros((0, 4), np.int64)
        k = k[np.lexsort(k.T[::-1])]
        before = len(k) if pivot is None else _place(k, pivot)
        after = before + (before < len(k) and pivot is not None and tuple(k[before]) == pivot)
        sides = [(side, part) for side, part in ((0, k[:before]), (1, k[after:])) if len(part)]
        for side, part in sides:
            row = [side, len(part), *part[(len(part) - 1) // 2].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in row], names=["side", "n", *_KEY])

    found = keys.mapInArrow(medians, "side long, n long, a long, b long, c long, d long").collect()
    return [(r[0], r[1], tuple(r[2:])) for r in found]


def _place(k: np.ndarray, key: Key) -> int:
    """How many rows of the sorted ``k`` lie before ``key``."""
    lo, hi = 0, len(k)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if tuple(k[mid]) < key else (lo, mid)
    return lo


def _weighted_median(medians: list[tuple[int, Key]]) -> Key:
    """Least median up to which at least half of the keys stand in partitions of no greater one."""
    medians = sorted(medians, key=lambda m: m[1])
    half, seen = sum(n for n, _ in medians), 0
    for n, key in medians:
        seen += 2 * n
        if seen >= half:
            return key
    raise ValueError("no keys")


def cutoff(keys: DataFrame, need: int, last_keys: int = LAST_KEYS) -> Key:
    """The ``need``-th smallest of the keys ``a, b, c, d``, all different.

    A round is one job that returns one or two rows per partition: how many keys lie
    on each side of the pivot, and the median of either side, from which the next
    pivot comes.  Keys out of the race are left out of what the next rounds read once
    they are most of it; when ``last_keys`` are left the cutoff is picked among them.
    """
    lo = hi = None
    kept, own = keys, False
    chosen = [(n, key) for _, n, key in _halves(kept, None)]
    left = stored = sum(n for n, _ in chosen)
    while left > last_keys:
        pivot = _weighted_median(chosen)
        sides = _halves(_within(kept, lo, hi), pivot)
        before = sum(n for side, n, _ in sides if side == 0)
        if need == before + 1:
            break
        if need <= before:
            hi, side = pivot, 0
        else:
            lo, side, need = pivot, 1, need - before - 1
        chosen = [(n, key) for s, n, key in sides if s == side]
        left = sum(n for n, _ in chosen)
        if left * 8 < stored:
            parts = max(1, -(-left // PART_KEYS))
            fewer = materialize(_within(kept, lo, hi).coalesce(parts))
            if own:
                drop_cut(kept)
            kept, stored, own = fewer, left, True
    else:
        rest = sorted(tuple(r) for r in _within(kept, lo, hi).collect())  # ``last_keys`` at most
        pivot = rest[need - 1]
    if own:
        drop_cut(kept)
    return pivot


def _within(keys: DataFrame, lo: Key | None, hi: Key | None) -> DataFrame:
    if lo is not None:
        keys = keys.where(~_below(lo, strict=False))
    return keys if hi is None else keys.where(_below(hi, strict=True))


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, last_keys: int = LAST_KEYS) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of :func:`weigh`'s; rank is null where not drawn."""
    rows = materialize(scored.withColumn("__row", F.monotonically_increasing_id()))
    fit = F.col("n_words") >= least_words
    able = rows.where(fit)
    take = percent * able.count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not take:
        return rows.select(*columns, none)
    last = cutoff(able.select(*_keys()), take, last_keys)
    keyed = rows.select("*", fit.alias("__fit"), *_keys())
    drawn = F.col("__fit") & _below(last, strict=False)
    placed = ranked(keyed.where(drawn).select(*columns, *_KEY), _KEY, "__pos")
    return placed.select(*columns, (F.col("__pos") + 1).alias("rank")).union(keyed.where(~drawn).select(*columns, none))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    salt: str = SALT,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document; the drawn ones have rank 1, 2, 3, ...

    ``percent`` of the documents of ``least_words`` words or more are drawn, those of
    the highest score; ties go to the smaller id, null ids last.  Of rows that repeat
    an id and its score, one after the other is drawn, in no stated order.  A null or
    empty text has no features and weight 0.  Texts are taken whole, block by block.
    Empty tables give every bucket the same gain, or no rows.  Other columns are not
    read.  Texts are read twice and never shuffled; the driver holds one gain per
    bucket and one or two medians per partition.
    """
    gain = gains(bucket_counts(docs, "text", buckets), bucket_counts(target, "text", buckets))
    return draw(weigh(docs, gain, salt=salt), percent, least_words)


def resampling_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn towards the benchmark texts."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return resample(docs, target)


RESAMPLING_SQL = r"""
WITH bytes AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k:
    CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
texts AS (
  SELECT TRUE AS own, doc_id, row_number() OVER () AS r, text FROM documents
  UNION ALL SELECT FALSE, NULL, -row_number() OVER (), text FROM benchmark),
words AS (
  SELECT own, doc_id, r, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
features AS (
  SELECT own, r, unnest(w) AS f FROM words
  UNION ALL SELECT own, r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words),
hexes AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM features)),
codes AS (
  SELECT f, xor(list_reduce(list_concat([4294967295::BIGINT],
    list_transform(range(1, length(h) + 1, 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM hexes, bytes),
hit AS (SELECT own, r, bucket FROM features JOIN codes USING (f)),
counts AS (
  SELECT b AS bucket, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t
  FROM range(10000) x(b) LEFT JOIN hit ON bucket = b GROUP BY b),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * ((SELECT count(*) FROM hit WHERE own) + 10000.0::DOUBLE)
    / ((s + 1.0::DOUBLE) * ((SELECT count(*) FROM hit WHERE NOT own) + 10000.0::DOUBLE)))) AS BIGINT) AS g FROM counts),
weights AS (
  SELECT r, count(*) AS n_features, sum(g)::BIGINT AS total FROM hit JOIN gain USING (bucket) WHERE own GROUP BY r),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features,
    CASE WHEN n_features IS NULL THEN 0
         ELSE (total - ((total % n_features) + n_features) % n_features) // n_features END AS weight,
    ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM words LEFT JOIN weights USING (r) WHERE own),
noisy AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM scored),
placed AS (
  SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS place,
    count(*) FILTER (n_words >= 20) OVER () AS n FROM noisy)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM placed
"""
