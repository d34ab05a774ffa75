"""SimHash near-duplicates through an inverted index of positional bytes.

Two 64-bit fingerprints that differ in at most two bits share at least six of
their eight positional bytes.  A posting of the index holds the fingerprints that
share one choice of six bytes, so a pair meets in a posting exactly when its tally
of shared bytes reaches that minimum, and pairs below it never meet.  Within a
posting two bytes are free: it has at most 65,536 different fingerprints however
many documents there are, and a pair is verified by its differing bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import materialize
from .common import arrow_map, components, unused

SHINGLE_WORDS, SEED, MOST_BITS = 3, 42, 2
BYTES = 8
#: Bytes that any linked pair shares at least: each differing bit spoils one byte at most.
LEAST_SHARED = BYTES - MOST_BITS
#: Shingles hashed at a time; a longer text is tallied in parts.
_PART = 1 << 15
#: Postings up to this size are compared pair by pair, larger ones by listing near values.
_SMALL = 256


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash; 0 for a null text or one without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    width = min(SHINGLE_WORDS, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(first), _PART):
        spans = zip(first[at : at + _PART], last[at : at + _PART], strict=True)
        hashes = np.array([h(joined[a:b], SEED) for a, b in spans], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(first)).view(">u8")[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, th, fp`` of every row: a hash of the text and the fingerprint as a signed long."""

    def make():
        def kernel(ids: list, hashes: list, texts: list):
            for i, h, t in zip(ids, hashes, texts, strict=True):
                value = fingerprint(t)
                yield i, h, value - (1 << 64) if value >> 63 else value

        return kernel

    t = F.col(text).cast("string")
    plain = docs.select(F.col("doc_id").cast("long"), F.xxhash64(t).alias("th"), t.alias("t"))
    return arrow_map(plain, make, "doc_id long, th long, fp long")


def _masks() -> list[int]:
    """One signed mask per choice of ``LEAST_SHARED`` positional bytes."""
    found = []
    for chosen in combinations(range(BYTES), LEAST_SHARED):
        mask = sum(0xFF << (8 * b) for b in chosen)
        found.append(mask - (1 << 64) if mask >> 63 else mask)
    return found


def _joined(values: np.ndarray, free: np.ndarray) -> np.ndarray:
    """For sorted different fingerprints of a posting, the index of the smallest one reachable by links."""
    n = len(values)
    root = np.arange(n)
    if n <= _SMALL:
        near = np.bitwise_count(values[:, None] ^ values[None, :]) <= MOST_BITS
        a, b = np.nonzero(np.triu(near, 1))
    else:
        # The two free bytes as a 16-bit number: all numbers within two bits of it are looked up in a table.
        table = np.full(1 << 16, -1)
        table[free] = root
        flips = [1 << i for i in range(16)]
        flips += [x | y for x, y in combinations(flips, 2)]
        found = [(root[hit >= 0], hit[hit >= 0]) for hit in (table[free ^ f] for f in flips)]
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        differ = root[a] != root[b]
        a, b = a[differ], b[differ]
    return root


def links(nodes: DataFrame) -> DataFrame:
    """Links ``a, b`` that join the fingerprints ``fp`` (all different) into their components.

    Every posting gives a spanning set of its links, not all pairs; together they
    connect what all links connect.
    """
    masks = _masks()
    fp = F.col("fp")
    entries = F.array(*(F.struct(F.lit(c).alias("c"), fp.bitwiseAND(F.lit(m)).alias("key")) for c, m in enumerate(masks)))
    posted = nodes.select("fp", F.explode(entries).alias("e")).select("e.c", "e.key", "fp")
    posted = posted.repartition("c", "key").sortWithinPartitions("c", "key", "fp")
    free_bytes = [
        [b for b in range(BYTES) if not (m >> (8 * b)) & 0xFF] for m in (x & 0xFFFFFFFFFFFFFFFF for x in masks)
    ]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the last posting of a batch may go on in the next
        for c, key, value in _postings(batches, held):
            low, high = free_bytes[c]
            bits = value.view(np.uint64)
            free = (((bits >> np.uint64(8 * high)) & np.uint64(255)) << np.uint64(8)) | (
                (bits >> np.uint64(8 * low)) & np.uint64(255)
            )
            root = _joined(bits, free.astype(np.int64))
            at = np.nonzero(root != np.arange(len(root)))[0]
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(value[at]), pa.array(value[root[at]])], schema=schema)

    return posted.mapInArrow(near, "a long, b long")


def _postings(batches: Iterator[pa.RecordBatch], held: list) -> Iterator[tuple[int, int, np.ndarray]]:
    """Postings of two or more fingerprints from rows sorted by (c, key, fp)."""
    carry = None
    for batch in batches:
        c, key, fp = (np.asarray(x) for x in batch.columns)
        if carry is not None:
            c, key, fp = (np.concatenate(x) for x in zip(carry, (c, key, fp), strict=True))
        if not len(c):
            continue
        cuts = np.nonzero((c[1:] != c[:-1]) | (key[1:] != key[:-1]))[0] + 1
        starts = np.concatenate(([0], cuts))
        carry = tuple(x[starts[-1] :].copy() for x in (c, key, fp))
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True) if (np.diff(starts) > 1).any() else ():
            if e - s > 1:
                yield int(c[s]), int(key[s]), fp[s:e]
    if carry is not None and len(carry[0]) > 1:
        yield int(carry[0][0]), int(carry[1][0]), carry[2]


def _grouped(docs: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Fingerprinted rows, and ``fp, least`` for each fingerprint: least (doc_id, th) of its component."""
    rows = materialize(fingerprints(docs, text))
    # Copies of a fingerprint are one node: equal texts, however many, meet only in this pre-aggregated minimum.
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "th"))
    nodes = materialize(rows.groupBy("fp").agg(F.min(named).alias("least")))
    roots = components(links(nodes.select("fp")))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    placed = placed.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("least"))
    return rows, placed.select("fp", "root").join(smallest, "root").select("fp", "least")


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` for every row.

    Rows are linked when their fingerprints differ in ``MOST_BITS`` bits or fewer;
    ``component_id`` is the smallest id reachable.  Texts without words have
    fingerprint 0 and are linked like any other.  A row with a null id is
    fingerprinted and carries links but names no component; repeated ids come back
    as often as given.
    """
    rows, named = _grouped(docs, text)
    return rows.join(named, "fp").select("doc_id", "fp", F.col("least.doc_id").alias("component_id"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest id, with the columns it came with.

    Of rows that share that id one text stays, and one row of it.  Rows with a null
    id stay: no id tells them apart.
    """
    rows, named = _grouped(docs, "text")
    id_, th = unused(docs, "__id", "__th")
    kept = named.select(F.col("least.doc_id").alias(id_), F.col("least.th").alias(th)).distinct()
    counts = rows.groupBy(F.col("doc_id").alias(id_), F.col("th").alias(th)).agg(F.count("*").alias("__copies"))
    kept = kept.join(counts, [id_, th])
    keyed = docs.withColumns({id_: F.col("doc_id").cast("long"), th: F.xxhash64(F.col("text").cast("string"))})
    single = keyed.join(kept.where("__copies = 1"), [id_, th], "left_semi")
    # Repeats of whole (id, text) pairs: the pre-aggregated first row, however many there are.
    repeated = keyed.join(kept.where("__copies > 1"), [id_, th], "left_semi").dropDuplicates([id_, th])
    whole = single.unionByName(repeated).unionByName(keyed.where(F.col(id_).isNull()))
    return whole.select(*(F.col(f"`{c}`") for c in docs.columns))


def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
