"""Best-fit packing of token sequences by linear grouping.

Only lengths matter for packing and there are at most ``CAPACITY`` of them, so the
plan is made on their histogram, whatever the number of documents.  Large lengths
are rounded up within groups of equal cardinality; the configuration programme over
those few sizes is solved by column generation; actual lengths then take the places
of the rounded ones, and small lengths go best-fit into the room that is left.  The
plan says how many sequences have which lengths at which offsets; documents find
their place by their rank among those of the same length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.durable import materialize
from .common import arrow_map, unused
from .tokens import VOCABULARY, encoder

CAPACITY = 2048
END_ID = 0
#: Groups that large lengths are rounded within, and the least share of a sequence that is large.
GROUPS, LARGE = 128, 0.42
_ROUNDS = 1500


@dataclass(frozen=True)
class Run:
    """``count`` sequences from number ``first`` on hold a piece of ``length`` at ``offset``."""

    length: int
    count: int
    first: int
    offset: int


def group_lengths(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Lengths with counts, largest first, cut into groups of equal cardinality; a length may lie in several."""
    total = sum(counts.values())
    size = -(-total // max(1, min(groups, total)))
    cut: list[list[tuple[int, int]]] = [[]]
    room = size
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                cut.append([])
                room = size
            n = min(left, room)
            cut[-1].append((length, n))
            left -= n
            room -= n
    return [g for g in cut if g]


def _best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits (unbounded knapsack, one layer per item)."""
    rooms = np.arange(capacity + 1)
    left = rooms[None, :] - sizes[:, None]
    fits, left = left >= 0, np.maximum(left, 0)
    best, chosen = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        value = np.where(fits, best[left] + worth[:, None], -1.0)
        at = value.argmax(0)
        value = value[at, rooms]
        better = value > best + 1e-12
        chosen.append(np.where(better, at, -1))
        best = np.where(better, value, best)
    pattern, room = np.zeros(len(sizes), int), capacity
    for layer in reversed(chosen):
        if layer[room] >= 0:
            pattern[layer[room]] += 1
            room -= int(sizes[layer[room]])
    return float(best[capacity]), pattern


def solve_configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns with whole counts, none above the demand, from the fractional optimum rounded down.

    Column generation with the revised simplex method: the basis has one pattern per
    size, and its inverse is updated by one elementary step per pattern that enters.
    """
    s, b = np.array(sizes), np.array(demand, float)
    k = len(s)
    basis = np.diag(capacity // s).astype(float)
    inverse = np.diag(1.0 / (capacity // s))
    for _ in range(_ROUNDS):
        value, pattern = _best_pattern(s, np.maximum(inverse.sum(0), 0), capacity)
        if value <= 1 + 1e-7:
            break
        level, direction = (inverse * b).sum(1), (inverse * pattern).sum(1)
        steps = np.where(direction > 1e-9, level / np.maximum(direction, 1e-9), np.inf)
        leaves = int(steps.argmin())
        basis[:, leaves] = pattern
        row = inverse[leaves] / direction[leaves]
        inverse -= direction[:, None] * row[None, :]
        inverse[leaves] = row
    level = (inverse * b).sum(1)
    return [(basis[:, j].astype(int), n) for j in range(k) if (n := int(level[j] + 1e-7)) > 0]


class _Open:
    """Sequences with room, alike ones together: (room, contents) with a count."""

    def __init__(self) -> None:
        self.rooms: list[int] = []
        self.by_room: dict[int, dict[tuple, int]] = {}

    def add(self, contents: tuple, count: int, room: int) -> None:
        if room not in self.by_room:
            self.by_room[room] = {}
            insort(self.rooms, room)
        self.by_room[room][contents] = self.by_room[room].get(contents, 0) + count

    def tightest(self, length: int) -> int | None:
        at = bisect_left(self.rooms, length)
        return self.rooms[at] if at < len(self.rooms) else None

    def take(self, room: int, most: int) -> tuple[tuple, int]:
        held = self.by_room[room]
        contents, count = held.popitem()
        n = min(count, most)
        if n < count:
            held[contents] = count - n
        if not held:
            del self.by_room[room]
            self.rooms.pop(bisect_left(self.rooms, room))
        return contents, n


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[list[Run], int]:
    """Places for all pieces of a length histogram, and the number of sequences."""
    small_below = max(1, int(capacity * LARGE))
    large = {n: c for n, c in histogram.items() if small_below < n < capacity}
    opened = _Open()
    rest = {n: c for n, c in histogram.items() if n <= small_below}
    if full := histogram.get(capacity, 0):
        opened.add((capacity,), full, 0)
    if large:
        cut = group_lengths(large, groups)
        # Groups rounded to the same length are one size.
        by_size: dict[int, list[tuple[int, int]]] = {}
        for g in cut:
            by_size.setdefault(g[0][0], []).extend(g)
        sizes = sorted(by_size, reverse=True)
        queues = [list(reversed(by_size[n])) for n in sizes]
        demand = [sum(c for _, c in by_size[n]) for n in sizes]
        for pattern, count in solve_configurations(sizes, demand, capacity):
            slots = [i for i, n in enumerate(pattern) for _ in range(n)]
            while count:
                # As many sequences as hold the same actual lengths; a queue gives its longest first.
                used = {i: slots.count(i) for i in slots}
                if any(not queues[i] or sum(c for _, c in queues[i]) < n for i, n in used.items()):
                    break
                take = min([count, *(max(1, queues[i][-1][1] // n) for i, n in used.items())])
                contents = []
                for i, n in used.items():
                    for _ in range(n):
                        left = take
                        length, c = queues[i][-1]
                        if c < left:  # only where take is 1
                            left = c
                        queues[i][-1] = (length, c - left)
                        if c == left:
                            queues[i].pop()
                        contents.append(length)
                opened.add(tuple(contents), take, capacity - sum(contents))
                count -= take
        for q in queues:
            for length, c in q:
                if c:
                    rest[length] = rest.get(length, 0) + c
    # Best fit, longest first: what rounding left over, then the small lengths.
    for length in sorted(rest, reverse=True):
        left = rest[length]
        while left:
            room = opened.tightest(length)
            if room is None:
                per = capacity // length
                n, over = divmod(left, per)
                if n:
                    opened.add((length,) * per, n, capacity - per * length)
                if over:
                    opened.add((length,) * over, 1, capacity - over * length)
                break
            contents, n = opened.take(room, left)
            opened.add((*contents, length), n, room - length)
            left -= n
    runs, first = [], 0
    for room in opened.rooms:
        for contents, count in opened.by_room[room].items():
            offset = 0
            for length in contents:
                runs.append(Run(length, count, first, offset))
                offset += length
            first += count
    return runs, first


def token_pieces(docs: DataFrame, text: str = "text", path: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: documents as ids and an end mark, long ones cut.

    A document is its ids followed by ``END_ID``; a null text is empty.  Only documents
    above ``capacity`` are cut, into pieces of exactly that many ids but for a shorter first one.
    """

    def make() -> Callable[[list, list], Iterator[tuple]]:
        encode = encoder(path)

        def kernel(ids: list, texts: list) -> Iterator[tuple]:
            for i, t in zip(ids, texts, strict=True):
                content = np.array([*encode(t or ""), END_ID], "<u4")
                n = len(content)
                cuts = [0, *range(n % capacity or capacity, n, capacity), n] if n > capacity else [0, n]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    yield i, piece, a, b - a, zlib.crc32(content[a:b].tobytes())

        return kernel

    plain = docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias("t"))
    return arrow_map(plain, make, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id, offset`` to pieces of lengths 1 to ``capacity``; other columns stay, but for any of these two names.

    The histogram on the driver has at most ``capacity`` rows and the plan a number of
    runs bounded by it.  Pieces of equal length are numbered within salts, so a
    length that a third of all pieces have is still spread over all tasks; an
    empty table gives an empty result.
    """
    pieces = materialize(pieces.drop("sequence_id", "offset"))
    salt, rank, before, n = unused(pieces, "__salt", "__rank", "__before", "__n")
    salts = max(1, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    columns_ = [F.col(f"`{c}`") for c in pieces.columns]
    salted = pieces.withColumn(salt, F.pmod(F.xxhash64(*columns_), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", salt).agg(F.count("*").alias(n))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum(n)).collect()}
    if any(not 0 < n <= capacity for n in histogram):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    runs, _ = plan(histogram, capacity)
    runs.sort(key=lambda r: r.length)
    lengths = np.array([r.length for r in runs], np.int64)
    sizes = np.array([r.count for r in runs], np.int64)
    ends = np.cumsum(sizes)
    first = np.array([r.first for r in runs], np.int64)
    offsets = np.array([r.offset for r in runs], np.int64)
    # Runs lie one after the other, by length: a piece's place is where its length begins plus its rank.
    begins = np.zeros(capacity + 2, np.int64)
    if len(runs):
        begins[: capacity + 1] = np.concatenate(([0], ends))[np.searchsorted(lengths, np.arange(capacity + 1))]
    earlier = Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", salt, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    inside = Window.partitionBy("length", salt).orderBy(*columns_)
    ranked = salted.withColumn(rank, F.row_number().over(inside) - 1).join(starts, ["length", salt])
    ranked = ranked.select(*columns_, (F.col(before) + F.col(rank)).alias(rank))
    kept = [f for f in pieces.schema.fields]
    names = pieces.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "sequence_id long, offset long"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = np.asarray(batch.column(names.index("length")))
            at = begins[length] + np.asarray(batch.column(len(names)))
            run = np.searchsorted(ends, at, side="right")
            number = first[run] + at - (ends[run] - sizes[run])
            columns = [*batch.columns[: len(names)], pa.array(number), pa.array(offsets[run])]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the documents."""
    return pack(token_pieces(docs))


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most ``CAPACITY`` ids."""
    return pack(token_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))
