"""Embedding near-duplicates: an exact metric range join.

Cosine >= c on unit vectors is Euclidean distance <= r with r^2 = 2 - 2c.  Pivots
partition the vectors into cells, each vector at home with its nearest pivot.  A
vector goes as a guest to every other cell that the triangle inequality cannot rule
out, so all partners of a cell's own vectors are in the cell and cells join
independently.  Equal vectors are one point with a count, and a cell is cut into a
grid of blocks, so no task holds more than two blocks whatever a cell holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import materialize
from .common import components

COSINE = 0.95
#: Points of a cell aimed at, pivots at most (they go to every task), rows of a block.
CELL_POINTS, MOST_PIVOTS, BLOCK_ROWS = 8192, 1024, 8192
#: Rows of a block compared at a time.
_STRIP = 256
#: Slack on the radius, far above the rounding of a cosine near the limit and far below any distance that matters.
_SLACK = 1e-9
#: Least distance of two pivots for the bound by the plane between them: nearer ones say nothing about a radius.
_APART = 1e-3


def _rounding(dim: int) -> float:
    """Most that a square of :func:`_distances` between unit vectors is off: about 2 (dim + 2) eps, taken 8 times.

    The distance itself is off by the root of this, near 0: 5e-7 in 64 dimensions.
    """
    return 16 * (dim + 8) * float(np.finfo(float).eps)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0))


def _between(centres: np.ndarray) -> np.ndarray:
    """Distances among pivots from differences: equal to rounding also where pivots are almost equal."""
    return np.stack([np.sqrt(((centres - c) ** 2).sum(1)) for c in centres])


def _matrix(blobs: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), dim)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def _scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, so that products neither overflow nor vanish; cosines stay as they are."""
    _, exponent = np.frexp(np.abs(x).max(1))
    return np.ldexp(x, -exponent[:, None])


def _key(column: str) -> list:
    """128 bits that stand for a vector where only its identity counts."""
    return [F.xxhash64(column).alias("h1"), F.xxhash64(F.lit(1), column).alias("h2")]


def _vectors(vectors: DataFrame, column: str) -> DataFrame:
    """``vec_id, x``: the vector as doubles without negative zeros, null where it cannot link."""
    x = F.transform(F.col(column).cast("array<double>"), lambda c: c + F.lit(0.0))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(valid(column), x).alias("x"))


def points(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """``node, h1, h2, least, n, dim, v``: different valid vectors, their smallest id and the number of copies.

    ``node`` numbers the vectors; it is fixed once the frame is kept.  An id that
    several vectors share is the smallest id of each of them.
    """
    rows = _vectors(vectors, column).where("vec_id IS NOT NULL AND x IS NOT NULL")
    grouped = rows.groupBy("x").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    grouped = grouped.select(F.monotonically_increasing_id().alias("node"), *_key("x"), "least", "n", "x")
    names = ["node", "h1", "h2", "least", "n"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, lists = batch.columns
            sizes = np.asarray(lists.value_lengths())
            values, ends = np.asarray(lists.flatten()), np.cumsum(sizes)
            blobs = [_scaled(values[None, e - s : e])[0].astype("<f8").tobytes() for s, e in zip(sizes, ends, strict=True)]
            columns = [*kept, pa.array(sizes, pa.int32()), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "dim", "v"])

    return grouped.mapInArrow(pack, ", ".join(f"{c} long" for c in names) + ", dim int, v binary")


def valid(column: str):
    """Whether a vector can link: not null, no null or non-finite component, not zero."""
    finite = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.coalesce(F.col(column).isNotNull() & finite & F.exists(column, lambda c: c != 0), F.lit(False))


def _guests(
    d: np.ndarray, home: np.ndarray, between: np.ndarray, reach: np.ndarray, r: float, rounding: float
) -> np.ndarray:
    """Which cells each vector must visit: no bound excludes a partner there.

    ``d`` holds distances to pivots, ``between`` those among pivots, ``reach`` the
    greatest distance of a cell's own vectors.  A partner y at home in j has
    d(y, j) <= d(y, home) and d(y, j) <= reach[j].  All of these are rounded, also
    those that y was dealt by: ``rounding`` bounds the error of a squared distance,
    and up to four distances stand in a bound (with two squares of pivots' lengths).
    """
    own = d[np.arange(len(d)), home]
    slack = 4 * np.sqrt(rounding)
    near = d - own[:, None] <= 2 * r + slack  # triangle inequality on both pivots
    near &= d <= reach[None, :] + r + slack  # triangle inequality on the cell's ball
    apart = between[home]
    # Distance from the plane between the pivots.
    plane = d * d - (own * own)[:, None] - 6 * rounding <= 2 * r * apart
    near &= plane | (apart < _APART)
    near[np.arange(len(d)), home] = False
    return near


def links(nodes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``a, b, n``: per point (b null) partial numbers of linked vectors, and links (n null) that join what is linked.

    ``nodes`` as of :func:`points`, durable.  Vectors of different lengths never link.
    """
    spark = nodes.sparkSession
    r = float(np.sqrt(2 - 2 * cosine)) + _SLACK
    sizes = {row[0]: row[1] for row in nodes.groupBy("dim").count().collect()}
    out = None
    for dim, total in sorted(sizes.items()):
        own = nodes.where(F.col("dim") == dim)
        pivots = min(MOST_PIVOTS, -(-total // CELL_POINTS))
        chosen = own.select("v", "node").orderBy(F.xxhash64("node"), "node").limit(pivots).collect()
        centres = _unit(_matrix([bytes(c[0]) for c in chosen], dim))
        found = _cells(spark, own.drop("dim"), dim, centres, r, cosine)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], "a long, b long, n long") if out is None else out


def _cells(spark: SparkSession, own: DataFrame, dim: int, centres: np.ndarray, r: float, cosine: float) -> DataFrame:
    def distances(x: np.ndarray) -> np.ndarray:
        return _distances(_unit(x), centres)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = distances(_matrix(batch.column(2).to_pylist(), dim))
                home = d.argmin(1)
                extra = [pa.array(home.astype(np.int32)), pa.array(d[np.arange(len(d)), home])]
                yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=["node", "n", "v", "home", "far"])

    settled = materialize(own.select("node", "n", "v").mapInArrow(settle, "node long, n long, v binary, home int, far double"))
    k = len(centres)
    reach, homes = np.full(k, -np.inf), np.zeros(k, np.int64)
    for row in settled.groupBy("home").agg(F.max("far"), F.count("*")).collect():  # one row per pivot
        reach[row[0]], homes[row[0]] = row[1], row[2]
    between, rounding = _between(centres), _rounding(dim)

    def visits(x: np.ndarray, home: np.ndarray) -> np.ndarray:
        return _guests(distances(x), home, between, reach, r, rounding)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += visits(_matrix(batch.column(0).to_pylist(), dim), np.asarray(batch.column(1))).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(total)], names=["cell", "n"])

    members = homes.copy()
    counted = settled.select("v", "home").mapInArrow(tally, "cell int, n long").groupBy("cell").agg(F.sum("n"))
    for row in counted.collect():  # one row per pivot
        members[row[0]] += row[1]
    high = np.maximum(1, -(-homes // BLOCK_ROWS))  # blocks of own vectors
    wide = np.maximum(1, -(-members // BLOCK_ROWS))  # blocks of own vectors and guests

    names = ["cell", "row", "col", "mine", "node", "n", "v"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                node, home = np.asarray(batch.column(0)), np.asarray(batch.column(3))
                stay = visits(_matrix(batch.column(2).to_pylist(), dim), home)
                stay[np.arange(len(home)), home] = True
                place = (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
                parts = []
                for cell in np.nonzero(stay.any(0))[0]:
                    here = np.nonzero(stay[:, cell])[0]
                    mine = here[home[here] == cell]
                    for col in range(wide[cell]):  # an own vector against every block of the cell
                        parts.append((cell, (place[mine] % np.uint64(high[cell])).astype(np.int32), col, 1, mine))
                    for row in range(high[cell]):  # any vector of the cell against every block of own ones
                        parts.append((cell, row, (place[here] % np.uint64(wide[cell])).astype(np.int32), 0, here))
                for cell, row, col, mine, rows in parts:
                    if len(rows):
                        full = lambda x, m=len(rows): pa.array(np.broadcast_to(np.asarray(x, np.int32), m))
                        taken = batch.take(pa.array(rows))
                        columns = [full(cell), full(row), full(col), full(mine), *taken.columns[:3]]
                        yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "cell int, row int, col int, mine int, node long, n long, v binary"
    laid = settled.mapInArrow(spread, schema).repartition("cell", "row", "col")
    laid = laid.sortWithinPartitions("cell", "row", "col", "mine", "node")
    result = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            yield from (pa.RecordBatch.from_arrays(c, schema=result) for c in _compare(block, dim, cosine))

    return laid.mapInArrow(join, "a long, b long, n long")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Blocks (rows of equal cell, row and col) of sorted batches; a block may go over several batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([np.asarray(batch.column(i)) for i in range(3)], 1)
        cuts = [0, *(np.nonzero((keys[1:] != keys[:-1]).any(1))[0] + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            key = tuple(keys[a])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _compare(block: pa.Table, dim: int, cosine: float) -> Iterator[list[pa.Array]]:
    """Numbers of linked vectors of the block's own points, and links that span what they join."""
    mine, node, n = (np.asarray(block.column(i)) for i in (3, 4, 5))
    x = _matrix(block.column(6).to_pylist(), dim)
    length = np.sqrt((x * x).sum(1))
    own, all_ = np.nonzero(mine == 1)[0], np.nonzero(mine == 0)[0]
    ids, label = np.unique(node, return_inverse=True)
    group = np.arange(len(ids))  # smallest point joined so far
    edges: list[tuple[int, int]] = []
    linked = np.zeros(len(own), np.int64)
    for at in range(0, len(own), _STRIP):
        strip = own[at : at + _STRIP]
        near = (x[strip] @ x[all_].T) / (length[strip, None] * length[None, all_]) >= cosine
        near &= label[strip, None] != label[None, all_]
        linked[at : at + _STRIP] = near @ n[all_]
        for i in np.nonzero(near.any(1))[0]:
            to = label[all_[near[i]]]
            roots = np.unique(np.append(group[to], group[label[strip[i]]]))
            if len(roots) > 1:
                group[np.isin(group, roots)] = roots[0]
                edges += [(root, roots[0]) for root in roots[1:]]
    hit = np.nonzero(linked)[0]
    if len(hit):
        yield [pa.array(node[own[hit]]), pa.nulls(len(hit), pa.int64()), pa.array(linked[hit])]
    if edges:
        a, b = (ids[list(e)] for e in zip(*edges, strict=True))
        yield [pa.array(a), pa.array(b), pa.nulls(len(edges), pa.int64())]


def near_vectors(vectors: DataFrame, column: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``, one row each.

    Vectors that are null, zero, empty or hold a null or non-finite component link
    with nothing, nor does a row without an id (its component is null).  Equal rows
    that repeat count as links of each other.  Where rows share an id but not the
    vector, each has the links and the component of its own vector.
    """
    nodes = materialize(points(vectors, column))
    found = materialize(links(nodes.select("node", "n", "dim", "v"), cosine))
    numbers = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("near"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    placed = nodes.select("node", "h1", "h2", "least", "n").join(numbers, "node", "left").join(roots, "node", "left")
    placed = placed.withColumn("root", F.coalesce("root", "node"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    n_links = (F.col("n") - 1 + F.coalesce("near", F.lit(0))).cast("long").alias("n_links")
    placed = placed.join(smallest, "root").select("h1", "h2", n_links, "component_id")
    # A row finds its class by the key of its vector, unique there; a vector that very many rows share is split by AQE.
    rows = _vectors(vectors, column).select("vec_id", F.col("x").isNotNull().alias("linked"), *_key("x"))
    linked = F.col("linked") & F.col("vec_id").isNotNull()
    whole = rows.where(linked).join(placed, ["h1", "h2"], "left").select("vec_id", "n_links", "component_id")
    alone = rows.where(~linked).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    return whole.union(alone).select("*", kept)


def embeddings_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate links of all embeddings."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
