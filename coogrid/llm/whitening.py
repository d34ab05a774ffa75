"""Embedding whitening by polarisation.

The covariance of two dimensions follows from three variances,
2 cov(i, j) = var(i + j) - var(i) - var(j), so the only second moments gathered from
the data are sums of squared centred values: one for every dimension and one for
every sum of two dimensions.  Entries are whole numbers, all sums are exact, and
the matrix that ``eigh`` gets is the true covariance, rounded once per entry.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

#: Components returned, units of a fixed-point entry in 1, and what is added to it.
COMPONENTS, UNITS, SHIFT = 8, 1024, 100_000
#: Rows of one vectorised step.
_STEP = 4096
#: Numbers below this bound can be added, squared and summed over a step in 64 bits.
_SMALL = 1 << 24
#: Eigenvalues below this share of the largest one are rounding of 0.
_LEAST = 1e-12


def fixed_point(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """``vec_id, dim, x``: vectors without null or non-finite entries, entry c as floor(1024 c) + 100000.

    An entry too large for a BIGINT fails the query.
    """
    c = F.col(column).cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), c.alias("c"))
    finite = F.forall("c", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    rows = rows.where(F.coalesce(F.col("c").isNotNull() & finite, F.lit(False)))

    def whole(e):
        scaled = F.floor(e * F.lit(float(UNITS)))
        wide = F.raise_error(F.concat(F.lit("entry out of range: "), e.cast("string"))).cast("long")
        return F.when(F.abs(e) < float(1 << 52), scaled + F.lit(SHIFT)).otherwise(wide)

    return rows.select("vec_id", F.size("c").alias("dim"), F.transform("c", whole).alias("x"))


def _groups(batches: Iterator[pa.RecordBatch], ids: bool = False) -> Iterator[tuple]:
    """Steps of equally long vectors: ``dim, matrix of BIGINT`` and, if asked for, ``vec_id``; columns dim, x[, vec_id]."""
    for batch in slices(batches, _STEP):
        sizes = batch.column(0).to_numpy()
        ends = np.cumsum(sizes)
        values = batch.column(1).flatten().to_numpy()
        for dim in np.unique(sizes):
            here = np.nonzero(sizes == dim)[0]
            x = values[(ends[here] - dim)[:, None] + np.arange(dim)[None, :]]
            yield (int(dim), x, batch.column(2).take(pa.array(here))) if ids else (int(dim), x)


def _exact(x: np.ndarray) -> np.ndarray:
    """``x``, as Python numbers where 64 bits might not hold what is computed from it."""
    return x if not x.size or max(int(x.max()), -int(x.min())) < _SMALL else x.astype(object)


_SUMS = pa.schema([("dim", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("s", pa.string())])


def _sums(totals: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Square arrays of exact sums as rows ``dim, i, j, s``."""
    for dim, total in totals.items():
        i, j = (a.ravel().astype(np.int32) for a in np.indices(total.shape))
        columns = [np.full(len(i), dim, np.int32), i, j, [str(v) for v in total.ravel()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SUMS.types, strict=True)], schema=_SUMS)


def _collected(df: DataFrame, kernel) -> dict[int, dict[tuple[int, int], int]]:
    """Exact sums per length and place: one number per task and place is shuffled, one per place reaches the driver."""
    parts = df.select("dim", "x").mapInArrow(kernel, "dim int, i int, j int, s string")
    summed = parts.groupBy("dim", "i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found: dict[int, dict[tuple[int, int], int]] = {}
    for r in summed.collect():
        found.setdefault(r["dim"], {})[r["i"], r["j"]] = int(r["s"])
    return found


def _add(totals: dict[int, np.ndarray], dim: int, part: np.ndarray) -> None:
    part = part.astype(object)
    totals[dim] = totals[dim] + part if dim in totals else part


class Fit:
    """Mean and covariance of the vectors of one length, exact, and their components.

    ``total`` are the sums per dimension, ``squares[i, i]`` the sum of squares of the
    values centred on the whole part of the mean, ``squares[i, j]`` that of the sum
    of two such values.
    """

    def __init__(self, n: int, total: list[int]):
        self.n, self.total = n, total
        self.floor = [s // n for s in total]
        self.rest = [s % n for s in total]  # n times what the whole part leaves of the mean

    @property
    def mean_rest(self) -> np.ndarray:
        return np.array([r / self.n for r in self.rest])

    def solve(self, squares: dict[tuple[int, int], int]) -> None:
        d, n = len(self.total), self.n

        def variance(i: int, j: int) -> int:
            """n^2 times the variance of a dimension or of the sum of two: what the whole part left is taken back."""
            rest = self.rest[i] if i == j else self.rest[i] + self.rest[j]
            return n * squares[i, j] - rest * rest

        own = [variance(i, i) for i in range(d)]
        cov = np.zeros((d, d))
        for i in range(d):
            cov[i, i] = Fraction(own[i], n * n)
            for j in range(i):
                cov[i, j] = cov[j, i] = Fraction(variance(j, i) - own[i] - own[j], 2 * n * n)
        trace = float(Fraction(sum(own), n * n))
        values, vectors = np.linalg.eigh(cov)
        k = min(COMPONENTS, d)
        self.values, self.vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
        live = self.values > _LEAST * max(values[-1], 0.0) if trace else np.zeros(k, bool)
        self.scale = np.where(live, 1 / np.sqrt(np.where(live, self.values, 1.0)), np.nan)
        self.explained = self.values / trace if trace else np.zeros(k)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x`` less the whole part of the mean: exact."""
        return _exact(x) - np.array(self.floor, object if max(map(abs, self.floor), default=0) >= _SMALL else np.int64)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        y = self.centred(x).astype(float) - self.mean_rest
        return (y @ self.vectors) * self.scale

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2, exact."""
        y = self.centred(x)
        bound = self.n * (max(int(y.max()), -int(y.min())) + 1)
        kind = np.int64 if bound < 1 << 31 and bound * bound * y.shape[1] < 1 << 63 else object
        z = y.astype(kind) * self.n - np.array(self.rest, kind)
        return (z * z).sum(1).tolist()


def fit(x: DataFrame) -> dict[int, Fit]:
    """Components per vector length; ``x`` as of :func:`fixed_point`.

    Two passes that shuffle only sums: the mean, then the squares about it.
    """

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for dim, rows in _groups(batches):
            whole = np.abs(rows).max(initial=0) >= 1 << 50
            sums = (rows.astype(object) if whole else rows).sum(0)
            _add(totals, dim, np.append(np.asarray(sums, object), len(rows))[None, :])  # the last place counts rows
        yield from _sums(totals)

    fits = {}
    for dim, sums in _collected(x.where("dim > 0"), means).items():
        fits[dim] = Fit(sums[0, dim], [sums[0, j] for j in range(dim)])

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for dim, rows in _groups(batches):
            y = np.ascontiguousarray(_exact(fits[dim].centred(rows)).T)
            found = np.zeros((dim, dim), object)
            for i in range(dim):
                pair = y[i:] + y[i]
                pair[0] = y[i]
                found[i, i:] = (pair * pair).sum(1)
            _add(totals, dim, found)
        yield from _sums(totals)

    for dim, sums in _collected(x.where("dim > 0"), squares).items() if fits else ():
        fits[dim].solve(sums)
    return fits


def identity_errors(x: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """Per length the largest absolute entry of the whitened values' covariance less the identity.

    Measured on the whitened values of all rows; components without variance are left out.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for dim, rows in _groups(batches):
            w = fits[dim].whiten(rows)
            w = np.hstack([w, np.ones((len(w), 1))])
            totals[dim] = totals[dim] + w.T @ w if dim in totals else w.T @ w
        for dim, total in totals.items():
            i, j = (a.ravel() for a in np.indices(total.shape))
            columns = [np.full(len(i), dim), i, j, total.ravel()]
            types = [pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["dim", "i", "j", "s"])

    if not fits:
        return {}
    parts = x.where("dim > 0").select("dim", "x").mapInArrow(moments, "dim int, i int, j int, s double")
    found = {}
    for r in parts.groupBy("dim", "i", "j").agg(F.sum("s").alias("s")).collect():  # 81 numbers a length
        found.setdefault(r["dim"], {})[r["i"], r["j"]] = r["s"]
    errors = {}
    for dim, sums in found.items():
        k, n = len(fits[dim].scale), fits[dim].n
        gram = np.array([[sums[i, j] / n for j in range(k + 1)] for i in range(k + 1)])
        cov = gram[:k, :k] - np.outer(gram[:k, k], gram[:k, k])
        live = ~np.isnan(fits[dim].scale)
        error = np.abs(cov - np.eye(k))[np.ix_(live, live)]
        errors[dim] = float(error.max()) if error.size else 0.0
    return errors


_OUT = pa.schema(
    [("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64())]
    + [("deviation_exact", pa.decimal128(38, 0))]
    + [(c, pa.float64()) for c in ("whitened", "explained", "identity_error")]
)


def whiten(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """One row per valid vector and component:
    ``vec_id, component, n, deviation, deviation_exact, whitened, explained, identity_error``.

    Rows whose vector is null or holds a null or non-finite entry are dropped; they
    take no part in the fit.  A null id stays null and repeated rows are rows like
    others.  Vectors of different lengths are fitted apart, each length by its own
    rows (``n`` counts them); a vector of d < 8 entries has d components and an empty
    one none.  A component without variance (eigenvalue below 1e-12 of the largest)
    has whitened null, and explained is 0 where nothing varies.  ``deviation`` is null
    where it exceeds a BIGINT; ``deviation_exact`` holds it always.  Other columns are
    not read.  Only sums per dimension and pair of dimensions reach the driver.
    """
    x = fixed_point(vectors, column)
    fits = fit(x)
    errors = identity_errors(x, fits)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, values, ids in _groups(batches, ids=True):
            f, m = fits[dim], len(values)
            k = len(f.scale)
            w = f.whiten(values)
            exact = f.deviations(values)
            short = [v if v < 1 << 63 else None for v in exact]
            again = pa.array(np.repeat(np.arange(m), k))
            columns = [
                ids.take(again),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, f.n)),
                pa.array(short, pa.int64()).take(again),
                pa.array(exact, pa.decimal128(38, 0)).take(again),
                pa.array(w.ravel(), mask=np.isnan(w.ravel())),
                pa.array(np.tile(f.explained, m)),
                pa.array(np.full(m * k, errors[dim])),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=_OUT)

    schema = "vec_id long, component int, n long, deviation long, deviation_exact decimal(38,0), whitened double, explained double, identity_error double"
    return x.where("dim > 0").select("dim", "x", "vec_id").mapInArrow(rows, schema)


def whitening_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight leading whitened components of all embeddings."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
