"""Krylov solvers for sparse systems.

The vectors of one solve live in one table ``idx, x, r, p, ...``, so an iteration
is a product with A plus column arithmetic; the driver holds scalars only.  A is
laid out by column index once and kept in the shared folder; every iteration ends
in the shared folder too, so its lineage stays one step long and a lost executor
costs one step at most.  The scalars of an iteration are sums observed while its
vectors are being kept, so the state is not read again for them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..matrix import COL, ROW, VAL, Matrix, _checked
from ..plans.durable import drop_cut, materialize
from ..plans.skew import Stripes
from .vector import IDX, diagonal


#: Share of a sum of squares below which a difference of such sums is not trusted.
_CANCELLED = 1e-8


@dataclass(frozen=True)
class Solution:
    """Result vector and how it was reached; running out of iterations is not an error."""

    x: DataFrame
    iterations: int
    residual: float
    converged: bool


class _Operator:
    """A matrix prepared for many products with changing vectors."""

    def __init__(self, A: Matrix, cell: int | None = None):
        if A.nrows != A.ncols:
            raise ValueError(f"a square system is needed, not {A.shape}")
        a = A if A.valued else A.with_ones()
        entries = a.df.select(F.col(COL).alias("__k"), ROW, F.col(VAL).cast("double").alias("__a"))
        # Hub columns are cut into stripes; a vector entry goes to every stripe of its column.
        self.stripes = Stripes(entries, ["__k"], cell)
        layout = self.stripes.on
        entries = self.stripes.cut(entries, by=[ROW]).repartition(*layout).sortWithinPartitions(*layout)
        self.entries = materialize(entries)

    def times(self, vector: DataFrame) -> DataFrame:
        """``idx, q`` for the vector ``idx, v``; rows without a stored entry are absent."""
        v = vector.select(F.col(IDX).alias("__k"), "v")
        met = self.entries.join(self.stripes.copy(v), self.stripes.on)
        return met.groupBy(F.col(ROW).alias(IDX)).agg(F.sum(F.col("__a") * F.col("v")).alias("q"))

    def drop(self) -> None:
        """Delete the layout; the vectors of a solve are kept without it."""
        drop_cut(self.entries)


def _scalars(df: DataFrame, **exprs: Column) -> dict[str, float]:
    row = df.agg(*(F.coalesce(F.sum(e), F.lit(0.0)).alias(n) for n, e in exprs.items())).first()
    return {n: float(row[n]) for n in exprs}


def _start(A: Matrix, b: DataFrame, precond: str, x0: DataFrame | None, op: _Operator) -> DataFrame:
    """``idx, x, b, m``: the start vector, its residual as ``b`` and the inverse preconditioner ``m``.

    Every index of the system takes part; one that ``b`` or ``x0`` leave out counts
    as 0, one outside the system fails the query.
    """
    if precond not in ("identity", "diagonal"):
        raise ValueError(f"unknown preconditioner {precond!r}")

    def given(vector: DataFrame, name: str) -> DataFrame:
        return vector.select(_checked(F.col(IDX), A.nrows, name).alias(IDX), F.col(VAL).cast("double").alias(name))

    every = A.df.sparkSession.range(A.nrows).select(F.col("id").alias(IDX))
    # A full join lets an index outside the system reach its check.
    rhs = every.join(given(b, "b"), IDX, "full").withColumn("b", F.coalesce("b", F.lit(0.0)))
    if x0 is None:
        rhs = rhs.withColumn("x", F.lit(0.0))
    else:
        rhs = rhs.join(given(x0, "x"), IDX, "full").withColumn("x", F.coalesce("x", F.lit(0.0)))
        product = op.times(rhs.select(IDX, F.col("x").alias("v")))
        rhs = rhs.join(product, IDX, "left").withColumn("b", F.col("b") - F.coalesce("q", F.lit(0.0))).drop("q")
    if precond == "identity":
        return rhs.withColumn("m", F.lit(1.0))
    inverse = diagonal(A, inverse=True).select(IDX, F.col(VAL).alias("m"))
    return rhs.join(inverse, IDX, "left").withColumn("m", F.coalesce("m", F.lit(1.0)))


class _State:
    """The vectors of a solve, cut after every product; a cut is dropped when its successor is complete."""

    def __init__(self, df: DataFrame):
        self.df = self._cut = materialize(df.repartition(IDX))

    def keep(self, df: DataFrame) -> None:
        old, self._cut = self._cut, materialize(df)
        self.df = self._cut
        drop_cut(old)

    def with_product(self, op: _Operator, v: Column, out: str, **sums: Column) -> dict[str, float]:
        """Add ``out`` = A ``v`` to the state, keep it, and return the sums over it: one action."""
        product = op.times(self.df.select(IDX, v.alias("v"))).withColumnRenamed("q", out)
        joined = self.df.join(product, IDX, "left").withColumn(out, F.coalesce(out, F.lit(0.0)))
        seen = Observation()
        self.keep(joined.observe(seen, *(F.sum(e).alias(n) for n, e in sums.items())))
        return {n: float(seen.get[n] or 0.0) for n in sums}


def cg(
    A: Matrix,
    b: DataFrame,
    rtol: float = 1e-3,
    atol: float = 0.0,
    max_iter: int = 100,
    precond: str = "identity",
    x0: DataFrame | None = None,
) -> Solution:
    """Conjugate gradients for symmetric positive definite ``A x = b`` from ``x0``, or from 0.

    Stops when the residual norm falls to ``max(rtol * |b - A x0|, atol)``, at once where it is 0.
    """
    op = _Operator(A)
    x, r, p, s, w, m = (F.col(c) for c in "xrpswm")
    zero = F.lit(0.0)
    start = _start(A, b, precond, x0, op).select(IDX, "x", F.col("b").alias("r"), "m", zero.alias("p"), zero.alias("s"))
    kept = _State(start)
    # Each iteration multiplies the preconditioned residual, so both of its scalar products come from one pass;
    # the product with the direction follows by recurrence.
    sums = {"rr": r * r, "rz": r * r * m, "curvature": m * r * w}
    at = kept.with_product(op, m * r, "w", **sums)
    norm, rz, curvature, beta = at["rr"] ** 0.5, at["rz"], at["curvature"], 0.0
    goal, done = max(rtol * norm, atol), 0
    while norm > goal and done < max_iter and curvature != 0.0:
        step = rz / curvature
        state = kept.df.withColumns({"p": m * r + F.lit(beta) * p, "s": w + F.lit(beta) * s})
        kept.df = state.withColumns({"x": x + F.lit(step) * p, "r": r - F.lit(step) * s}).drop("w")
        at = kept.with_product(op, m * r, "w", **sums)
        norm, beta, done = at["rr"] ** 0.5, (at["rz"] / rz if rz else 0.0), done + 1
        rz = at["rz"]
        curvature = at["curvature"] - (beta * rz / step if step else 0.0)
    op.drop()
    return Solution(kept.df.select(IDX, x.alias(VAL)), done, norm, norm <= goal)


def bicgstab(
    A: Matrix,
    b: DataFrame,
    rtol: float = 1e-3,
    atol: float = 0.0,
    max_iter: int = 100,
    precond: str = "identity",
    x0: DataFrame | None = None,
) -> Solution:
    """Stabilised bi-conjugate gradients for general square ``A x = b`` from ``x0``, or from 0."""
    op = _Operator(A)
    r, p, m, s = F.col("r"), F.col("p"), F.col("m"), F.col("s")
    start = _start(A, b, precond, x0, op).select(
        IDX,
        "x",
        F.col("b").alias("r"),
        F.col("b").alias("r0"),
        F.col("b").alias("p"),
        "m",
    )
    kept = _State(start)
    v, t, r0 = F.col("v"), F.col("t"), F.col("r0")
    rho = _scalars(kept.df, rr=r * r)["rr"]
    norm, done = rho**0.5, 0
    goal = max(rtol * norm, atol)
    while norm > goal and done < max_iter and rho != 0.0:
        shadow = kept.with_product(op, m * p, "v", rv=r0 * v)["rv"]
        if shadow == 0.0:
            break
        alpha = rho / shadow
        kept.df = kept.df.withColumn("s", r - F.lit(alpha) * v)
        at = kept.with_product(op, m * s, "t", ts=t * s, tt=t * t, ss=s * s, shadow_s=r0 * s, shadow_t=r0 * t)
        omega = at["ts"] / at["tt"] if at["tt"] else 0.0
        state = kept.df.withColumns(
            {
                "x": F.col("x") + F.lit(alpha) * m * p + F.lit(omega) * m * s,
                "r": s - F.lit(omega) * t,
            }
        )
        # The products of the new residual s - omega t follow from those of s and t.
        rr, before = at["ss"] - 2 * omega * at["ts"] + omega * omega * at["tt"], rho
        if rr <= max(_CANCELLED * at["ss"], goal * goal):  # too few digits are left, or the end is near: added anew
            rr = _scalars(state, rr=r * r)["rr"]
        rho = at["shadow_s"] - omega * at["shadow_t"]
        beta = (rho / before) * (alpha / omega) if omega else 0.0
        state = state.withColumn("p", r + F.lit(beta) * (p - F.lit(omega) * v))
        kept.df = state.drop("v", "s", "t")
        norm, done = rr**0.5, done + 1
        if omega == 0.0:
            break
    op.drop()
    return Solution(kept.df.select(IDX, F.col("x").alias(VAL)), done, norm, norm <= goal)
