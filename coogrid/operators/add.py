"""Element-wise sums: one union and one aggregation on the position."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.semiring import Semiring, semiring as resolve
from ..matrix import COL, ROW, VAL, Matrix


def ewise_add(
    A: Matrix,
    B: Matrix,
    semiring: str | Semiring = "or_and",
    add: Callable[[Column], Column] | None = None,
) -> Matrix:
    """Union of the patterns; values that meet are combined by the semiring's ``add``.

    A position held by one operand only keeps its value.
    """
    A.require_same_shape(B)
    sr = resolve(semiring, None, add)
    if sr.pattern_only:
        return Matrix(A.extract_pairs().union(B.extract_pairs()).distinct(), *A.shape)
    a, b = (m if m.valued else m.with_ones(sr.one) for m in (A, B))
    both = a.df.select(ROW, COL, VAL).union(b.df.select(ROW, COL, VAL))
    return Matrix(both.groupBy(ROW, COL).agg(sr.add(F.col(VAL)).alias(VAL)), *A.shape)


def axpby_matrix(alpha: float, A: Matrix, beta: float, B: Matrix) -> Matrix:
    """``alpha*A + beta*B``; a sum that comes to 0 stays stored."""
    a, b = (m if m.valued else m.with_ones() for m in (A, B))
    return ewise_add(a.scaled(alpha), b.scaled(beta), "plus_times")
