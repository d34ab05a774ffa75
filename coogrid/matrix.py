"""The sparse matrix: a DataFrame of entries plus a shape."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .plans.durable import materialize

ROW, COL, VAL = "row_id", "col_id", "val"


def _checked(index: Column, size: int, what: str) -> Column:
    """``index`` itself, or a query failure naming the value when missing or out of bounds.

    The outer coalesce never acts.  It tells the optimizer that the index cannot be
    NULL, so joins on rows and joins on columns infer no filters of their own and
    share one scan and one shuffle of the entries.
    """
    message = F.concat(
        F.lit(f"{what} index out of bounds for size {size}: "),
        F.coalesce(index.cast("string"), F.lit("NULL")),
    )
    inside = (index >= 0) & (index < F.lit(size))
    return F.coalesce(F.when(inside, index).otherwise(F.raise_error(message)), F.lit(-1))


#: Steps of a plan that are not worth running twice.
_COSTLY = re.compile(r"^\W*(Join|Generate|Window|MapIn\w+|FlatMap\w+)\b", re.MULTILINE)


@dataclass(frozen=True)
class Matrix:
    """Entries ``(row_id BIGINT, col_id BIGINT[, val])`` without duplicates, 0-based.

    The shape is metadata: trailing empty rows leave no trace in the entries.  The
    entries are unordered until :meth:`ordered`.
    """

    df: DataFrame
    nrows: int
    ncols: int
    #: The entries before repeats were dropped, where that is cheaper to count than ``df``.
    raw: DataFrame | None = None

    @classmethod
    def from_edges(
        cls,
        df: DataFrame,
        row: str,
        col: str,
        nrows: int,
        ncols: int,
        val: str | None = None,
        dup: str = "first",
        order: str | None = None,
        check: bool = True,
    ) -> Matrix:
        """Build from an edge list.

        Without ``val`` repeated pairs collapse.  With ``val`` the rule is ``sum``,
        ``max``, ``min`` or ``first``; the last one means first along ``order``.
        """
        r, c = F.col(row).cast("long"), F.col(col).cast("long")
        if check:
            r, c = _checked(r, nrows, "row"), _checked(c, ncols, "column")
        if val is None:
            stated = df.select(r.alias(ROW), c.alias(COL))
            return cls(stated.distinct(), nrows, ncols, stated)
        if dup == "first":
            if order is None:
                raise ValueError("dup='first' needs an order column: rows of a DataFrame have none")
            rule = F.min_by(VAL, "__order")
        else:
            rule = {"sum": F.sum, "max": F.max, "min": F.min}[dup](VAL)
        missing = F.concat_ws(" ", F.lit("no value at"), F.col(row), F.col(col))
        value = F.when(F.col(val).isNotNull(), F.col(val)).otherwise(F.raise_error(missing)) if check else F.col(val)
        kept = [r.alias(ROW), c.alias(COL), value.alias(VAL)]
        if order is not None:
            kept.append(F.col(order).alias("__order"))
        stated = df.select(*kept)
        return cls(stated.groupBy(ROW, COL).agg(rule.alias(VAL)), nrows, ncols, stated.select(ROW, COL))

    @property
    def shape(self) -> tuple[int, int]:
        return self.nrows, self.ncols

    @property
    def valued(self) -> bool:
        return VAL in self.df.columns

    @property
    def columns(self) -> list[str]:
        return [ROW, COL, VAL] if self.valued else [ROW, COL]

    def nvals(self) -> int:
        """Number of stored entries (an action)."""
        return self.df.count()

    def pattern(self) -> Matrix:
        """Positions only."""
        return replace(self, df=self.df.select(ROW, COL))

    def with_ones(self, dtype: str = "bigint") -> Matrix:
        """The pattern with value 1.  ``decimal(38,0)`` leaves room where counts may pass 2**63."""
        return replace(self, df=self.df.select(ROW, COL, F.lit(1).cast(dtype).alias(VAL)))

    def scaled(self, alpha: float) -> Matrix:
        return replace(self, df=self.df.select(ROW, COL, (F.lit(alpha) * F.col(VAL)).alias(VAL)))

    def transposed(self) -> Matrix:
        swap = [F.col(COL).alias(ROW), F.col(ROW).alias(COL)]
        raw = None if self.raw is None else self.raw.select(*swap)
        return Matrix(self.df.select(*swap, *([VAL] if self.valued else [])), self.ncols, self.nrows, raw)

    def sizing(self) -> DataFrame:
        """Positions to count rows and columns by; may hold repeats."""
        return self.df if self.raw is None else self.raw

    def extract_pairs(self) -> DataFrame:
        """The positions as two plain columns."""
        return self.df.select(ROW, COL)

    def ordered(self) -> DataFrame:
        """Entries in (row, column) order: a range shuffle and local sorts that spill."""
        return self.df.orderBy(ROW, COL)

    def persist(self) -> Matrix:
        """Cache the entries for several uses; recomputed when an executor is lost."""
        return replace(self, df=self.df.persist(), raw=None)

    def unpersist(self) -> Matrix:
        self.df.unpersist()
        return self

    def materialized(self, by: Sequence[str] = ()) -> Matrix:
        """Keep the entries in the shared folder, optionally laid out by ``by``."""
        df = self.df
        if by:
            df = df.repartition(*by).sortWithinPartitions(*by)
        return replace(self, df=materialize(df), raw=None)

    def once(self, by: Sequence[str] = ()) -> Matrix:
        """This matrix, kept in the shared folder and laid out by ``by`` where working it out again would cost.

        A cached or kept frame and one that only scans, filters and drops repeats stay as
        they are; one with a join, a window or code of its own is evaluated here, once.
        """
        plan = self.sizing()._jdf.queryExecution().withCachedData().toString()
        return self.materialized(by) if _COSTLY.search(plan) and "InMemoryRelation" not in plan else self

    def require_same_shape(self, other: Matrix) -> None:
        if self.shape != other.shape:
            raise ValueError(f"shapes differ: {self.shape} and {other.shape}")
