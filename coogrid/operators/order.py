"""Sorting, merging and neighbour comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..matrix import COL, ROW, Matrix
from ..plans.ordered import dense_width, ranked, scan, with_previous

#: Copies that one record stands for after the first and the second cut of a long run.
COPY_CUTS = (1 << 32, 1 << 16)


def int_div(a: Column, b: int) -> Column:
    """Whole-number quotient of a non-negative BIGINT (``/`` would go through DOUBLE)."""
    return F.call_function("div", a, F.lit(b).cast("long"))


def ordered_positions(A: Matrix) -> DataFrame:
    """Entries with their 0-based place in (row, column) order: ``pos`` added."""
    return ranked(A.df, [ROW, COL])


def sort_by_key(
    df: DataFrame, key: str, pos: str, ascending: bool = True, out: str = "rank"
) -> DataFrame:
    """Stable sort by ``key``: rows keep their ``pos`` order within a key; place in ``out``.

    (key, pos) has no ties, so the range shuffle also splits a key that holds a
    large share of the rows.
    """
    return ranked(df, [F.col(key).asc() if ascending else F.col(key).desc(), F.col(pos).asc()], out)


def _cut_runs(runs: DataFrame, cols: list[str], size: int) -> DataFrame:
    """Cut runs ``__start, __n`` into runs of at most ``size`` copies."""
    pieces = F.sequence(F.lit(0).cast("long"), int_div(F.col("__n") - 1, size))
    begin = F.col("__i") * F.lit(size)
    return runs.withColumn("__i", F.explode(pieces)).select(
        *cols,
        (F.col("__start") + begin).alias("__start"),
        F.least(F.lit(size).cast("long"), F.col("__n") - begin).alias("__n"),
    )


def _expand_copies(counted: DataFrame, cols: list[str]) -> DataFrame:
    """One row per copy, ``pos`` counted from ``__start``.

    A long run is cut in steps, so no record expands far, and the pieces are hashed
    over all tasks before the last step.
    """
    for size in COPY_CUTS:
        counted = _cut_runs(counted, cols, size)
    copies = _cut_runs(counted.repartition("__start"), cols, 1)
    return copies.select(F.col("__start").alias("pos"), *cols)


def merge_values(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Merge two lists of numbers, repeats kept: ``pos, <col>`` in ascending order.

    Repeats are counted map-side, positions come from a scan over distinct values.
    """
    both = a.select(col).union(b.select(col))
    counted = both.groupBy(col).agg(F.count(F.lit(1)).alias("__n"))
    placed = scan(counted, col, "__n", exclusive=True, out="__start")
    return _expand_copies(placed, [col])


def linear_index(A: Matrix) -> Column:
    """Position in row-major order as one number; DECIMAL where BIGINT would overflow."""
    wide = "bigint" if A.nrows * A.ncols < 1 << 63 else "decimal(38,0)"
    return F.col(ROW).cast(wide) * F.lit(A.ncols).cast("bigint") + F.col(COL)


def merge_sorted(A: Matrix, B: Matrix) -> DataFrame:
    """Merge the entries of two matrices in (row, column) order, repeats kept: ``pos, row_id, col_id``."""
    A.require_same_shape(B)
    both = A.extract_pairs().union(B.extract_pairs())
    counted = both.groupBy(ROW, COL).agg(F.count(F.lit(1)).alias("__n"))
    counted = counted.withColumn("__at", linear_index(A))
    placed = scan(counted, "__at", "__n", exclusive=True, out="__start")
    return _expand_copies(placed, [ROW, COL])


def flag_repeats(df: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """Sort by ``keys`` and flag the rows that equal their predecessor.

    Adds ``pos``, ``is_repeat`` (0 for the very first row) and its converse
    ``is_new``.  ``tie`` orders equal rows and must tell them apart.
    """
    placed = ranked(df, [*keys, tie])
    compared = with_previous(placed, "pos", keys, width=dense_width(df.sparkSession, placed.count()))
    same = F.coalesce(F.col("prev") == F.struct(*keys), F.lit(False))
    return compared.select(
        *df.columns, "pos", same.cast("long").alias("is_repeat"), (~same).cast("long").alias("is_new")
    )
