"""Sizes and work estimates of matrices and of products not yet made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..matrix import COL, ROW, Matrix
from ..plans.durable import materialize
from ..plans.ordered import scan
from ..plans.skew import BROADCAST_KEYS
from .add import ewise_add
from .multiply import mxm, mxm_paths


def row_nnz(A: Matrix) -> DataFrame:
    """``row_id, nnz`` for the non-empty rows."""
    return A.df.groupBy(ROW).agg(F.count(F.lit(1)).alias("nnz"))


def result_shape(A: Matrix) -> DataFrame:
    """``nrows, ncols, nvals`` of a matrix as one row."""
    counted = A.df.agg(F.count(F.lit(1)).alias("nvals"))
    return counted.select(
        F.lit(A.nrows).cast("long").alias("nrows"), F.lit(A.ncols).cast("long").alias("ncols"), "nvals"
    )


def matrix_stats(A: Matrix) -> DataFrame:
    """One row: shape, entries, entries per row, longest row (the last row counts too), empty rows."""
    per_row = row_nnz(A)
    nnz = F.coalesce(F.sum("nnz"), F.lit(0))
    return per_row.agg(
        F.lit(A.nrows).cast("long").alias("nrows"),
        F.lit(A.ncols).cast("long").alias("ncols"),
        nnz.alias("nnz"),
        (nnz / F.lit(float(A.nrows))).alias("nnz_per_row") if A.nrows else F.lit(0.0).alias("nnz_per_row"),
        F.coalesce(F.max("nnz"), F.lit(0)).alias("max_nnz_row"),
        (F.lit(A.nrows).cast("long") - F.count(F.lit(1))).alias("empty_rows"),
    )


def mxm_workload(A: Matrix, B: Matrix) -> DataFrame:
    """Paths per output row of ``A . B``, ``row_id, work``: an upper bound of its entries.

    Rows of A that meet only empty rows of B have work 0.  Twice the total is the
    number of flops of the numeric product.  The lookup side has one row per index,
    so adaptive execution can split a hub index on the other side.
    """
    left = A.df.select(ROW, F.col(COL).alias("__k"))
    right = row_nnz(B).select(F.col(ROW).alias("__k"), F.col("nnz").alias("__n"))
    met = left.join(right, "__k", "left")
    return met.groupBy(ROW).agg(F.sum(F.coalesce("__n", F.lit(0))).alias("work"))


#: Columns of one bitmap, and paths per bitmap from which a row is counted in bitmaps.
BITMAP_COLUMNS, DENSE_PATHS = 32_768, 1024


def mxm_row_nnz(A: Matrix, B: Matrix, dense: int = DENSE_PATHS) -> DataFrame:
    """Exact entries per row of ``A . B``, ``row_id, nnz``, without keeping the product.

    Sparse rows are counted as distinct positions.  A row with many paths for the bitmaps
    its columns need sets bits instead: a task sends 4 KB per row and 32,768 columns at
    most, however many paths it has.  Whether there can be such rows is told by the
    longest rows of both operands; which ones, by the work estimate.
    """
    A, B = A.pattern(), B.pattern()
    least = dense * -(-B.ncols // BITMAP_COLUMNS)
    longest = [row_nnz(m).agg(F.coalesce(F.max("nnz"), F.lit(0)).alias("n")) for m in (A, B)]
    a, b = (r["n"] for r in longest[0].withColumn("at", F.lit(0)).union(longest[1].withColumn("at", F.lit(1))).orderBy("at").collect())
    if a * b < least:
        return row_nnz(mxm(A, B))
    rows = materialize(mxm_workload(A, B).where(F.col("work") >= least).select(ROW))
    few = F.broadcast(rows) if rows.count() <= BROADCAST_KEYS else rows
    heavy, light = (Matrix(A.df.join(few, ROW, how), *A.shape) for how in ("left_semi", "left_anti"))
    at = F.col(COL) + 1  # bit positions count from 1
    bits = mxm_paths(heavy, B).select(ROW, F.bitmap_bucket_number(at).alias("__b"), F.bitmap_bit_position(at).alias("__bit"))
    bits = bits.groupBy(ROW, "__b").agg(F.bitmap_count(F.bitmap_construct_agg("__bit")).alias("nnz"))
    return bits.groupBy(ROW).agg(F.sum("nnz").alias("nnz")).union(row_nnz(mxm(light, B)))


def ewise_row_nnz(A: Matrix, B: Matrix) -> DataFrame:
    """Exact entries per row of ``A + B``, ``row_id, nnz``."""
    return row_nnz(ewise_add(A, B))


def ceil_log2(n: Column) -> Column:
    """Exact ceil(log2(n)) of a positive integer: the bits of n - 1."""
    return F.when(n <= 1, F.lit(0)).otherwise(F.length(F.bin(n - 1)))


def workload_histogram(A: Matrix, B: Matrix) -> DataFrame:
    """``bin, rows, work``: rows of A by ceil(log2(work)); rows without work in bin -1."""
    work = F.col("work")
    binned = F.when(work == 0, F.lit(-1)).otherwise(ceil_log2(work)).cast("long")
    return (
        mxm_workload(A, B)
        .groupBy(binned.alias("bin"))
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("work").alias("work"))
    )


def compact_rows(A: Matrix) -> DataFrame:
    """Non-empty rows renumbered without gaps: ``row_id, new_row``."""
    rows = A.df.select(ROW).distinct().withColumn("__one", F.lit(1).cast("long"))
    return scan(rows, ROW, "__one", exclusive=True, out="new_row").drop("__one")
