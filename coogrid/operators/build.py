"""Building and checking matrices."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..matrix import COL, ROW, VAL, Matrix
from .order import int_div


def mirror(A: Matrix) -> Matrix:
    """Add (col, row) for every (row, col); diagonal entries stay single.

    One pass over the entries (not a union of two reads) and one shuffle, whose
    map side already drops repeats.
    """
    if A.nrows != A.ncols:
        raise ValueError(f"only a square matrix can be mirrored, not {A.shape}")
    here = F.struct(F.col(ROW).alias(ROW), F.col(COL).alias(COL))
    there = F.struct(F.col(COL).alias(ROW), F.col(ROW).alias(COL))
    both = F.explode(F.array(here, there)).alias("__e")
    if not A.valued:
        stated = A.df.select(both).select("__e.*")
        return replace(A, df=stated.distinct(), raw=stated if A.raw is None else A.raw.select(both).select("__e.*"))
    # A stored entry wins over the image of its opposite.
    own = A.df.select(both, F.col(VAL), F.col(ROW).alias("__r"), F.col(COL).alias("__c"))
    is_image = (F.col("__e.row_id") != F.col("__r")) | (F.col("__e.col_id") != F.col("__c"))
    entries = own.select("__e.*", VAL, is_image.alias("__image"))
    return replace(A, df=entries.groupBy(ROW, COL).agg(F.min_by(VAL, "__image").alias(VAL)), raw=None)


def duplicate_entries(raw: DataFrame, undirected: bool = False) -> DataFrame:
    """Positions stated more than once in ``raw`` and how often: ``row_id, col_id, n``.

    With ``undirected`` an entry also repeats the mirror image of another one, and
    is reported at its smaller index first.
    """
    r, c = F.col(ROW), F.col(COL)
    if undirected:
        r, c = F.least(ROW, COL), F.greatest(ROW, COL)
    pairs = raw.select(r.alias(ROW), c.alias(COL))
    return pairs.groupBy(ROW, COL).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def bad_entries(raw: DataFrame, nrows: int, ncols: int) -> DataFrame:
    """Rows of ``raw`` whose 0-based position is missing or outside the shape."""
    r, c = F.col(ROW), F.col(COL)
    fits = (r >= 0) & (r < F.lit(nrows)) & (c >= 0) & (c < F.lit(ncols))
    return raw.where(~F.coalesce(fits, F.lit(False)))


def validate_entries(raw: DataFrame, nrows: int, ncols: int, nnz: int | None = None) -> DataFrame:
    """Return ``raw`` if it fits the shape (and states ``nnz`` entries), else raise.

    Bounds and count come from one aggregation; a sample of bad rows is read only
    to word the error.
    """
    r, c = F.col(ROW), F.col(COL)
    fits = (r >= 0) & (r < F.lit(nrows)) & (c >= 0) & (c < F.lit(ncols))
    seen = raw.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.coalesce(fits, F.lit(False))).alias("bad"),
    ).first()
    if seen["bad"]:
        shown = [tuple(x) for x in bad_entries(raw, nrows, ncols).limit(10).collect()]
        raise ValueError(f"{seen['bad']} entries outside {nrows} x {ncols}, such as {shown}")
    if nnz is not None and seen["n"] != nnz:
        raise ValueError(f"{nnz} entries announced, {seen['n']} found")
    return raw


def dedup(df: DataFrame) -> DataFrame:
    """Keep one row per (row_id, col_id)."""
    return df.dropDuplicates([ROW, COL])


def dedup_values(df: DataFrame, col: str) -> DataFrame:
    """The distinct values of one column."""
    return df.select(col).distinct()


def poisson5pt(spark: SparkSession, nx: int, ny: int) -> Matrix:
    """Five-point Poisson stencil on an nx x ny grid: 4 on the diagonal, -1 to each neighbour.

    Every grid point makes its own row, so there is no shuffle.
    """
    n = nx * ny
    x, y = F.col("id") % F.lit(nx), int_div(F.col("id"), nx)

    def point(step: int, exists, value: float):
        entry = F.struct((F.col("id") + F.lit(step)).alias(COL), F.lit(value).alias(VAL))
        return F.when(exists, entry)

    stencil = F.array(
        point(0, F.lit(True), 4.0),
        point(-1, x > 0, -1.0),
        point(1, x < nx - 1, -1.0),
        point(-nx, y > 0, -1.0),
        point(nx, y < ny - 1, -1.0),
    )
    entries = (
        spark.range(n)
        .select(F.col("id").alias(ROW), F.explode(stencil).alias("__e"))
        .where("__e IS NOT NULL")
        .select(ROW, "__e.*")
    )
    return Matrix(entries, n, n)
