"""Other layouts of a matrix.

Wide records are cut into column blocks of a fixed width, so no record or group
grows with the longest row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..matrix import COL, ROW, VAL, Matrix, _checked
from ..plans.durable import materialize
from ..plans.ordered import dense_width, last_mark, scan
from .order import int_div

#: Columns per adjacency record; also the bound on the length of its array.
ADJACENCY_WIDTH = 1 << 20
#: Columns per dense record.
DENSE_WIDTH = 1 << 16


def _inside(df: DataFrame, nrows: int, ncols: int) -> Matrix:
    """A matrix of entries that fail the query where they are out of bounds."""
    at = [_checked(F.col(ROW), nrows, "row").alias(ROW), _checked(F.col(COL), ncols, "column").alias(COL)]
    return Matrix(df.select(*at, *([VAL] if VAL in df.columns else [])), nrows, ncols)


def to_csr_offsets(A: Matrix) -> DataFrame:
    """Row pointers ``idx, offset`` for idx 0..nrows: entries before row idx."""
    spark = A.df.sparkSession
    counts = A.df.groupBy(F.col(ROW).alias("idx")).agg(F.count(F.lit(1)).alias("__n"))
    rows = spark.range(A.nrows + 1).withColumnRenamed("id", "idx")
    counted = rows.join(counts, "idx", "left").select("idx", F.coalesce("__n", F.lit(0)).alias("__n"))
    width = dense_width(spark, A.nrows + 1)
    return scan(counted, "idx", "__n", exclusive=True, out="offset", width=width).drop("__n")


def from_csr(offsets: DataFrame, cols: DataFrame, nrows: int, ncols: int) -> Matrix:
    """Entries from row pointers ``idx, offset`` and column indices ``pos, col_id``.

    The row of a position is the last row that starts at or before it: each
    non-empty row is a mark at its first position that is carried on, so a long row
    is not expanded inside one record.  There must be as many columns as the last
    offset says, and no index may be out of bounds.
    """
    n, seen = cols.count(), Observation()
    offsets = offsets.observe(seen, F.max("offset").alias("n"), F.max("idx").alias("last"))
    # Empty rows share the offset of the next non-empty row, which has the largest index.
    starts = materialize(offsets.groupBy(F.col("offset").alias("pos")).agg(F.max("idx").alias("__start")))
    stated, last = seen.get["n"], seen.get["last"]
    if (stated or 0) != n or (last is not None and last != nrows):
        raise ValueError(f"offsets end at index {last} with {stated}; there are {nrows} rows and {n} columns")
    starts = starts.where(F.col("pos") < n)
    kept = [COL, *([VAL] if VAL in cols.columns else [])]
    rows = last_mark(cols.select("pos", *kept), starts, "pos", "__start", n, ROW)
    return _inside(rows.select(ROW, *kept), nrows, ncols)


def to_adjacency(A: Matrix, width: int = ADJACENCY_WIDTH) -> DataFrame:
    """Non-empty rows as sorted column lists: ``row_id, block, cols, nnz``.

    A row has one record per block of ``width`` columns that it touches.
    """
    block = int_div(F.col(COL), width)
    return (
        A.df.groupBy(ROW, block.alias("block"))
        .agg(F.sort_array(F.collect_list(COL)).alias("cols"))
        .select(ROW, "block", "cols", F.size("cols").cast("long").alias("nnz"))
    )


def from_adjacency(df: DataFrame, nrows: int, ncols: int) -> Matrix:
    """Entries of adjacency records."""
    return _inside(df.select(ROW, F.explode("cols").alias(COL)), nrows, ncols)


def to_dense(A: Matrix, width: int = DENSE_WIDTH) -> DataFrame:
    """Dense rows ``row_id, block, vals`` with zeros filled in.

    Only the stored entries are shuffled.  A record is then written as the runs of
    zeros before each entry, the entry, and the zeros after the last one.
    """
    spark = A.df.sparkSession
    blocks = max(1, -(-A.ncols // width))
    valued = A if A.valued else A.with_ones()
    at = F.col(COL) % F.lit(width)
    sparse = valued.df.groupBy(ROW, int_div(F.col(COL), width).alias("block")).agg(
        F.sort_array(
            F.collect_list(F.struct(at.cast("int").alias("at"), F.col(VAL).cast("double").alias("val")))
        ).alias("__e")
    )
    grid = spark.range(A.nrows * blocks).select(
        int_div(F.col("id"), blocks).alias(ROW),
        (F.col("id") % F.lit(blocks)).alias("block"),
    )
    size = F.least(F.lit(width), F.lit(A.ncols) - F.col("block") * F.lit(width)).cast("int")
    zero = F.lit(0.0)

    def run(entry, i):
        after = F.when(i > 0, F.get(F.col("__e"), i - 1)["at"]).otherwise(F.lit(-1))
        return F.concat(F.array_repeat(zero, entry["at"] - after - 1), F.array(entry["val"]))

    last = F.element_at("__e", -1)["at"]
    filled = F.concat(
        F.flatten(F.transform("__e", run)), F.array_repeat(zero, F.col("__size") - last - 1)
    )
    empty = F.array_repeat(zero, F.col("__size"))
    return (
        grid.join(sparse, [ROW, "block"], "left")
        .withColumn("__size", size)
        .select(ROW, "block", F.when(F.col("__e").isNull(), empty).otherwise(filled).alias("vals"))
    )


def dense_cells(dense: DataFrame, width: int = DENSE_WIDTH) -> DataFrame:
    """Cells ``row_id, col_id, val`` of dense records, zeros included."""
    return dense.select(ROW, "block", F.posexplode("vals").alias("__at", VAL)).select(
        ROW, (F.col("block") * F.lit(width) + F.col("__at")).alias(COL), VAL
    )


def from_dense(dense: DataFrame, nrows: int, ncols: int, width: int = DENSE_WIDTH) -> Matrix:
    """The non-zero cells of dense records ``row_id[, block], vals``."""
    if "block" not in dense.columns:
        dense = dense.withColumn("block", F.lit(0).cast("long"))
    return _inside(dense_cells(dense, width).where(F.col(VAL) != 0), nrows, ncols)


def from_dense_flat(flat: DataFrame, nrows: int, ncols: int) -> Matrix:
    """The non-zero cells of a row-major sequence ``pos, val``."""
    pos = F.col("pos")
    cells = flat.where(F.col(VAL) != 0).select(
        int_div(pos, ncols).alias(ROW), (pos % F.lit(ncols)).alias(COL), VAL
    )
    return _inside(cells, nrows, ncols)
