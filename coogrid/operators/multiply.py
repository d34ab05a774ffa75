"""Matrix products.

A product is an equi-join on the inner index followed by one aggregation on the
output position.  The aggregation combines map-side, so several paths to the
same cell collapse before the shuffle, and it hashes on the whole position, so a
dense output row is spread over all tasks.  The join goes through
``spread_join``: a hub index is split over cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semiring import Semiring, semiring as resolve
from ..matrix import COL, ROW, VAL, Matrix
from ..plans.durable import drop_cut, drop_path, path_exists, scratch_path, shuffles_released
from ..plans.skew import CELL_ROWS, GRID_COL, GRID_ROW, Counted, count_keys, grid_of, spread_join

#: Join hints behind the ``strategy`` argument; None leaves the choice to Catalyst and AQE.
STRATEGIES = {None: None, "hash": "shuffle_hash", "merge": "merge"}


#: Entries of the matrices that one job squares, about.
BATCH_ENTRIES = 1 << 30
#: Pairs of a Kronecker cell at least.
LEAST_CELL = 1 << 16
#: Paths of one pass of a product at least, and paths per entry of the operands from which passes pay.
PASS_PATHS, DENSE_PATHS = 1 << 28, 8


def _products(
    a: DataFrame,
    b: DataFrame,
    ids: Sequence[str],
    sr: Semiring,
    strategy: str | None,
    split: bool,
    cell: int | None,
    sizing: tuple[DataFrame, DataFrame] | None = None,
    counted: Counted | None = None,
) -> DataFrame:
    """One row per path ``A[i,k], B[k,j]``; with ``val`` unless only the pattern counts."""
    left_cols = [*ids, ROW, F.col(COL).alias("__k")]
    right_cols = [*ids, F.col(ROW).alias("__k"), COL]
    if not sr.pattern_only:
        one = F.lit(1).cast(sr.one)
        left_cols.append((F.col(VAL) if VAL in a.columns else one).alias("__a"))
        right_cols.append((F.col(VAL) if VAL in b.columns else one).alias("__b"))
    paths = spread_join(
        a.select(*left_cols),
        b.select(*right_cols),
        [*ids, "__k"],
        left_by=[ROW],
        right_by=[COL],
        hint=STRATEGIES[strategy],
        cell=cell,
        split=split,
        sizing=_inner(*(sizing or (a, b)), ids),
        counted=counted,
    )
    if sr.pattern_only:
        return paths.select(*ids, ROW, COL)
    return paths.select(*ids, ROW, COL, sr.mul(F.col("__a"), F.col("__b")).alias(VAL))


def _inner(a: DataFrame, b: DataFrame, ids: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The inner indices on which entries of the operands meet."""
    return a.select(*ids, F.col(COL).alias("__k")), b.select(*ids, F.col(ROW).alias("__k"))


def _reduce(paths: DataFrame, ids: Sequence[str], sr: Semiring) -> DataFrame:
    if sr.pattern_only:
        return paths.distinct()
    return paths.groupBy(*ids, ROW, COL).agg(sr.add(F.col(VAL)).alias(VAL))


def _require_inner(A: Matrix, B: Matrix) -> None:
    if A.ncols != B.nrows:
        raise ValueError(f"inner dimensions differ: {A.shape} times {B.shape}")


def _operands(A: Matrix, B: Matrix, split: bool) -> tuple[Matrix, Matrix]:
    """Both operands, ready to be read twice."""
    if not split:
        return A, B
    if A is B:
        kept = A.once()
        return kept, kept
    return A.once([COL]), B.once([ROW])


def mxm(
    A: Matrix,
    B: Matrix,
    semiring: str | Semiring = "or_and",
    mul: Callable[[Column, Column], Column] | None = None,
    add: Callable[[Column], Column] | None = None,
    strategy: str | None = None,
    split: bool = True,
    cell: int | None = None,
) -> Matrix:
    """``A . B`` over a semiring.

    ``or_and`` and ``any_pair`` give the pattern; ``plus_times`` and the other valued
    semirings keep every structurally present cell, also one whose sum is 0.  A
    pattern operand counts as ones.  Hub indices are counted before the product is
    planned; an operand that is itself costly to make (a product) is laid out by the
    inner index first, counted on that layout and joined from it, so it is evaluated
    once.  ``split=False`` skips the count.

    A product with many more paths than its operands have entries is worked out in
    passes, each for a part of the rows, and read back from the shared folder: one pass
    shuffles about as many paths as the operands have entries, and frees the disk for the next.
    """
    _require_inner(A, B)
    A, B = _operands(A, B, split)
    sr = resolve(semiring, mul, add)
    counted = count_keys(*_inner(A.sizing(), B.sizing()), ["__k"], cell) if split else None
    if counted and counted.work > max(PASS_PATHS, DENSE_PATHS * counted.rows):
        passes = math.ceil(counted.work / max(PASS_PATHS, counted.rows))
        return Matrix(_in_passes(A, B, sr, strategy, cell, counted, passes), A.nrows, B.ncols)
    paths = _products(A.df, B.df, [], sr, strategy, split, cell, counted=counted)
    return Matrix(_reduce(paths, [], sr), A.nrows, B.ncols)


def _in_passes(
    A: Matrix, B: Matrix, sr: Semiring, strategy: str | None, cell: int | None, counted: Counted, passes: int
) -> DataFrame:
    """The entries of ``A . B``, a share of the rows at a time, kept in the shared folder.

    A is dealt to the passes by a hash of the row, B is laid out by the inner index once.
    A cell belongs to one row, so the parts are disjoint, and each is complete when its
    pass ends.
    """
    spark = A.df.sparkSession
    dealt, out = scratch_path(spark, "rows"), scratch_path(spark, "product")
    share = F.pmod(F.xxhash64(F.lit("pass"), ROW), F.lit(passes)).cast("int").alias("__pass")  # not the hash of the grids
    kept = B.materialized([ROW])
    with shuffles_released(spark):
        A.df.select("*", share).hint("rebalance", "__pass").write.partitionBy("__pass").parquet(dealt)
        kind = A.df.schema
        full = [i for i in range(passes) if path_exists(spark, f"{dealt}/__pass={i}")]
        for i in full:
            rows = spark.read.schema(kind).parquet(f"{dealt}/__pass={i}")
            paths = _products(rows, kept.df, [], sr, strategy, True, cell, counted=counted)
            _reduce(paths, [], sr).write.parquet(f"{out}/{i}")
    drop_path(spark, dealt)
    drop_cut(kept.df)
    return spark.read.parquet(*(f"{out}/{i}" for i in full))


def mxm_paths(A: Matrix, B: Matrix, split: bool = True) -> DataFrame:
    """``row_id, col_id`` of every path of ``A . B``, repeats kept."""
    _require_inner(A, B)
    A, B = _operands(A, B, split)
    return _products(A.df, B.df, [], resolve("or_and"), None, split, None, (A.sizing(), B.sizing()))


def mxm_add(
    A: Matrix,
    B: Matrix,
    C: Matrix,
    semiring: str | Semiring = "or_and",
    strategy: str | None = None,
    split: bool = True,
    cell: int | None = None,
) -> Matrix:
    """``A . B + C`` in one go: the paths and C meet in a single final aggregation."""
    _require_inner(A, B)
    if C.shape != (A.nrows, B.ncols):
        raise ValueError(f"addend is {C.shape}, product is {(A.nrows, B.ncols)}")
    A, B = _operands(A, B, split)
    sr = resolve(semiring)
    paths = _products(A.df, B.df, [], sr, strategy, split, cell, (A.sizing(), B.sizing()))
    if not sr.pattern_only and not C.valued:
        C = C.with_ones(sr.one)
    addend = C.df.select(*paths.columns)
    return Matrix(_reduce(paths.unionByName(addend), [], sr), A.nrows, B.ncols)


def square_entries(entries: DataFrame, ids: Sequence[str] = ("matrix_id",), split: bool = True) -> DataFrame:
    """Square every matrix of a table that holds many: the id joins the keys."""
    sr = resolve("or_and")
    return _reduce(_products(entries, entries, list(ids), sr, None, split, None), ids, sr)


def square_workload(
    entries: DataFrame, out: str | None = None, resume: bool = False, batch: int = BATCH_ENTRIES
) -> DataFrame:
    """Square all matrices of a workload and keep them, one folder per matrix.

    Matrices are squared in batches of about ``batch`` entries, a larger one alone; a
    batch is one job.  When a batch is complete its matrices are marked as done below
    ``out``; with ``resume`` those marked before are not squared again, and a batch that
    broke off is written anew, without it ``out`` is emptied first.  The rebalance before
    the write gives files of even size: a matrix that holds most of the result is
    written by many tasks, small ones by one each.
    """
    spark = entries.sparkSession
    out = out or scratch_path(spark, "squares")
    marks = f"{out}/_done"
    done: set = set()
    if not resume:
        drop_path(spark, out)
    elif path_exists(spark, marks):
        done = {r[0] for r in spark.read.parquet(marks).collect()}  # one row per matrix
    sizes = entries.groupBy("matrix_id").count().orderBy("matrix_id").collect()  # one row per matrix
    batches: list[list] = []
    held = batch
    for matrix_id, n in ((str(r[0]), r[1]) for r in sizes if str(r[0]) not in done):
        if held + n > batch:
            batches.append([])
            held = 0
        batches[-1].append(matrix_id)
        held += n
    every = len(batches) == 1 and not done
    for ids in batches:
        part = entries if every else entries.where(F.col("matrix_id").isin(ids))
        squares = square_entries(part).hint("rebalance", "matrix_id").write.mode("overwrite")
        squares.option("partitionOverwriteMode", "dynamic").partitionBy("matrix_id").parquet(out)
        spark.createDataFrame([(i,) for i in ids], "matrix_id string").coalesce(1).write.mode("append").parquet(marks)
    schema = "row_id bigint, col_id bigint, matrix_id string"
    return spark.read.schema(schema).parquet(out) if path_exists(spark, out) else spark.createDataFrame([], schema)


def kronecker(A: Matrix, B: Matrix) -> Matrix:
    """Kronecker product: entry pairs (a, b) land at a * shape(B) + b; values multiply.

    Every pair is an output entry, so the work is the output size.  The pairs are laid
    out on a p x q grid sized from both counts: entries of A choose a grid row by hash
    and are copied to its q cells, entries of B choose a column and are copied to its p
    cells, so the smaller operand is copied more.  Each pair meets in one cell; the
    positions are all different, nothing is deduped.
    """
    spark = A.df.sparkSession
    ins, outs = A.nvals(), B.nvals()
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cell = max(LEAST_CELL, min(CELL_ROWS, ins * outs // (4 * tasks)))
    p, q = grid_of(ins, outs, cell) if ins and outs else (1, 1)

    def spread(df: DataFrame, own: str, own_n: int, copy: str, copy_n: int) -> DataFrame:
        mine = F.pmod(F.xxhash64(ROW, COL), F.lit(own_n)).cast("int")
        return df.withColumn(own, mine).withColumn(copy, F.explode(F.sequence(F.lit(0), F.lit(copy_n - 1))))

    at = [GRID_ROW, GRID_COL]
    a = spread(A.df, GRID_ROW, p, GRID_COL, q)
    a = a.select(*at, F.col(ROW).alias("__ar"), F.col(COL).alias("__ac"), *_val(A, "__av"))
    b = spread(B.df, GRID_COL, q, GRID_ROW, p)
    b = b.select(*at, F.col(ROW).alias("__br"), F.col(COL).alias("__bc"), *_val(B, "__bv"))
    row = F.col("__ar") * F.lit(B.nrows) + F.col("__br")
    col = F.col("__ac") * F.lit(B.ncols) + F.col("__bc")
    cells = [row.alias(ROW), col.alias(COL)]
    values = [F.col(c) for m, c in ((A, "__av"), (B, "__bv")) if m.valued]
    if values:
        cells.append((values[0] if len(values) == 1 else values[0] * values[1]).alias(VAL))
    return Matrix(a.join(b, at).select(*cells), A.nrows * B.nrows, A.ncols * B.ncols)


def _val(m: Matrix, name: str) -> list[Column]:
    return [F.col(VAL).alias(name)] if m.valued else []
