"""Equi-joins that split hot keys.

A key with ``in`` rows on the left and ``out`` rows on the right makes
``in * out`` output rows in one task of an ordinary join.  Adaptive execution
splits partitions that are large on disk, which covers a key with many rows on
one side.  It does not see a key whose inputs are small and whose output is not:
a hub with 10**5 rows on either side is 2 MB to read and 10**10 rows to write.
``spread_join`` lays such a key out on a ``p x q`` grid: left rows choose a grid
row by hash and are copied to the q cells of it, right rows choose a grid column
and are copied to the p cells of it.  Each pair of rows meets in exactly one
cell, so results (also sums) are those of the plain join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .durable import materialize

#: Output rows of one join cell: a key with more is hot.  Where a quarter of an even
#: share per task is less than the upper bound, that share counts instead.
CELL_ROWS = 1 << 25
MIN_CELL_ROWS = 1 << 20
#: Tables of hot keys up to this many rows are sent to every task; larger ones are joined as Spark sees fit.
BROADCAST_KEYS = 100_000

# Grid columns: sizes and place of a row's cell.  Inputs must not use these names.
GRID_ROWS, GRID_COLS, GRID_ROW, GRID_COL = "__grid_p", "__grid_q", "__grid_row", "__grid_col"


def grid_of(ins: int, outs: int, cell: int) -> tuple[int, int]:
    """Grid p x q for a key, so that a cell makes about ``cell`` rows.

    sqrt(cells * in / out) by sqrt(cells * out / in) keeps the copied rows
    ``in * q + out * p`` smallest.
    """
    cells = -(-ins * outs // cell)
    p = min(cells, max(1, math.ceil(math.sqrt(cells * ins / outs))))
    return p, -(-cells // p)


def _grid_columns(cell: int) -> list[Column]:
    """:func:`grid_of` over the columns ``__in`` and ``__out``."""
    ins, outs = F.col("__in").cast("double"), F.col("__out").cast("double")
    cells = F.ceil(ins * outs / F.lit(cell))
    p = F.least(cells, F.greatest(F.lit(1).cast("long"), F.ceil(F.sqrt(cells * ins / outs))))
    return [p.cast("int").alias(GRID_ROWS), F.ceil(cells / p).cast("int").alias(GRID_COLS)]


def _cell_size(total: float | None, tasks: int, cell: int | None) -> int:
    """Rows of a cell: as asked, or a quarter of an even share per task within the two bounds."""
    if cell is not None:
        return cell
    return max(MIN_CELL_ROWS, min(CELL_ROWS, int((total or 0) / (4 * tasks))))


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _found(heavy: DataFrame, work: Column, cell: int | None) -> tuple[DataFrame, int] | None:
    """Keys of ``heavy`` whose work is above a cell, kept once, and the size of a cell; None without any.

    All of them are kept, as a table; only the sum of the work and the number of
    keys reach the driver.
    """
    seen = Observation()
    least = cell if cell is not None else MIN_CELL_ROWS
    counted = heavy.observe(seen, F.sum(work).alias("work"), F.count_if(work > least).alias("keys"))
    kept = materialize(counted.where(work > least))
    if not seen.get["keys"]:
        return None
    return kept, _cell_size(seen.get["work"], _tasks(heavy), cell)


def _small(keys: DataFrame) -> DataFrame:
    """A broadcast hint for a table of keys whose number allows one."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


@dataclass(frozen=True)
class Counted:
    """What counting the keys of both sides of a join has found: grids of the hot keys, rows put in, rows that come out."""

    hot: DataFrame | None
    rows: int
    work: float


def hot_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], cell: int | None = None) -> DataFrame | None:
    """Grids ``*keys, __grid_p, __grid_q`` of the keys that make more than a cell of output; None without any.

    One aggregation over both sides: counts combine map-side, a hot key shuffles one
    row per map task.  However many keys are hot, all are found.
    """
    return count_keys(left, right, keys, cell).hot


def count_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], cell: int | None = None) -> Counted:
    """The grids of :func:`hot_keys`, with the rows of both sides and of the join; one pass for all."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    both = left.select(*keys, one.alias("__in"), zero.alias("__out")).union(right.select(*keys, zero, one))
    counts = both.groupBy(*keys).agg(F.sum("__in").alias("__in"), F.sum("__out").alias("__out"))
    work = F.col("__in").cast("double") * F.col("__out")
    met, seen = F.col("__in") + F.col("__out"), Observation()
    found = _found(counts.observe(seen, F.sum(met).alias("rows"), F.sum(work).alias("work")), work, cell)
    totals = int(seen.get["rows"] or 0), float(seen.get["work"] or 0)
    if found is None:
        return Counted(None, *totals)
    kept, size = found
    return Counted(kept.where(work > size).select(*keys, *_grid_columns(size)), *totals)


def spread_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_by: Sequence[str],
    right_by: Sequence[str],
    hint: str | None = None,
    cell: int | None = None,
    split: bool = True,
    sizing: tuple[DataFrame, DataFrame] | None = None,
    counted: Counted | None = None,
) -> DataFrame:
    """Inner join on the shared columns ``keys`` with hot keys split over cells.

    ``left_by`` / ``right_by`` name the columns whose hash spreads the rows of one
    key.  ``hint`` is a join hint for the right side.  Hot keys are looked for first,
    in ``sizing`` where given (frames with the same keys that are cheaper to read), or
    taken from ``counted``; without any, or with ``split=False``, this is the plain join.
    """
    keys = list(keys)
    hinted = right.hint(hint) if hint else right
    if split and counted is None:
        counted = count_keys(*(sizing or (left, right)), keys, cell)
    found = counted.hot if split else None
    if found is None:
        return left.join(hinted, keys)
    hot = _small(found)

    def spread(df: DataFrame, by: Sequence[str], own: str, own_n: str, copy: str, copy_n: str) -> DataFrame:
        mine = F.coalesce(F.pmod(F.xxhash64(*by), F.col(own_n)), F.lit(0)).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(copy_n), F.lit(1)) - 1))
        return df.join(hot, keys, "left").withColumn(own, mine).withColumn(copy, copies).drop(own_n, copy_n)

    l = spread(left, left_by, GRID_ROW, GRID_ROWS, GRID_COL, GRID_COLS)
    r = spread(right, right_by, GRID_COL, GRID_COLS, GRID_ROW, GRID_ROWS)
    met = l.join(r.hint(hint) if hint else r, [*keys, GRID_ROW, GRID_COL])
    return met.drop(GRID_ROW, GRID_COL)


def busy_keys(left: DataFrame, keys: Sequence[str], cell: int | None = None) -> DataFrame | None:
    """Stripes ``*keys, __grid_p`` of the keys with more rows than a cell; None without any."""
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__in"))
    found = _found(counts, F.col("__in").cast("double"), cell)
    if found is None:
        return None
    kept, size = found
    stripes = F.ceil(F.col("__in") / F.lit(size)).cast("int").alias(GRID_ROWS)
    return kept.where(F.col("__in") > size).select(*keys, stripes)


class Stripes:
    """Busy keys of a big table cut into stripes, to be looked up in a table unique on the keys.

    Adaptive execution does this for a shuffled join on its own, but not where the
    big side keeps a stored layout, nor where an aggregation by the same keys follows.
    """

    def __init__(self, big: DataFrame, keys: Sequence[str], cell: int | None = None):
        self.keys = list(keys)
        self.found = busy_keys(big, self.keys, cell)
        self._busy = None if self.found is None else _small(self.found)

    @property
    def on(self) -> list[str]:
        """Columns to join the two sides on."""
        return self.keys if self._busy is None else [*self.keys, GRID_ROW]

    def cut(self, big: DataFrame, by: Sequence[str]) -> DataFrame:
        """Rows of the big table with their stripe, a hash of ``by``."""
        if self._busy is None:
            return big
        stripe = F.coalesce(F.pmod(F.xxhash64(*by), F.col(GRID_ROWS)), F.lit(0)).cast("int")
        return big.join(self._busy, self.keys, "left").withColumn(GRID_ROW, stripe).drop(GRID_ROWS)

    def copy(self, small: DataFrame) -> DataFrame:
        """Rows of the unique table, one for every stripe of their key."""
        if self._busy is None:
            return small
        stripes = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(GRID_ROWS), F.lit(1)) - 1))
        return small.join(self._busy, self.keys, "left").withColumn(GRID_ROW, stripes).drop(GRID_ROWS)
