"""Order-dependent passes without a single-task window.

An un-partitioned window sends every row to one task.  The passes here cut the
order into buckets, run the window inside each bucket, reduce each bucket to one
row, and carry those few rows (one per bucket) across the bucket edges.  The number
of buckets follows from the number of rows.  Bucket bounds are literals of the plan, so a bucket
recomputed after a lost executor holds the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from .durable import materialize

BUCKET, KEY = "__bucket", "__key"
_ID_BITS = 33  # low bits of monotonically_increasing_id(): row number inside the partition


#: Buckets per task, so that hashing them over the tasks comes out even, and most buckets of one pass.
BUCKETS_PER_TASK, MOST_BUCKETS = 8, 1_000_000
#: Rows of a bucket: fewer are not worth one of their own, more do not go into one.
LEAST_BUCKET_ROWS, BUCKET_ROWS = 1 << 12, 1 << 22
#: Quantiles read in the pass that counts the rows, and the size of their sketch: ranks are off by 0.0004 of the rows.
_GRID, _SKETCH = 1024, 16_384
#: Buckets whose carry is worked out in one window, and that form a group where there are more.
CARRY_FAN = 1024


class Width(int):
    """A bucket width that is known to make a bounded number of buckets."""

    buckets = MOST_BUCKETS


def bucket_count(spark: SparkSession, n: int) -> int:
    """Buckets for ``n`` rows: several per task where the rows fill them, more where a bucket would grow too large."""
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    even = min(BUCKETS_PER_TASK * tasks, -(-n // LEAST_BUCKET_ROWS))
    return max(1, min(MOST_BUCKETS, max(even, -(-n // BUCKET_ROWS))))


def dense_width(spark: SparkSession, n: int) -> Width:
    """Bucket width for an order column that takes each of 0..n-1 once."""
    width = Width(max(1, -(-n // bucket_count(spark, n))))
    width.buckets = -(-n // width)
    return width


def _bounded_width(df: DataFrame, order: str, width: int) -> Width:
    """``width``, or the least one that keeps to MOST_BUCKETS over the range of ``order``."""
    if isinstance(width, Width):
        return width
    ends = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    span = 0 if ends["lo"] is None else ends["hi"] - ends["lo"] + 1
    kept = Width(max(width, -(-span // MOST_BUCKETS)))
    kept.buckets = span // kept + 2
    return kept


def _bounds(df: DataFrame, order: str) -> list[float]:
    """Bounds of even buckets, as many as the rows ask for.

    One pass both counts the rows and sketches their quantiles; partial sketches
    merge, so only a bounded summary per task moves.  Where more buckets are needed
    than the sketch tells apart, a finer one is read.
    """
    x = F.col(order).cast("double")
    n, ranks = F.count(x), F.expr(f"array({', '.join(f'{i / _GRID}D' for i in range(1, _GRID))})")
    grid = F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(x, F.lit(_SKETCH)), ranks)
    seen = df.agg(n.alias("n"), F.when(n > 0, grid).alias("cuts")).first()
    n = bucket_count(df.sparkSession, seen["n"])
    if n <= _GRID:
        cuts = [seen["cuts"][_GRID * i // n - 1] for i in range(1, n)]
    else:
        (cuts,) = df.select(x.alias("__order")).approxQuantile(["__order"], [i / n for i in range(1, n)], 0.25 / n)
    return sorted(set(cuts))


def _bucketed(df: DataFrame, order: str, width: int | None) -> tuple[DataFrame, int]:
    """:func:`add_bucket` and how many buckets there are at most."""
    if width is not None:
        width = _bounded_width(df, order, width)
        return df.withColumn(BUCKET, F.call_function("div", F.col(order), F.lit(int(width)).cast("long"))), width.buckets
    inner = _bounds(df, order)
    if not inner:
        return df.withColumn(BUCKET, F.lit(0).cast("long")), 1
    as_double = df.withColumn("__order", F.col(order).cast("double"))
    splits = [float("-inf"), *inner, float("inf")]
    tagged = Bucketizer(splits=splits, inputCol="__order", outputCol="__cut").transform(as_double)
    return tagged.withColumn(BUCKET, F.col("__cut").cast("long")).drop("__order", "__cut"), len(splits)


def add_bucket(df: DataFrame, order: str, width: int | None = None) -> DataFrame:
    """Tag rows with a bucket that grows with the numeric column ``order``.

    ``width`` serves dense orders (positions, row numbers).  Otherwise the bounds
    are approximate quantiles, so buckets are even however the values lie, and their
    number follows from the number of rows.
    """
    return _bucketed(df, order, width)[0]


def _before(keys: Sequence[str], order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _carried(
    totals: DataFrame, keys: Sequence[str], fold: Callable[[str], Column], combine: Callable[[Column, Column], Column], buckets: int
) -> DataFrame:
    """``*keys, bucket, __carry``: ``__total`` folded over all buckets of the key that lie before.

    Many buckets are carried in two levels, groups of ``CARRY_FAN`` and the buckets of a
    group, so no window holds them all; few go to every task.
    """
    if buckets <= CARRY_FAN:
        carry = totals.select(*keys, BUCKET, fold("__total").over(_before(keys, BUCKET)).alias("__carry"))
        return carry if keys else F.broadcast(carry)  # one row per bucket
    above = [*keys, "__group"]
    grouped = totals.withColumn("__group", F.call_function("div", F.col(BUCKET), F.lit(CARRY_FAN).cast("long")))
    inner = grouped.withColumn("__inner", fold("__total").over(_before(above, BUCKET)))
    whole = Window.partitionBy(*above).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = grouped.select(*above, fold("__total").over(whole).alias("__top")).groupBy(*above).agg(F.first("__top").alias("__top"))
    tops = tops.select(*above, fold("__top").over(_before(keys, "__group")).alias("__upper"))
    return inner.join(tops, above).select(*keys, BUCKET, combine(F.col("__upper"), F.col("__inner")).alias("__carry"))


def _sum_two(a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b)


_OPS = {
    "sum": (F.sum, _sum_two),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
}


def scan(
    df: DataFrame,
    order: str,
    val: str,
    op: str = "sum",
    exclusive: bool = False,
    identity: object = None,
    keys: Sequence[str] = (),
    out: str = "scan",
    width: int | None = None,
) -> DataFrame:
    """Prefix scan of ``val`` along ``order`` (unique per key group), restarted per ``keys``.

    ``op`` is sum, min or max; ``identity`` replaces the empty prefix (0 for sum
    when not given).  One shuffle of the rows, by (keys, bucket): a hot key is
    split like any other stretch of the order.
    """
    fold, combine = _OPS[op]
    if identity is None and op == "sum":
        identity = 0
    columns = df.columns
    tagged, buckets = _bucketed(df, order, width)
    if keys:
        tagged = tagged.withColumn(KEY, F.struct(*keys))  # a struct of nulls equals itself
    part = [KEY] if keys else []
    cells = [*part, BUCKET]
    rows = Window.partitionBy(*cells).orderBy(order)
    rows = rows.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    totals = tagged.groupBy(*cells).agg(fold(val).alias("__total"))
    carry = _carried(totals, part, fold, combine, buckets)
    local = tagged.withColumn("__local", fold(val).over(rows))
    value = combine(F.col("__carry"), F.col("__local"))
    if identity is not None:
        value = F.coalesce(value, F.lit(identity))
    return local.join(carry, cells).select(*columns, value.alias(out))


def last_mark(rows: DataFrame, marks: DataFrame, order: str, mark: str, n: int, out: str) -> DataFrame:
    """Add the ``mark`` of the last row of ``marks`` at or before each row along ``order``, a place in 0..n-1.

    Marks grow with their place.  Rows and marks meet in the buckets of one shuffle;
    what is carried into a bucket is known from the marks alone, so the rows are read
    once.
    """
    spark, columns = rows.sparkSession, rows.columns
    width = dense_width(spark, n)
    bucket = F.call_function("div", F.col(order), F.lit(int(width)).cast("long"))
    kind = marks.schema[mark].dataType
    both = rows.select(*columns, F.lit(None).cast(kind).alias("__mark"))
    both = both.unionByName(marks.select(order, F.col(mark).alias("__mark")), allowMissingColumns=True).withColumn(BUCKET, bucket)
    upto = Window.partitionBy(BUCKET).orderBy(order, F.col("__mark").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__local", F.max("__mark").over(upto)).where("__mark IS NULL")
    totals = marks.groupBy(bucket.alias(BUCKET)).agg(F.max(mark).alias("__total"))
    totals = spark.range(width.buckets).withColumnRenamed("id", BUCKET).join(totals, BUCKET, "left")
    carry = _carried(totals, [], F.max, F.greatest, width.buckets)
    return found.join(carry, BUCKET).select(*columns, F.coalesce("__local", "__carry").alias(out))


def with_previous(
    df: DataFrame, order: str, cols: Sequence[str], out: str = "prev", width: int | None = None
) -> DataFrame:
    """Add the struct of ``cols`` of the row just before in ``order`` (NULL for the first row)."""
    columns = df.columns
    tagged, buckets = _bucketed(df, order, width)
    record = F.struct(*cols)
    inside = Window.partitionBy(BUCKET).orderBy(order)
    last = tagged.groupBy(BUCKET).agg(F.max_by(record, F.col(order)).alias("__total"))
    carry = _carried(last, [], F.last, lambda upper, inner: F.coalesce(inner, upper), buckets)
    return (
        tagged.withColumn("__lag", F.lag(record).over(inside))
        .join(carry, BUCKET)
        .select(*columns, F.coalesce("__lag", "__carry").alias(out))
    )


def ranked(df: DataFrame, order: Sequence[str | Column], out: str = "pos") -> DataFrame:
    """Number the rows 0, 1, ... along any total order of columns.

    One range shuffle: the sorted frame is kept in the shared folder, the ids Spark
    gives rows inside each partition become positions by adding the sizes of the
    partitions before.  Sampled range bounds may differ from run to run, hence the
    durable copy between the two readings.
    """
    columns = df.columns
    tagged = materialize(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", _ID_BITS)
    inner = F.col("__id").bitwiseAND(F.lit((1 << _ID_BITS) - 1))
    tagged = tagged.select(*columns, part.alias("__part"), inner.alias("__inner"))
    sizes = tagged.groupBy("__part").agg((F.max("__inner") + 1).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return tagged.join(F.broadcast(starts), "__part").select(  # one row per partition
        *columns, (F.col("__start") + F.col("__inner")).alias(out)
    )
