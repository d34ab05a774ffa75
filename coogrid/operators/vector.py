"""Dense vectors: DataFrames ``idx BIGINT, val`` that hold every index once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..matrix import COL, ROW, VAL, Matrix

IDX = "idx"


def ieee_divide(a: Column, b: Column) -> Column:
    """Floating division that gives Inf and NaN where ANSI mode would raise."""
    a, b = a.cast("double"), b.cast("double")
    negative = (a < 0) != (b.cast("string") == "-0.0")
    inf = F.when(negative, F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).otherwise(inf)
    return F.when(b == 0, by_zero).otherwise(a / F.when(b != 0, b))


_OPS = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": ieee_divide,
}


def _zip(x: DataFrame, z: DataFrame) -> DataFrame:
    """Values of two vectors side by side; an index that only one of them holds fails the query."""
    a = x.select(IDX, F.struct(F.col(VAL).alias("v")).alias("__a"))
    b = z.select(IDX, F.struct(F.col(VAL).alias("v")).alias("__b"))
    lone = F.raise_error(F.concat(F.lit("vectors differ in length: one lacks index "), F.col(IDX).cast("string")))
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    at = F.when(both, F.col(IDX)).otherwise(lone.cast("long"))
    return a.join(b, IDX, "full").select(
        at.alias(IDX), F.when(both, F.col("__a.v")).otherwise(lone).alias("__x"), F.col("__b.v").alias("__z")
    )


def full(spark: SparkSession, n: int, v: float) -> DataFrame:
    """The constant vector of length n."""
    return spark.range(n).select(F.col("id").alias(IDX), F.lit(v).alias(VAL))


def axpy(alpha: float, x: DataFrame, z: DataFrame, op: str = "+") -> DataFrame:
    """``z op (alpha * x)`` for op in + - *."""
    return _zip(x, z).select(IDX, _OPS[op](F.col("__z"), F.lit(alpha) * F.col("__x")).alias(VAL))


def axpby(alpha: float, x: DataFrame, beta: float, z: DataFrame, op: str = "+") -> DataFrame:
    """``(alpha * x) op (beta * z)`` for op in + - *."""
    scaled = _OPS[op](F.lit(alpha) * F.col("__x"), F.lit(beta) * F.col("__z"))
    return _zip(x, z).select(IDX, scaled.alias(VAL))


def scale(alpha: float, y: DataFrame) -> DataFrame:
    return y.select(IDX, (F.lit(alpha) * F.col(VAL)).alias(VAL))


def ewise(x: DataFrame, y: DataFrame, op: str) -> DataFrame:
    """``x op y`` for op in + - * /; division follows IEEE rules."""
    return _zip(x, y).select(IDX, _OPS[op](F.col("__x"), F.col("__z")).alias(VAL))


def diagonal(A: Matrix, inverse: bool = False) -> DataFrame:
    """Stored diagonal entries as a vector; rows without one are left out."""
    a = A if A.valued else A.with_ones()
    val = F.col(VAL)
    if inverse:
        val = ieee_divide(F.lit(1.0), val)
    return a.df.where(F.col(ROW) == F.col(COL)).select(F.col(ROW).alias(IDX), val.alias(VAL))


def vsum(x: DataFrame) -> DataFrame:
    return x.agg(F.sum(VAL).alias(VAL))


def vsumsq(x: DataFrame) -> DataFrame:
    return x.agg(F.sum(F.col(VAL) * F.col(VAL)).alias(VAL))


def vsumabs(x: DataFrame) -> DataFrame:
    return x.agg(F.sum(F.abs(VAL)).alias(VAL))


def nrm1(x: DataFrame) -> DataFrame:
    """Sum of magnitudes."""
    return vsumabs(x)


def nrm2(x: DataFrame) -> DataFrame:
    """Euclidean norm."""
    return x.agg(F.sqrt(F.sum(F.col(VAL) * F.col(VAL))).alias(VAL))


def dot(x: DataFrame, y: DataFrame) -> DataFrame:
    return _zip(x, y).agg(F.sum(F.col("__x") * F.col("__z")).alias(VAL))
