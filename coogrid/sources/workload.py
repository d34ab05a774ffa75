"""Workload lists: which matrices to load, how, and how often to run them."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .mtx import read_many

_SCHEMA = "matrix_id string, undirected boolean, iterations bigint"


def read_workload(spark: SparkSession, path: str) -> DataFrame:
    """``matrix_id, undirected, iterations`` from lines ``name flag count``.

    Lines that start with ``%`` and blank lines are skipped; a missing or unreadable
    number counts as 0.
    """
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    return lines.select(parts.alias("__t")).selectExpr(
        "get(__t, 0) AS matrix_id",
        "coalesce(try_cast(get(__t, 1) AS INT), 0) <> 0 AS undirected",
        "coalesce(try_cast(get(__t, 2) AS BIGINT), 0) AS iterations",
    )


def workload_entry(spark: SparkSession, name: str, undirected: bool, iterations: int) -> DataFrame:
    """A workload of a single matrix."""
    return spark.createDataFrame([(name, bool(undirected), int(iterations))], _SCHEMA)


def load_workload(spark: SparkSession, workload: DataFrame, base: str = "") -> tuple[DataFrame, DataFrame]:
    """All matrices of a workload as one table keyed by ``matrix_id``, and their shapes.

    The list itself names input paths, so the driver has to know it; the matrices
    are read and checked together in one job.
    """
    listed = [
        (x["matrix_id"], posixpath.join(base, x["matrix_id"]), x["undirected"]) for x in workload.collect()
    ]
    return read_many(spark, listed)
