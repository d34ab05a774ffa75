"""Where intermediate tables live when a plan has to be cut.

A cut must outlive the executor that wrote it, so every cut goes to the folder
the cluster names in ``spark.checkpoint.dir``.  Block-manager copies are used
only as a cache of something Spark can recompute, never as a cut.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a private one only for ``local`` masters."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):  # local-cluster has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="coogrid-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


#: Spark's switch for deleting the shuffle files of a query when it ends; without it they stay until the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files behind; for those whose result is kept elsewhere."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame) -> DataFrame:
    """Run ``df`` once, keep it in the shared folder and start a fresh lineage.

    The checkpoint keeps the partitioning and sort order of ``df``, so a frame
    that was laid out for a join is not shuffled again by that join.  What it shuffled
    on the way is deleted when it is complete.
    """
    spark = df.sparkSession
    shared_dir(spark)
    with shuffles_released(spark):
        return df.select("*").checkpoint(eager=True)  # a plan of its own: ``df`` may run again


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder for a table that a job writes and re-reads."""
    return f"{shared_dir(spark)}/coogrid/{name}-{uuid.uuid4().hex}"


def drop_cut(cut: DataFrame) -> None:
    """Delete the files of a frame made by :func:`materialize` that nothing reads any more."""
    kept = cut._jdf.logicalPlan().rdd().getCheckpointFile()
    if kept.isDefined():
        drop_path(cut.sparkSession, kept.get())


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table in the shared folder that nothing reads any more."""
    files, place = _place(spark, path)
    files.delete(place, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    files, place = _place(spark, path)
    return files.exists(place)


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place
