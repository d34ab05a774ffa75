"""Keyed reductions and segmented scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import scan, with_previous


def reduce_by_key(df: DataFrame, key: str, val: str) -> DataFrame:
    """Sum per key: ``<key>, <val>``."""
    return df.groupBy(key).agg(F.sum(val).alias(val))


def reduce_by_runs(
    df: DataFrame, order: str, key: str, val: str, width: int | None = None
) -> DataFrame:
    """Sum per run of equal adjacent keys along ``order``: ``run_id, <key>, <val>``.

    A key that comes back later starts a new run.  ``order`` must have no ties.
    """
    rows = df.select(order, key, val)
    compared = with_previous(rows, order, [key], out="__prev", width=width)
    starts = ~F.coalesce(F.col("__prev")[key].eqNullSafe(F.col(key)), F.lit(False))
    # The first row has no predecessor; a NULL key there must still not open run 1.
    opens = F.when(F.col("__prev").isNull(), F.lit(0)).otherwise(starts.cast("int"))
    numbered = scan(
        compared.withColumn("__opens", opens.cast("long")), order, "__opens", out="run_id", width=width
    )
    return numbered.groupBy("run_id", key).agg(F.sum(val).alias(val))


def scan_by_key(
    df: DataFrame,
    key: str,
    order: str,
    val: str,
    op: str = "sum",
    exclusive: bool = False,
    out: str = "scan",
) -> DataFrame:
    """Prefix scan restarted for every key."""
    return scan(df, order, val, op=op, exclusive=exclusive, keys=[key], out=out)
