"""Statistics of timing samples ``experiment, iteration, ms`` and memory samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import Stripes


def timing_stats(samples: DataFrame) -> DataFrame:
    """Per experiment: iterations, total, mean, mean without iteration 0, sd, min, max.

    The sd is the sample deviation about the mean of all iterations.  With a single
    iteration both the sd and the mean without the first are 0.
    """
    ms = F.col("ms")
    zero = F.lit(0.0)
    return samples.groupBy("experiment").agg(
        F.count(F.lit(1)).alias("iterations"),
        F.sum(ms).alias("total_ms"),
        F.avg(ms).alias("avg_ms"),
        F.coalesce(F.avg(F.when(F.col("iteration") > 0, ms)), zero).alias("avg_drop_first_ms"),
        F.coalesce(F.stddev_samp(ms), zero).alias("sd_ms"),
        F.min(ms).alias("min_ms"),
        F.max(ms).alias("max_ms"),
    )


def trimmed_mean(samples: DataFrame, k: float = 1.0) -> DataFrame:
    """Mean per experiment without samples more than k deviations from the mean.

    ``experiment, n, kept, mean_ms, trimmed_ms``.  The statistics are joined back to
    the samples with hot experiments cut into stripes, then combined map-side.
    """
    stats = samples.groupBy("experiment").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("ms").alias("mean_ms"),
        F.coalesce(F.stddev_samp("ms"), F.lit(0.0)).alias("__sd"),
    )
    stripes = Stripes(samples, ["experiment"])
    met = stripes.cut(samples, by=["iteration", "ms"]).join(stripes.copy(stats), stripes.on)
    near = F.abs(F.col("ms") - F.col("mean_ms")) <= F.lit(k) * F.col("__sd")
    return met.groupBy("experiment").agg(
        F.max("n").alias("n"),
        F.count_if(near).alias("kept"),
        F.max("mean_ms").alias("mean_ms"),
        F.avg(F.when(near, F.col("ms"))).alias("trimmed_ms"),
    )


def usage_peak(samples: DataFrame, by: str | None = None, used: str = "used_mib") -> DataFrame:
    """``max_mib, min_mib, peak_mib, samples`` of a sample stream, per ``by`` when given."""
    grouped = samples.groupBy(by) if by else samples.groupBy()
    return grouped.agg(
        F.max(used).alias("max_mib"),
        F.min(used).alias("min_mib"),
        (F.max(used) - F.min(used)).alias("peak_mib"),
        F.count(F.lit(1)).alias("samples"),
    )


def throughput(df: DataFrame, kind: str, index_bytes: int = 4, value_bytes: int = 4) -> DataFrame:
    """Add ``rate`` to rows with ``ms`` and sizes.

    * ``elements``: ``nnz`` per ns (Gi-elements/s of a conversion)
    * ``spmv``: bytes moved per ns from ``nnz, nrows, ncols``
    * ``spgemm``: twice ``work`` per ms (flops)
    """
    ns = F.col("ms") * F.lit(1e6)
    if kind == "elements":
        rate = F.col("nnz") / ns
    elif kind == "spmv":
        moved = F.lit(index_bytes) * (F.col("nnz") + F.col("nrows"))
        moved = moved + F.lit(value_bytes) * (F.col("nnz") + F.col("ncols") + F.col("nrows"))
        rate = moved / ns
    elif kind == "spgemm":
        rate = F.lit(2.0) * F.col("work") / F.col("ms")
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return df.withColumn("rate", rate)
