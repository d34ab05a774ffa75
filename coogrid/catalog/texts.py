"""Text formats: tables written out as text and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

import coogrid.sources.mtx as mtx
from coogrid.functions import micros
from coogrid.matrix import Matrix
from coogrid.plans.durable import scratch_path
from coogrid.sources.samples import read_mem_samples, read_time_points, read_usage_samples
from coogrid.sources.workload import load_workload, read_workload

from .registry import query
from .tables import G, G2, W, Tables


@query("mtx_roundtrip", f"WITH {G} SELECT row_id, col_id FROM g")
def mtx_roundtrip(t: Tables):
    path = scratch_path(t.spark, "pattern.mtx")
    mtx.write_mtx(t.graph(), path)
    return mtx.read_mtx(t.spark, path).df


@query("mtx_undirected", f"WITH {G} SELECT row_id, col_id FROM g UNION SELECT col_id, row_id FROM g")
def mtx_undirected(t: Tables):
    path = scratch_path(t.spark, "undirected.mtx")
    mtx.write_mtx(t.graph(), path)
    return mtx.read_mtx(t.spark, path, undirected=True).df


@query("mtx_values_roundtrip", f"WITH {W} SELECT row_id, col_id, val FROM w")
def mtx_values_roundtrip(t: Tables):
    path = scratch_path(t.spark, "values.mtx")
    mtx.write_mtx_values(t.weights(), path)
    return mtx.read_mtx_values(t.spark, path).df


@query(
    "mtx_values_nonzero",
    """SELECT l_suppkey AS row_id, l_partkey AS col_id, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) AS val
FROM lineitem GROUP BY l_suppkey, l_partkey HAVING sum(CAST(round(l_discount * 100) AS BIGINT)) <> 0""",
)
def mtx_values_nonzero(t: Tables):
    """Summed discounts in hundredths as text, read back without the zeros."""
    path = scratch_path(t.spark, "discounts.mtx")
    lines = t.read("lineitem").withColumn("cents", F.round(F.col("l_discount") * 100).cast("bigint"))
    shape = t.size("supplier"), t.size("part")
    mtx.write_mtx_values(Matrix.from_edges(lines, "l_suppkey", "l_partkey", *shape, "cents", "sum"), path)
    return mtx.read_mtx_values(t.spark, path, keep_zeros=False).df


@query("mtx_square_roundtrip", f"WITH {G2} SELECT row_id, col_id FROM g2")
def mtx_square_roundtrip(t: Tables):
    path = scratch_path(t.spark, "square.mtx")
    mtx.write_mtx(t.graph_squared(), path + "2")
    return mtx.read_mtx_square(t.spark, path).df


@query(
    "workload_read",
    """SELECT DISTINCT l_returnflag AS matrix_id, l_orderkey AS row_id, l_partkey AS col_id
FROM lineitem
UNION
SELECT l_returnflag, l_partkey, l_orderkey FROM lineitem WHERE l_returnflag = (SELECT min(l_returnflag) FROM lineitem)""",
)
def workload_read(t: Tables):
    """One text per return flag and a list that names them; the first is undirected."""
    spark, base, n = t.spark, scratch_path(t.spark, "workload"), t.size("orders")
    lines = t.read("lineitem")
    listed = ["% name | undirected | iterations"]
    flags = sorted(r[0] for r in lines.select("l_returnflag").distinct().collect())
    for flag in flags:
        of_flag = lines.where(F.col("l_returnflag") == flag)
        mtx.write_mtx(Matrix.from_edges(of_flag, "l_orderkey", "l_partkey", n, n), f"{base}/{flag}.mtx")
        listed.append(f"{flag}.mtx   {int(flag == flags[0])}   10")
    spark.createDataFrame([("\n".join(listed),)], "value string").write.text(f"{base}/config")
    table, _ = load_workload(spark, read_workload(spark, f"{base}/config"), base)
    return table.withColumn("matrix_id", F.regexp_replace("matrix_id", r"\.mtx$", ""))


@query(
    "mem_samples_read",
    """SELECT epoch_us(ts) // 1000 * 1000 AS ts_us, 'P' || user_id AS pstate, CAST(8117 AS BIGINT) AS total_mib,
       CAST(round(value * 100) AS BIGINT) AS used_mib FROM events""",
)
def mem_samples_read(t: Tables):
    """The events as a sampler's CSV with millisecond stamps."""
    path = scratch_path(t.spark, "samples.csv")
    rows = t.cents().select(
        F.date_format("ts", "yyyy/MM/dd HH:mm:ss.SSS").alias("timestamp"),
        F.concat(F.lit(" P"), "user_id").alias(" pstate"),
        F.lit(" 8117 MiB").alias(" memory.total [MiB]"),
        F.concat(F.lit(" "), "cents", F.lit(" MiB")).alias(" memory.used [MiB]"),
    )
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return read_mem_samples(t.spark, path).select(micros("ts").alias("ts_us"), "pstate", "total_mib", "used_mib")


@query(
    "usage_samples_read",
    "SELECT 8117 + user_id AS total_mib, CAST(round(value * 100) AS BIGINT) AS used_mib FROM events",
)
def usage_samples_read(t: Tables):
    """The events as the two-column form of a sampler's CSV."""
    path = scratch_path(t.spark, "usage.csv")
    rows = t.cents().select(
        F.concat((F.col("user_id") + 8117).cast("string"), F.lit(" MiB")).alias("memory.total [MiB]"),
        F.concat(F.lit(" "), "cents", F.lit(" MiB")).alias(" memory.used [MiB]"),
    )
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return read_usage_samples(t.spark, path)


@query(
    "time_points_read",
    """SELECT event_id AS section_id, event_type AS target, 'data/' || user_id || '.mtx' AS matrix,
       epoch_us(ts) // 1000 * 1000 AS begin_us, epoch_us(ts) // 1000 * 1000 + 90000000 AS end_us FROM events""",
)
def time_points_read(t: Tables):
    """The events as three-line records."""
    path = scratch_path(t.spark, "points.txt")
    stamp = "yyyy/MM/dd HH:mm:ss.SSS"
    by_event = t.read("events").orderBy("event_id").select(
        F.explode(
            F.array(
                F.concat("event_type", F.lit(" data/"), "user_id", F.lit(".mtx 1 10")),
                F.date_format("ts", stamp),
                F.date_format(F.expr("ts + INTERVAL 90 SECOND"), stamp),
            )
        ).alias("value")
    )
    by_event.write.text(path)
    return read_time_points(t.spark, path).select(
        "section_id",
        "target",
        "matrix",
        micros("t_begin").alias("begin_us"),
        micros("t_end").alias("end_us"),
    )
