"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local cores.
Every query runs ``BENCH_RUNS`` times (four at least) into a no-op sink; as in the
published figures the first run is dropped, and the median of the rest is given.  The ``resident_*``
entries time the operation alone on matrices held in memory, the others start
from the parquet files.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from coogrid import ewise_add, mirror, mxm, mxm_add, spmv  # noqa: E402
from coogrid.catalog import QUERIES  # noqa: E402
from coogrid.catalog.tables import Tables  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = max(4, int(os.environ.get("BENCH_RUNS", "4")))
END_TO_END = (
    "mxm_bool mxm_hash mxm_plus_times mxm_weights mxm_add ewise_add square_workload kronecker mxm_workload "
    "mxm_row_nnz matrix_stats to_csr_offsets from_csr to_adjacency from_dense ordered merge_sorted flag_repeats "
    "scan_sum scan_by_key reduce_by_runs dot spmv spmm timing_stats trimmed_mean asof_left section_memory "
    "mtx_roundtrip"
).split()


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("coogrid-bench")
        .config("spark.sql.shuffle.partitions", CPUS if CPUS.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def seconds(make) -> float:
    """Median time of a query without its first run."""
    taken = []
    for _ in range(RUNS):
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        taken.append(time.perf_counter() - began)
    return round(statistics.median(taken[1:]), 3)


def main() -> None:
    spark = session()
    only = sys.argv[1:]
    tables = Tables(spark, SF_DIR)
    g = tables.graph().persist()
    nnz = g.nvals()
    x = tables.vector("orders", "o_orderkey", "o_totalprice").persist()
    x.count()
    both = mirror(g).persist()
    both.nvals()
    resident = {
        "resident_mxm": lambda: mxm(g, g).df,
        "resident_mxm_add": lambda: mxm_add(g, g, g).df,
        "resident_spmv": lambda: spmv(g, x),
        # The square and the mirrored graph in one result, of the size of the published ones.
        "resident_mxm_add_large": lambda: mxm_add(g, g, both).df,
    }
    times = {n: seconds(f) for n, f in resident.items() if not only or n in only}
    # The sum is timed with both operands in memory; a cached square must not serve the products.
    g2 = mxm(g, g).persist()
    nnz2 = g2.nvals()
    large = ewise_add(g2, both).nvals()
    if not only or "resident_add" in only:
        times["resident_add"] = seconds(lambda: ewise_add(g, g2).df)
    for m in (g, g2, both):
        m.unpersist()
    x.unpersist()
    for name in END_TO_END:
        if not only or name in only:
            times[name] = seconds(lambda: QUERIES[name](spark, SF_DIR))
    print(
        json.dumps(
            {
                "metric": "total time of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": SF_DIR.rsplit("sf", 1)[-1].strip("/"),
                "nnz": nnz,
                "nnz_squared": nnz2,
                "nnz_large": large,
                "cpus": CPUS,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
