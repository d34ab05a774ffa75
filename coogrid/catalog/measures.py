"""Timing statistics, memory peaks, lookups and interval joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import coogrid.operators.intervals as iv
import coogrid.operators.measure as measure
from coogrid.functions import micros
from coogrid.matrix import Matrix
from coogrid.operators.stats import mxm_workload
from coogrid.plans.durable import scratch_path
import coogrid.streaming.live as live
from coogrid.sources.summary import (
    append_summary,
    append_summary_text,
    read_summaries,
    read_summary_text,
    section_lines,
    section_report as write_report,
)

from .registry import query
from .tables import CENTS, SECTIONS, Tables

_STATS = """SELECT event_type AS experiment, count(*) AS iterations, round(sum(value), 4) AS total_ms,
       round(avg(value), 6) AS avg_ms,
       round(coalesce(avg(value) FILTER (WHERE event_id > 0), 0), 6) AS avg_drop_first_ms,
       round(coalesce(stddev_samp(value), 0), 6) AS sd_ms, min(value) AS min_ms, max(value) AS max_ms
FROM events GROUP BY event_type"""


def _rounded_stats(t: Tables):
    return measure.timing_stats(t.timings()).select(
        "experiment",
        "iterations",
        F.round("total_ms", 4).alias("total_ms"),
        *(F.round(c, 6).alias(c) for c in ("avg_ms", "avg_drop_first_ms", "sd_ms")),
        "min_ms",
        "max_ms",
    )


@query("timing_stats", _STATS)
def timing_stats(t: Tables):
    return _rounded_stats(t)


@query(
    "trimmed_mean",
    """WITH s AS (SELECT event_type, count(*) AS n, avg(value) AS m, coalesce(stddev_samp(value), 0) AS sd
           FROM events GROUP BY event_type)
SELECT event_type AS experiment, n, count(*) FILTER (WHERE abs(value - m) <= sd) AS kept, round(m, 6) AS mean_ms,
       round(avg(value) FILTER (WHERE abs(value - m) <= sd), 6) AS trimmed_ms
FROM events JOIN s USING (event_type) GROUP BY event_type, n, m""",
)
def trimmed_mean(t: Tables):
    got = measure.trimmed_mean(t.timings())
    return got.withColumns({c: F.round(c, 6) for c in ("mean_ms", "trimmed_ms")})


@query(
    "usage_peak",
    f"""WITH {CENTS} SELECT user_id, max(cents) AS max_mib, min(cents) AS min_mib, max(cents) - min(cents) AS peak_mib,
       count(*) AS samples FROM c GROUP BY user_id""",
)
def usage_peak(t: Tables):
    return measure.usage_peak(t.cents(), "user_id", "cents")


def _rates_sql(rate: str) -> str:
    return f"""WITH s AS (SELECT event_type, avg(value) AS ms, row_number() OVER (ORDER BY event_type) AS k
           FROM events WHERE event_id > 0 GROUP BY event_type),
e AS (SELECT count(*) AS n FROM s),
f AS (SELECT l_returnflag AS matrix_id, row_number() OVER (ORDER BY l_returnflag) AS k FROM lineitem GROUP BY l_returnflag),
g AS (SELECT DISTINCT l_returnflag AS matrix_id, l_orderkey AS r, l_partkey AS c FROM lineitem),
z AS (SELECT matrix_id, count(*) AS nnz, count(DISTINCT r) AS nrows, count(DISTINCT c) AS ncols FROM g GROUP BY matrix_id),
d AS (SELECT matrix_id, c, count(*) AS n FROM g GROUP BY matrix_id, c),
o AS (SELECT matrix_id, r, count(*) AS n FROM g GROUP BY matrix_id, r),
w AS (SELECT d.matrix_id, sum(d.n * o.n) AS work FROM d JOIN o ON d.matrix_id = o.matrix_id AND d.c = o.r GROUP BY d.matrix_id)
SELECT matrix_id, round({rate}, 9) AS rate
FROM z JOIN f USING (matrix_id) JOIN w USING (matrix_id) CROSS JOIN e JOIN s ON s.k = (f.k - 1) % e.n + 1"""


def _sizes(t: Tables):
    """Per return flag: sizes of its order-part graph, work of squaring it, and the mean time of an experiment."""
    lines = t.read("lineitem")
    flags = [r[0] for r in lines.select("l_returnflag").distinct().orderBy("l_returnflag").collect()]
    stats = measure.timing_stats(t.timings()).orderBy("experiment")
    names = [r["experiment"] for r in stats.select("experiment").collect()]
    n = t.size("orders")
    parts = []
    for k, flag in enumerate(flags):
        g = Matrix.from_edges(lines.where(F.col("l_returnflag") == flag), "l_orderkey", "l_partkey", n, n)
        sizes = g.df.agg(
            F.count("*").alias("nnz"), F.countDistinct("row_id").alias("nrows"), F.countDistinct("col_id").alias("ncols")
        )
        work = mxm_workload(g, g).agg(F.sum("work").alias("work"))
        time = stats.where(F.col("experiment") == names[k % len(names)]).select(F.col("avg_drop_first_ms").alias("ms"))
        one = sizes.crossJoin(work).crossJoin(time)  # one row each
        parts.append(one.withColumn("matrix_id", F.lit(flag)))
    return reduce(DataFrame.union, parts)


def _rate(t: Tables, kind: str):
    return measure.throughput(_sizes(t), kind).select("matrix_id", F.round("rate", 9).alias("rate"))


@query("throughput", _rates_sql("nnz / (ms * 1e6)"))
def throughput(t: Tables):
    return _rate(t, "elements")


@query("throughput_spmv", _rates_sql("(4 * (nnz + nrows) + 4 * (nnz + ncols + nrows)) / (ms * 1e6)"))
def throughput_spmv(t: Tables):
    return _rate(t, "spmv")


@query("throughput_spgemm", _rates_sql("2.0::DOUBLE * work / ms"))
def throughput_spgemm(t: Tables):
    return _rate(t, "spgemm")


@query(
    "summaries",
    """WITH s AS (SELECT event_type AS name, count(*) AS iterations,
       round(coalesce(avg(value) FILTER (WHERE event_id > 0), 0), 6) AS expectation_ms,
       round(coalesce(stddev_samp(value), 0), 6) AS sd_ms FROM events GROUP BY event_type)
SELECT *, 'add' AS target FROM s UNION ALL SELECT *, 'multiply' FROM s""",
)
def summaries(t: Tables):
    """Two targets append their summaries, the report reads both."""
    base = scratch_path(t.spark, "summaries")
    stats = _rounded_stats(t)
    for target in ("multiply", "add"):
        append_summary(stats, f"{base}/target={target}")
    return read_summaries(t.spark, base)


_MEMORY = f"""WITH {SECTIONS},
m AS (SELECT s.section_id, count(*) AS n, min(cents) AS lo, max(cents) AS hi
      FROM s JOIN c ON c.ts >= s.b AND c.ts < s.last GROUP BY s.section_id),
r AS (SELECT event_id AS section_id, event_type AS name, coalesce(n, 0) AS samples, lo AS min_mib, hi AS max_mib,
             hi - lo AS used_mib FROM events LEFT JOIN m ON event_id = section_id)"""


@query(
    "summary_text",
    """SELECT event_type AS name, count(*) AS iterations,
       round(coalesce(avg(value) FILTER (WHERE event_id > 0), 0), 6) AS expectation_ms,
       round(coalesce(stddev_samp(value), 0), 6) AS sd_ms FROM events GROUP BY event_type""",
)
def summary_text(t: Tables):
    """The summaries as fixed-width text, read back."""
    path = scratch_path(t.spark, "summary-text")
    append_summary_text(_rounded_stats(t), path, "multiply")
    return read_summary_text(t.spark, path).drop("file")


@query(
    "section_report_text",
    _MEMORY
    + r""" SELECT section_id, name, min_mib, max_mib, used_mib FROM r WHERE samples > 0""",
)
def section_report_text(t: Tables):
    """The report written as text and read back: figures of the sections that are not empty."""
    path = scratch_path(t.spark, "report")
    experiments = t.experiments()
    table = iv.section_memory(t.samples(), experiments)
    write_report(table.join(experiments.select("section_id", "name"), "section_id"), path)
    shape = r"(?s)^\[(\d+)\] ([^\n]+)\nmin= (\d+) MiB max= (\d+) MiB used= (\d+) MiB"
    text = t.spark.read.option("lineSep", "\n\n").text(path)
    text = text.where(F.col("value").rlike(shape))

    def group(i: int, kind: str = "bigint"):
        return F.regexp_extract("value", shape, i).cast(kind)

    return text.select(
        group(1).alias("section_id"),
        group(2, "string").alias("name"),
        group(3).alias("min_mib"),
        group(4).alias("max_mib"),
        group(5).alias("used_mib"),
    )


@query(
    "live_section_memory",
    f"""WITH {CENTS}, e AS (SELECT event_id AS section_id, ts AS b, ts + INTERVAL 37 MINUTE AS f FROM events)
SELECT section_id, count(*) AS samples, min(cents) AS min_mib, max(cents) AS max_mib, max(cents) - min(cents) AS used_mib
FROM e JOIN c ON c.ts >= e.b AND c.ts <= e.f GROUP BY section_id""",
)
def live_section_memory(t: Tables):
    """The live figures over all samples as one batch."""
    return live.live_section_memory(t.samples(), t.experiments())


def _asof_sql(match: str) -> str:
    return f"""WITH p AS (SELECT event_id, ts + INTERVAL 37 MINUTE AS t FROM events),
b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events)
SELECT p.event_id, CASE WHEN t BETWEEN lo AND hi THEN epoch_us(e.ts) END AS sample_us
FROM p CROSS JOIN b ASOF LEFT JOIN events e ON {match}"""


def _asof(t: Tables, direction: str):
    points = t.experiments().select(F.col("section_id").alias("event_id"), F.col("t_end").alias("at"))
    found = iv.asof(t.samples(), points, direction)
    return found.select("event_id", micros("sample_ts").alias("sample_us"))


@query("asof_left", _asof_sql("p.t >= e.ts"))
def asof_left(t: Tables):
    return _asof(t, "left")


@query("asof_right", _asof_sql("p.t <= e.ts"))
def asof_right(t: Tables):
    return _asof(t, "right")


@query(
    "sections",
    f"""WITH {SECTIONS} SELECT s.section_id, c.event_id AS seq FROM s JOIN c ON c.ts >= s.b AND c.ts < s.last""",
)
def sections(t: Tables):
    return iv.sections(t.samples(), t.experiments()).select("section_id", "seq")


@query("section_memory", _MEMORY + " SELECT section_id, samples, min_mib, max_mib, used_mib FROM r")
def section_memory(t: Tables):
    return iv.section_memory(t.samples(), t.experiments())


@query(
    "section_report",
    _MEMORY
    + r""" SELECT section_id, '[' || section_id || '] ' || name || chr(10) || 'min= ' || coalesce(CAST(min_mib AS VARCHAR), '-')
  || ' MiB max= ' || coalesce(CAST(max_mib AS VARCHAR), '-') || ' MiB used= ' || coalesce(CAST(used_mib AS VARCHAR), '-')
  || ' MiB' || chr(10) AS line FROM r""",
)
def section_report(t: Tables):
    experiments = t.experiments()
    table = iv.section_memory(t.samples(), experiments)
    return section_lines(table.join(experiments.select("section_id", "name"), "section_id"))
