"""Sorting, merging, scans and keyed reductions."""

from __future__ import annotations

from pyspark.sql import functions as F

import coogrid.operators.order as order
import coogrid.operators.reduce as red
from coogrid.functions import micros
from coogrid.plans.ordered import dense_width, scan

from .registry import query
from .tables import CENTS, G, Tables


@query("ordered", f"WITH {G} SELECT row_number() OVER (ORDER BY row_id, col_id) - 1 AS pos, row_id, col_id FROM g")
def ordered(t: Tables):
    return order.ordered_positions(t.graph())


def _sorted_sql(direction: str) -> str:
    return f"""SELECT row_number() OVER (ORDER BY user_id {direction}, event_id) - 1 AS rank, user_id, event_id,
       event_type, value FROM events"""


def _events(t: Tables):
    return t.read("events").select("user_id", "event_id", "event_type", "value")


@query("sort_by_key", _sorted_sql("ASC"))
def sort_by_key(t: Tables):
    """Events by user, in event order within a user, with two payloads."""
    return order.sort_by_key(_events(t), "user_id", "event_id")


@query("sort_by_key_desc", _sorted_sql("DESC"))
def sort_by_key_desc(t: Tables):
    return order.sort_by_key(_events(t), "user_id", "event_id", ascending=False)


@query(
    "merge_sorted",
    f"""WITH {G}, u AS (SELECT row_id, col_id FROM g UNION ALL SELECT col_id, row_id FROM g)
SELECT row_number() OVER (ORDER BY row_id, col_id) - 1 AS pos, row_id, col_id FROM u""",
)
def merge_sorted(t: Tables):
    g = t.graph()
    return order.merge_sorted(g, g.transposed())


@query(
    "merge_values",
    """SELECT row_number() OVER (ORDER BY v) - 1 AS pos, v
FROM (SELECT l_partkey AS v FROM lineitem UNION ALL SELECT l_suppkey FROM lineitem)""",
)
def merge_values(t: Tables):
    lines = t.read("lineitem")
    return order.merge_values(
        lines.select(F.col("l_partkey").alias("v")), lines.select(F.col("l_suppkey").alias("v")), "v"
    )


@query(
    "flag_repeats",
    """WITH r AS (SELECT l_orderkey AS row_id, l_partkey AS col_id, l_linenumber FROM lineitem),
p AS (SELECT *, row_number() OVER (ORDER BY row_id, col_id, l_linenumber) - 1 AS pos,
             lag(row_id) OVER w AS pr, lag(col_id) OVER w AS pc FROM r
      WINDOW w AS (ORDER BY row_id, col_id, l_linenumber)),
f AS (SELECT *, CASE WHEN row_id = pr AND col_id = pc THEN 1 ELSE 0 END AS s FROM p)
SELECT row_id, col_id, l_linenumber, pos, CAST(s AS BIGINT) AS is_repeat, CAST(1 - s AS BIGINT) AS is_new FROM f""",
)
def flag_repeats(t: Tables):
    return order.flag_repeats(t.raw_pairs(), ["row_id", "col_id"], "l_linenumber")


def _scan_sql(call: str) -> str:
    return f"WITH {CENTS} SELECT event_id, {call} AS scan FROM c"


def _by_time(t: Tables):
    return t.cents().select("event_id", micros("ts").alias("at"), "cents")


_UP_TO = "OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING)"
_BEFORE = "OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("scan_sum", _scan_sql(f"CAST(sum(cents) {_UP_TO} AS BIGINT)"))
def scan_sum(t: Tables):
    return scan(_by_time(t), "at", "cents").select("event_id", "scan")


@query("scan_exclusive", _scan_sql(f"CAST(coalesce(sum(cents) {_BEFORE}, 0) AS BIGINT)"))
def scan_exclusive(t: Tables):
    return scan(_by_time(t), "at", "cents", exclusive=True).select("event_id", "scan")


@query("scan_min", _scan_sql(f"min(cents) {_UP_TO}"))
def scan_min(t: Tables):
    return scan(_by_time(t), "at", "cents", "min").select("event_id", "scan")


@query("scan_max", _scan_sql(f"coalesce(max(cents) {_BEFORE}, -1)"))
def scan_max(t: Tables):
    """Exclusive maximum with identity -1."""
    return scan(_by_time(t), "at", "cents", "max", exclusive=True, identity=-1).select("event_id", "scan")


@query("scan_min_exclusive", _scan_sql(f"min(cents) {_BEFORE}"))
def scan_min_exclusive(t: Tables):
    return scan(_by_time(t), "at", "cents", "min", exclusive=True).select("event_id", "scan")


@query("scan_max_inclusive", _scan_sql(f"max(cents) {_UP_TO}"))
def scan_max_inclusive(t: Tables):
    return scan(_by_time(t), "at", "cents", "max").select("event_id", "scan")


@query(
    "scan_by_key",
    f"""WITH {CENTS} SELECT event_type, event_id,
       CAST(sum(cents) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS scan
FROM c""",
)
def scan_by_key(t: Tables):
    rows = t.cents().select("event_type", "event_id", "cents")
    return red.scan_by_key(rows, "event_type", "event_id", "cents").drop("cents")


@query("reduce_by_key", f"WITH {CENTS} SELECT user_id, CAST(sum(cents) AS BIGINT) AS cents FROM c GROUP BY user_id")
def reduce_by_key(t: Tables):
    return red.reduce_by_key(t.cents(), "user_id", "cents")


@query(
    "reduce_by_runs",
    f"""WITH {CENTS},
f AS (SELECT *, CASE WHEN event_type = lag(event_type, 1, event_type) OVER (ORDER BY event_id) THEN 0 ELSE 1 END AS s
      FROM c),
r AS (SELECT *, sum(s) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT CAST(run AS BIGINT) AS run_id, event_type, CAST(sum(cents) AS BIGINT) AS cents FROM r GROUP BY run, event_type""",
)
def reduce_by_runs(t: Tables):
    """Sum per run of equal event types; event ids are dense."""
    width = dense_width(t.spark, t.size("events"))
    return red.reduce_by_runs(t.cents(), "event_id", "event_type", "cents", width)
