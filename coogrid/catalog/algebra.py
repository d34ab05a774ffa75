"""Construction, products, sums, sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

import coogrid.operators.add as add
import coogrid.operators.build as build
import coogrid.operators.multiply as multiply
import coogrid.operators.stats as stats

from .registry import query
from .tables import G, G2, W, Tables

_PRODUCT = f"WITH {G} SELECT DISTINCT x.row_id, y.col_id FROM g x JOIN g y ON x.col_id = y.row_id"


@query("from_edges", f"WITH {G} SELECT row_id, col_id FROM g")
def from_edges(t: Tables):
    return t.graph().df


@query(
    "from_edges_first",
    """SELECT user_id AS row_id, CAST(hour(ts) AS BIGINT) AS col_id, arg_min(value, event_id) AS val
FROM events GROUP BY 1, 2""",
)
def from_edges_first(t: Tables):
    """Valued build of user x hour where the first event of a pair counts."""
    events = t.read("events").withColumn("hour", F.hour("ts"))
    shape = t.size("customer"), 24
    return build.Matrix.from_edges(events, "user_id", "hour", *shape, "value", "first", "event_id").df


@query("mirror", f"WITH {G} SELECT row_id, col_id FROM g UNION SELECT col_id, row_id FROM g")
def mirror(t: Tables):
    return build.mirror(t.graph()).df


@query(
    "duplicate_entries",
    """SELECT l_suppkey AS row_id, l_partkey AS col_id, count(*) AS n
FROM lineitem GROUP BY l_suppkey, l_partkey HAVING count(*) > 1""",
)
def duplicate_entries(t: Tables):
    raw = t.read("lineitem").select(F.col("l_suppkey").alias("row_id"), F.col("l_partkey").alias("col_id"))
    return build.duplicate_entries(raw)


@query(
    "duplicate_entries_undirected",
    """WITH p AS (SELECT least(l_suppkey, l_partkey) AS row_id, greatest(l_suppkey, l_partkey) AS col_id FROM lineitem)
SELECT row_id, col_id, count(*) AS n FROM p GROUP BY row_id, col_id HAVING count(*) > 1""",
)
def duplicate_entries_undirected(t: Tables):
    raw = t.read("lineitem").select(F.col("l_suppkey").alias("row_id"), F.col("l_partkey").alias("col_id"))
    return build.duplicate_entries(raw, undirected=True)


@query("dedup", f"WITH {G} SELECT row_id, col_id FROM g")
def dedup(t: Tables):
    return build.dedup(t.raw_pairs().drop("l_linenumber"))


@query("dedup_values", "SELECT DISTINCT l_partkey FROM lineitem")
def dedup_values(t: Tables):
    return build.dedup_values(t.read("lineitem"), "l_partkey")


@query(
    "validate_entries",
    """SELECT l_orderkey AS row_id, l_partkey AS col_id FROM lineitem
WHERE l_orderkey < 0 OR l_orderkey >= (SELECT count(*) FROM orders)
   OR l_partkey < 0 OR l_partkey >= (SELECT count(*) FROM supplier)""",
)
def validate_entries(t: Tables):
    """Entries that would not fit if parts were numbered like suppliers."""
    raw = t.raw_pairs().drop("l_linenumber")
    build.validate_entries(raw, t.size("orders"), t.size("part"), t.size("lineitem"))
    return build.bad_entries(raw, t.size("orders"), t.size("supplier"))


@query("extract_pairs", f"WITH {G2} SELECT row_id, col_id FROM g2")
def extract_pairs(t: Tables):
    return t.graph_squared().extract_pairs()


@query("mxm_bool", _PRODUCT)
def mxm_bool(t: Tables):
    return t.graph_squared().df


@query("mxm_any_pair", _PRODUCT)
def mxm_any_pair(t: Tables):
    g = t.graph()
    return multiply.mxm(g, g, "any_pair").df


@query("mxm_hash", _PRODUCT)
def mxm_hash(t: Tables):
    g = t.graph()
    return multiply.mxm(g, g, strategy="hash").df


@query(
    "mxm_plus_times",
    f"""WITH {G} SELECT x.row_id, y.col_id, count(*) AS val
FROM g x JOIN g y ON x.col_id = y.row_id GROUP BY x.row_id, y.col_id""",
)
def mxm_plus_times(t: Tables):
    """Path counts."""
    g = t.graph()
    return multiply.mxm(g, g, "plus_times").df


def _w_product(combine: str) -> str:
    return f"""WITH {W} SELECT x.row_id, y.row_id AS col_id, {combine} AS val
FROM w x JOIN w y ON x.col_id = y.col_id GROUP BY x.row_id, y.row_id"""


@query("mxm_weights", _w_product("sum(x.val * y.val)"))
def mxm_weights(t: Tables):
    """Numeric W times its transpose."""
    w = t.weights()
    return multiply.mxm(w, w.transposed(), "plus_times").df


@query("mxm_min_plus", _w_product("min(x.val + y.val)"))
def mxm_min_plus(t: Tables):
    w = t.weights()
    return multiply.mxm(w, w.transposed(), "min_plus").df


@query("mxm_max_times", _w_product("max(x.val * y.val)"))
def mxm_max_times(t: Tables):
    w = t.weights()
    return multiply.mxm(w, w.transposed(), "max_times").df


@query("mxm_bool_or_and", _w_product("bool_or(x.val > 25 AND y.val > 25)"))
def mxm_bool_or_and(t: Tables):
    """Boolean values: suppliers that both sell much of a common part."""
    w = t.weights()
    much = build.Matrix(w.df.withColumn("val", F.col("val") > 25), *w.shape)
    return multiply.mxm(much, much.transposed(), "bool_or_and").df


@query("mxm_user", _w_product("max(least(x.val, y.val))"))
def mxm_user(t: Tables):
    """A user semiring: widest path of two steps."""
    w = t.weights()
    return multiply.mxm(w, w.transposed(), mul=lambda a, b: F.least(a, b), add=F.max).df


@query("mxm_add", f"WITH {G2} SELECT row_id, col_id FROM g2 UNION SELECT row_id, col_id FROM g")
def mxm_add(t: Tables):
    g = t.graph()
    return multiply.mxm_add(g, g, g).df


@query("ewise_add", f"WITH {G2} SELECT row_id, col_id FROM g UNION SELECT row_id, col_id FROM g2")
def ewise_add(t: Tables):
    return add.ewise_add(t.graph(), t.graph_squared()).df


@query("ewise_add_any_pair", f"WITH {G2} SELECT row_id, col_id FROM g UNION SELECT row_id, col_id FROM g2")
def ewise_add_any_pair(t: Tables):
    return add.ewise_add(t.graph(), t.graph_squared(), "any_pair").df


def _two_weights() -> str:
    return f"""WITH {W},
v AS (SELECT l_suppkey AS row_id, l_partkey AS col_id, max(l_quantity) AS val
      FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey, l_partkey)"""


def _returned(t: Tables):
    lines = t.read("lineitem").where("l_returnflag = 'R'")
    shape = t.size("supplier"), t.size("part")
    return build.Matrix.from_edges(lines, "l_suppkey", "l_partkey", *shape, "l_quantity", "max")


@query(
    "ewise_add_max",
    _two_weights()
    + """ SELECT row_id, col_id, max(val) AS val FROM (SELECT * FROM w UNION ALL SELECT * FROM v)
GROUP BY row_id, col_id""",
)
def ewise_add_max(t: Tables):
    return add.ewise_add(t.weights(), _returned(t), add=F.max).df


@query(
    "axpby_matrix",
    _two_weights()
    + """ SELECT row_id, col_id, sum(val) AS val
FROM (SELECT row_id, col_id, 3 * val AS val FROM w UNION ALL SELECT row_id, col_id, -2 * val FROM v)
GROUP BY row_id, col_id""",
)
def axpby_matrix(t: Tables):
    return add.axpby_matrix(3.0, t.weights(), -2.0, _returned(t)).df


@query(
    "square_workload",
    """WITH m AS (SELECT DISTINCT l_returnflag AS matrix_id, l_orderkey AS row_id, l_partkey AS col_id FROM lineitem)
SELECT DISTINCT x.matrix_id, x.row_id, y.col_id
FROM m x JOIN m y ON x.matrix_id = y.matrix_id AND x.col_id = y.row_id""",
)
def square_workload(t: Tables):
    """One matrix per return flag, all squared and stored in one job."""
    table = t.read("lineitem").select(
        F.col("l_returnflag").alias("matrix_id"),
        F.col("l_orderkey").alias("row_id"),
        F.col("l_partkey").alias("col_id"),
    )
    return multiply.square_workload(table.distinct())


@query(
    "kronecker",
    """SELECT n_nationkey * (SELECT count(*) FROM customer) + c_custkey AS row_id,
       n_regionkey * (SELECT count(*) FROM nation) + c_nationkey AS col_id
FROM nation CROSS JOIN customer""",
)
def kronecker(t: Tables):
    """Nation -> region times customer -> nation."""
    nations = t.member("nation", "n_nationkey", "n_regionkey", t.size("region"))
    customers = t.member("customer", "c_custkey", "c_nationkey", t.size("nation"))
    return multiply.kronecker(nations, customers).df


@query(
    "nvals",
    f"""WITH {G2} SELECT (SELECT count(*) FROM orders) AS nrows, (SELECT count(*) FROM orders) AS ncols,
       count(*) AS nvals FROM g2""",
)
def nvals(t: Tables):
    return stats.result_shape(t.graph_squared())


@query(
    "mxm_workload",
    f"""WITH {G}, n AS (SELECT row_id, count(*) AS k FROM g GROUP BY row_id)
SELECT g.row_id, CAST(sum(coalesce(n.k, 0)) AS BIGINT) AS work
FROM g LEFT JOIN n ON g.col_id = n.row_id GROUP BY g.row_id""",
)
def mxm_workload(t: Tables):
    g = t.graph()
    return stats.mxm_workload(g, g)


@query("mxm_row_nnz", f"WITH {G2} SELECT row_id, count(*) AS nnz FROM g2 GROUP BY row_id")
def mxm_row_nnz(t: Tables):
    g = t.graph()
    return stats.mxm_row_nnz(g, g)


@query(
    "ewise_row_nnz",
    f"""WITH {G}, u AS (SELECT row_id, col_id FROM g UNION SELECT col_id, row_id FROM g)
SELECT row_id, count(*) AS nnz FROM u GROUP BY row_id""",
)
def ewise_row_nnz(t: Tables):
    g = t.graph()
    return stats.ewise_row_nnz(g, g.transposed())


@query(
    "matrix_stats",
    f"""WITH {G}, n AS (SELECT row_id, count(*) AS k FROM g GROUP BY row_id),
s AS (SELECT count(*) AS size FROM orders)
SELECT s.size AS nrows, s.size AS ncols, CAST(sum(k) AS BIGINT) AS nnz,
       sum(k) / CAST(s.size AS DOUBLE) AS nnz_per_row, max(k) AS max_nnz_row, s.size - count(*) AS empty_rows
FROM n, s GROUP BY s.size""",
)
def matrix_stats(t: Tables):
    return stats.matrix_stats(t.graph())


@query(
    "workload_histogram",
    f"""WITH {G}, n AS (SELECT row_id, count(*) AS k FROM g GROUP BY row_id),
w AS (SELECT g.row_id, CAST(sum(coalesce(n.k, 0)) AS BIGINT) AS work
      FROM g LEFT JOIN n ON g.col_id = n.row_id GROUP BY g.row_id),
b AS (SELECT CASE WHEN work = 0 THEN -1 WHEN work = 1 THEN 0 ELSE length(bin(work - 1)) END AS bin, work FROM w)
SELECT CAST(bin AS BIGINT) AS bin, count(*) AS rows, CAST(sum(work) AS BIGINT) AS work FROM b GROUP BY 1""",
)
def workload_histogram(t: Tables):
    g = t.graph()
    return stats.workload_histogram(g, g)


@query(
    "compact_rows",
    f"WITH {G} SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS new_row FROM (SELECT DISTINCT row_id FROM g)",
)
def compact_rows(t: Tables):
    return stats.compact_rows(t.graph())


@query(
    "poisson5pt",
    """WITH d AS (SELECT (SELECT count(DISTINCT s_suppkey) FROM supplier) AS nx, (SELECT count(DISTINCT s_nationkey) FROM supplier) AS ny),
p AS (SELECT i, i % nx AS x, i // nx AS y, nx, ny FROM (SELECT nx, ny, unnest(range(nx * ny)) AS i FROM d))
SELECT i AS row_id, i AS col_id, CAST(4 AS DOUBLE) AS val FROM p
UNION ALL SELECT i, i - 1, -1 FROM p WHERE x > 0
UNION ALL SELECT i, i + 1, -1 FROM p WHERE x < nx - 1
UNION ALL SELECT i, i - nx, -1 FROM p WHERE y > 0
UNION ALL SELECT i, i + nx, -1 FROM p WHERE y < ny - 1""",
)
def poisson5pt(t: Tables):
    """A grid as wide as there are suppliers and as high as there are nations with one."""
    sizes = t.read("supplier").agg(F.count_distinct("s_suppkey").alias("nx"), F.count_distinct("s_nationkey").alias("ny")).first()
    return build.poisson5pt(t.spark, sizes["nx"], sizes["ny"]).df
