"""Conversions, vectors, sparse times dense, solvers."""

from __future__ import annotations

from pyspark.sql import functions as F

import coogrid.operators.build as build
import coogrid.operators.convert as convert
import coogrid.operators.solve as solve
import coogrid.operators.spmv as sp
import coogrid.operators.vector as vec
from coogrid.matrix import Matrix
from coogrid.operators.build import mirror
from coogrid.operators.order import ordered_positions
from coogrid.operators.stats import row_nnz

from .registry import query
from .tables import G, W, Tables, orders_by_sql

#: Blocks narrow enough that rows of the tables spread over several of them.
ADJACENCY_WIDTH = 1024
DENSE_WIDTH = 10


@query(
    "to_csr_offsets",
    f"""WITH {G}, n AS (SELECT row_id, count(*) AS k FROM g GROUP BY row_id),
i AS (SELECT unnest(range((SELECT count(*) FROM orders) + 1)) AS idx)
SELECT idx, CAST(coalesce(sum(coalesce(k, 0)) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
       AS BIGINT) AS "offset"
FROM i LEFT JOIN n ON i.idx = n.row_id""",
)
def to_csr_offsets(t: Tables):
    return convert.to_csr_offsets(t.graph())


@query("from_csr", f"WITH {G} SELECT row_id, col_id FROM g")
def from_csr(t: Tables):
    """To row pointers and column indices and back."""
    g = t.graph()
    cols = ordered_positions(g).select("pos", "col_id")
    return convert.from_csr(convert.to_csr_offsets(g), cols, *g.shape).df


@query(
    "to_adjacency",
    f"""WITH {G} SELECT row_id, col_id // {ADJACENCY_WIDTH} AS block,
       string_agg(CAST(col_id AS VARCHAR), ',' ORDER BY col_id) AS cols, count(*) AS nnz
FROM g GROUP BY 1, 2""",
)
def to_adjacency(t: Tables):
    lists = convert.to_adjacency(t.graph(), ADJACENCY_WIDTH)
    return lists.withColumn("cols", F.array_join(F.col("cols").cast("array<string>"), ","))


@query("from_adjacency", f"WITH {G} SELECT row_id, col_id FROM g")
def from_adjacency(t: Tables):
    g = t.graph()
    return convert.from_adjacency(convert.to_adjacency(g), *g.shape).df


@query(
    "to_dense",
    """SELECT s_suppkey AS row_id, CAST(n_nationkey AS BIGINT) AS col_id,
       CASE WHEN s_nationkey = n_nationkey THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS val
FROM supplier CROSS JOIN nation""",
)
def to_dense(t: Tables):
    suppliers = t.member("supplier", "s_suppkey", "s_nationkey", t.size("nation"))
    return convert.dense_cells(convert.to_dense(suppliers, DENSE_WIDTH), DENSE_WIDTH)


_EMBEDDED = """SELECT vec_id AS row_id, i - 1 AS col_id, CAST(embedding[i] AS DOUBLE) AS val
FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"""


def _dims(t: Tables) -> int:
    """Length of the embeddings."""
    return t.read("embeddings").agg(F.max(F.size("embedding"))).first()[0] or 0


@query("from_dense", f"SELECT * FROM ({_EMBEDDED}) WHERE val <> 0")
def from_dense(t: Tables):
    rows = t.read("embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("vals")
    )
    return convert.from_dense(rows, t.size("embeddings"), _dims(t)).df


@query("from_dense_flat", f"SELECT * FROM ({_EMBEDDED}) WHERE val <> 0")
def from_dense_flat(t: Tables):
    """The same matrix as one row-major sequence."""
    dims = _dims(t)
    flat = t.read("embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    flat = flat.select((F.col("vec_id") * dims + F.col("i")).alias("pos"), F.col("v").cast("double").alias("val"))
    return convert.from_dense_flat(flat, t.size("embeddings"), dims).df


def _x(t: Tables):
    return t.vector("part", "p_partkey", "p_size")


def _z(t: Tables):
    return t.vector("part", "p_partkey", "p_retailprice")


_XZ = "v AS (SELECT p_partkey AS idx, CAST(p_size AS DOUBLE) AS x, p_retailprice AS z FROM part)"


def _vector_sql(expr: str) -> str:
    return f"WITH {_XZ} SELECT idx, {expr} AS val FROM v"


@query("axpy", _vector_sql("z + 2.5::DOUBLE * x"))
def axpy(t: Tables):
    return vec.axpy(2.5, _x(t), _z(t))


@query("axpy_minus", _vector_sql("z - 2.5::DOUBLE * x"))
def axpy_minus(t: Tables):
    return vec.axpy(2.5, _x(t), _z(t), "-")


@query("axpy_times", _vector_sql("z * (2.5::DOUBLE * x)"))
def axpy_times(t: Tables):
    return vec.axpy(2.5, _x(t), _z(t), "*")


@query("axpby", _vector_sql("2.5::DOUBLE * x + 0.5::DOUBLE * z"))
def axpby(t: Tables):
    return vec.axpby(2.5, _x(t), 0.5, _z(t))


@query("axpby_minus", _vector_sql("2.5::DOUBLE * x - 0.5::DOUBLE * z"))
def axpby_minus(t: Tables):
    return vec.axpby(2.5, _x(t), 0.5, _z(t), "-")


@query("axpby_times", _vector_sql("(2.5::DOUBLE * x) * (0.5::DOUBLE * z)"))
def axpby_times(t: Tables):
    return vec.axpby(2.5, _x(t), 0.5, _z(t), "*")


@query("scale", _vector_sql("0.1::DOUBLE * z"))
def scale(t: Tables):
    return vec.scale(0.1, _z(t))


@query("ewise_plus", _vector_sql("x + z"))
def ewise_plus(t: Tables):
    return vec.ewise(_x(t), _z(t), "+")


@query("ewise_minus", _vector_sql("x - z"))
def ewise_minus(t: Tables):
    return vec.ewise(_x(t), _z(t), "-")


@query("ewise_times", _vector_sql("x * z"))
def ewise_times(t: Tables):
    return vec.ewise(_x(t), _z(t), "*")


@query("ewise_divide", _vector_sql("x / z"))
def ewise_divide(t: Tables):
    return vec.ewise(_x(t), _z(t), "/")


@query(
    "full",
    "SELECT unnest(range((SELECT count(*) FROM part))) AS idx, CAST((SELECT max(p_retailprice) FROM part) AS DOUBLE) AS val",
)
def full(t: Tables):
    """A vector as long as the parts, with the highest price everywhere."""
    part = t.read("part").agg(F.count(F.lit(1)).alias("n"), F.max("p_retailprice").alias("top")).first()
    return vec.full(t.spark, part["n"], float(part["top"]))


@query("full_axpby", "SELECT p_partkey AS idx, 2.0::DOUBLE * p_retailprice + 3.0::DOUBLE * 1.5::DOUBLE AS val FROM part")
def full_axpby(t: Tables):
    """A constant vector added to the prices."""
    return vec.axpby(2.0, _z(t), 3.0, vec.full(t.spark, t.size("part"), 1.5))


@query(
    "poisson_apply",
    """WITH d AS (SELECT (SELECT count(*) FROM supplier) AS nx, (SELECT count(*) FROM nation) AS ny),
p AS (SELECT i, i % nx AS x, i // nx AS y, nx, ny FROM (SELECT nx, ny, unnest(range(nx * ny)) AS i FROM d)),
v AS (SELECT i, x, y, nx, ny, s_acctbal AS a FROM p JOIN supplier ON s_suppkey = x)
SELECT m.i AS idx, round(4 * m.a - CASE WHEN m.x > 0 THEN l.a ELSE 0 END - CASE WHEN m.x < m.nx - 1 THEN r.a ELSE 0 END
       - CASE WHEN m.y > 0 THEN m.a ELSE 0 END - CASE WHEN m.y < m.ny - 1 THEN m.a ELSE 0 END, 4) + 0.0::DOUBLE AS val
FROM v m LEFT JOIN v l ON l.i = m.i - 1 LEFT JOIN v r ON r.i = m.i + 1""",
)
def poisson_apply(t: Tables):
    """The stencil on a grid of suppliers by nations, applied to the suppliers' balances in every row."""
    nx, ny = t.size("supplier"), t.size("nation")
    grid = t.spark.range(nx * ny).select(F.col("id").alias("idx"), (F.col("id") % nx).alias("s_suppkey"))
    x = grid.join(t.read("supplier").select("s_suppkey", F.col("s_acctbal").alias("val")), "s_suppkey")
    found = sp.spmv(build.poisson5pt(t.spark, nx, ny), x.select("idx", "val"))
    return found.select("idx", (F.round("val", 4) + F.lit(0.0)).alias("val"))


@query("diagonal", f"WITH {W} SELECT row_id AS idx, val FROM w WHERE row_id = col_id")
def diagonal(t: Tables):
    return vec.diagonal(t.weights())


@query("diagonal_inverse", f"WITH {W} SELECT row_id AS idx, 1.0::DOUBLE / val AS val FROM w WHERE row_id = col_id")
def diagonal_inverse(t: Tables):
    return vec.diagonal(t.weights(), inverse=True)


def _rounded(df):
    return df.select(F.round("val", 4).alias("val"))


@query("vsum", f"WITH {_XZ} SELECT round(sum(z), 4) AS val FROM v")
def vsum(t: Tables):
    return _rounded(vec.vsum(_z(t)))


@query("vsumsq", f"WITH {_XZ} SELECT sum(x * x) AS val FROM v")
def vsumsq(t: Tables):
    return vec.vsumsq(_x(t))


@query("vsumabs", f"WITH {_XZ} SELECT sum(abs(x - 25)) AS val FROM v")
def vsumabs(t: Tables):
    return vec.vsumabs(_x(t).withColumn("val", F.col("val") - 25))


@query("nrm1", f"WITH {_XZ} SELECT sum(abs(-3 * x)) AS val FROM v")
def nrm1(t: Tables):
    return vec.nrm1(vec.scale(-3.0, _x(t)))


@query("nrm2", f"WITH {_XZ} SELECT round(sqrt(sum(z * z)), 4) AS val FROM v")
def nrm2(t: Tables):
    return _rounded(vec.nrm2(_z(t)))


@query("dot", f"WITH {_XZ} SELECT round(sum(x * z), 4) AS val FROM v")
def dot(t: Tables):
    return _rounded(vec.dot(_x(t), _z(t)))


_SPMV = f"""WITH {orders_by_sql("l_partkey")},
y AS (SELECT row_id, sum(val * p_size) AS v FROM a JOIN part ON col_id = p_partkey GROUP BY row_id)
SELECT o_orderkey AS idx, coalesce(v, 0.0::DOUBLE) AS val FROM orders LEFT JOIN y ON o_orderkey = row_id"""


@query("spmv", _SPMV)
def spmv(t: Tables):
    """Quantities times part sizes for every order, also those without lines."""
    return sp.spmv(t.orders_by("l_partkey", t.size("part")), _x(t))


@query(
    "spmv_exact",
    """WITH a AS (SELECT l_orderkey AS row_id, l_partkey AS col_id, max(l_extendedprice) AS val FROM lineitem GROUP BY 1, 2),
y AS (SELECT row_id, sum(CAST(val AS DECIMAL(18, 2)) * CAST(p_retailprice AS DECIMAL(18, 2))) AS v
      FROM a JOIN part ON col_id = p_partkey GROUP BY row_id)
SELECT o_orderkey AS idx, CAST(coalesce(v, 0) AS DOUBLE) AS val FROM orders LEFT JOIN y ON o_orderkey = row_id""",
)
def spmv_exact(t: Tables):
    """Prices times prices, both with cents: the sums of the exact products in any order."""
    lines = t.read("lineitem")
    a = Matrix.from_edges(
        lines, "l_orderkey", "l_partkey", t.size("orders"), t.size("part"), "l_extendedprice", "max"
    )
    return sp.spmv(a, _z(t), exact=True).select("idx", F.round("val", 4).alias("val"))


@query(
    "spmv_beta",
    f"""WITH {W}, y AS (SELECT row_id, sum(val * p_size) AS v FROM w JOIN part ON col_id = p_partkey GROUP BY row_id)
SELECT s_suppkey AS idx, round(2.0::DOUBLE * coalesce(v, 0) + 3.0::DOUBLE * s_acctbal, 4) AS val
FROM supplier LEFT JOIN y ON s_suppkey = row_id""",
)
def spmv_beta(t: Tables):
    y = t.vector("supplier", "s_suppkey", "s_acctbal")
    return sp.spmv(t.weights(), _x(t), 2.0, 3.0, y).select("idx", F.round("val", 4).alias("val"))


@query(
    "spmm",
    f"""WITH {orders_by_sql("l_suppkey")}, d AS ({_EMBEDDED}),
p AS (SELECT a.row_id, d.col_id, sum(a.val * d.val) AS v FROM a JOIN d ON a.col_id = d.row_id GROUP BY 1, 2),
i AS (SELECT o_orderkey AS row_id, j AS col_id FROM orders CROSS JOIN (SELECT unnest(range((SELECT max(len(embedding)) FROM embeddings))) AS j))
SELECT i.row_id, i.col_id, round(2.0::DOUBLE * coalesce(p.v, 0), 4) + 0.0::DOUBLE AS val
FROM i LEFT JOIN p ON i.row_id = p.row_id AND i.col_id = p.col_id""",
)
def spmm(t: Tables):
    """Order x supplier quantities times the dense embedding matrix."""
    dims = _dims(t)
    dense = sp.to_blocks(t.read("embeddings"), "vec_id", "embedding", dims)
    a = t.orders_by("l_suppkey", t.size("embeddings"))
    cells = sp.block_cells(sp.spmm(a, dense, dims, 2.0))
    return cells.select("row_id", "col_id", (F.round("val", 4) + F.lit(0.0)).alias("val"))


@query(
    "spmm_beta",
    f"""WITH a AS (SELECT s_suppkey AS row_id, s_nationkey AS col_id, s_acctbal AS val FROM supplier), d AS ({_EMBEDDED}),
p AS (SELECT a.row_id, d.col_id, a.val * d.val AS v FROM a JOIN d ON a.col_id = d.row_id)
SELECT p.row_id, p.col_id, round(2.0::DOUBLE * p.v + 3.0::DOUBLE * c.val, 4) + 0.0::DOUBLE AS val
FROM p JOIN d c ON c.row_id = p.row_id AND c.col_id = p.col_id""",
)
def spmm_beta(t: Tables):
    """Supplier balances times the embeddings of their nations, plus three times those of their own numbers."""
    dims, n = _dims(t), t.size("supplier")
    dense = sp.to_blocks(t.read("embeddings"), "vec_id", "embedding", dims)
    one = t.read("supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    a = Matrix.from_edges(one, "s_suppkey", "s_nationkey", n, t.size("embeddings"), "s_acctbal", "sum")
    own = dense.where(F.col("row_id") < n)
    cells = sp.block_cells(sp.spmm(a, dense, dims, 2.0, 3.0, own))
    return cells.select("row_id", "col_id", (F.round("val", 4) + F.lit(0.0)).alias("val"))


def _system(a: Matrix) -> Matrix:
    """Off-diagonal -1 where ``a`` has an entry, diagonal twice the row count plus one."""
    inner = a.df.where("row_id <> col_id")
    degree = row_nnz(Matrix(inner, *a.shape)).select(F.col("row_id").alias("id"), "nnz")
    rows = a.df.sparkSession.range(a.nrows).join(degree, "id", "left")
    twice = (F.coalesce("nnz", F.lit(0)) * 2.0 + 1.0).alias("val")
    diagonal_ = rows.select(F.col("id").alias("row_id"), F.col("id").alias("col_id"), twice)
    return Matrix(inner.select("row_id", "col_id", F.lit(-1.0).alias("val")).union(diagonal_), *a.shape)


def _solved_back(a: Matrix, b, solver):
    """``A x`` for the solution x of ``A x = b``, to be compared with b."""
    found = solver(a, b, rtol=1e-8, max_iter=60, precond="diagonal")
    return sp.spmv(a, found.x).select("idx", (F.round("val", 3) + F.lit(0.0)).alias("val"))


_LINES = """SELECT o_orderkey AS idx, CAST(count(l_orderkey) AS DOUBLE) AS val
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey"""


def _lines(t: Tables):
    n = t.read("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    orders = t.read("orders").select("o_orderkey").join(n, "o_orderkey", "left")
    return orders.select(F.col("o_orderkey").alias("idx"), F.coalesce("n", F.lit(0)).cast("double").alias("val"))


@query("cg_solve", _LINES)
def cg_solve(t: Tables):
    """A symmetric system on the mirrored graph, solved and multiplied back."""
    a = _system(mirror(t.graph())).materialized()
    return _solved_back(a, _lines(t), solve.cg)


@query("bicgstab_solve", _LINES)
def bicgstab_solve(t: Tables):
    """A non-symmetric system on the directed graph, solved and multiplied back."""
    a = _system(t.graph()).materialized()
    return _solved_back(a, _lines(t), solve.bicgstab)
