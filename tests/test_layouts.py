import math
import random
import sys
from fractions import Fraction

import numpy as np
import pytest
from helpers import cells, pairs, rows, values
from pyspark.sql import functions as F

import coogrid as cg
import coogrid.operators.solve as solve
import coogrid.operators.spmv as sp
from coogrid.operators.spmv import exact_sums


@pytest.fixture
def sample(pattern):
    rng = random.Random(8)
    entries = sorted({(rng.randrange(12), rng.randrange(20)) for _ in range(60)} - {(4, j) for j in range(20)})
    return entries, pattern(entries, 15, 20)


def test_csr_round_trip(spark, sample):
    entries, A = sample
    offsets = cg.to_csr_offsets(A)
    got = rows(offsets, "idx", "offset")
    assert got == [(i, sum(1 for r, _ in entries if r < i)) for i in range(16)]
    cols = cg.ordered_positions(A).select("pos", "col_id")
    back = cg.from_csr(offsets, cols, 15, 20)
    assert pairs(back.df) == entries


def test_adjacency_round_trip(sample):
    entries, A = sample
    for width in (7, 64):
        adj = cg.to_adjacency(A, width)
        for r in adj.collect():
            assert r["cols"] == sorted(c for q, c in entries if q == r["row_id"] and c // width == r["block"])
            assert r["nnz"] == len(r["cols"])
        assert pairs(cg.from_adjacency(adj, 15, 20).df) == entries


def test_dense_round_trip(sample):
    entries, A = sample
    for width in (6, 64):
        dense = cg.to_dense(A, width)
        assert dense.count() == 15 * math.ceil(20 / width)
        got = cells(cg.dense_cells(dense, width))
        assert got == {(i, j): float((i, j) in entries) for i in range(15) for j in range(20)}
        back = cg.from_dense(dense, 15, 20, width)
        assert pairs(back.df) == entries and set(cells(back.df).values()) == {1.0}


def test_flat_dense(spark):
    flat = spark.createDataFrame(list(enumerate([0.0, 2.0, 0.0, 0.0, 0.0, 3.0])), "pos bigint, val double")
    assert cells(cg.from_dense_flat(flat, 2, 3).df) == {(0, 1): 2.0, (1, 2): 3.0}


def test_vector_arithmetic(spark, vector):
    x, z = vector([1, 2, -3]), vector([10, 20, 30])
    assert values(cg.axpy(2.0, x, z)) == {0: 12.0, 1: 24.0, 2: 24.0}
    assert values(cg.axpy(2.0, x, z, "-")) == {0: 8.0, 1: 16.0, 2: 36.0}
    assert values(cg.axpy(2.0, x, z, "*")) == {0: 20.0, 1: 80.0, 2: -180.0}
    assert values(cg.axpby(2.0, x, 0.5, z, "-")) == {0: -3.0, 1: -6.0, 2: -21.0}
    assert values(cg.scale(3.0, x)) == {0: 3.0, 1: 6.0, 2: -9.0}
    assert values(cg.ewise(z, x, "/")) == {0: 10.0, 1: 10.0, 2: -10.0}
    assert values(cg.full(spark, 3, 1.5)) == {0: 1.5, 1: 1.5, 2: 1.5}
    one = lambda df: df.first()["val"]
    assert (one(cg.vsum(x)), one(cg.vsumsq(x)), one(cg.vsumabs(x)), one(cg.nrm1(x))) == (0.0, 14.0, 6.0, 6.0)
    assert one(cg.nrm2(x)) == pytest.approx(math.sqrt(14))
    assert one(cg.dot(x, z)) == -40.0


def test_division_by_zero_is_ieee(vector):
    x, y = vector([1, -1, 0, 4, 1, float("nan")]), vector([0, 0, 0, 2, -0.0, 0])
    got = values(cg.ewise(x, y, "/"))
    assert (got[0], got[1], got[3], got[4]) == (math.inf, -math.inf, 2.0, -math.inf)
    assert math.isnan(got[2]) and math.isnan(got[5])


def test_diagonal(valued):
    A = valued([(0, 0, 4.0), (0, 1, 9.0), (2, 2, -2.0)], 3)
    assert values(cg.diagonal(A)) == {0: 4.0, 2: -2.0}
    assert values(cg.diagonal(A, inverse=True)) == {0: 0.25, 2: -0.5}


def test_spmv(spark, valued, vector):
    A = valued([(0, 0, 2.0), (0, 2, 1.0), (2, 1, -1.0)], 4, 3)
    x, y = vector([1, 2, 3]), vector([1, 1, 1, 1])
    assert values(cg.spmv(A, x)) == {0: 5.0, 1: 0.0, 2: -2.0, 3: 0.0}
    assert values(cg.spmv(A, x, 2.0, 10.0, y)) == {0: 20.0, 1: 10.0, 2: 6.0, 3: 10.0}
    assert values(cg.spmv(A, x, exact=True)) == {0: 5.0, 1: 0.0, 2: -2.0, 3: 0.0}


def test_exact_spmv_does_not_lose_small_terms(spark, valued, vector):
    big = 1e16
    A = valued([(0, 0, big), (0, 1, 1.0), (0, 2, 1.0), (0, 3, -big)], 1, 4)
    assert values(cg.spmv(A, vector([1, 1, 1, 1]), exact=True)) == {0: 2.0}


def test_spmm(spark, valued):
    A = valued([(0, 0, 2.0), (0, 1, 1.0), (2, 1, -1.0)], 3, 2)
    B = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [4.0, 5.0, 6.0])], "i bigint, v array<double>")
    for width in (2, 32):
        blocks = cg.to_blocks(B, "i", "v", 3, width)
        R = cg.spmm(A, blocks, 3, width=width)
        expected = {0: [6.0, 9.0, 12.0], 1: [0.0, 0.0, 0.0], 2: [-4.0, -5.0, -6.0]}
        assert cells(cg.block_cells(R, width)) == {(i, j): v for i, r in expected.items() for j, v in enumerate(r)}
        S = cg.spmm(A, blocks, 3, 2.0, 10.0, R, width)
        assert cells(cg.block_cells(S, width)) == {
            (i, j): 12 * v for i, r in expected.items() for j, v in enumerate(r)
        }


def test_poisson_stencil(spark):
    P = cg.poisson5pt(spark, 10, 10)
    entries = cells(P.df)
    assert P.shape == (100, 100) and len(entries) == 460
    assert all(entries[j, i] == v for (i, j), v in entries.items())
    assert entries[0, 0] == 4.0 and entries[0, 1] == -1.0 and (9, 10) not in entries


def residual(A, x, b):
    got, want = values(cg.spmv(A, x)), values(b)
    return math.sqrt(sum((got[i] - want[i]) ** 2 for i in want)) / math.sqrt(sum(v * v for v in want.values()))


@pytest.mark.parametrize("precond", ["identity", "diagonal"])
def test_cg(spark, precond):
    A = cg.poisson5pt(spark, 5, 4)
    b = cg.full(spark, 20, 1.0)
    done = cg.cg(A, b, rtol=1e-6, precond=precond)
    assert done.converged and done.iterations <= 20
    assert residual(A, done.x, b) < 1e-5


def test_cg_out_of_iterations_is_a_result(spark):
    done = cg.cg(cg.poisson5pt(spark, 5, 4), cg.full(spark, 20, 1.0), rtol=1e-9, max_iter=1)
    assert not done.converged and done.iterations == 1 and done.residual > 0


def test_cg_with_split_hub_column(spark, valued, monkeypatch):
    import coogrid.operators.solve as solve

    n = 12
    arrow = [(i, i, 20.0) for i in range(n)] + [x for i in range(1, n) for x in ((0, i, 1.0), (i, 0, 1.0))]
    A, b = valued(arrow, n), cg.full(spark, n, 1.0)
    monkeypatch.setattr(solve._Operator.__init__, "__defaults__", (3,))
    op = solve._Operator(A)
    assert op.stripes.found
    done = cg.cg(A, b, rtol=1e-8)
    assert done.converged and residual(A, done.x, b) < 1e-6


def test_bicgstab_on_a_nonsymmetric_system(spark, valued):
    n = 15
    band = [(i, i, 4.0) for i in range(n)] + [(i, i + 1, -1.5) for i in range(n - 1)]
    A = valued(band + [(i + 1, i, -0.5) for i in range(n - 1)], n)
    b = cg.full(spark, n, 1.0)
    done = cg.bicgstab(A, b, rtol=1e-6, precond="diagonal")
    assert done.converged
    assert residual(A, done.x, b) < 1e-5


def _fails(df, text):
    with pytest.raises(Exception, match=text):
        df.collect()


def test_vectors_of_different_length_fail(spark, vector):
    long, short = vector([1, 2, 3]), vector([1])
    for made in (cg.dot(long, short), cg.ewise(long, short, "*"), cg.axpy(2.0, short, long), cg.axpby(1.0, long, 1.0, short)):
        _fails(made, "vectors differ in length")


def test_short_right_operands_fail(spark, valued, vector):
    A = valued([(0, 0, 1.0), (1, 2, 2.0)], 2, 3)
    _fails(cg.spmv(A, vector([1, 1])), "lacks index 2")
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "i long, v array<double>")
    _fails(cg.spmm(A, sp.to_blocks(rows, "i", "v", 2), 2), "lacks index 2")


def test_blocks_need_arrays_of_the_stated_length(spark):
    for values in ([1.0] * 5, [1.0], None):
        rows = spark.createDataFrame([(0, values)], "i long, v array<double>")
        _fails(sp.to_blocks(rows, "i", "v", 3), "not 3 numbers in row 0")


def test_layouts_out_of_bounds_fail(spark):
    flat = spark.createDataFrame([(99, 1.0)], "pos long, val double")
    _fails(cg.from_dense_flat(flat, 2, 2).df, "out of bounds")
    _fails(cg.from_adjacency(spark.createDataFrame([(9, [9])], "row_id long, cols array<long>"), 2, 2).df, "out of bounds")
    _fails(cg.from_dense(spark.createDataFrame([(0, [0.0, 0.0, 1.0])], "row_id long, vals array<double>"), 2, 2).df, "out of bounds")
    offsets = spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "idx long, offset long")
    cols = spark.createDataFrame([(0, 7)], "pos long, col_id long")
    _fails(cg.from_csr(offsets, cols, 2, 2).df, "out of bounds")
    with pytest.raises(ValueError, match="offsets end"):
        cg.from_csr(offsets, cols.limit(0), 2, 2)


def test_exact_spmv_keeps_every_term(spark, valued, vector):
    inf, nan = float("inf"), float("nan")
    A = valued(
        [(0, 0, 1e-35), (0, 1, 2e-35), (1, 0, 1e20), (1, 1, 1e-18), (1, 2, -1e20), (2, 0, nan), (2, 1, 1.0), (3, 0, inf),
         (3, 1, 1.0), (4, 0, inf), (4, 1, -inf), (5, 0, 5e-324), (5, 1, 1.7e308), (6, 0, -0.1), (6, 1, 0.3)],
        7, 3,
    )
    got = values(cg.spmv(A, vector([1, 1, 1]), exact=True))
    assert got[0] == 3e-35 and got[1] == 1e-18 and got[2] != got[2] and got[3] == inf and got[4] != got[4]
    assert got[5] == 1.7e308 and got[6] == math.fsum([-0.1, 0.3])


def test_exact_spmv_does_not_depend_on_the_layout(spark):
    import random

    rng = random.Random(1)
    terms = [(0, j, rng.choice([-1, 1]) * 10 ** rng.uniform(-12, 12)) for j in range(3000)]
    df = spark.createDataFrame(terms, "r long, c long, v double")
    x = spark.range(3000).selectExpr("id AS idx", "1.0D AS val")
    found = {
        cg.spmv(cg.Matrix.from_edges(df.repartition(n), "r", "c", 1, 3000, "v", "sum"), x, exact=True).first()["val"]
        for n in (1, 5, 13)
    }
    assert len(found) == 1 and found.pop() == pytest.approx(math.fsum(v for _, _, v in terms), rel=4e-16)


def test_solvers_take_every_index_of_the_system(spark, valued):
    A = valued([(0, 0, 2.0), (0, 1, -1.0), (1, 0, -1.0), (1, 1, 2.0)], 2)
    b = spark.createDataFrame([(0, 1.0)], "idx long, val double")
    for solver in (cg.cg, cg.bicgstab):
        found = solver(A, b, rtol=1e-10)
        assert found.converged and values(found.x) == pytest.approx({0: 2 / 3, 1: 1 / 3})
        with pytest.raises(Exception, match="out of bounds"):
            solver(A, spark.createDataFrame([(5, 1.0)], "idx long, val double"))
        again = solver(A, b, atol=1e-8, x0=found.x)
        assert again.iterations == 0 and again.converged
        near = solver(A, b, atol=1e-9, x0=spark.createDataFrame([(1, 0.3)], "idx long, val double"))
        assert values(near.x) == pytest.approx({0: 2 / 3, 1: 1 / 3})


def test_solver_keeps_a_constant_number_of_cuts(spark, valued):
    from pathlib import Path

    def cuts():
        top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
        return sum(1 for p in Path(top).rglob("rdd-*") if p.is_dir())

    n = 60
    A = valued([(i, j, 2.0 if i == j else -1.0) for i in range(n) for j in (i - 1, i, i + 1) if 0 <= j < n], n)
    b = spark.range(n).selectExpr("id AS idx", "1.0D AS val")
    before = cuts()
    assert cg.cg(A, b, rtol=1e-30, max_iter=20).iterations == 20
    assert cuts() - before <= 3


def nearest(terms):
    exact = sum(map(Fraction, terms))
    try:
        return float(exact)
    except OverflowError:
        return math.inf if exact > 0 else -math.inf


def exact_groups():
    rng, top = random.Random(11), sys.float_info.max
    edges = [2.0 ** (8 * k) for k in range(-134, 128)]
    groups = [[e] for e in edges] + [[math.nextafter(e, 0)] for e in edges] + [[-math.nextafter(e, math.inf)] for e in edges]
    groups += [[top], [-top], [5e-324], [2.2250738585072014e-308, -5e-324], [1e300, -1e300, 5e-324], [255.99999999999997]]
    groups += [[1.0, 2**-53], [1.0, 2**-53, 2**-300], [1.0, 2**-53, -(2**-300)], [0.0, -0.0], [0.1] * 10]
    groups += [[top, top / 2, -top], [top, top, -top], [2.0**1023, 2.0**1023, -(2.0**1016) + 2.0**900], [top, top], [-top, -top]]
    for _ in range(300):
        spread = rng.choice([2, 60, 1000])
        terms = [math.ldexp(rng.uniform(-1, 1), rng.randint(-spread, spread)) for _ in range(rng.randint(1, 40))]
        groups.append(terms + [-x for x in terms[1:]] if rng.random() < 0.5 else terms)
    return groups


@pytest.mark.parametrize("parts", [1, 13])
def test_exact_sums_are_the_nearest_doubles(spark, parts):
    groups = exact_groups()
    rows = [(k, x) for k, terms in enumerate(groups) for x in terms]
    random.Random(parts).shuffle(rows)
    df = spark.createDataFrame(rows, "idx bigint, __term double").repartition(parts)
    got = {r["idx"]: r["__sum"] for r in exact_sums(df).collect()}
    assert [(k, got[k]) for k in sorted(got)] == [(k, nearest(terms)) for k, terms in enumerate(groups)]


def test_exact_sums_of_what_is_not_finite(spark):
    inf, nan = math.inf, math.nan
    groups = [[1.0, inf], [-inf, 1e308], [inf, -inf], [nan, 1.0], [inf, nan]]
    df = spark.createDataFrame([(k, x) for k, terms in enumerate(groups) for x in terms], "idx bigint, __term double")
    got = [r["__sum"] for r in exact_sums(df).orderBy("idx").collect()]
    assert got[:2] == [inf, -inf] and all(map(math.isnan, got[2:]))


@pytest.mark.parametrize("solver,actions", [("cg", 1), ("bicgstab", 2)])
def test_an_iteration_is_an_action_per_product(spark, monkeypatch, solver, actions):
    A, b = cg.poisson5pt(spark, 6, 5), cg.full(spark, 30, 1.0)
    kept, read = solve.materialize, solve._scalars
    calls = []
    monkeypatch.setattr(solve, "materialize", lambda df: calls.append("keep") or kept(df))
    monkeypatch.setattr(solve, "_scalars", lambda df, **e: calls.append("read") or read(df, **e))
    counts = []
    for n in (2, 5):
        calls.clear()
        assert getattr(solve, solver)(A, b, rtol=1e-14, max_iter=n).iterations == n
        counts.append(len(calls))
    assert counts[1] - counts[0] == 3 * actions


def test_cg_steps_are_those_of_the_textbook(spark):
    n = 30
    A = np.zeros((n, n))
    for r in cg.poisson5pt(spark, 6, 5).df.collect():
        A[r["row_id"], r["col_id"]] = r["val"]
    b = np.arange(n) % 7 - 2.0
    for steps in (1, 4, 9):
        x, r = np.zeros(n), b.copy()
        p = r.copy()
        for _ in range(steps):
            a = r @ r / (p @ A @ p)
            x, after = x + a * p, r - a * (A @ p)
            p, r = after + (after @ after) / (r @ r) * p, after
        vector = spark.createDataFrame(list(enumerate(map(float, b))), "idx bigint, val double")
        got = values(cg.cg(cg.poisson5pt(spark, 6, 5), vector, rtol=1e-14, max_iter=steps).x)
        assert max(abs(got[i] - x[i]) for i in range(n)) < 1e-10


@pytest.mark.parametrize("limit,busy", [(1 << 26, 1 << 20), (1 << 26, 4), (0, 1 << 20)])
def test_spmm_shuffles_entries_where_the_dense_side_is_small(spark, valued, monkeypatch, limit, busy):
    import coogrid.plans.skew as skew

    monkeypatch.setattr(sp, "DENSE_BYTES", limit)
    monkeypatch.setattr(skew, "MIN_CELL_ROWS", busy)
    monkeypatch.setattr(skew, "CELL_ROWS", busy)
    triples = [(0, k, float(k + 1)) for k in range(6)] + [(2, 1, -2.0), (2, 3, 0.5), (4, 0, 3.0)]
    dense = [[float((3 * k + j) % 5) - 1 for j in range(5)] for k in range(6)]
    blocks = sp.to_blocks(spark.createDataFrame(list(enumerate(dense)), "i bigint, v array<double>"), "i", "v", 5, 2)
    blocks = blocks.union(blocks.where("row_id = 3"))  # a record that comes twice counts twice
    found = cg.spmm(valued(triples, 6, 6), blocks, 5, -2.0, width=2)
    want = {(i, j): 0.0 for i in range(6) for j in range(5)}
    for i, k, v in triples:
        for j in range(5):
            want[i, j] += -2.0 * v * dense[k][j] * (2 if k == 3 else 1)
    assert cells(sp.block_cells(found, 2)) == pytest.approx(want)
    records = [(r["row_id"], r["block"], len(r["vals"])) for r in found.collect()]
    assert sorted(records) == [(i, b, 1 if b == 2 else 2) for i in range(6) for b in range(3)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    wide = [line for line in plan.splitlines() if "Exchange hashpartitioning(row_id" in line and ", block#" in line]
    assert bool(wide) == (limit == 0 or busy == 4)  # only then are sums of blocks shuffled


@pytest.mark.parametrize("solver", ["cg", "bicgstab"])
def test_a_solve_leaves_its_layout_nowhere(spark, valued, vector, monkeypatch, solver):
    import coogrid.operators.solve as solve
    from coogrid.plans.durable import path_exists

    made = []

    class Kept(solve._Operator):
        def __init__(self, *a):
            super().__init__(*a)
            made.append(self.entries._jdf.logicalPlan().rdd().getCheckpointFile().get())
            assert path_exists(spark, made[-1])

    monkeypatch.setattr(solve, "_Operator", Kept)
    A = valued([(0, 0, 4.0), (1, 1, 3.0), (0, 1, 1.0), (1, 0, 1.0)], 2)
    found = getattr(solve, solver)(A, vector([1, 2]), rtol=1e-9)
    assert len(made) == 1 and not path_exists(spark, made[0])
    got = {r["idx"]: r["val"] for r in found.x.collect()}
    assert got == pytest.approx({0: 1 / 11, 1: 7 / 11})
