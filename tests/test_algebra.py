import itertools
import random

import pytest
from helpers import cells, pairs, rows
from pyspark.sql import functions as F

import coogrid as cg
import coogrid.operators.multiply as multiply
from coogrid.plans.skew import Stripes, grid_of, hot_keys, spread_join

PATH4 = [(0, 1), (1, 2), (2, 3), (3, 3)]


def brute(a, b):
    return sorted({(i, j) for i, k in a for k2, j in b if k == k2})


def random_pairs(seed, n, m, count):
    rng = random.Random(seed)
    return sorted({(rng.randrange(n), rng.randrange(m)) for _ in range(count)})


def test_square_of_path(pattern):
    A = pattern(PATH4, 4)
    assert pairs(cg.mxm(A, A).df) == [(0, 2), (1, 3), (2, 3), (3, 3)]
    total = cg.ewise_add(A, cg.mxm(A, A))
    assert total.nvals() == 6
    assert pairs(cg.mxm_add(A, A, A).df) == pairs(total.df)
    assert set(cells(cg.mxm(A, A, "plus_times").df).values()) == {1}


@pytest.mark.parametrize("strategy", [None, "hash", "merge"])
def test_product_matches_brute_force(pattern, strategy):
    a, b = random_pairs(1, 30, 20, 120), random_pairs(2, 20, 25, 110)
    A, B = pattern(a, 30, 20), pattern(b, 20, 25)
    R = cg.mxm(A, B, strategy=strategy)
    assert R.shape == (30, 25)
    assert pairs(R.df) == brute(a, b)
    assert pairs(cg.mxm(A, B, "any_pair").df) == brute(a, b)
    counts = cells(cg.mxm(A, B, "plus_times").df)
    assert sorted(counts) == brute(a, b)
    assert sum(counts.values()) == sum(1 for x in a for y in b if x[1] == y[0])


def test_semirings(valued):
    a = [(0, 0, 2.0), (0, 1, 3.0), (1, 1, 5.0)]
    b = [(0, 0, 7.0), (1, 0, 1.0), (1, 1, 4.0)]
    A, B = valued(a, 2), valued(b, 2)
    assert cells(cg.mxm(A, B, "plus_times").df) == {(0, 0): 17.0, (0, 1): 12.0, (1, 0): 5.0, (1, 1): 20.0}
    assert cells(cg.mxm(A, B, "min_plus").df) == {(0, 0): 4.0, (0, 1): 7.0, (1, 0): 6.0, (1, 1): 9.0}
    assert cells(cg.mxm(A, B, "max_times").df) == {(0, 0): 14.0, (0, 1): 12.0, (1, 0): 5.0, (1, 1): 20.0}
    mine = cg.mxm(A, B, mul=lambda x, y: F.greatest(x, y), add=F.min)
    assert cells(mine.df) == {(0, 0): 3.0, (0, 1): 4.0, (1, 0): 5.0, (1, 1): 5.0}


def test_bool_valued_semiring(valued):
    A = valued([(0, 1, 1.0)], 2)
    T = cg.Matrix(A.df.withColumn("val", F.lit(True)), 2, 2)
    U = cg.Matrix(A.transposed().df.withColumn("val", F.lit(False)), 2, 2)
    assert cells(cg.mxm(T, U, "bool_or_and").df) == {(0, 0): False}


def test_cancelled_sum_stays(valued):
    R = cg.mxm(valued([(0, 0, 1.0), (0, 1, 1.0)], 1, 2), valued([(0, 0, 1.0), (1, 0, -1.0)], 2, 1), "plus_times")
    assert cells(R.df) == {(0, 0): 0.0}


def test_shapes_are_checked(pattern):
    A, B = pattern([(0, 0)], 2, 3), pattern([(0, 0)], 3, 2)
    assert cg.mxm(A, B).shape == (2, 2)
    with pytest.raises(ValueError, match="inner dimensions"):
        cg.mxm(A, A)
    with pytest.raises(ValueError, match="shapes differ"):
        cg.ewise_add(A, B)
    with pytest.raises(ValueError, match="unknown semiring"):
        cg.mxm(A, B, "nope")


def test_identity_associativity_and_sum_laws(pattern):
    a, b, c = (random_pairs(s, 12, 12, 40) for s in (3, 4, 5))
    A, B, C = (pattern(x, 12) for x in (a, b, c))
    identity = pattern([(i, i) for i in range(12)], 12)
    assert pairs(cg.mxm(A, identity).df) == a
    assert pairs(cg.mxm(cg.mxm(A, B), C).df) == pairs(cg.mxm(A, cg.mxm(B, C)).df)
    assert pairs(cg.ewise_add(A, B).df) == pairs(cg.ewise_add(B, A).df) == sorted(set(a) | set(b))
    assert pairs(cg.ewise_add(A, A).df) == a


def test_hub_is_split_and_result_unchanged(spark, pattern):
    m = 40
    star = [(0, j) for j in range(1, m + 1)] + [(j, 0) for j in range(1, m + 1)]
    A = pattern(star, m + 1)
    # Index 0 makes m*m of the paths: with a small cell it must be laid out on a grid.
    left = A.df.select("row_id", F.col("col_id").alias("k"))
    right = A.df.select(F.col("row_id").alias("k"), "col_id")
    ((key, p, q),) = hot_keys(left, right, ["k"], cell=100).collect()
    assert (key, p, q) == (0, 4, 4)
    met = spread_join(left, right, ["k"], ["row_id"], ["col_id"], cell=100)
    assert met.count() == m * m + m
    assert met.distinct().count() == m * m + m
    expected = brute(star, star)
    assert len(expected) == m * m + 1
    for strategy in (None, "hash"):
        assert pairs(cg.mxm(A, A, cell=100, strategy=strategy).df) == expected
    plain = cells(cg.mxm(A, A, "plus_times", split=False).df)
    assert cells(cg.mxm(A, A, "plus_times", cell=100).df) == plain
    work = rows(cg.mxm_workload(A, A), "row_id", "work")
    assert sum(w for _, w in work) == m * m + m


def test_default_cell_is_a_share_of_the_work(pattern, monkeypatch):
    import coogrid.plans.skew as skew

    m = 60
    star = [(0, j) for j in range(1, m + 1)] + [(j, 0) for j in range(1, m + 1)]
    A = pattern(star, m + 1)
    monkeypatch.setattr(skew, "MIN_CELL_ROWS", 50)
    sides = A.df.selectExpr("col_id AS k"), A.df.selectExpr("row_id AS k")
    # 8 tasks: a cell holds a quarter of (m*m + m) / 8 paths.
    ((key, p, q),) = hot_keys(*sides, ["k"]).collect()
    share = (m * m + m) // 32
    assert key == 0 and (p, q) == grid_of(m, m, share) and p * q >= 32
    assert pairs(cg.mxm(A, A).df) == brute(star, star)
    monkeypatch.setattr(skew, "CELL_ROWS", 60)
    assert [tuple(r) for r in hot_keys(*sides, ["k"]).collect()] == [(0, *grid_of(m, m, 60))]


def test_grid_sizes():
    assert grid_of(600, 1, 50) == (12, 1)
    assert grid_of(1, 600, 50) == (1, 12)
    for ins, outs in ((10**6, 10**6), (10**9, 10), (7, 10**8), (10**12, 10**3)):
        p, q = grid_of(ins, outs, 1 << 25)
        assert ins * outs / (p * q) <= 1 << 25 and p * q <= 2 * (ins * outs >> 25) + 2


def test_one_sided_hub(spark):
    left = spark.range(1000).selectExpr("id", "if(id < 600, 7, id) AS k")
    right = spark.range(900).selectExpr("id AS k", "id * 10 AS v")
    assert [tuple(r) for r in hot_keys(left, right, ["k"], cell=50).collect()] == [(7, 12, 1)]
    got = spread_join(left, right, ["k"], ["id"], ["k"], cell=50)
    assert got.count() == 900 and got.where("v <> k * 10").count() == 0
    stripes = Stripes(left, ["k"], cell=50)
    assert [tuple(r) for r in stripes.found.collect()] == [(7, 12)]
    cut = stripes.cut(left, ["id"])
    assert cut.where("k = 7").select("__grid_row").distinct().count() == 12
    for how, n in (("inner", 900), ("left", 1000)):
        got = cut.join(stripes.copy(right), stripes.on, how)
        assert got.count() == n
        assert got.where("v <> k * 10").count() == 0
        assert got.where("v IS NULL").count() == n - 900


def test_ewise_add_values(valued):
    A, B = valued([(0, 0, 1.0), (0, 1, 2.0)], 2), valued([(0, 1, 5.0), (1, 1, -1.0)], 2)
    assert cells(cg.ewise_add(A, B, add=F.max).df) == {(0, 0): 1.0, (0, 1): 5.0, (1, 1): -1.0}
    assert cells(cg.axpby_matrix(3.0, A, 2.0, B).df) == {(0, 0): 3.0, (0, 1): 16.0, (1, 1): -2.0}
    assert cells(cg.axpby_matrix(5.0, A, -2.0, B).df)[0, 1] == 0.0
    assert pairs(cg.ewise_add(A, B, "any_pair").df) == [(0, 0), (0, 1), (1, 1)]


def test_mxm_add_values(pattern):
    A = pattern(PATH4, 4)
    got = cells(cg.mxm_add(A, A, A, "plus_times").df)
    assert got == {(0, 1): 1, (0, 2): 1, (1, 2): 1, (1, 3): 1, (2, 3): 2, (3, 3): 2}


def test_kronecker(pattern, valued):
    R = cg.kronecker(pattern([(0, 1)], 2), pattern([(1, 0)], 3))
    assert R.shape == (6, 6) and pairs(R.df) == [(1, 3)]
    a, b = random_pairs(6, 5, 4, 8), random_pairs(7, 3, 6, 9)
    K = cg.kronecker(pattern(a, 5, 4), pattern(b, 3, 6))
    expected = sorted((3 * i + k, 6 * j + l) for (i, j), (k, l) in itertools.product(a, b))
    assert pairs(K.df) == expected
    V = cg.kronecker(valued([(0, 0, 2.0)], 1), valued([(0, 1, 3.0)], 1, 2))
    assert cells(V.df) == {(0, 1): 6.0}


def test_square_workload(spark, tmp_path):
    table = spark.createDataFrame(
        [("p", *x) for x in PATH4] + [("q", 0, 1), ("q", 1, 0)], "matrix_id string, row_id bigint, col_id bigint"
    )
    out = cg.square_workload(table, str(tmp_path / "squares"))
    got = rows(out, "matrix_id", "row_id", "col_id")
    assert got == [("p", 0, 2), ("p", 1, 3), ("p", 2, 3), ("p", 3, 3), ("q", 0, 0), ("q", 1, 1)]


def test_a_broken_off_workload_redoes_what_is_missing(spark, tmp_path, monkeypatch):
    table = spark.createDataFrame(
        [(f"m{k}", i, (i + k) % 5) for k in range(6) for i in range(5)] + [("none", 0, 1)], "matrix_id string, row_id bigint, col_id bigint"
    )
    out, square, squared = str(tmp_path / "squares"), multiply.square_entries, []

    def breaks_off(entries, *args):
        ids = sorted(r[0] for r in entries.select("matrix_id").distinct().collect())
        if len(squared) >= 4 and not resumed:
            raise RuntimeError("lost")
        squared.extend(ids)
        return square(entries, *args)

    monkeypatch.setattr(multiply, "square_entries", breaks_off)
    resumed = False
    with pytest.raises(RuntimeError):
        cg.square_workload(table, out, batch=10)
    assert squared == ["m0", "m1", "m2", "m3"]
    resumed, squared[:] = True, []
    got = cg.square_workload(table, out, resume=True, batch=10)
    assert squared == ["m4", "m5", "none"]
    expected = sorted((f"m{k}", i, (i + 2 * k) % 5) for k in range(6) for i in range(5))
    assert rows(got, "matrix_id", "row_id", "col_id") == expected
    squared[:] = []
    assert rows(cg.square_workload(table, out, resume=True), "matrix_id", "row_id", "col_id") == expected and squared == []
    again = cg.square_workload(table.where("matrix_id = 'm1'"), out)
    assert rows(again, "matrix_id", "row_id", "col_id") == [r for r in expected if r[0] == "m1"]


@pytest.mark.parametrize("dense", [1, 3, 10**6])
def test_row_counts_by_bitmaps(pattern, dense):
    a = random_pairs(21, 9, 30, 70) + [(8, j) for j in range(30) if j % 2]
    b = [(i, (i * 7919 + j * 4001) % 100_000) for i in range(30) for j in range(12)] + [(1, 0), (1, 32_767), (1, 32_768), (1, 99_999)]
    A, B = pattern(sorted(set(a)), 9, 30), pattern(sorted(set(b)), 30, 100_000)
    product = {(i, j) for i, k in a for m, j in b if m == k}
    expected = sorted((i, len({j for r, j in product if r == i})) for i in {i for i, _ in product})
    assert rows(cg.mxm_row_nnz(A, B, dense), "row_id", "nnz") == expected


def test_a_costly_operand_is_evaluated_once(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()

    def count(batches):
        import uuid

        (seen / uuid.uuid4().hex).touch()
        yield from batches

    edges = spark.createDataFrame([(i, (i * i + 1) % 12) for i in range(12)], "r bigint, c bigint").coalesce(1)
    A = cg.Matrix.from_edges(edges.mapInArrow(count, "r bigint, c bigint"), "r", "c", 12, 12)
    B = cg.Matrix.from_edges(edges, "r", "c", 12, 12)
    power = cg.mxm(cg.mxm(cg.mxm(A, B), B), B)
    step = {i: (i * i + 1) % 12 for i in range(12)}
    assert pairs(power.df) == [(i, step[step[step[step[i]]]]) for i in range(12)]
    assert len(list(seen.iterdir())) == 1


def test_sizes_and_work(pattern):
    A = pattern([(0, 0), (2, 0), (2, 1), (2, 2)], 4)
    stats = cg.matrix_stats(A).first()
    assert (stats["nnz"], stats["max_nnz_row"], stats["empty_rows"], stats["nnz_per_row"]) == (4, 3, 2, 1.0)
    empty = cg.matrix_stats(pattern([], 3)).first()
    assert (empty["nnz"], empty["max_nnz_row"], empty["empty_rows"]) == (0, 0, 3)
    assert rows(cg.mxm_workload(A, A), "row_id", "work") == [(0, 1), (2, 4)]
    assert rows(cg.mxm_row_nnz(A, A), "row_id", "nnz") == [(0, 1), (2, 3)]
    assert rows(cg.ewise_row_nnz(A, A), "row_id", "nnz") == [(0, 1), (2, 3)]
    assert rows(cg.compact_rows(A), "row_id", "new_row") == [(0, 0), (2, 1)]
    assert cg.result_shape(A).first().asDict() == {"nrows": 4, "ncols": 4, "nvals": 4}


def test_histogram_bins(pattern):
    # Row i of A meets row i of B, which has i entries.
    A = pattern([(i, i) for i in range(10)], 10)
    B = pattern([(i, j) for i in range(10) for j in range(i)], 10)
    got = rows(cg.workload_histogram(A, B), "bin", "rows", "work")
    assert got == [(-1, 1, 0), (0, 1, 1), (1, 1, 2), (2, 2, 7), (3, 4, 26), (4, 1, 9)]


def test_empty_matrix(pattern):
    E = pattern([], 3)
    assert pairs(cg.mxm(E, E).df) == []
    assert rows(cg.to_csr_offsets(E), "idx", "offset") == [(0, 0), (1, 0), (2, 0), (3, 0)]


def test_out_of_bounds_edge_raises(pattern):
    with pytest.raises(Exception, match="out of bounds"):
        pattern([(0, 5)], 3).df.collect()


def test_every_hub_is_split_however_many(spark, monkeypatch):
    import coogrid.plans.skew as skew

    hubs, m = 60, 12
    left = spark.range(hubs * m).selectExpr("id AS a", f"id % {hubs} AS k")
    right = spark.range(hubs * m).selectExpr("id AS b", f"id % {hubs} AS k")
    assert hot_keys(left, right, ["k"], cell=20).count() == hubs
    want = sorted((a, b) for a in range(hubs * m) for b in range(a % hubs, hubs * m, hubs))
    for bound in (100_000, 0):  # with the table of hot keys broadcast, and joined
        monkeypatch.setattr(skew, "BROADCAST_KEYS", bound)
        got = spread_join(left, right, ["k"], ["a"], ["b"], cell=20)
        assert sorted((r["a"], r["b"]) for r in got.collect()) == want
    assert hot_keys(left, right, ["k"], cell=m * m) is None


def test_pattern_operands_of_a_boolean_semiring(pattern):
    A = pattern([(0, 1), (1, 2)], 3)
    assert cells(cg.mxm(A, A, "bool_or_and").df) == {(0, 2): True}
    assert cells(cg.mxm_add(A, A, A, "bool_or_and").df) == {(0, 1): True, (0, 2): True, (1, 2): True}
    assert cells(cg.ewise_add(A, A, "bool_or_and").df) == {(0, 1): True, (1, 2): True}


def test_kronecker_with_the_large_operand_on_either_side(pattern, monkeypatch):
    import coogrid.operators.multiply as multiply

    monkeypatch.setattr(multiply, "LEAST_CELL", 50)
    small, large = [(0, 1)], [(i, (3 * i) % 40) for i in range(40)]
    for a, b, n, m in ((small, large, 2, 40), (large, small, 40, 2), (large, large, 40, 40)):
        got = cg.kronecker(pattern(a, n), pattern(b, m))
        assert pairs(got.df) == sorted((i * m + k, j * m + l) for i, j in a for k, l in b)


@pytest.mark.parametrize("cell", [None, 3])
def test_a_product_of_many_paths_is_worked_out_in_passes(spark, valued, monkeypatch, cell):
    rng = random.Random(7)
    cells = {(rng.randrange(12), rng.randrange(5)): float(rng.randrange(1, 9)) for _ in range(50)}
    A = valued([(i, k, v) for (i, k), v in cells.items()], 12, 5)
    B = A.transposed()
    terms = {}
    for (i, k), v in cells.items():
        for (j, m), w in cells.items():
            if k == m:
                terms.setdefault((i, j), []).append((v, w))
    monkeypatch.setattr(multiply, "PASS_PATHS", 20)
    monkeypatch.setattr(multiply, "DENSE_PATHS", 1)
    passes = []
    kept = multiply._in_passes
    monkeypatch.setattr(multiply, "_in_passes", lambda *a: passes.append(a[-1]) or kept(*a))
    got = cg.mxm(A, B, "plus_times", cell=cell).df
    assert {(r[0], r[1]): r[2] for r in got.collect()} == {c: sum(v * w for v, w in t) for c, t in terms.items()}
    got = cg.mxm(A, B, mul=lambda a, b: F.least(a, b), add=F.max, cell=cell).df
    assert {(r[0], r[1]): r[2] for r in got.collect()} == {c: max(min(x) for x in t) for c, t in terms.items()}
    assert {tuple(r) for r in cg.mxm(A, B, cell=cell).df.collect()} == set(terms)
    assert len(passes) == 3 and min(passes) > 1
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()  # read back, paths are not shuffled again
