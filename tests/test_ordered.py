import random

import pytest
from helpers import pairs, rows
from pyspark.sql import functions as F

import coogrid as cg
from coogrid.operators.order import _expand_copies
from coogrid.plans import ordered as plans
from coogrid.plans.ordered import add_bucket, bucket_count, with_previous


@pytest.fixture(autouse=True)
def small_buckets(monkeypatch):
    """Small tables make many buckets here, whose carry goes through two levels."""
    monkeypatch.setattr(plans, "LEAST_BUCKET_ROWS", 8)
    monkeypatch.setattr(plans, "CARRY_FAN", 4)


def prefix(values, op, exclusive, identity):
    out, acc = [], identity
    for v in values:
        nxt = v if acc is None else op(acc, v)
        out.append(acc if exclusive else nxt)
        acc = nxt
    return out


@pytest.mark.parametrize("op,fn", [("sum", lambda a, b: a + b), ("min", min), ("max", max)])
@pytest.mark.parametrize("exclusive", [False, True])
def test_scan(spark, monkeypatch, op, fn, exclusive):
    monkeypatch.setattr(plans, "CARRY_FAN", 1024 if exclusive else 4)
    rng = random.Random(1)
    keys = sorted(rng.sample(range(10**6), 300))
    vals = [rng.randrange(-50, 50) for _ in keys]
    df = spark.createDataFrame(list(zip(keys, vals)), "t bigint, v bigint").repartition(5)
    got = [r[1] for r in rows(cg.scan(df, "t", "v", op, exclusive), "t", "scan")]
    assert got == prefix(vals, fn, exclusive, 0 if op == "sum" else None)


def test_scan_dense_width_and_order_types(spark):
    df = spark.range(100).select(F.col("id").alias("p"), F.lit(1).alias("v"))
    assert rows(cg.scan(df, "p", "v", width=7), "p", "scan") == [(i, i + 1) for i in range(100)]
    neg = df.select((-F.col("p")).cast("double").alias("p"), "v")
    assert rows(cg.scan(neg, "p", "v", exclusive=True), "p", "scan") == [(-99.0 + i, i) for i in range(100)]


def test_buckets_grow_with_the_order_and_are_even(spark):
    skewed = spark.range(4000).select((F.col("id") * F.col("id") * F.col("id")).alias("t"))
    sizes = add_bucket(skewed, "t").groupBy("__bucket").agg(F.count("*").alias("n"), F.min("t"), F.max("t"))
    got = sizes.orderBy("__bucket").collect()
    n = bucket_count(spark, 4000)
    assert n == 64 and n / 2 < len(got) <= n and max(r["n"] for r in got) < 3 * 4000 / n
    assert all(a["max(t)"] < b["min(t)"] for a, b in zip(got, got[1:]))


def test_bucket_number_follows_the_rows(spark, monkeypatch):
    monkeypatch.setattr(plans, "LEAST_BUCKET_ROWS", 100)
    monkeypatch.setattr(plans, "BUCKET_ROWS", 500)
    for n, want in ((0, 1), (1, 1), (350, 4), (6400, 64), (20_000, 64), (40_000, 80)):
        assert bucket_count(spark, n) == want
        rows_ = spark.range(n).selectExpr("id * id AS t")
        found = add_bucket(rows_, "t").groupBy("__bucket").count().collect()
        assert len(found) in (want, want - 1) and max((r["count"] for r in found), default=0) <= max(500, 3 * n / want)


def test_more_buckets_than_the_first_sketch_tells_apart(spark, monkeypatch):
    monkeypatch.setattr(plans, "_GRID", 16)
    df = spark.range(2000).selectExpr("id AS t", "1L AS v")
    assert add_bucket(df, "t").select("__bucket").distinct().count() > 50
    assert cg.scan(df, "t", "v").where("scan <> t + 1").count() == 0


def test_null_keys_are_a_key(spark):
    data = [(None if i % 3 else i % 2, i, 1) for i in range(300)]
    df = spark.createDataFrame(data, "k bigint, p bigint, v bigint").repartition(4)
    got = rows(cg.scan_by_key(df, "k", "p", "v"), "p", "scan")
    seen, expected = {}, []
    for k, p, v in data:
        seen[k] = seen.get(k, 0) + v
        expected.append((p, seen[k]))
    assert got == expected


def test_scan_by_key_with_hot_key(spark):
    rng = random.Random(2)
    data = [(0 if rng.random() < 0.5 else rng.randrange(1, 9), i, rng.randrange(100)) for i in range(600)]
    df = spark.createDataFrame(data, "k bigint, p bigint, v bigint").repartition(4)
    acc, expected = {}, []
    for k, p, v in data:
        acc[k] = acc.get(k, 0) + v
        expected.append((p, acc[k]))
    assert rows(cg.scan_by_key(df, "k", "p", "v"), "p", "scan") == expected


def test_with_previous_crosses_buckets(spark):
    df = spark.range(50).select((F.col("id") * 3).alias("t"), (F.col("id") % 4).alias("k")).repartition(3)
    got = with_previous(df, "t", ["k"]).selectExpr("t", "prev.k AS pk").collect()
    assert sorted((r["t"], r["pk"]) for r in got)[1:] == [(3 * i, (i - 1) % 4) for i in range(1, 50)]
    assert [r["pk"] for r in got if r["t"] == 0] == [None]


def test_ranked_any_order(spark):
    rng = random.Random(3)
    data = [(rng.choice("aab"), i) for i in range(200)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k string, i bigint").repartition(6)
    got = rows(cg.ranked(df, [F.col("k").desc(), "i"]), "pos", "k", "i")
    expected = sorted(data, key=lambda x: (-ord(x[0]), x[1]))
    assert got == [(n, *x) for n, x in enumerate(expected)]


def test_sort_by_key_is_stable_both_ways(spark):
    rng = random.Random(4)
    data = [(5 if rng.random() < 0.4 else rng.randrange(-5, 5), i) for i in range(150)]
    df = spark.createDataFrame(data, "k bigint, pos bigint").repartition(5)
    up = rows(cg.sort_by_key(df, "k", "pos"), "rank", "k", "pos")
    assert [x[1:] for x in up] == sorted(data)
    down = rows(cg.sort_by_key(df, "k", "pos", ascending=False), "rank", "k", "pos")
    assert [x[1:] for x in down] == sorted(data, key=lambda x: -x[0])
    assert [x[0] for x in up] == list(range(150))


def test_merges(spark, pattern):
    a, b = [1, 3, 3, 7, 7, 7], [0, 3, 9]
    A, B = (spark.createDataFrame([(x,) for x in v], "v bigint") for v in (a, b))
    assert rows(cg.merge_values(A, B, "v"), "pos", "v") == list(enumerate(sorted(a + b)))
    p, q = [(0, 1), (1, 2)], [(0, 1), (0, 0), (2, 2)]
    got = rows(cg.merge_sorted(pattern(p, 3), pattern(q, 3)), "pos", "row_id", "col_id")
    assert got == [(i, *x) for i, x in enumerate(sorted(p + q))]


def test_merge_positions_of_a_huge_matrix_use_decimals(spark):
    n = 1 << 40
    df = spark.createDataFrame([(n - 1, n - 1), (0, 5), (n - 1, 0)], "row_id bigint, col_id bigint")
    A = cg.Matrix(df, n, n)
    got = rows(cg.merge_sorted(A, A), "pos", "row_id", "col_id")
    assert [x[1:] for x in got] == sorted([(n - 1, n - 1), (0, 5), (n - 1, 0)] * 2)


def test_long_runs_are_expanded_in_chunks(spark):
    n = 3 * (1 << 16) + 5
    counted = spark.createDataFrame([(4, 0, 2), (6, 2, n)], "v bigint, __start bigint, __n bigint")
    got = _expand_copies(counted, ["v"])
    seen = got.agg(F.count("*"), F.countDistinct("pos"), F.min("pos"), F.max("pos")).first()
    assert tuple(seen) == (n + 2, n + 2, 0, n + 1)
    assert got.where("v = 4").count() == 2


def test_flag_repeats(spark):
    data = [(0, 1, 0), (0, 1, 1), (0, 2, 2), (1, 2, 3), (1, 2, 4), (1, 2, 5)]
    df = spark.createDataFrame(data, "row_id bigint, col_id bigint, t bigint").repartition(4)
    got = rows(cg.flag_repeats(df, ["row_id", "col_id"], "t"), "pos", "t", "is_repeat", "is_new")
    assert [x[2] for x in got] == [0, 1, 0, 0, 1, 1]
    assert [x[3] for x in got] == [1, 0, 1, 1, 0, 0]


def test_reduce_by_runs(spark):
    df = spark.createDataFrame(
        [(0, "a", 1), (1, "a", 2), (2, "b", 3), (3, "a", 4)], "p bigint, k string, v bigint"
    ).repartition(4)
    assert rows(cg.reduce_by_runs(df, "p", "k", "v"), "run_id", "k", "v") == [(0, "a", 3), (1, "b", 3), (2, "a", 4)]
    assert rows(cg.reduce_by_key(df, "k", "v"), "k", "v") == [("a", 7), ("b", 3)]


def test_reduce_by_runs_against_plain_loop(spark):
    rng = random.Random(5)
    data, key = [], 0
    for i in range(400):
        if rng.random() < 0.2:
            key = rng.randrange(3)
        data.append((i * 5, key, rng.randrange(9)))
    expected = []
    for _, k, v in data:
        if expected and expected[-1][0] == k:
            expected[-1][1] += v
        else:
            expected.append([k, v])
    df = spark.createDataFrame(data, "p bigint, k bigint, v bigint").repartition(7)
    got = rows(cg.reduce_by_runs(df, "p", "k", "v"), "run_id", "k", "v")
    assert got == [(i, *x) for i, x in enumerate(expected)]


def test_build_helpers(spark, pattern, valued):
    raw = spark.createDataFrame([(0, 1), (1, 2), (0, 1), (2, 1)], "row_id bigint, col_id bigint")
    assert rows(cg.duplicate_entries(raw), "row_id", "col_id", "n") == [(0, 1, 2)]
    assert rows(cg.duplicate_entries(raw, True), "row_id", "col_id", "n") == [(0, 1, 2), (1, 2, 2)]
    assert cg.dedup(raw).count() == 3
    assert rows(cg.dedup_values(raw, "row_id"), "row_id") == [(0,), (1,), (2,)]
    assert pairs(cg.bad_entries(raw, 2, 9)) == [(2, 1)]
    assert cg.validate_entries(raw, 3, 3, 4) is raw
    with pytest.raises(ValueError, match="outside 2 x 3"):
        cg.validate_entries(raw, 2, 3)
    with pytest.raises(ValueError, match="5 entries announced"):
        cg.validate_entries(raw, 3, 3, 5)
    assert pairs(cg.mirror(pattern([(0, 0), (0, 1)], 3)).df) == [(0, 0), (0, 1), (1, 0)]
    both = cg.mirror(valued([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 2, 4.0)], 3))
    assert rows(both.df, "row_id", "col_id", "val") == [
        (0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 2, 4.0), (2, 1, 4.0)
    ]


def test_first_rule_follows_the_order(spark):
    df = spark.createDataFrame([(0, 0, 5.0, 2), (0, 0, 7.0, 1), (1, 1, 1.0, 3)], "r bigint, c bigint, v double, o int")
    A = cg.Matrix.from_edges(df, "r", "c", 2, 2, "v", "first", "o")
    assert rows(A.df, "row_id", "col_id", "val") == [(0, 0, 7.0), (1, 1, 1.0)]
    with pytest.raises(ValueError, match="order"):
        cg.Matrix.from_edges(df, "r", "c", 2, 2, "v", "first")


def test_ordered_entries(pattern):
    A = pattern([(2, 0), (0, 3), (0, 1)], 4)
    assert [(r[0], r[1]) for r in A.ordered().collect()] == [(0, 1), (0, 3), (2, 0)]
    assert rows(cg.ordered_positions(A), "pos", "row_id", "col_id") == [(0, 0, 1), (1, 0, 3), (2, 2, 0)]


def test_narrow_buckets_stay_bounded(spark, monkeypatch):
    import coogrid.plans.ordered as ordered

    monkeypatch.setattr(ordered, "MOST_BUCKETS", 10)
    df = spark.range(1000).selectExpr("id AS at", "1L AS v")
    assert ordered.add_bucket(df, "at", 1).select(ordered.BUCKET).distinct().count() <= 10
    got = ordered.scan(df, "at", "v", width=1)
    assert got.where("scan <> at + 1").count() == 0
