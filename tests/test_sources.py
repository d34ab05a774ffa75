import random

import pytest
from helpers import cells, pairs, rows

import coogrid as cg
import coogrid.sources.mtx as mtx


@pytest.fixture
def write(tmp_path):
    def save(name, text):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
        return str(p)

    return save


DUP = "%%MatrixMarket matrix coordinate pattern general\n% note\n4 4 5\n1 2\n2 3\n3 4\n4 4\n1 2\n"


def test_read_pattern(spark, write):
    path = write("dup.mtx", DUP)
    A = cg.read_mtx(spark, path)
    assert A.shape == (4, 4)
    assert pairs(A.df) == [(0, 1), (1, 2), (2, 3), (3, 3)]
    raw, *_ = cg.read_mtx_raw(spark, path)
    assert rows(cg.duplicate_entries(raw), "row_id", "col_id", "n") == [(0, 1, 2)]


def test_read_undirected(spark, write):
    A = cg.read_mtx(spark, write("undir.mtx", "3 3 2\n1 1\n1 2\n"), undirected=True)
    assert pairs(A.df) == [(0, 0), (0, 1), (1, 0)]


def test_value_token_is_ignored_by_the_pattern(spark, write):
    A = cg.read_mtx(spark, write("v.mtx", "2 2 2\n1 1 0\n2 1 3.5\n"))
    assert pairs(A.df) == [(0, 0), (1, 0)]


@pytest.mark.parametrize(
    "text,what",
    [
        ("3 3 2\n0 1\n1 1\n", "0 1"),
        ("3 3 2\n1 1\n4 1\n", "4 1"),
        ("3 3 2\n1 1\n1 5\n", "1 5"),
        ("3 3 3\n1 1\n2 1\n", "3 entries announced, 2 found"),
        ("3 3 1\n1 1\n2 1\n", "1 entries announced, 2 found"),
        ("3 3 2\n1 1\n% late\n2 2\n", "late"),
        ("3 3 2\n1 1\nx y\n", "x y"),
        ("% only\n", "no header"),
        ("3 3\n1 1\n", "no header"),
    ],
)
def test_bad_text_raises(spark, write, text, what):
    with pytest.raises(ValueError, match=what):
        cg.read_mtx(spark, write("bad.mtx", text))


def test_values_and_zeros(spark, write):
    path = write("v.mtx", "% c\n2 3 4\n1 1 0.0\n1 3 2.5\n2 2 -1e3\n2 2 1\n")
    assert cells(cg.read_mtx_values(spark, path).df) == {(0, 0): 0.0, (0, 2): 2.5, (1, 1): -999.0}
    assert cells(cg.read_mtx_values(spark, path, keep_zeros=False, dup="max").df) == {(0, 2): 2.5, (1, 1): 1.0}
    sym = write("s.mtx", "2 2 2\n1 1 3\n2 1 4\n")
    assert cells(cg.read_mtx_values(spark, sym, undirected=True).df) == {(0, 0): 3.0, (0, 1): 4.0, (1, 0): 4.0}
    plain = write("p.mtx", "2 2 1\n2 1\n")
    assert cells(cg.read_mtx_values(spark, plain).df) == {(1, 0): 1.0}


def test_entry_with_the_text_of_the_header(spark, write):
    path = write("twin.mtx", "3 3 3\n1 1 2\n3 3 3\n3 3 3\n")
    assert cells(cg.read_mtx_values(spark, path).df) == {(0, 0): 2.0, (2, 2): 6.0}
    raw, *_ = cg.read_mtx_raw(spark, path)
    assert raw.count() == 3
    assert pairs(cg.read_mtx(spark, path).df) == [(0, 0), (2, 2)]


def test_empty_matrix_text(spark, write):
    A = cg.read_mtx(spark, write("e.mtx", "% none\n3 5 0\n"))
    assert A.shape == (3, 5) and A.nvals() == 0


def test_header_behind_a_comment_block_larger_than_a_split(spark, write):
    body = sorted({(random.Random(i).randrange(50) + 1, i % 40 + 1) for i in range(400)})
    text = "".join(f"% {'x' * 60}\n" for _ in range(400)) + f"50 40 {len(body)}\n"
    path = write("long.mtx", text + "".join(f"{r} {c}\n" for r, c in body))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        A = cg.read_mtx(spark, path)
        assert A.shape == (50, 40)
        assert pairs(A.df) == [(r - 1, c - 1) for r, c in body]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_write_and_read_back(spark, pattern, valued, tmp_path):
    rng = random.Random(9)
    entries = sorted({(rng.randrange(30), rng.randrange(40)) for _ in range(300)})
    A = pattern(entries, 31, 40)
    assert cg.write_mtx(A, str(tmp_path / "a.mtx")) == len(entries)
    back = cg.read_mtx(spark, str(tmp_path / "a.mtx"))
    assert back.shape == (31, 40) and pairs(back.df) == entries
    S = pattern([(0, 1), (1, 0)], 3)
    cg.write_mtx(cg.mxm(S, S), str(tmp_path / "s.mtx2"))
    assert pairs(cg.read_mtx_square(spark, str(tmp_path / "s.mtx")).df) == [(0, 0), (1, 1)]
    V = valued([(0, 0, 0.5), (1, 1, -2.25)], 2)
    assert cg.write_mtx_values(V, str(tmp_path / "v.mtx")) == 2
    assert cells(cg.read_mtx_values(spark, str(tmp_path / "v.mtx")).df) == {(0, 0): 0.5, (1, 1): -2.25}
    again = pattern([(2, 2)], 3)
    cg.write_mtx(again, str(tmp_path / "a.mtx"))
    assert pairs(cg.read_mtx(spark, str(tmp_path / "a.mtx")).df) == [(2, 2)]


def test_workload(spark, write, tmp_path):
    write("data/one/one.mtx", DUP)
    write("data/two.mtx", "3 3 2\n1 1\n1 2\n")
    listing = write(
        "config.txt", "% name | flag | runs\ndata/one/one.mtx   0   10\n\ndata/two.mtx  1  3\n%data/x.mtx 0 1\n"
    )
    workload = cg.read_workload(spark, listing)
    assert rows(workload, "matrix_id", "undirected", "iterations") == [
        ("data/one/one.mtx", False, 10),
        ("data/two.mtx", True, 3),
    ]
    table, shapes = cg.load_workload(spark, workload, str(tmp_path))
    got = rows(table, "matrix_id", "row_id", "col_id")
    assert got == [("data/one/one.mtx", *x) for x in [(0, 1), (1, 2), (2, 3), (3, 3)]] + [
        ("data/two.mtx", *x) for x in [(0, 0), (0, 1), (1, 0)]
    ]
    assert rows(shapes, "matrix_id", "nrows", "ncols") == [("data/one/one.mtx", 4, 4), ("data/two.mtx", 3, 3)]
    squares = cg.square_entries(table)
    assert squares.where("matrix_id = 'data/two.mtx'").count() == 4
    single = cg.workload_entry(spark, "data/two.mtx", True, 1)
    assert cg.load_workload(spark, single, str(tmp_path))[0].count() == 3


def test_samples_and_time_points(spark, write):
    csv = write(
        "samples.csv",
        "timestamp, pstate, memory.total [MiB], memory.used [MiB]\n"
        "2020/11/12 13:14:15.250, P8, 8117 MiB, 93 MiB\n2020/11/12 13:14:15.251, P0, 8117 MiB, 105 MiB\n",
    )
    got = cg.read_mem_samples(spark, csv)
    assert dict(got.dtypes)["ts"] == "timestamp_ntz"
    assert [(str(r["ts"]), r["pstate"], r["total_mib"], r["used_mib"]) for r in got.orderBy("ts").collect()] == [
        ("2020-11-12 13:14:15.250000", "P8", 8117, 93),
        ("2020-11-12 13:14:15.251000", "P0", 8117, 105),
    ]
    points = write(
        "points.txt",
        "mult_a data/x.mtx 1 10\n2020/11/12 13:14:15.250\n2020/11/12 13:15:00.001\n"
        "mult_b data/y.mtx 0 10\n2020/11/12 13:16:15.000\n2020/11/12 13:17:00.123456\n",
    )
    got = cg.read_time_points(spark, points).orderBy("section_id").collect()
    assert [(r["section_id"], r["name"], str(r["t_end"])) for r in got] == [
        (0, "mult_a data/x.mtx", "2020-11-12 13:15:00.001000"),
        (1, "mult_b data/y.mtx", "2020-11-12 13:17:00.123456"),
    ]
    two = write("two.csv", "memory.total [MiB], memory.used [MiB]\n8117 MiB, 93 MiB\n8117 MiB, 120 MiB\n")
    peak = cg.usage_peak(cg.read_usage_samples(spark, two)).first()
    assert (peak["max_mib"], peak["min_mib"], peak["peak_mib"], peak["samples"]) == (120, 93, 27, 2)


def test_summaries(spark, write, tmp_path):
    samples = spark.createDataFrame(
        [("a", 0, 9.0), ("a", 1, 1.0), ("a", 2, 3.0), ("b", 0, 5.0)], "experiment string, iteration bigint, ms double"
    )
    stats = cg.timing_stats(samples)
    for target in ("x", "y"):
        cg.append_summary(stats, str(tmp_path / "sum" / f"target={target}"))
    cg.append_summary(stats, str(tmp_path / "sum" / "target=y"))
    got = rows(cg.read_summaries(spark, str(tmp_path / "sum")), "target", "name", "iterations", "expectation_ms")
    assert got == [("x", "a", 3, 2.0), ("x", "b", 1, 0.0)] + [("y", "a", 3, 2.0)] * 2 + [("y", "b", 1, 0.0)] * 2
    text = write(
        "runs-t.txt",
        "Benchmarking: t\n\n            Friendly name|      iterations|  expectation ms|           sd ms| \n"
        "      data/one/one.mtx:              10              7.9           0.25\n",
    )
    assert rows(cg.read_summary_text(spark, text), "file", "name", "iterations", "expectation_ms", "sd_ms") == [
        ("runs-t.txt", "data/one/one.mtx", 10, 7.9, 0.25)
    ]


def test_missing_values_fail(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, None)], "r long, c long, v double")
    with pytest.raises(Exception, match="no value at"):
        cg.Matrix.from_edges(df, "r", "c", 2, 2, "v", "sum").df.collect()
    raw = cg.Matrix(df.selectExpr("r AS row_id", "c AS col_id", "v AS val"), 2, 2)
    with pytest.raises(Exception, match="no value at"):
        cg.write_mtx_values(raw, str(tmp_path / "null.mtx"))


def test_white_space_and_the_bad_entry_in_the_message(spark, tmp_path):
    good = tmp_path / "tabs.mtx"
    good.write_text("%%banner\n\t 2 2 1\t\n\t1\t2 \n")
    assert pairs(cg.read_mtx(spark, str(good)).df) == [(0, 1)]
    bad = tmp_path / "bad.mtx"
    bad.write_text("% one\n% two\n2 2 1\n7 1\n")
    with pytest.raises(ValueError, match=r"\['7 1'\]"):
        cg.read_mtx(spark, str(bad))


def test_cut_off_records_fail(spark, tmp_path):
    points = tmp_path / "points.txt"
    points.write_text("multiply a.mtx 0 10\n2021/03/04 10:00:00.5\n2021/03/04 10:00:01.5\nadd a.mtx 0 10\n2021/03/04 10:00:02.5\n")
    with pytest.raises(Exception, match="cut off"):
        cg.read_time_points(spark, str(points)).collect()


def test_the_banner_may_decide(spark, tmp_path):
    def text(kind):
        p = tmp_path / f"{kind}.mtx"
        p.write_text(f"%%MatrixMarket matrix coordinate real {kind}\n2 2 2\n1 1 4\n2 1 3\n")
        return str(p)

    half = {(0, 0): 4.0, (1, 0): 3.0}
    read = lambda kind, **how: cells(cg.read_mtx_values(spark, text(kind), **how).df)
    assert read("symmetric") == half
    assert read("general", symmetry="banner") == half
    assert read("symmetric", symmetry="banner") == half | {(0, 1): 3.0}
    assert read("skew-symmetric", symmetry="banner") == half | {(0, 1): -3.0}
    with pytest.raises(ValueError, match="hermitian"):
        read("hermitian", symmetry="banner")


def test_summary_text_is_appended(spark, tmp_path):
    stats = spark.createDataFrame([("a.mtx", 10, 1.25, 0.5)], "experiment string, iterations long, avg_drop_first_ms double, sd_ms double")
    path = str(tmp_path / "Summary")
    for _ in range(2):
        cg.append_summary_text(stats, path, "multiply")
    got = cg.read_summary_text(spark, path)
    assert [tuple(r)[1:] for r in got.collect()] == [("a.mtx", 10, 1.25, 0.5)] * 2
    lines = [r["value"] for r in spark.read.text(path).collect()]
    assert sum(v.startswith("Benchmarking") for v in lines) == 1


def test_jobs_do_not_grow_with_the_texts(spark, tmp_path):
    from coogrid.sources.mtx import read_many

    def load(n):
        top = tmp_path / str(n)
        top.mkdir()
        listed = []
        for i in range(n):
            p = top / f"m {i}.mtx"
            p.write_text(f"3 3 2\n1 {i % 3 + 1}\n3 3 1\n")
            listed.append((f"m{i}", str(p), i % 2 == 0))
        group = f"texts-{n}"
        spark.sparkContext.setJobGroup(group, group)
        table, shapes = read_many(spark, listed)
        got = sorted(tuple(r) for r in table.collect())
        want = {(f"m{i}", *e) for i in range(n) for e in ((0, i % 3), (2, 2))}
        want |= {(f"m{i}", i % 3, 0) for i in range(0, n, 2)}
        assert got == sorted(want) and shapes.count() == n
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    few = load(2)
    assert load(50) <= few + 1  # many paths are listed by a job of their own
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_complex_values_are_refused(spark, tmp_path):
    path = tmp_path / "c.mtx"
    path.write_text("%%MatrixMarket matrix coordinate complex general\n2 2 1\n1 1 2.0 3.0\n")
    with pytest.raises(ValueError, match="complex"):
        cg.read_mtx_values(spark, str(path), symmetry="banner")


def test_a_workload_of_many_texts(spark, tmp_path, monkeypatch):
    listed = []
    for k in range(200):
        path = tmp_path / f"set {k % 7}" / f"m%{k}.mtx"
        path.parent.mkdir(exist_ok=True)
        path.write_text(f"4 4 2\n{k % 4 + 1} 1\n2 {k % 3 + 2}\n")
        listed.append((f"m{k}", str(path), False))
    parts = tmp_path / "whole" / "1-entries"
    parts.mkdir(parents=True)
    (tmp_path / "whole" / "0-header").write_text("2 2 2\n")
    (parts / "part-0").write_text("1 1\n")
    (parts / "part-1").write_text("2 2\n")
    listed += [("whole", str(tmp_path / "whole"), False), ("again", str(tmp_path / "whole"), False)]
    for few in (100_000, 0):
        monkeypatch.setattr(mtx, "BROADCAST_KEYS", few)
        table, shapes = mtx.read_many(spark, listed)
        want = sorted({(f"m{k}", k % 4, 0) for k in range(200)} | {(f"m{k}", 1, k % 3 + 1) for k in range(200)})
        want += [(name, i, i) for name in ("again", "whole") for i in (0, 1)]
        assert rows(table, "matrix_id", "row_id", "col_id") == sorted(want) and shapes.count() == 202
