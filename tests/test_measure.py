import datetime as dt
import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

import coogrid as cg

T0 = dt.datetime(2024, 3, 31, 1, 0, 0)


def at(s):
    return T0 + dt.timedelta(seconds=s)


@pytest.fixture
def series(spark):
    def make(items):
        if items and len(items[0]) == 3:
            return spark.createDataFrame([(at(t), u, q) for t, u, q in items], "ts timestamp_ntz, used_mib bigint, seq bigint")
        return spark.createDataFrame([(at(t), u) for t, u in items], "ts timestamp_ntz, used_mib bigint")

    return make


@pytest.fixture
def experiments(spark):
    def make(items):
        data = [(i, f"e{i}", at(b), at(e)) for i, (b, e) in enumerate(items)]
        return spark.createDataFrame(data, "section_id bigint, name string, t_begin timestamp_ntz, t_end timestamp_ntz")

    return make


BASE = [(0, 5), (1, 9), (2, 7), (3, 8), (4, 6)]


def test_timing_stats(spark):
    df = spark.createDataFrame(
        [("one", 0, 4.0), ("three", 0, 10.0), ("three", 1, 1.0), ("three", 2, 4.0)],
        "experiment string, iteration bigint, ms double",
    )
    got = {r["experiment"]: r for r in cg.timing_stats(df).collect()}
    one, three = got["one"], got["three"]
    assert (one["sd_ms"], one["avg_drop_first_ms"], one["avg_ms"], one["iterations"]) == (0.0, 0.0, 4.0, 1)
    assert (three["total_ms"], three["avg_ms"], three["avg_drop_first_ms"]) == (15.0, 5.0, 2.5)
    assert three["sd_ms"] == pytest.approx(21**0.5)
    assert (three["min_ms"], three["max_ms"]) == (1.0, 10.0)


def test_trimmed_mean(spark):
    df = spark.createDataFrame(
        [("a", i, v) for i, v in enumerate([10.0, 11.0, 9.0, 10.0, 100.0])] + [("b", 0, 3.0)],
        "experiment string, iteration bigint, ms double",
    )
    assert rows(cg.trimmed_mean(df), "experiment", "n", "kept", "mean_ms", "trimmed_ms") == [
        ("a", 5, 4, 28.0, 10.0),
        ("b", 1, 1, 3.0, 3.0),
    ]


def test_throughput(spark):
    df = spark.createDataFrame([(2.0, 100, 10, 20, 500)], "ms double, nnz bigint, nrows bigint, ncols bigint, work bigint")
    assert cg.throughput(df, "elements").first()["rate"] == pytest.approx(100 / 2e6)
    assert cg.throughput(df, "spmv").first()["rate"] == pytest.approx((4 * 110 + 4 * 130) / 2e6)
    assert cg.throughput(df, "spgemm").first()["rate"] == 500.0
    with pytest.raises(ValueError):
        cg.throughput(df, "x")


def test_asof(spark, series):
    points = spark.createDataFrame([(i, at(t)) for i, t in enumerate([-1, 0, 0.5, 2, 4, 4.5, 0.5])], "id int, at timestamp_ntz")

    def lookup(**kw):
        got = cg.asof(series(BASE), points, **kw).collect()
        return [r["sample_ts"] and (r["sample_ts"] - T0).total_seconds() for r in sorted(got, key=lambda r: r["id"])]

    assert lookup(direction="left") == [None, 0, 0, 2, 4, None, 0]
    assert lookup(direction="right") == [None, 0, 1, 2, 4, None, 1]
    assert lookup(direction="left", clip=True) == [None, 0, 0, 2, 4, 4, 0]
    assert lookup(direction="right", clip=True) == [0, 0, 1, 2, 4, None, 1]


def test_section_of_the_fixture(series, experiments):
    s, e = series(BASE), experiments([(0.5, 3.5)])
    assert rows(cg.sections(s, e), "section_id", "used_mib") == [(0, 7), (0, 9)]
    assert rows(cg.section_memory(s, e), "section_id", "samples", "min_mib", "max_mib", "used_mib") == [(0, 2, 7, 9, 2)]


def test_edges_ties_and_empty_sections(series, experiments):
    e = experiments([(1, 3), (-5, 99), (2, 2), (3.2, 3.8), (50, 60), (-9, -8), (4, 4.5)])
    got = {r["section_id"]: r for r in cg.section_memory(series(BASE), e).collect()}
    assert [got[i]["samples"] for i in range(7)] == [2, 4, 0, 0, 0, 0, 0]
    assert (got[0]["min_mib"], got[0]["max_mib"]) == (7, 9)
    assert (got[1]["min_mib"], got[1]["max_mib"]) == (5, 9)
    assert got[4]["used_mib"] is None and got[2]["min_mib"] is None


def test_samples_of_one_instant_are_told_apart(series, experiments):
    s = series([(0, 1, 0), (1, 2, 1), (1, 9, 2), (2, 3, 3)])
    assert rows(cg.sections(s, experiments([(0, 1.5)])), "used_mib") == [(1,), (2,)]
    assert cg.section_memory(s, experiments([(0, 1.5)])).first()["max_mib"] == 2


def test_no_samples_at_all(series, experiments):
    s, e = series([]), experiments([(0, 1)])
    s = s.select("ts", "used_mib")
    assert cg.sections(s, e).count() == 0
    assert cg.section_memory(s, e).first()["samples"] == 0


@pytest.mark.parametrize("cells", [None, 1, 7, 100_000])
def test_sections_match_index_search(series, experiments, cells):
    rng = random.Random(11)
    times = sorted(rng.sample(range(5000), 300))
    data = [(t / 10, rng.randrange(1000)) for t in times]
    spans = [sorted((rng.uniform(data[0][0], data[-1][0]), rng.uniform(data[0][0], data[-1][0]))) for _ in range(40)]
    expected = []
    for i, (b, e) in enumerate(spans):
        first = next(n for n, (t, _) in enumerate(data) if t >= b)
        final = max(n for n, (t, _) in enumerate(data) if t <= e)
        inside = [u for _, u in data[first:final]]
        expected.append((i, len(inside), min(inside, default=None), max(inside, default=None)))
    s, e = series(data), experiments(spans)
    got = sorted((r["section_id"], r["samples"], r["min_mib"], r["max_mib"]) for r in cg.section_memory(s, e, cells=cells).collect())
    assert got == expected
    listed = cg.sections(s, e, cells=cells).groupBy("section_id").count()
    assert rows(listed, "section_id", "count") == [(i, n) for i, n, *_ in expected if n]


def test_a_burst_and_a_section_over_the_whole_series(series, experiments):
    # Nearly all instants lie in one second of a long series.
    times = [0.0, 50_000.0] + [100 + i / 2000 for i in range(1500)]
    data = sorted((t, int(t * 7) % 97) for t in times)
    spans = [(0, 50_000), (99, 101), (100.2, 100.4), (100.2001, 60_000), (-5, 100.1)]
    s, e = series(data), experiments(spans)
    want = []
    for i, (b, f) in enumerate(spans):
        last = max(n for n, (t, _) in enumerate(data) if t <= f)
        inside = [u for t, u in data[:last] if t >= b]
        want.append((i, len(inside), min(inside), max(inside)))
    got = sorted((r["section_id"], r["samples"], r["min_mib"], r["max_mib"]) for r in cg.section_memory(s, e).collect())
    assert got == want
    listed = cg.sections(s, e).groupBy("section_id").count()
    assert rows(listed, "section_id", "count") == [(i, n) for i, n, *_ in want]


def test_samples_go_up_only_to_levels_in_use(series, experiments, monkeypatch):
    import coogrid.operators.intervals as intervals

    monkeypatch.setattr(intervals, "FAN", 4)
    monkeypatch.setattr(intervals, "CELL_SAMPLES", 2)
    asked, above = [], intervals.cells_above
    monkeypatch.setattr(intervals, "cells_above", lambda cell, levels: asked.append(list(levels)) or above(cell, levels))
    data = [(i, i % 13) for i in range(600)]
    for spans, levels in (([(10, 12), (300, 301)], None), ([(10, 15)], [0]), ([(0, 64), (3, 9)], [0, 1, 2]), ([(0, 600)], [0, 1, 2, 3, 4])):
        asked.clear()
        got = cg.sections(series(data), experiments(spans))
        assert not asked if levels is None else set(asked[0]) <= set(levels) and asked[0]
        want = sorted((i, u) for i, (b, e) in enumerate(spans) for t, u in data if b <= t < min(e, 599))
        assert rows(got, "section_id", "used_mib") == want


def test_section_report(spark, series, experiments, tmp_path):
    e = experiments([(0.5, 3.5), (50, 60)])
    table = cg.section_memory(series(BASE), e).join(e.select("section_id", "name"), "section_id")
    cg.section_report(table, str(tmp_path / "report"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert lines == [
        "[0] e0", "min= 7 MiB max= 9 MiB used= 2 MiB", "", "[1] e1", "min= - MiB max= - MiB used= - MiB", "",
    ]


def test_time_columns_do_not_depend_on_the_session_zone(spark):
    from coogrid.functions import from_micros, micros

    df = spark.sql("SELECT timestamp_ntz'2024-03-31 02:30:00.123457' AS ts")
    for zone in ("UTC", "Europe/Berlin"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            row = df.select(micros("ts").alias("us"), from_micros(micros("ts")).alias("ts")).first()
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert row["us"] == 1711852200123457
        assert row["ts"] == dt.datetime(2024, 3, 31, 2, 30, 0, 123457)


def test_covering_cells(spark):
    from pyspark.sql import functions as F

    from coogrid.operators.intervals import FAN, covering

    spans = [(0, 0), (0, 1), (5, 63), (0, 64), (1, 64), (1, 129), (63, 65), (3, 9000), (0, FAN**3), (17, 262_143), (9, 4)]
    df = spark.createDataFrame(spans, "a bigint, z bigint")
    for levels in (1, 2, 4):
        for r in df.select("a", "z", covering(F.col("a"), F.col("z"), levels).alias("c")).collect():
            if levels < 4 and r["z"] - r["a"] > 9000:
                continue
            covered = [x for c in r["c"] for x in range(c["cell"] * FAN ** c["level"], (c["cell"] + 1) * FAN ** c["level"])]
            assert sorted(covered) == list(range(r["a"], r["z"]))
            if levels > 1:
                assert all(sum(c["level"] == i for c in r["c"]) < 2 * FAN or i == levels - 1 for i in range(levels))


def test_tied_instants_inside_and_at_the_end(series, experiments):
    data = [(0, 5, 0), (1, 50, 1), (1, 1, 2), (2, 7, 3), (3, 4, 4), (3, 90, 5), (3, 2, 6), (5, 8, 7)]
    e = experiments([(0, 4), (1, 1), (0, 1), (3, 3.5)])
    got = rows(cg.section_memory(series(data), e), "section_id", "samples", "min_mib", "max_mib")
    assert got == [(0, 6, 1, 90), (1, 1, 50, 50), (2, 2, 5, 50), (3, 2, 4, 90)]
    listed = cg.sections(series(data), e).groupBy("section_id").count()
    assert rows(listed, "section_id", "count") == [(0, 6), (1, 1), (2, 2), (3, 2)]


def test_cuts_leave_no_shuffle_files(spark):
    from coogrid.plans.durable import materialize

    def shuffled():
        tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
        return set(str(tracker.shuffleStatuses().keySet()).strip("Set() ").replace(",", " ").split())

    before = shuffled()
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("v"))
    kept = materialize(df)
    assert shuffled() <= before and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert rows(kept, "k", "v") == rows(df, "k", "v")  # the frame itself may run again
