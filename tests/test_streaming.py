import datetime as dt
import random
from pathlib import Path

import pytest
from helpers import rows

import coogrid as cg
from coogrid.streaming import closed_section_memory, live_section_memory
from coogrid.streaming import live

T0 = dt.datetime(2024, 5, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


@pytest.mark.parametrize("mode", ["complete", "update"])
def test_live_sections_grow_with_the_stream(spark, tmp_path, mode):
    schema = "ts timestamp_ntz, used_mib bigint"
    sections = spark.createDataFrame(
        [(0, at(1), at(3)), (1, at(2), at(90))], "section_id bigint, t_begin timestamp_ntz, t_end timestamp_ntz"
    )
    inbox, name = str(tmp_path / "in"), f"live_{mode}"
    first = spark.createDataFrame([(at(0), 99), (at(1), 5), (at(2), 7)], schema)
    first.write.mode("append").parquet(inbox)
    stream = spark.readStream.schema(schema).parquet(inbox)
    query = (
        live_section_memory(stream, sections)
        .writeStream.outputMode(mode)
        .format("memory")
        .queryName(name)
        .option("checkpointLocation", str(tmp_path / "state"))
        .start()
    )
    try:
        query.processAllAvailable()
        cols = ("section_id", "samples", "min_mib", "max_mib", "used_mib")
        assert rows(spark.table(name), *cols) == [(0, 2, 5, 7, 2), (1, 1, 7, 7, 0)]
        second = spark.createDataFrame([(at(3), 4), (at(50), 20), (at(91), 1)], schema)
        second.write.mode("append").parquet(inbox)
        query.processAllAvailable()
        latest = rows(spark.table(name), *cols)[-4 if mode == "update" else -2 :]
        assert {r[0]: r for r in sorted(latest, key=lambda r: r[1])} == {0: (0, 3, 4, 7, 3), 1: (1, 3, 4, 20, 16)}
    finally:
        query.stop()


SECTIONS = "section_id bigint, t_begin timestamp_ntz, t_end timestamp_ntz"


@pytest.mark.parametrize("tied,few", [(True, 100_000), (False, 0)])
def test_closed_sections_equal_the_batch(spark, tmp_path, monkeypatch, tied, few):
    monkeypatch.setattr(live, "BROADCAST_KEYS", few)
    rng = random.Random(5)
    # Short sections, one over everything, one between samples, one before all, one not over at the end.
    spans = [(i, at(rng.randrange(200)), at(rng.randrange(200))) for i in range(40)]
    spans += [(50, at(0), at(200)), (51, at(3.2), at(3.4)), (52, at(-9), at(-5)), (53, at(100), at(5000)), (54, at(7), at(7))]
    sections = spark.createDataFrame(spans, SECTIONS)
    times = sorted(rng.choice([rng.uniform(0, 230), rng.randrange(230)]) for _ in range(500)) + [400.0]
    samples = [(at(t), rng.choice([None, rng.randrange(100)]), i) for i, t in enumerate(times)]
    schema = "ts timestamp_ntz, used_mib bigint, seq bigint" if tied else "ts timestamp_ntz, used_mib bigint"
    kept = [s if tied else s[:2] for s in samples]
    inbox = str(tmp_path / "in")
    Path(inbox).mkdir()
    stream = spark.readStream.schema(schema).parquet(inbox)
    name = f"closed_{tied}"
    query = (
        closed_section_memory(stream, sections, delay="20 seconds")
        .writeStream.outputMode("append").format("memory").queryName(name)
        .option("checkpointLocation", str(tmp_path / "state")).start()
    )
    held = []
    try:
        # Five deliveries, each a little out of order, the last one far ahead.
        for k in range(0, 500, 125):
            part = kept[k : k + 125]
            rng.shuffle(part)
            spark.createDataFrame(part, schema).repartition(3).write.mode("append").parquet(inbox)
            query.processAllAvailable()
            held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        spark.createDataFrame(kept[500:], schema).write.mode("append").parquet(inbox)
        query.processAllAvailable()
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        cols = ("section_id", "samples", "min_mib", "max_mib", "used_mib")
        got = rows(spark.table(name), *cols)
    finally:
        query.stop()
    batch = {r[0]: r for r in rows(cg.section_memory(spark.createDataFrame(kept, schema), sections), *cols)}
    assert len({r[0] for r in got}) == len(got) > 20
    assert got == [batch[r[0]] for r in got]
    # Whoever is missing is still open or met no sample.
    assert all(k == 53 or batch[k][1] == 0 for k in set(batch) - {r[0] for r in got})
    assert max(held) > 5 and held[-1] == 1


def test_late_samples_do_not_reopen_a_section(spark, tmp_path):
    schema = "ts timestamp_ntz, used_mib double"
    sections = spark.createDataFrame([(0, at(1), at(5)), (1, at(1), at(500))], SECTIONS)
    inbox = str(tmp_path / "in")
    Path(inbox).mkdir()
    stream = spark.readStream.schema(schema).parquet(inbox)
    query = (
        closed_section_memory(stream, sections, delay="1 second")
        .writeStream.outputMode("append").format("memory").queryName("late")
        .option("checkpointLocation", str(tmp_path / "state")).start()
    )
    try:
        for part in ([(at(1), 2.5), (at(2), 4.0), (at(3), 9.0)], [(at(60), 1.0)], [(at(4), 100.0), (at(61), 1.0)]):
            spark.createDataFrame(part, schema).write.mode("append").parquet(inbox)
            query.processAllAvailable()
        assert rows(spark.table("late"), "section_id", "samples", "min_mib", "max_mib") == [(0, 2, 2.5, 4.0)]
    finally:
        query.stop()


@pytest.mark.parametrize("few,cells", [(100_000, None), (0, None), (0, 3), (0, 500)])
def test_samples_that_are_all_there_meet_each_section_once(spark, monkeypatch, few, cells):
    rng = random.Random(11)
    spans = [(i, at(rng.randrange(300)), at(rng.randrange(300))) for i in range(40)]
    spans += [(50, at(-5), at(900)), (51, at(3.2), at(3.4)), (52, at(-9), at(-5)), (53, at(7), at(7)), (53, at(7), at(7)), (54, None, at(9))]
    # Many samples at one instant, some outside all sections, some without a value or a time.
    samples = [(at(rng.randrange(300)), rng.randrange(100)) for _ in range(400)]
    samples += [(at(7), v) for v in range(60)] + [(at(-1000), 999), (at(5000), 999), (None, 999), (at(8), None)]
    want = []
    for i in {s[0] for s in spans}:
        inside = [u for s, b, e in spans if s == i and b is not None for t, u in samples if t is not None and b <= t <= e]
        if inside:
            lo, hi = (f((u for u in inside if u is not None), default=None) for f in (min, max))
            want.append((i, len(inside), lo, hi, hi - lo))
    met = []
    join = live.spread_join
    monkeypatch.setattr(live, "spread_join", lambda l, r, *a, **k: met.append((l, r)) or join(l, r, *a, **k))
    monkeypatch.setattr(live, "BROADCAST_KEYS", few)
    sections = spark.createDataFrame(spans, SECTIONS)
    frame = spark.createDataFrame(samples, "ts timestamp_ntz, used_mib bigint")
    got = live_section_memory(frame, sections, cells=cells)
    assert rows(got, "section_id", "samples", "min_mib", "max_mib", "used_mib") == sorted(want)
    if not few:
        ((left, right),) = met
        ends = f"__level = {live.ENDS}"
        instants = len({t for t, _ in samples if t is not None and at(-9) <= t <= at(900)})
        assert left.where(ends).count() == instants  # not one row a sample
        assert right.where(ends).count() <= 2 * 45  # not one row a part
