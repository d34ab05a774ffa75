"""Resampling, archives and whitening against plain computation, on odd and on given tables."""

import gzip
import hashlib
import math
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from coogrid.llm import resampling, warc, whitening

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from check_queries import compare, connect  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
mounted = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="tables not mounted")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@mounted
@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_warc_index"])
def test_queries_agree_with_their_sql(spark, name):
    same, account = compare(spark, connect(SF_DIR), SF_DIR, name, entry_points.queries()[name], entry_points.oracle_sql()[name])
    assert same, account


# --- resampling


def plain_features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain_resample(docs, target, percent=25):
    def count(texts):
        return Counter(zlib.crc32(f.encode()) % 10000 for t in texts for f in plain_features(t)[1])

    own, aim = count(t for _, t in docs), count(target)
    up, down = sum(own.values()) + 10000, sum(aim.values()) + 10000
    rows = []
    for i, t in docs:
        words, features = plain_features(t)
        gains = [
            math.floor(1000 * math.log((aim[b] + 1) * up / ((own[b] + 1) * down)))
            for b in (zlib.crc32(f.encode()) % 10000 for f in features)
        ]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words)])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = able[: percent * len(able) // 100]
    return sorted(
        ((*r[:4], next((k + 1 for k, d in enumerate(drawn) if d is r), None)) for r in rows), key=lambda r: (r[0] is None, r)
    )


def odd_documents():
    long = "Größe élan 42 naïve " * 4000
    texts = [None, "", " .!? ", "one", "A b", long, "x" * 300_000, "Ünder_score-d w0rds\x00and\x7fmore 漢字 the"]
    texts += [" ".join(f"w{(i * k) % 37}" for k in range(15 + i)) for i in range(60)]
    return list(enumerate(texts)) + [(None, "no id " * 12)]


def test_resampling_of_odd_documents(spark, monkeypatch):
    monkeypatch.setattr(resampling, "_BLOCK", 1000)
    docs = odd_documents()
    target = ["w1 w2 w3 w4", None, "", "the élan w0rds"]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    table = table.withColumns({"score": F.lit("x"), "rank": F.lit(1), "__row": F.lit(2), "a": F.lit(3), "n_words": F.lit(None)})
    got = resampling.resample(table, spark.createDataFrame([(t,) for t in target], "text string").withColumn("bucket", F.lit(1)))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: (r[0] is None, r)) == plain_resample(docs, target)
    assert resampling.resample(table.limit(0), table).collect() == []
    none = resampling.resample(table, table.limit(0)).collect()
    assert len(none) == len(docs) and sum(r["rank"] is not None for r in none) == sum(r["rank"] is not None for r in got.collect())


def test_repeated_rows_are_drawn_one_by_one(spark):
    text = "one two three four five " * 6
    table = spark.createDataFrame([(7, text)] * 40 + [(8, text)] * 4 + [(None, text)] * 4, "doc_id long, text string").repartition(6)
    rows = resampling.resample(table, table).collect()
    assert sorted(r["rank"] for r in rows if r["rank"] is not None) == list(range(1, 13))


@pytest.mark.parametrize("need", [1, 2, 37, 500, 999, 1000])
def test_cutoff_is_exact_however_keys_lie(spark, need):
    rng = np.random.default_rng(need)
    keys = [(int(a), int(b), int(c), d) for d, (a, b, c) in enumerate(rng.integers(0, [3, 2, 5], (1000, 3)))]
    frame = spark.createDataFrame(keys, "a long, b long, c long, d long")
    for laid in (frame.repartition(7), frame.repartitionByRange(4, "d").union(frame.limit(0))):
        assert resampling.cutoff(laid, need, last_keys=1) == sorted(keys)[need - 1]


def test_a_round_discards_a_quarter_at_least():
    rng = np.random.default_rng(3)
    for _ in range(50):
        parts = [sorted(rng.integers(0, 1000, rng.integers(1, 60)).tolist()) for _ in range(12)]
        pivot = resampling._weighted_median([(len(p), (p[(len(p) - 1) // 2], 0, 0, 0)) for p in parts])[0]
        every = sorted(k for p in parts for k in p)
        assert sum(k <= pivot for k in every) >= len(every) / 4 and sum(k >= pivot for k in every) >= len(every) / 4


# --- archives


def odd_pages():
    big, other = "Größe " * 400, "x" * 1000
    rows = [(1, "http://a/1", big), (5, "http://a/5", big), (3, None, big), (None, "http://a/n", big), (9, "u", "x" * 999), (8, "u", "x" * 999)]
    rows += [(20, "http://b/ ü\r\nInjected: yes", other), (21, "", other), (21, "again", other), (30, "e", None), (31, "e", "")]
    rows += [(None, "n1", "only null ids " * 90), (None, "n2", "only null ids " * 90), (40, "long", "lång\r\n\r\n" * 200_000), (41, "lone", "y" * 5000)]
    return rows


def want_pages(rows):
    groups = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000:
            groups.setdefault(h, []).append(i)
    stored = {h: max((i for i in ids if i is not None), default=None) for h, ids in groups.items()}
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        refers = stored.get(h) if stored.get(h) != i else None
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


@pytest.mark.parametrize("few", [100_000, 0])
def test_odd_pages_come_back(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(warc, "BROADCAST_KEYS", few)
    rows = odd_pages()
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    table = table.withColumns({"offset": F.lit("x"), "key": F.lit(1), "body": F.lit(2), "stored": F.lit(3), "sha1": F.lit(4)})
    index = warc.write_warc(table, str(tmp_path / "w"))
    back = warc.read_warc(index).collect()
    digest = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[c] for c in digest) for r in back), key=str) == want_pages(rows)
    payloads = {(i, (h or "").encode()) for i, _, h in rows}
    assert all((r["page_id"], bytes(r["payload"])) in payloads for r in back if r["record_type"] == "response")
    assert all(r["payload"] is None for r in back if r["record_type"] == "revisit")
    urls = {r["url"] for r in back}
    assert "http://b/%20ü%0D%0AInjected:%20yes" in urls and None in urls and "" in urls
    some = warc.read_warc(index.where("page_id >= 21"), gap=0)
    assert sorted(r["page_id"] for r in some.collect()) == [21, 21, 30, 31, 40, 41]
    assert warc.read_warc(index.limit(0)).collect() == []
    assert warc.read_warc(warc.write_warc(table.limit(0), str(tmp_path / "e"))).collect() == []


def test_archives_are_plain_warc_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (40 + i % 5)) for i in range(200)]
    index = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), str(tmp_path / "w"))
    places = index.collect()
    files = sorted((tmp_path / "w" / "archives").iterdir())
    assert len(files) > 4 and {r["archive"] for r in places} == {f.name for f in files}
    for f in files:
        content = f.read_bytes()
        whole = gzip.decompress(content)
        assert whole.count(b"WARC/1.1\r\n") == 1 + sum(r["archive"] == f.name for r in places)
        assert whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        for r in (r for r in places if r["archive"] == f.name):
            found = warc.parse(gzip.decompress(content[r["offset"] : r["offset"] + r["length"]]))
            assert (found["page_id"], found["url"], found["payload_digest"]) == (r["page_id"], r["url"], r["payload_digest"])


def test_reads_are_sorted_and_joined():
    places = [("f", "a", 0, 10), ("f", "a", 10, 10), ("f", "a", 25, 5), ("f", "a", 100, 5), ("f", "b", 105, 5), ("f", "b", 110, 900), ("f", "b", 1010, 5)]
    assert [len(r) for r in warc._runs(places, 5, 905)] == [3, 1, 2, 1]
    assert [len(r) for r in warc._runs(places, 0, 10)] == [1, 1, 1, 1, 1, 1, 1]
    assert list(warc._runs([], 5, 10)) == []


def test_a_damaged_record_is_told():
    good = warc.record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None, "2020-01-01T00:00:00Z")
    assert warc.parse(good)["payload"] == b"abc"
    for bad in (good.replace(b"abc", b"abd"), good[:-3], b"XARC" + good[4:]):
        with pytest.raises(ValueError):
            warc.parse(bad)


# --- whitening


def plain_whitening(rows):
    """Per id: deviation and whitened values up to sign; shares."""
    c = np.array([v for _, v in rows], float)
    x = np.floor(1024 * c).astype(np.int64) + 100_000
    n, total = len(x), x.sum(0)
    y = x - total / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    exact = ((n * x.astype(object) - total) ** 2).sum(1)
    return exact, y @ vectors / np.sqrt(values), values / np.trace(y.T @ y / n)


def by_row(got, k):
    found = {}
    for r in got:
        found.setdefault(r["vec_id"], [None] * k)[r["component"] - 1] = r["whitened"]
    return found


def test_whitening_is_that_of_plain_numpy(spark):
    rng = np.random.default_rng(2)
    mix = rng.normal(size=(12, 12)) * np.linspace(0.2, 3, 12)
    rows = [(i, [float(e) for e in v]) for i, v in enumerate(rng.normal(size=(400, 12)) @ mix + 5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    got = whitening.whiten(table).collect()
    exact, white, share = plain_whitening(rows)
    assert len(got) == 400 * 8 and {r["n"] for r in got} == {400}
    assert all(r["deviation"] == exact[r["vec_id"]] == r["deviation_exact"] for r in got)
    found = np.array([by_row(got, 8)[i] for i in range(400)])
    sign = np.sign((found * white).sum(0))
    assert np.abs(found * sign - white).max() < 1e-9
    assert all(abs(r["explained"] / share[r["component"] - 1] - 1) < 1e-9 and r["identity_error"] < 1e-9 for r in got)


@pytest.mark.parametrize("size", [1.0, 3e7, 2.0**45])
def test_sums_of_squares_are_exact(spark, size):
    rng = np.random.default_rng(4)
    rows = [(i, [float(e) for e in v]) for i, v in enumerate(size * rng.normal(size=(50, 3)))]
    x = whitening.fixed_point(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    ints = np.array([[math.floor(1024 * e) + 100_000 for e in v] for _, v in rows], object)
    fit = whitening.fit(x)[3]
    assert (fit.n, fit.total) == (50, ints.sum(0).tolist())
    z = 50 * ints - ints.sum(0)
    cov = np.array([[float(sum(a * b for a, b in zip(z[:, i], z[:, j]))) / 50**3 for j in range(3)] for i in range(3)])
    values, vectors = np.linalg.eigh(cov)
    assert np.abs(fit.values / values[::-1] - 1).max() < 1e-12
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = (z**2).sum(1)
    assert all(int(r["deviation_exact"]) == want[r["vec_id"]] for r in got)
    assert all(r["deviation"] == (want[r["vec_id"]] if want[r["vec_id"]] < 1 << 63 else None) for r in got)
    assert {round(r["identity_error"], 9) for r in got} == {0}


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.5, 1.0]), (2, [1.5, 1.0]), (2, [1.5, 1.0]), (None, [2.5, 1.0]), (3, None), (4, [1.0, None]), (5, [nan, 1.0])]
    rows += [(6, [inf, 0.0]), (7, []), (8, [1.0, 2.0, 3.0]), (9, [-0.3] * 9)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    table = table.withColumns({"n": F.lit("x"), "dim": F.lit(1), "x": F.lit(2), "component": F.lit(3), "whitened": F.lit(None)})
    got = whitening.whiten(table).collect()
    assert Counter(r["vec_id"] for r in got) == {1: 2, 2: 4, None: 2, 8: 3, 9: 8}
    two = [r for r in got if r["vec_id"] in (1, 2, None)]
    assert {r["n"] for r in two} == {4} and [r["deviation"] for r in two if r["vec_id"] == 1][0] == (4 * 512 - (512 + 1536 * 2 + 2560)) ** 2
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in two)
    assert sum(r["whitened"] ** 2 for r in two if r["component"] == 1) == pytest.approx(4)
    assert all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 for r in got if r["vec_id"] in (8, 9))
    assert whitening.whiten(table.limit(0)).collect() == [] and whitening.whiten(table.where("vec_id = 7")).collect() == []
    with pytest.raises(Exception, match="out of range"):
        whitening.whiten(spark.createDataFrame([(1, [1e300])], "vec_id long, embedding array<double>")).collect()


@mounted
def test_whitening_of_the_given_vectors(spark):
    got = whitening.whitening_query(spark, SF_DIR).collect()
    vectors = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    ok = [(r["vec_id"], r["embedding"]) for r in vectors if r["embedding"] is not None and all(e is not None and math.isfinite(e) for e in r["embedding"])]
    exact, white, share = plain_whitening(ok)
    found = by_row(got, 8)
    assert sorted(found) == sorted(i for i, _ in ok)
    found = np.array([found[i] for i, _ in ok])
    assert np.abs(found * np.sign((found * white).sum(0)) - white).max() < 1e-8
    deviations = {r["vec_id"]: r["deviation"] for r in got}
    assert [deviations[i] for i, _ in ok] == exact.tolist()
    assert max(r["identity_error"] for r in got) < 1e-9
