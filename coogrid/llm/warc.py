"""WARC archives with an index that is written first.

Records are gzip members of their own, so any of them can be read alone by its offset
and length.  Writing returns one index row per record (archive, offset, length, URL,
digest); reading starts from chosen index rows, sorts them by place, and joins byte
ranges that lie close together into one read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import materialize, scratch_path
from ..plans.skew import BROADCAST_KEYS
from .common import slices

#: Payloads from this size on are stored once; smaller ones always whole.
LEAST_BYTES = 1000
#: An archive is closed when it is this long.
ARCHIVE_BYTES = 1 << 30
#: Byte ranges with at most this gap become one read, reads end beyond this size, a reading task gets about so much.
GAP_BYTES, READ_BYTES, TASK_BYTES = 1 << 16, 1 << 23, 1 << 26
LEVEL = 6

_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7f<>]")
_INDEX = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("record_type", pa.string())]
    + [("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
)
_INDEX_SQL = "page_id long, url string, payload_digest string, record_type string, archive string, offset long, length long"


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_id(record_id: str) -> int | None:
    number = record_id.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, date: str) -> bytes:
    """One WARC 1.1 record: a response with its payload, or a revisit that has the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id)}"]
    lines.append(f"WARC-Date: {date}")
    if url is not None:
        # A line end or blank in a URL would break the header.
        lines.append("WARC-Target-URI: " + _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode())
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-Profile: {_REVISIT}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(content: bytes) -> dict:
    """``page_id, url, payload (None in a revisit), payload_bytes, payload_digest, record_type, refers_to`` of a record.

    Lengths and the digest of a stored payload are checked against the headers.
    """
    head, _, rest = content.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if not version.startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"not a whole WARC record: {fields.get('WARC-Record-ID')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not agree with its digest")
    return {
        "page_id": _page_id(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "payload": None if revisit else payload,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": _page_id(fields["WARC-Refers-To"]) if revisit else None,
    }


class _Archive:
    """An archive being written; its name belongs to one attempt of one task."""

    def __init__(self, folder: str, date: str):
        self.name = f"{uuid.uuid4().hex}.warc.gz"
        where, path = fs.FileSystem.from_uri(f"{folder}/{self.name}")
        self.out, self.at = where.open_output_stream(path, compression=None), 0
        note = b"software: coogrid\r\nformat: WARC File Format 1.1\r\n"
        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\n"
        head += f"Content-Type: application/warc-fields\r\nContent-Length: {len(note)}\r\n\r\n"
        self.add(head.encode() + note + b"\r\n\r\n")

    def add(self, content: bytes) -> tuple[int, int]:
        """Offset and length of the new member."""
        pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 16 + zlib.MAX_WBITS)
        member = pack.compress(content) + pack.flush()
        self.out.write(member)
        self.at += len(member)
        return self.at - len(member), len(member)


def classify(pages: DataFrame, payload: str = "html") -> DataFrame:
    """``page_id, url, body, sha1, refers_to``: which stored page a page repeats, null for those stored whole.

    Of equal payloads of ``LEAST_BYTES`` or more the one with the largest id is
    stored.  Payloads are equal when length, SHA-256 and SHA-1 are; counts per payload
    combine map-side, so a page with very many copies shuffles one row per task.  Only
    payloads that repeat are joined back: broadcast while they are few, otherwise
    joined on the digest, unique there, so adaptive execution can split a page with
    many copies.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    url = F.col("url").cast("string").alias("url")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url, body.alias("body"))
    rows = rows.withColumn("sha1", F.sha1("body"))
    large = F.octet_length("body") >= LEAST_BYTES
    key = F.when(large, F.concat("sha1", F.sha2("body", 256), F.octet_length("body").cast("string")))
    keyed = rows.withColumn("key", key)
    counted = keyed.where(large).groupBy("key").agg(F.count("*").alias("n"), F.max("page_id").alias("stored"))
    repeats = materialize(counted.where("n > 1 AND stored IS NOT NULL").select("key", "stored"))
    few = F.broadcast(repeats) if repeats.count() <= BROADCAST_KEYS else repeats
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("stored")), F.col("stored"))
    return keyed.join(few, "key", "left").select("page_id", "url", "body", "sha1", refers.alias("refers_to"))


def write_warc(pages: DataFrame, folder: str | None = None, payload: str = "html", date: str | None = None) -> DataFrame:
    """Write every row of ``pages`` as a record, and return the index, kept as Parquet in ``<folder>/index``.

    Index rows: ``page_id, url, payload_digest, record_type, archive, offset, length``;
    the archives are in ``<folder>/archives``, one or more per task.  A null payload is
    empty, a null URL has no header, a null id never is a stored page that others refer
    to (where only null ids share a payload, all are stored).  Rows that repeat the
    stored id with its payload are stored again.  Other columns are not read.

    A task that is run again writes archives of other names; the index, which Spark
    commits, names only those of the attempt that counted.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    archives = f"{folder}/archives"
    where, path = fs.FileSystem.from_uri(archives)
    where.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for part in slices(batches):
            rows = []
            for page_id, url, body, sha1, refers_to in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if archive is None or archive.at >= ARCHIVE_BYTES:
                    if archive:
                        archive.out.close()
                    archive = _Archive(archives, date)
                at, length = archive.add(record(page_id, url, body, sha1, refers_to, date))
                rows.append((page_id, url, sha1, "response" if refers_to is None else "revisit", archive.name, at, length))
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _INDEX.types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=_INDEX)
        if archive:
            archive.out.close()

    index = f"{folder}/index"
    classify(pages, payload).mapInArrow(write, _INDEX_SQL).write.mode("overwrite").parquet(index)
    return spark.read.schema(_INDEX_SQL).parquet(index).withColumn("folder", F.lit(archives))


def _runs(places: list[tuple], gap: int, most: int) -> Iterator[list[tuple]]:
    """Sorted (folder, archive, offset, length) cut where the next one is far away, or a read would grow too long."""
    run: list[tuple] = []
    for place in places:
        if run:
            first, last = run[0], run[-1]
            apart = place[:2] != last[:2] or place[2] - (last[2] + last[3]) > gap
            if apart or place[2] + place[3] - first[2] > most:
                yield run
                run = []
        run.append(place)
    if run:
        yield run


_RECORDS = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64())]
    + [("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
)
_RECORDS_SQL = (
    "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
)


def read_warc(index: DataFrame, payloads: bool = True, gap: int = GAP_BYTES, most: int = READ_BYTES) -> DataFrame:
    """The records that the rows of ``index`` name: ``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to``.

    ``index`` is any selection of rows of :func:`write_warc`'s.  Rows are dealt to
    tasks by place, about ``TASK_BYTES`` of archive each, and sorted there; ranges that
    lie within ``gap`` bytes are read at once, up to ``most`` bytes.  Every record is
    checked against its own headers.  A revisit has no payload (null) but its length
    and digest; ``payloads=False`` leaves all payloads out.
    """
    places = index.select("folder", "archive", "offset", "length")
    total = places.agg(F.sum("length")).first()[0] or 0
    laid = places.repartitionByRange(max(1, -(-total // TASK_BYTES)), "folder", "archive", "offset")
    laid = laid.sortWithinPartitions("folder", "archive", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, file = None, None
        for part in slices(batches, 4096):
            for run in _runs(list(zip(*(c.to_pylist() for c in part.columns), strict=True)), gap, most):
                if run[0][:2] != place:
                    place = run[0][:2]
                    where, path = fs.FileSystem.from_uri("/".join(place))
                    file = where.open_input_file(path)
                start, end = run[0][2], run[-1][2] + run[-1][3]
                content = file.read_at(end - start, start)
                rows = [parse(zlib.decompress(content[a - start : a - start + n], 16 + zlib.MAX_WBITS)) for _, _, a, n in run]
                for r in rows if not payloads else ():
                    r["payload"] = None
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)

    return laid.mapInArrow(read, _RECORDS_SQL)


def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back."""
    index = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_warc(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
r AS (SELECT h, max(page_id) AS stored FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM stored AND stored IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM stored THEN stored END AS refers_to
FROM p LEFT JOIN r USING (h)
"""
