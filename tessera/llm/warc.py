"""WARC archives: write records with an index first, then read selected records by coalesced byte ranges.

Every record is a gzip member of its own. While a task writes its archives it emits the index: file, offset,
length, URL and digest per record. Readers take index rows sorted by file and offset, join neighbouring ranges
into one read, and parse the members out of it.

Nulls: null html is an empty payload, a null url an empty target URI; a null page_id is written without its
header and comes back null. A null id never becomes the response of a group that has another id. Rows with the
same page_id and payload are all responses if that id is the group's largest. An empty table gives no archive
and an empty result. A payload of any size is one record. Only page_id, url and html are read, whatever other columns are called.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import _arrow_schema, new_path, open_fs, steps, store

#: Payloads below so many bytes are never written as revisits.
LEAST_REVISIT = 1000
#: Up to so many repeated digests are sent to all executors (about 100 bytes each); more are joined by a shuffle.
BROADCAST_REPEATED = 200_000
#: An archive is closed beyond so many bytes; one read spans at most SPAN bytes and skips gaps of up to GAP.
ARCHIVE, SPAN, GAP = 256 << 20, 8 << 20, 64 << 10
INDEX = "page_id long, url string, digest string, record_type string, file string, offset long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_DATE = "2020-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def _header_value(text: str) -> str:
    return re.sub(r"[\r\n]+", " ", text)


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple[bytes, str]:
    """A gzip member with a response or, where refers_to is given, a revisit record; and the payload's SHA-1 in hex."""
    sha1 = hashlib.sha1(payload, usedforsecurity=False)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {_header_value(url or '')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1.digest()).decode()}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    head = "\r\n".join(lines).encode() + b"\r\n\r\n"
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush(), sha1.hexdigest()


def decode_record(member: bytes) -> dict[str, object]:
    """Parse one gzip member; a response's payload is checked against its digest."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload, usedforsecurity=False).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']}: the payload does not match its digest")
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("X-Page-ID"),
        "url": fields["WARC-Target-URI"],
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": number("X-Refers-To-Page-ID"),
        "payload": payload if kind == "response" else None,
    }


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html, refers_to: which records are revisits, and of which response. Only digests and ids are grouped; payloads
    meet the few digests that repeat where they are, unless those are too many to send."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    large = F.octet_length("html") >= LEAST_REVISIT
    key = F.sha2("html", 256)
    groups = rows.filter(large).select(key.alias("key"), "page_id").groupBy("key").agg(F.max("page_id").alias("largest"), F.count("*").alias("n"))
    repeated = store(groups.filter("n > 1 and largest is not null").select("key", "largest"), "warc-repeated")
    if repeated.count() <= BROADCAST_REPEATED:
        repeated = F.broadcast(repeated)
    joined = rows.filter(large).withColumn("key", key).join(repeated, "key", "left")
    revisit = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    joined = joined.select("page_id", "url", "html", F.when(revisit, F.col("largest")).alias("refers_to"))
    return joined.union(rows.filter(~large).select("page_id", "url", "html", F.lit(None).cast("long")))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write (page_id, url, html, refers_to) into archives below folder and return the stored index."""
    fields = _arrow_schema(records.sparkSession, INDEX)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, top = open_fs(folder)
        filesystem.create_dir(top, recursive=True)
        task = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        out, name, offset, count = None, "", 0, 0
        for batch in steps(batches):
            rows = []
            for page, url, html, refers in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if out is None:
                    name, offset, count = f"{task}-{count:04d}.warc.gz", 0, count + 1
                    out = filesystem.open_output_stream(f"{top}/{name}", compression=None)
                member, digest = encode_record(page, url, html.encode(), refers)
                out.write(member)
                rows.append((page, url, digest, "response" if refers is None else "revisit", name, offset, len(member)))
                offset += len(member)
                if offset >= ARCHIVE:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)
        if out is not None:
            out.close()

    return store(records.select("page_id", "url", "html", "refers_to").mapInArrow(write, INDEX), "warc-index")


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Read the records of the given index rows; neighbouring ranges of a file are read at once."""
    fields = _arrow_schema(index.sparkSession, RECORD)
    wanted = index.select("file", "offset", "length")
    parts = max(1, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    wanted = wanted.repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        file, run = "", []
        for batch in batches:
            for f, o, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                last = run[-1][0] + run[-1][1] if run else 0
                if run and (f != file or o - last > GAP or o + n - run[0][0] > SPAN):
                    yield file, run
                    run = []
                file = f
                run.append((o, n))
        if run:
            yield file, run

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, top = open_fs(folder)
        handle, at = None, ""
        for file, run in spans(batches):
            if file != at:
                if handle:
                    handle.close()
                handle, at = filesystem.open_input_file(f"{top}/{file}"), file
            start = run[0][0]
            data = handle.read_at(run[-1][0] + run[-1][1] - start, start)
            rows = [decode_record(data[o - start : o - start + n]) for o, n in run]
            if not payloads:
                rows = [r | {"payload": None} for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in fields], schema=fields)
        if handle:
            handle.close()

    return wanted.mapInArrow(read, RECORD)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    index = write_archives(plan_records(spark.read.parquet(f"{sf_dir}/pages.parquet")), folder)
    back = read_records(index, folder, payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, strlen(html) AS n, sha1(html) AS digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS largest FROM s)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> largest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> largest THEN largest END AS refers_to
FROM m
"""
