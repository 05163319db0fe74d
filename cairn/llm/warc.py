"""WARC archives through a chunked record table, written and read back in a stream.

A payload leaves the scan as rows ``(record, chunk, data)`` of at most
``chunk_bytes``; from there on no row, exchange or Arrow batch holds a whole
one. One walk over a record's rows carries the SHA-1 and the byte count so far,
so its digest stands on its last row. Archives are written from chunk rows
sorted by record and number, and read back as rows of the same shape; both
stream in fixed buffers.

Of records with equal payloads of ``least_bytes`` or more, that with the
largest id is a ``response``, the others are ``revisit`` records that name it;
smaller ones are all responses. Equality is by SHA-1. The largest id comes from
partial maxima by digest, and digests that very many pages share get it by
broadcast, so their rows are not gathered.

Archives are written under ``spark.checkpoint.dir``, by attempt, and only the
manifest that the finished tasks return names them: what lost or doubled tasks
leave behind is never read.

Defined cases: null html is an empty payload; a null url is ``urn:page:<id>``;
control characters and spaces in a url are percent-encoded; a null page_id gets
a record, is never referred to while an id exists, and returns null; rows that
share an id and a payload of ``least_bytes`` are each the response; every record
has a ``WARC-Record-ID`` of its own, of the id and a number; an empty table gives
an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import os
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm._store import fresh_path, materialise, small_batches, spread_join

CHUNK = 64 << 10
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


CHUNKED = "record long, page_id long, url string, chunk int, data binary, payload_bytes long, payload_digest string, last boolean"
CHUNKED_ARROW = pa.schema([("record", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("chunk", pa.int32()), ("data", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("last", pa.bool_())])


def chunk_table(pages: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """The payloads as rows of chunks; a record's last row has its digest and number of bytes."""
    small_batches(pages.sparkSession, 64)
    rows = pages.select(F.monotonically_increasing_id().alias("record"), F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.octet_length("html") / chunk_bytes).cast("int") - 1))
    cut = rows.select("*", F.explode(numbers).alias("chunk")).select("record", "page_id", "url", "chunk", F.expr(f"substring(html, chunk * {chunk_bytes} + 1, {chunk_bytes})").alias("data"), ((F.col("chunk") + 1) * chunk_bytes >= F.octet_length("html")).alias("last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running, seen = hashlib.sha1(), 0
        for batch in batches:
            sizes, digests = [], []
            for data, last in zip(batch.column("data"), batch.column("last").to_pylist(), strict=True):
                view = data.as_buffer()
                running.update(view)
                seen += len(view)
                sizes.append(seen)
                digests.append(running.hexdigest() if last else None)
                if last:
                    running, seen = hashlib.sha1(), 0
            columns = {"payload_bytes": pa.array(sizes, pa.int64()), "payload_digest": pa.array(digests, pa.string())}
            yield pa.RecordBatch.from_arrays([columns.get(f.name, batch.column(f.name) if f.name in batch.schema.names else None) for f in CHUNKED_ARROW], schema=CHUNKED_ARROW)

    return materialise(cut.mapInArrow(run, CHUNKED), "warc-chunks")


def plan_records(chunks: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """``record, payload_digest, payload_bytes, record_type, refers_to struct<page_id, record>`` of each record of ``chunk_table``; no payloads."""
    rows = chunks.filter("last").select("record", "page_id", "payload_digest", "payload_bytes")
    own = F.struct("page_id", "record")
    large = rows.filter(F.col("payload_bytes") >= least_bytes)
    winners = materialise(large.groupBy("payload_digest").agg(F.max(own).alias("winner"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "warc-winners")
    small = rows.filter(F.col("payload_bytes") < least_bytes).withColumn("winner", F.lit(None).cast("struct<page_id: bigint, record: bigint>"))
    both = spread_join(large, winners, "payload_digest", "n", "left").unionByName(small)
    revisit = F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner.page_id"))
    return both.select("record", "payload_digest", "payload_bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("winner")).alias("refers_to"))


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if re.match(r"\w+:", uri) else f"file://{os.path.abspath(uri)}")


def record_name(page_id: int | None, record: int) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{record}>"


def target(url: str | None, page_id: int | None) -> str:
    if not url:
        return f"urn:page:{'' if page_id is None else page_id}"
    return re.sub(r"[\x00-\x20\x7f-\x9f  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def header(record: int, page_id: int | None, url: str | None, kind: str, digest: str, size: int, refers_to: dict | None) -> bytes:
    """The record's header and, for a response, that of the HTTP message, up to the payload."""
    http = HTTP % size
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_name(page_id, record)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target(url, page_id)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"WARC-Payload-Length: {size}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_name(**refers_to)}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + (size if kind == 'response' else 0)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


def write_archives(chunks: DataFrame, records: DataFrame) -> DataFrame:
    """Writes one record for each of ``records``; the manifest ``path, records, bytes`` of the archives.

    Chunk rows are exchanged once, beside their plans; each partition of that
    exchange is an archive, gzipped record by record.
    """
    spark = chunks.sparkSession
    small_batches(spark, 64)
    plans = records.select("record", "record_type", "refers_to", F.col("payload_digest").alias("digest"), F.col("payload_bytes").alias("bytes"))
    rows = chunks.select("record", "page_id", "url", "chunk", "data", "last").join(plans.hint("shuffle_hash"), "record")
    # a revisit leaves without its payload
    rows = rows.filter((F.col("record_type") == "response") | F.col("last")).withColumn("data", F.when(F.col("record_type") == "response", F.col("data")))
    sorted_ = rows.sortWithinPartitions("record", "chunk").select("record", "page_id", "url", "record_type", "digest", "bytes", "refers_to", "last", "data")
    folder = fresh_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = _file_system(folder)
        fs.create_dir(root, recursive=True)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        n, member, at = 0, None, None
        with fs.open_output_stream(f"{root}/{name}") as out:
            for batch in batches:
                fields = list(zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True))
                for (record, *rest, last), data in zip(fields, batch.column(8), strict=True):
                    if record != at:
                        at, member = record, zlib.compressobj(6, zlib.DEFLATED, 31)
                        out.write(member.compress(header(record, *rest)))
                    if data.is_valid:
                        out.write(member.compress(data.as_buffer()))
                    if last:
                        out.write(member.compress(b"\r\n\r\n") + member.flush())
                        n += 1
            size = out.tell()
        yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": n, "bytes": size}], pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return materialise(sorted_.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


def _lines(stream: BinaryIO) -> Iterator[bytes]:
    while (line := stream.readline(64 << 10)) not in (b"\r\n", b""):
        yield line.rstrip(b"\r\n")


def read_records(stream: BinaryIO, chunk_bytes: int = CHUNK, data: bool = True) -> Iterator[dict]:
    """Chunk rows of an archive's records, in order.

    The running digest and size are those of the payload up to and with the
    row's chunk; ``last`` marks a record's end. A revisit has one row without
    data, that carries what its header says of the payload.
    """
    while first := stream.readline(1 << 10):
        if not first.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        fields = dict(line.decode().split(": ", 1) for line in _lines(stream))
        left, http = int(fields["Content-Length"]), 0
        for line in iter(lambda: stream.readline(64 << 10), b"\r\n"):
            http += len(line)
        left -= http + 2
        stated = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        row = {"record_id": fields["WARC-Record-ID"], "record_type": fields["WARC-Type"], "refers_to": fields.get("WARC-Refers-To"), "target": fields["WARC-Target-URI"]}
        if row["record_type"] == "revisit":
            yield row | {"chunk": 0, "data": b"", "payload_bytes": int(fields["WARC-Payload-Length"]), "payload_digest": stated, "last": True}
        else:
            running, seen, number = hashlib.sha1(), 0, 0
            while True:
                part = stream.read(min(chunk_bytes, left))
                if len(part) < min(chunk_bytes, left):
                    raise ValueError(f"{row['record_id']} is cut short")
                left -= len(part)
                seen += len(part)
                running.update(part)
                digest = running.hexdigest()
                if not left and digest != stated:
                    raise ValueError(f"{row['record_id']} differs from its digest")
                yield row | {"chunk": number, "data": part if data else None, "payload_bytes": seen, "payload_digest": digest, "last": not left}
                number += 1
                if not left:
                    break
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"{row['record_id']} lacks its end")


CHUNK_ROWS = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("target", pa.string()), ("chunk", pa.int64()), ("data", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("last", pa.bool_())])


def read_archives(manifest: DataFrame, chunk_bytes: int = CHUNK, data: bool = True) -> DataFrame:
    """The chunked record table of all archives; without ``data``, only digests are carried."""
    spark = manifest.sparkSession
    small_batches(spark, 64)
    files = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = _file_system(path)
                rows, held = [], 0
                with fs.open_input_stream(name) as raw, gzip.GzipFile(fileobj=raw) as plain, io.BufferedReader(plain, 1 << 20) as stream:
                    for row in read_records(stream, chunk_bytes, data):
                        rows.append(row)
                        held += len(row["data"] or b"") + 400
                        if held >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, CHUNK_ROWS)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, CHUNK_ROWS)

    return manifest.select("path").repartition(files).mapInArrow(run, "record_id string, record_type string, refers_to string, target string, chunk long, data binary, payload_bytes long, payload_digest string, last boolean")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    chunks = chunk_table(pages)
    manifest = write_archives(chunks, plan_records(chunks))
    ends = read_archives(manifest, data=False).filter("last")
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+):", 1).try_cast("long")
    return ends.select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"))


OP6_SQL = """
WITH page AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), win AS (SELECT payload_digest, max(page_id) AS winner FROM page WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> winner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> winner THEN winner END AS refers_to
FROM page LEFT JOIN win USING (payload_digest)
"""
