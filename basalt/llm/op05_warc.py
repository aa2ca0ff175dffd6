"""WARC archives: writing them, reading them back, and assembling transactions.

Each page becomes three WARC/1.1 records: a request, a response (or, for a payload that another page's response holds
already, a revisit) and a metadata record; request and metadata name the capture by WARC-Concurrent-To.  Archives are
written by Spark's own writer (gzip files of concatenated records), so any store that Spark writes to will do.  Reading
parses records by their Content-Length, recomputes the payload digest, and joins request and metadata to the capture
through the concurrent-to identifiers: one nested row per capture.

Of pages with equal payloads (at least ``revisit_bytes`` long) that with the largest page_id is the response, the
others revisit it: their WARC-Refers-To is the response's record identifier, which is made of page_id and payload, and
which reading resolves by a join.  Rows that repeat both page_id and payload are all responses; their identifiers
differ by a copy number after the one they share, by which they are referred to.  Null html: an empty payload.  A null
page_id is smaller than any other, and among its equals with no other all are responses.  Null url: an empty target.
Line ends in a url are percent-encoded.  Empty table: no archives, no rows.  Payloads of any length are written whole.
An archive holds about ``archive_bytes`` before compression, or one longer page.  Further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_dir, table, written

DATE = "2024-01-01T00:00:00Z"
COPY = "/copy-"
RECORD = "archive string, record_id string, type string, concurrent_to string, refers_to string, target_uri string, payload_digest string, block_bytes long, payload_bytes long, digest_ok boolean, fields map<string,string>"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Date", DATE), *headers, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block


def identifier(page_id: int | None, digest: str) -> str:
    """The name of the capture of a page with that payload."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}"


def transaction(page_id: int | None, url: str, html: str, first: int | None, revisit: bool, copy: int | None) -> bytes:
    """The three records of a page, without the last record's closing line ends; copy: tells repeated rows apart."""
    payload = html.encode()
    digest = base32_sha1(payload)
    me = identifier(page_id, digest) + ("" if copy is None else f"{COPY}{copy}")
    url = url.replace("\r", "%0D").replace("\n", "%0A")
    target = [("WARC-Target-URI", url)]
    host, _, path = url.partition("://")[2].partition("/")
    capture = f"<{me}>"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    own = [("WARC-Record-ID", capture), *target, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        main = record("revisit", [*own, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{identifier(first, digest)}>")], head)
    else:
        main = record("response", own, head + payload)
    about = [("WARC-Concurrent-To", capture), *target]
    ask = record("request", [("WARC-Record-ID", f"<{me}/request>"), *about, ("Content-Type", "application/http; msgtype=request")], f"GET /{path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode())
    meta = record("metadata", [("WARC-Record-ID", f"<{me}/metadata>"), *about, ("Content-Type", "application/warc-fields")], f"pageId: {'' if page_id is None else page_id}\r\npayloadLength: {len(payload)}\r\n".encode())
    return b"\r\n\r\n".join([ask, main, meta])


def write_warc(pages: DataFrame, path: str, revisit_bytes: int = 0, archive_bytes: int = 256 << 20) -> None:
    """Writes pages (page_id, url, html) as gzipped WARC files below path."""
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.sha2(F.col("html"), 256))
    slim = rows.groupBy("key", "page_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("html") >= revisit_bytes).alias("long"))
    slim = written(slim.where("page_id IS NOT NULL OR n > 1"), "page-keys")
    firsts = slim.where("long").groupBy("key").agg(F.max("page_id").alias("first")).where("first IS NOT NULL")
    again = slim.where("n > 1").select("key", F.col("page_id").alias("again_id"), F.lit(True).alias("again"))
    # plain equi-joins, whose hot keys Spark splits
    rows = rows.join(firsts, "key", "left").join(again.withColumnRenamed("key", "again_key"), F.expr("key = again_key AND page_id <=> again_id"), "left")
    rows = rows.select("page_id", "url", "html", "first", F.coalesce("again", F.lit(False)).alias("again"))
    part = min(archive_bytes, 8 << 20)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, out, size = TaskContext.get().partitionId() << 40, [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                page, url, html, first, again = (batch.column(c)[i].as_py() for c in range(5))
                out.append(transaction(page, url, html, first, first is not None and page != first, number if again else None).decode())
                number, size = number + 1, size + len(out[-1])
                if size >= part:
                    yield pa.RecordBatch.from_pydict({"value": pa.array(["\r\n\r\n".join(out)], pa.string())})
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pydict({"value": pa.array(["\r\n\r\n".join(out)], pa.string())})

    lines = rows.mapInArrow(work, "value string").write.option("maxRecordsPerFile", max(1, archive_bytes // part))
    lines.option("compression", "gzip").option("lineSep", "\r\n\r\n").text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed stream."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError(f"record {headers.get('warc-record-id')} ends early")
        yield headers, block


def read_warc(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """A row per record of the archives below path; payload: with a column of the HTTP payload."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                raw = content.as_buffer()
                stream = io.BufferedReader(gzip.GzipFile(fileobj=pa.BufferReader(raw)) if raw[:2].to_pybytes() == b"\x1f\x8b" else pa.BufferReader(raw), 1 << 20)
                rows, held = [], 0
                for headers, block in parse(stream):
                    rows.append(row(name, headers, block))
                    held += len(block) if payload else 200
                    if held >= 4 << 20 or len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def row(name: str, headers: dict[str, str], block: bytes) -> dict:
        kind = headers.get("warc-type")
        body = block.partition(b"\r\n\r\n")[2] if kind in ("response", "request", "revisit") else b""
        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
        got = {"archive": name, "record_id": headers.get("warc-record-id"), "type": kind, "concurrent_to": headers.get("warc-concurrent-to"), "refers_to": headers.get("warc-refers-to"), "target_uri": headers.get("warc-target-uri"), "payload_digest": digest, "block_bytes": len(block)}
        got["payload_bytes"] = len(body) if kind == "response" else None
        got["digest_ok"] = base32_sha1(body) == digest if kind == "response" and digest else None
        got["fields"] = [tuple(x.strip() for x in line.partition(":")[::2]) for line in block.decode().splitlines() if line] if kind == "metadata" else None
        return got | ({"payload": body if kind == "response" else None} if payload else {})

    kinds = {"fields": pa.map_(pa.string(), pa.string()), "block_bytes": pa.int64(), "payload_bytes": pa.int64(), "digest_ok": pa.bool_()}
    names = [x.strip().split(" ")[0] for x in RECORD.replace("map<string,string>", "map").split(",")]
    schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names] + ([("payload", pa.binary())] if payload else []))
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(work, RECORD + (", payload binary" if payload else ""))


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: record, request, metadata (null where the archive lacks them).

    A record without identifier is passed over, as are requests and metadata of captures that are not there.
    """
    of = lambda kind: records.where(F.col("type") == kind).select(F.col("concurrent_to").alias(f"{kind}_to"), F.struct("record_id", "target_uri", "block_bytes", "fields").alias(kind))
    main = records.where(F.col("type").isin("response", "revisit") & F.col("record_id").isNotNull())
    main = main.select("record_id", F.struct("archive", "type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "digest_ok").alias("record"))
    return main.join(of("request"), F.col("record_id") == F.col("request_to"), "left").join(of("metadata"), F.col("record_id") == F.col("metadata_to"), "left").select("record_id", "record", "request", "metadata")


def resolved(found: DataFrame) -> DataFrame:
    """captures with response: the capture that a revisit refers to, by its record identifier (null: none, or not there)."""
    name = F.regexp_replace("record_id", f"{COPY}\\d+>$", ">")
    responses = found.where("record.type = 'response'").groupBy(name.alias("name")).agg(F.min_by(F.struct("record_id", "record", "metadata"), "record_id").alias("response"))
    responses = written(responses, "responses")
    # captures that refer to none are spread by names that none has; a hot name's captures are split by Spark
    wanted = F.coalesce(F.col("record.refers_to"), F.concat("record_id", F.lit("#")))
    return found.withColumn("wanted", wanted).join(responses, F.col("wanted") == F.col("name"), "left").drop("wanted", "name")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), path)
    got = resolved(captures(written(read_warc(spark, path), "warc-records")))
    page = lambda x: F.nullif(F.element_at(f"{x}.fields", "pageId"), F.lit("")).cast("long")
    digest = F.when(F.coalesce(F.col("record.digest_ok"), F.lit(True)), F.col("record.payload_digest"))
    return got.select(page("metadata").alias("page_id"), F.element_at("metadata.fields", "payloadLength").cast("long").alias("payload_bytes"), digest.alias("payload_digest"), F.col("record.type").alias("record_type"), page("response.metadata").alias("refers_to"))
