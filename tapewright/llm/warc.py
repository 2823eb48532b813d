"""Deterministic WARC archives: sorted, rolled by compressed size, committed by renames and a manifest.

    <path>/data/part-SSSSS-NNNNN.warc.gz   records, each a gzip member of its own
    <path>/manifest                        one row a file: name, records, bytes, sha256, first and last page

Every record's header is made anew from the page: ids are derived from id and payload, the date is a parameter,
digests are computed. A task writes each file under a temporary name of its own attempt and renames it when it is
complete; a repeated attempt gives the same bytes under the same name. Files count once the manifest, written
last, names them.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.session import materialize

REVISIT_BYTES = 1000
ROLL_BYTES = 128 * 1024 * 1024
PAYLOAD_BYTES_PER_SHARD = 256 * 1024 * 1024
DATE = "2000-01-01T00:00:00Z"
LEVEL = 6
READ_BYTES = 1 << 20

# The format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_MANIFEST = "shard int, name string, records long, bytes long, sha256 string, first_page long, last_page long"
_RECORDS = "page_id long, url string, record_type string, record_id string, refers_to_id string, payload_digest string, payload binary"


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def record_id(page_id: int | None, sha1: str, url: str) -> str:
    """The same for the same page, payload and URL, in any run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{sha1}/{url}')}>"


def _digest(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def _printable(url: str) -> str:
    """Controls and blanks percent-encoded: a header is one line."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: tuple[int | None, str] | None, date: str = DATE) -> bytes:
    """One record, not yet compressed: a response, or a revisit of the page and record id in ``refers_to``.

    A page id of None and a missing URL leave their headers out.
    """
    sha1 = hashlib.sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = [
        ("WARC-Type", "revisit" if refers_to else "response"),
        ("WARC-Record-ID", record_id(page_id, sha1.hexdigest(), url or "")),
        ("WARC-Date", date),
        ("WARC-Target-URI", _printable(url) if url else None),
        ("WARC-Page-ID", None if page_id is None else str(page_id)),
        ("WARC-Profile", PROFILE if refers_to else None),
        ("WARC-Refers-To", refers_to[1] if refers_to else None),
        ("WARC-Payload-Digest", _digest(sha1.digest())),
        ("WARC-Block-Digest", _digest(hashlib.sha1(block).digest())),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head if v is not None)
    return f"{VERSION}\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def _info(name: str, date: str) -> bytes:
    block = b"software: tapewright\r\nformat: WARC File Format 1.1\r\n"
    return (
        f"{VERSION}\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>\r\n"
        f"WARC-Date: {date}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    ).encode() + block + b"\r\n\r\n"


class _File:
    """One archive file under its temporary name."""

    def __init__(self, fs: pafs.FileSystem, folder: str, name: str, attempt: int, date: str) -> None:
        self.fs, self.name, self.final, self.temporary = fs, name, f"{folder}/{name}", f"{folder}/_{name}.{attempt}.tmp"
        self.out = fs.open_output_stream(self.temporary, compression=None)
        self.sha256, self.bytes, self.records, self.pages = hashlib.sha256(), 0, 0, []
        self._write(_info(name, date))

    def _write(self, data: bytes) -> None:
        member = gzip.compress(data, LEVEL, mtime=0)
        self.out.write(member)
        self.sha256.update(member)
        self.bytes += len(member)

    def add(self, page_id: int | None, data: bytes) -> None:
        self._write(data)
        self.records += 1
        self.pages = [self.pages[0] if self.pages else page_id, page_id]

    def commit(self, shard: int) -> pa.RecordBatch:
        self.out.close()
        self.fs.move(self.temporary, self.final)
        values = [shard, self.name, self.records, self.bytes, self.sha256.hexdigest(), *self.pages]
        types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], [c.split()[0] for c in _MANIFEST.split(", ")])


def _write_shard(batches: Iterator[pa.RecordBatch], path: str, roll_bytes: int, date: str) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    shard, attempt = (task.partitionId(), task.taskAttemptId()) if task else (0, 0)
    fs, folder = _filesystem(f"{path}/data")
    fs.create_dir(folder, recursive=True)
    held, nth = None, 0
    for batch in batches:
        for row in batch.to_pylist():
            if held is None:
                held, nth = _File(fs, folder, f"part-{shard:05d}-{nth:05d}.warc.gz", attempt, date), nth + 1
            refers_to = (row["refers_to"], record_id(row["refers_to"], row["digest"], row["refers_to_url"] or "")) if row["is_revisit"] else None
            held.add(row["page_id"], record(row["page_id"], row["url"], row["payload"], refers_to, date))
            if held.bytes >= roll_bytes:
                yield held.commit(shard)
                held = None
    if held is not None:
        yield held.commit(shard)


def revisits(pages: DataFrame) -> DataFrame:
    """The rows of ``pages`` that revisit another: page_id, digest, bytes, refers_to and the URL of that page.

    Of equal payloads of at least ``REVISIT_BYTES`` bytes the largest page id is the response. Rows with that id
    are all responses, and so are rows without an id among themselves, as no header could name them.
    """
    long = pages.filter(F.col("bytes") >= REVISIT_BYTES).select("page_id", "url", "digest", "bytes")
    named = F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("last")
    last = long.groupBy("digest", "bytes").agg(named, F.count(F.lit(1)).alias("n")).filter("n > 1 and last is not null")
    return (
        long.join(last, ["digest", "bytes"]).filter(~F.col("page_id").eqNullSafe(F.col("last.page_id")))
        .groupBy(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"))
        .agg(F.first("last.page_id").alias("refers_to"), F.first("last.url").alias("refers_to_url"))
    )


def write_archive(
    pages: DataFrame, path: str, roll_bytes: int = ROLL_BYTES, date: str = DATE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> None:
    """One record per row of ``pages`` below ``path``, a folder all machines reach, in ascending order of the page id.

    A null html is an empty payload; null ids come first and null URLs have no target header. Rows that repeat
    an id are ordered by digest and URL; rows alike in all of them are records of equal content. An empty table
    writes an empty manifest.
    """
    payload = F.coalesce(pages[html_col].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    known = materialize(revisits(rows), "warc-revisits")
    marked = rows.join(known, rows["page_id"].eqNullSafe(known["r_page"]) & (rows["digest"] == known["r_digest"]), "left")
    marked = marked.select("page_id", "url", "payload", "digest", "refers_to", "refers_to_url", F.col("r_digest").isNotNull().alias("is_revisit"))
    size = rows.agg(F.sum("bytes")).first()[0] or 0
    shards = max(8, math.ceil(size / PAYLOAD_BYTES_PER_SHARD))
    ordered = marked.repartitionByRange(shards, "page_id", "digest", "url").sortWithinPartitions("page_id", "digest", "url")
    ordered.mapInArrow(lambda batches: _write_shard(batches, path, roll_bytes, date), _MANIFEST).write.parquet(f"{path}/manifest")


def records(stream, read_bytes: int = READ_BYTES) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one at a time."""
    inflate, out = zlib.decompressobj(wbits=31), []
    while data := stream.read(read_bytes):
        while data:
            out.append(inflate.decompress(data))
            if not inflate.eof:
                break
            yield b"".join(out)
            data, inflate, out = inflate.unused_data, zlib.decompressobj(wbits=31), []
    if out:
        raise ValueError("the file ends within a record")


def parse(data: bytes) -> dict[str, object]:
    """Headers by lower-case name, and under ``payload`` what follows the HTTP header of the block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"not a record: {lines[0][:40]}")
    found: dict[str, object] = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
    block = rest[: int(found["content-length"])]
    if "warc-block-digest" in found and found["warc-block-digest"] != _digest(hashlib.sha1(block).digest()):
        raise ValueError(f"damaged block in {found['warc-record-id']}")
    found["payload"] = block.partition(b"\r\n\r\n")[2]
    return found


def _read_files(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    fs, folder = _filesystem(f"{path}/data")
    names = [c.split()[0] for c in _RECORDS.split(", ")]
    schema = pa.schema([pa.field(n, pa.int64() if n == "page_id" else pa.binary() if n == "payload" else pa.string()) for n in names])
    for batch in batches:
        for name, expected in zip(batch.column("name").to_pylist(), batch.column("records").to_pylist()):
            rows, filled, seen = [], 0, 0
            with fs.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                for r in map(parse, records(stream)):
                    if r["warc-type"] == "warcinfo":
                        continue
                    page = r.get("warc-page-id")
                    digest = base64.b32decode(str(r["warc-payload-digest"]).removeprefix("sha1:")).hex()
                    rows.append(
                        {
                            "page_id": None if page is None else int(page), "url": r.get("warc-target-uri"), "record_type": r["warc-type"],
                            "record_id": r["warc-record-id"], "refers_to_id": r.get("warc-refers-to"), "payload_digest": digest,
                            "payload": r["payload"] if r["warc-type"] == "response" else None,
                        }
                    )
                    filled, seen = filled + len(r["payload"]), seen + 1
                    if filled >= 8 * READ_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, filled = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
            if seen != expected:
                raise ValueError(f"{name} has {seen} records, the manifest says {expected}")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per response and revisit of the files in the manifest; block digests and record counts are verified.

    page_id, url, record_type, record_id, refers_to_id, payload_digest (hex), payload (null for a revisit).
    """
    files = spark.read.parquet(f"{path}/manifest").select("name", "records")
    # A file a task: files are large, their names are not.
    spread = files.repartition(max(1, files.count()), "name")
    return spread.mapInArrow(lambda batches: _read_files(batches, path), _RECORDS)


def resolved(archive: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (page id): revisits take theirs from the response."""
    rows = archive.select(
        "page_id", "record_type", "record_id", "refers_to_id", F.octet_length("payload").cast("long").alias("bytes"),
        F.when(F.col("payload").isNotNull(), F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
    )
    rows = materialize(rows, "warc-records")
    again = rows.filter("record_type = 'revisit'")
    targets = rows.filter("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id")).agg(
        F.first("page_id").alias("refers_to"), F.first("bytes").alias("payload_bytes")
    )
    first = rows.filter("record_type = 'response'").select(
        "page_id", F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")
    )
    return first.unionByName(again.join(targets, "refers_to_id").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
