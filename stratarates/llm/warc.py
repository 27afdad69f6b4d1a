"""WARC archives: writing and sequential reading.

``write`` stores each row as one record in a gzip member of its own, many records to an
archive.  Payloads that occur several times are stored once; the others become revisit
records, which hold the HTTP header only and refer to the first.  ``read`` takes the
archives one by one: it inflates a member in small steps, cuts header and block by
``Content-Length``, and verifies both digests and that each member ends with its record.
A damaged archive raises; no record is skipped.

Which payload is first is found with an aggregation by digest (combined map-side, one row
per task for a digest that a third of all rows share) and a join that AQE may split.

Null html counts as empty.  A null url leaves out the target header and is read as null; a
null key is written without a number and read as null, and is never referred to unless all
rows of the payload have none.  Repeated rows give repeated records; rows that share the
smallest key are all responses.  An empty table gives no archive and no rows.  Other
columns are not stored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratarates.llm import scratch

ARCHIVE_BYTES = 64 << 20
STEP_BYTES = 256 << 10
REVISIT_FROM = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_KEY = "urn:key:"


def with_references(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
                    least: int = REVISIT_FROM) -> DataFrame:
    """(key, url, payload, digest, refers_to): refers_to is the smallest key with the same
    payload, null for that row itself and for payloads shorter than ``least`` bytes."""
    rows = pages.select(
        F.col(key).cast("long").alias("key"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    shared = (
        rows.where(F.octet_length("payload") >= least)
        .groupBy("digest")
        .agg(F.min("key").alias("first_key"), F.count("*").alias("copies"))
        .where((F.col("copies") > 1) & F.col("first_key").isNotNull())
        .drop("copies")
    )
    other = F.col("key").isNull() | (F.col("key") != F.col("first_key"))
    return rows.join(shared, "digest", "left").select(
        "key", "url", "payload", "digest", F.when(other, F.col("first_key")).alias("refers_to")
    )


def _record(key, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record: HTTP response with its body, or the response's header for a revisit."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_KEY}{'' if key is None else key}>",
        f"WARC-Date: {DATE}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {url}".replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_KEY}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _located(spark: SparkSession, folder: str) -> str:
    """``folder`` with scheme and host, as Spark's readers resolve it: a path without a scheme lies
    on the default file system, which on a cluster is not each executor's own disk."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder)


def write(pages: DataFrame, folder: str, level: int = 6, archive_bytes: int = ARCHIVE_BYTES,
          **names) -> DataFrame:
    """Write archives below ``folder`` and return their list (path, records, bytes).

    A task that is run again writes archives of other names; only those of the attempt
    that Spark accepted are in the list.  Paths have scheme and host, but for local files,
    which are plain paths.
    """
    rows = with_references(pages, **names)
    folder = _located(pages.sparkSession, folder.rstrip("/"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = _open_folder(folder)
        listed = top if isinstance(system, fs.LocalFileSystem) else folder
        part = TaskContext.get().partitionId()
        sink, name, records, size = None, "", 0, 0
        done = []

        def close():
            nonlocal sink
            if sink is not None:
                sink.close()
                done.append((name, records, size))
                sink = None

        for batch in batches:
            columns = [batch.column(c) for c in ("key", "url", "payload", "digest", "refers_to")]
            for i in range(batch.num_rows):
                if sink is None:
                    system.create_dir(top, recursive=True)
                    name = f"part-{part:05d}-{uuid.uuid4().hex}.warc.gz"
                    sink, records, size = system.open_output_stream(f"{top}/{name}", compression=None), 0, 0
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(_record(*(c[i].as_py() for c in columns))) + packer.flush()
                sink.write(member)
                records += 1
                size += len(member)
                if size >= archive_bytes:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{listed}/{d[0]}" for d in done]),
                 pa.array([d[1] for d in done], pa.int64()),
                 pa.array([d[2] for d in done], pa.int64())],
                names=["path", "records", "bytes"])

    made = rows.mapInArrow(run, "path string, records long, bytes long")
    return scratch.stage(made, "warc-list")


class _Member:
    """The inflated bytes of one gzip member, read in steps."""

    def __init__(self, source, rest: bytes):
        self.source, self.rest = source, rest
        self.inflate = zlib.decompressobj(31)
        self.ready = bytearray()

    def _more(self) -> bool:
        if self.inflate.eof:
            return False
        raw = self.inflate.unconsumed_tail or self.rest or self.source.read(STEP_BYTES)
        self.rest = b""
        if not raw:
            raise ValueError("archive ends within a record")
        self.ready += self.inflate.decompress(raw, STEP_BYTES)
        return True

    def line_block(self) -> bytes:
        """Up to and without the empty line."""
        while (at := self.ready.find(b"\r\n\r\n")) < 0:
            if not self._more():
                raise ValueError("record without an end of its header")
        out = bytes(self.ready[:at])
        del self.ready[:at + 4]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.ready and not self._more():
                raise ValueError("record shorter than its Content-Length")
            part = bytes(self.ready[:n])
            del self.ready[:n]
            n -= len(part)
            yield part

    def finish(self) -> bytes:
        """Check the record's end; the bytes behind the member."""
        if b"".join(self.take(4)) != b"\r\n\r\n":
            raise ValueError("record longer than its Content-Length")
        while self._more():
            pass
        if self.ready:
            raise ValueError("several records in one member")
        return self.inflate.unused_data


def _fields(block: bytes) -> dict[str, str]:
    lines = block.decode().split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def records(source, with_payload: bool = True) -> Iterator[dict]:
    """The records of an open archive, one after the other."""
    rest = b""
    while True:
        rest = rest or source.read(STEP_BYTES)
        if not rest:
            return
        member = _Member(source, rest)
        head = _fields(member.line_block())
        left = int(head["content-length"])
        block, payload = hashlib.sha256(), hashlib.sha256()
        kept, http, full = [], b"", None
        for part in member.take(left):
            block.update(part)
            if full is None:
                http += part
                if (at := http.find(b"\r\n\r\n")) < 0:
                    continue
                full = int(_fields(http[:at])["content-length"])
                part = http[at + 4:]
            payload.update(part)
            if with_payload:
                kept.append(part)
        rest = member.finish()
        digest = head["warc-payload-digest"].removeprefix("sha256:")
        revisit = head["warc-type"] == "revisit"
        if "sha256:" + block.hexdigest() != head["warc-block-digest"]:
            raise ValueError(f"wrong block digest: {head['warc-record-id']}")
        if not revisit and payload.hexdigest() != digest:
            raise ValueError(f"wrong payload digest: {head['warc-record-id']}")
        yield {
            "key": _number(head["warc-record-id"]),
            "url": head.get("warc-target-uri"),
            "record_type": head["warc-type"],
            "payload_bytes": full,
            "payload_digest": digest,
            "refers_to": _number(head["warc-refers-to"]) if revisit else None,
            "payload": b"".join(kept) if with_payload and not revisit else None,
        }


def _number(uri: str) -> int | None:
    text = uri.strip("<>").removeprefix(_KEY)
    return int(text) if text else None


_READ = pa.schema([("key", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                   ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                   ("refers_to", pa.int64()), ("payload", pa.binary())])


def read(archives: DataFrame, with_payload: bool = True, tasks: int | None = None) -> DataFrame:
    """The records of the archives listed in column ``path``: (key, url, record_type,
    payload_bytes, payload_digest, refers_to, payload).  The payload of a revisit is null,
    its length and digest are those of the full payload.  An archive is one task's work and
    is bounded by the size at which ``write`` begins the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, name = _open_folder(path)
                with system.open_input_stream(name, compression=None) as source:
                    held, size = [], 0
                    for record in records(source, with_payload):
                        held.append(record)
                        size += 200 + len(record["payload"] or b"")
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=_READ)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=_READ)

    # a number of its own: a short list of paths would else be put into one task
    paths = archives.select("path").repartition(tasks or max(1, archives.count()), "path")
    return paths.mapInArrow(run, "key long, url string, record_type string, payload_bytes long, "
                                 "payload_digest string, refers_to long, payload binary")
