"""WARC archives through a chunked record table.

A record is rows of (record, chunk number), each with the digest of all bytes so far. Writing streams such
rows into gzip members, one archive for each task; reading streams an archive back into them. Neither
side holds more than a few chunks of a payload besides the cell that it came in.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, fresh_path, key_join, materialize

#: Payload bytes of a chunk row.
CHUNK_BYTES = 256 << 10
#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 100
#: Payload bytes of an Arrow batch of chunk rows, about.
BATCH_BYTES = 2 << 20
_BLOCK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: What is known of a record, in each of its chunk rows.
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"
CHUNK = "chunk_no int, chunk_bytes long, digest_so_far string, last boolean, chunk binary"
CHUNKS = f"archive string, record_no long, {RECORD}, {CHUNK}"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
#: Schemes that Hadoop names otherwise than Arrow's file systems do.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def _schema(columns: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[t]) for n, t in (x.split() for x in columns.split(", "))])


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows whose last value is a chunk, as batches of about BATCH_BYTES."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 500 + len(row[-1] or b"")
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _files(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a path: local, HDFS, S3 (s3a too), GCS, ABFS; a scheme that it doesn't know is an error."""
    if ":/" not in path:
        return pafs.LocalFileSystem(), path
    scheme, rest = path.split(":", 1)
    return pafs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}")


def mark_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Pages (page_id, url, html) with payload_bytes, payload_digest (SHA-256), record_type, refers_to.

    Of equal payloads of ``least`` bytes or more, the rows of the smallest page id are responses, the others
    revisit it. Only digests that occur again are joined back, so payloads don't move.
    Null html is an empty payload; rows without a page id are responses and never referred to.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"))
    known = known.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha2("html", 256))
    large = known.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull())
    firsts = large.groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.max("page_id").alias("_last"))
    firsts = materialize(firsts.where("_first < _last").select("payload_digest", "_first"), "warc-firsts")
    out = key_join(known, firsts, "payload_digest", "left")
    again = (F.col("payload_bytes") >= least) & (F.col("page_id") > F.col("_first"))
    return out.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("_first")).alias("refers_to"))


def chunk_table(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of (record, chunk) of rows of mark_revisits, where they are: see RECORD and CHUNK for the columns.

    Chunks of a record follow each other in one partition. A revisit has one row without bytes, an empty payload too.
    """
    columns, schema = f"{RECORD}, {CHUNK}", _schema(f"{RECORD}, {CHUNK}")
    names = [x.split()[0] for x in RECORD.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            html = b.column("html")
            for k, known in enumerate(zip(*(b.column(c).to_pylist() for c in names), strict=True)):
                held, sha = 0 if known[2] == "revisit" else known[4], hashlib.sha256()
                payload = memoryview(html[k].as_buffer()) if held else b""
                for no, at in enumerate(range(0, max(1, held), chunk_bytes)):
                    chunk = bytes(payload[at : at + chunk_bytes])
                    sha.update(chunk)
                    yield *known, no, len(chunk), sha.hexdigest(), at + chunk_bytes >= held, chunk

    return records.select(*names, "html").mapInArrow(lambda batches: _batches(rows(batches), schema), columns)


def _header(fields: list[tuple[str, object]]) -> bytes:
    clean = lambda v: "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in str(v))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in fields if v is not None) + "\r\n").encode()


def _record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(map(str, parts)))}>"


def write_archives(chunks: DataFrame, path: str, per_task: str = "part") -> DataFrame:
    """Write rows of chunk_table to gzip archives under ``path``; returns the manifest (archive, records, bytes).

    Chunks go out as they come, so a payload is never whole here. A record whose last running digest isn't its payload's
    is an error. Control characters of a URL are percent-encoded, a null URL gives no field. An archive counts
    once its task has ended well: its name has the task's attempt in it, and what a lost attempt left
    behind is in no manifest. An empty table writes nothing.
    """
    names = [x.split()[0] for x in f"{RECORD}, {CHUNK}".split(", ")]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _files(path)
        fs.create_dir(top, recursive=True)
        task = TaskContext.get()
        name = f"{per_task}-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
        n = size = 0
        out = member = None
        for b in batches:
            for page, url, kind, refers, length, digest, no, held, so_far, last, chunk in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                out = out or fs.open_output_stream(f"{top}/{name}", compression=None)
                again = kind == "revisit"
                if no == 0:
                    # the id of a response follows from page and digest, so that revisits in other archives can name it
                    own = _record_id(name, n) if again or page is None else _record_id("page", page, digest)
                    member = zlib.compressobj(1, zlib.DEFLATED, 31)
                    size += out.write(member.compress(_header([
                        ("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", url),
                        ("Content-Type", "text/html; charset=utf-8"), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Profile", PROFILE if again else None), ("WARC-Refers-To", _record_id("page", refers, digest) if again else None),
                        ("X-Page-Id", page), ("X-Refers-To-Page-Id", refers), ("X-Payload-Length", length), ("Content-Length", 0 if again else length),
                    ])))
                size += out.write(member.compress(chunk or b""))
                if last:
                    if not again and so_far != digest:
                        raise ValueError(f"the chunks of page {page} don't have its payload's digest")
                    size += out.write(member.compress(b"\r\n\r\n") + member.flush())
                    n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [name], "records": [n], "bytes": [size]}, pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    with bounded_batches(chunks.sparkSession):
        return materialize(chunks.select(*names).mapInArrow(write, "archive string, records long, bytes long"), "warc-manifest")


class _Members:
    """Bytes of a gzip file of many members, or of a plain one, a few at a time."""

    def __init__(self, stream):
        self.stream, self.ready = stream, bytearray()
        self.raw = stream.read(_BLOCK)
        self.inflate = zlib.decompressobj(31) if self.raw[:2] == b"\x1f\x8b" else None

    def fill(self, least: int) -> None:
        while len(self.ready) < least:
            self.raw = self.raw or self.stream.read(_BLOCK)
            if not self.raw:
                return
            if self.inflate is None:
                self.ready += self.raw
                self.raw = b""
                continue
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            self.ready += self.inflate.decompress(self.raw, _BLOCK)
            self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail

    def take(self, n: int) -> bytes:
        self.fill(n)
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out

    def head(self) -> dict[str, str]:
        """Fields of the next header by lower-case name; {} at the end."""
        while (end := self.ready.find(b"\r\n\r\n")) < 0:
            before = len(self.ready)
            self.fill(before + 1024)
            if len(self.ready) == before:
                if before:
                    raise ValueError("an archive ends within a header")
                return {}
        lines = self.take(end + 4).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC header: {lines[0][:40]!r}")
        pairs = (x.split(":", 1) for x in lines[1:] if ":" in x)
        return {k.strip().lower(): v.strip() for k, v in pairs}


def _number(text: str | None) -> int | None:
    return int(text) if text and text.isdecimal() else None


def _known(head: dict[str, str]) -> tuple:
    """The values of RECORD of a header; fields that a foreign archive lacks are null. A SHA-256 is given bare, other digests as they are."""
    digest = head.get("warc-payload-digest")
    digest = digest[7:] if (digest or "").lower().startswith("sha256:") else digest
    return _number(head.get("x-page-id")), head.get("warc-target-uri"), head.get("warc-type"), _number(head.get("x-refers-to-page-id")), _number(head.get("x-payload-length")), digest


def read_chunks(manifest: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of (record, chunk number) of the archives in ``manifest`` (column archive), gzip or plain: see CHUNKS.

    Each record has at least one row, the last one marked; digest_so_far of that is the SHA-256 of its block, for
    revisits that of no bytes. Archives of other writers are read too: what they don't say is null, and a
    response's block is taken as it is, its HTTP header included. A torn archive is an error.
    """
    schema = _schema(CHUNKS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        fs, top = _files(path)
        for b in batches:
            for archive in b.column("archive").to_pylist():
                with fs.open_input_stream(f"{top}/{archive}", compression=None) as stream:
                    members, no = _Members(stream), 0
                    while head := members.head():
                        left, k, sha, known = int(head["content-length"]), 0, hashlib.sha256(), _known(head)
                        while True:
                            chunk = members.take(min(chunk_bytes, left))
                            if len(chunk) < min(chunk_bytes, left):
                                raise ValueError("an archive ends within a payload")
                            left -= len(chunk)
                            sha.update(chunk)
                            yield archive, no, *known, k, len(chunk), sha.hexdigest(), left == 0, chunk
                            k += 1
                            if not left:
                                break
                        if members.take(4) != b"\r\n\r\n":
                            raise ValueError("a record isn't closed")
                        no += 1

    n = max(1, manifest.count())
    return manifest.select("archive").repartition(n, "archive").mapInArrow(lambda batches: _batches(rows(batches), schema), CHUNKS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back into a chunk table: one row for each record.

    Columns page_id, payload_bytes, payload_digest, record_type, refers_to, chunks. Of responses, bytes and digest are
    those of the chunks in the table; a response whose digest differs from its header's is an error. Null html is
    an empty payload; repeated rows are records of their own; an empty table gives an empty result.
    """
    path = fresh_path(pages.sparkSession, "warc")
    manifest = write_archives(chunk_table(mark_revisits(pages)), path)
    chunks = materialize(read_chunks(manifest, path), "warc-chunks")
    held = chunks.groupBy("archive", "record_no").agg(
        *[F.first(c).alias(c) for c in ("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest")],
        F.sum(F.octet_length("chunk")).alias("held"), F.max_by("digest_so_far", "chunk_no").alias("found"), F.count(F.lit(1)).alias("chunks"),
    )
    response = F.col("record_type") == "response"
    wrong = response & ((F.col("found") != F.col("payload_digest")) | (F.col("held") != F.col("payload_bytes")))
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("payload differs from its digest: record "), F.col("record_no").cast("string")))).otherwise(F.when(response, F.col("found")).otherwise(F.col("payload_digest")))
    return held.select("page_id", F.when(response, F.col("held")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), checked.alias("payload_digest"), "record_type", "refers_to", "chunks")
