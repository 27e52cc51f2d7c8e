"""WARC archives: a gzip member per record, written and read in order.

Rows with equal payloads are stored once: the one with the largest id as a
response, the others as revisits that name it. The reader inflates an archive
piece by piece, frames records by their content length, and compares every
payload with its digest.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm.shared import saved

# Bytes of an archive from which on a task begins another one.
ARCHIVE_BYTES = 256 << 20
# Bytes that are read and inflated at a time.
READ_BYTES = 1 << 18
LEVEL = 6
# Tasks that read; with more archives, a task reads several, one after another.
MOST_TASKS = 20_000

# The format's version line, its profile of equal payloads, the names of records.
VERSION = "WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "urn:x-page:"
DATE = "1970-01-01T00:00:00Z"

ROLES = "page_id long, url string, payload binary, record_type string, refers_to long"


class DamagedArchive(ValueError):
    """An archive that is cut off, or whose records do not hold what they say."""


def roles(
    pages: DataFrame, smallest: int = 0, id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
) -> DataFrame:
    """`ROLES` of every row: whether it is stored as response or as revisit of another.

    Payloads are equal if their SHA-256, another hash and their length agree.
    Of equal payloads of at least `smallest` bytes the row with the largest id
    is the response. Rows that repeat this id are responses too. A null id is
    smaller than all; a null text is an empty payload.
    """
    payload = F.coalesce(F.col(html_column), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), payload.alias("payload"))
    same = [F.unhex(F.sha2("payload", 256)).alias("digest"), F.xxhash64("payload").alias("check"), F.length("payload").alias("size")]
    # The payloads' names only are grouped; the spread keeps a frequent payload from meeting in one task.
    names = saved(rows.select("page_id", *same, F.pmod(F.xxhash64("page_id"), F.lit(256)).cast("int").alias("spread")))
    keys = ["digest", "check", "size"]
    parts = saved(names.groupBy(*keys, "spread").agg(F.max("page_id").alias("largest")))
    firsts = parts.groupBy(*keys).agg(F.max("largest").alias("largest"))
    known = parts.select(*keys, "spread").join(firsts, keys)
    role = names.join(known, [*keys, "spread"]).select("page_id", *keys, "largest").distinct()
    later = (F.col("size") >= smallest) & ~F.col("page_id").eqNullSafe(F.col("largest"))
    revisit = role.where(later).select(F.xxhash64("page_id").alias("id_hash"), F.col("page_id").alias("of"), "digest", "largest")
    keyed = rows.select("*", F.xxhash64("page_id").alias("id_hash"), same[0])
    out = keyed.join(revisit, ["id_hash", "digest"], "left")
    # The hash of a long is one to one; null shares one with a single number.
    mine = F.col("largest").isNotNull() & F.col("page_id").eqNullSafe(F.col("of"))
    return out.select(
        "page_id", "url", "payload", F.when(mine, "revisit").otherwise("response").alias("record_type"),
        F.when(mine, F.col("largest")).alias("refers_to"),
    )


def sha1_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _named(page_id: int | None) -> str:
    return f"<{RECORD}{'none' if page_id is None else page_id}>"


def _id_of(name: str) -> int | None:
    number = name.strip("<>")[len(RECORD) :]
    return None if number == "none" else int(number)


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """A record as its own gzip member. A revisit has the response's header lines, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {_named(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        # What would break a line or is not printable goes by its bytes.
        clean = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
        lines.append(f"WARC-Target-URI: {clean}")
    lines += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{sha1_of(payload)}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: {_named(refers_to)}"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode()
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def write_warc(roles_: DataFrame, folder: str) -> DataFrame:
    """Write the rows of `ROLES` to archives in `folder` (a URI that all workers reach).

    Gives a row (`file`, `records`, `bytes`) per archive. A file's name follows
    from the task's number, so a task that runs again replaces its own files;
    a file gets its name when it is whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, base = pa.fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, n, size, done = None, 0, 0, []

        def close():
            nonlocal out, n, size
            out.close()
            name = f"{base}/part-{task.partitionId():05d}-{len(done):05d}.warc.gz"
            store.move(part, name)
            done.append({"file": name.rsplit("/", 1)[1], "records": n, "bytes": size})
            out, n, size = None, 0, 0

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    part = f"{base}/_{task.taskAttemptId()}-{len(done)}.part"
                    out = store.open_output_stream(part)
                member = record(row["page_id"], row["url"], row["payload"], row["record_type"], row["refers_to"])
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= ARCHIVE_BYTES:
                    close()
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done, pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return saved(roles_.mapInArrow(run, "file string, records long, bytes long"))


class _Inflated:
    """The text of a stream of gzip members, on demand."""

    def __init__(self, stream: BinaryIO, name: str):
        self.stream, self.name = stream, name
        self.unpack, self.ready, self.rest, self.began = None, bytearray(), b"", False

    def _more(self) -> bool:
        if not self.rest:
            self.rest = self.stream.read(READ_BYTES)
            if not self.rest:
                if self.began:
                    raise DamagedArchive(f"{self.name}: a gzip member is cut off")
                return False
        if self.unpack is None:
            self.unpack, self.began = zlib.decompressobj(31), True
        try:
            self.ready += self.unpack.decompress(self.rest, READ_BYTES)
        except zlib.error as error:
            raise DamagedArchive(f"{self.name}: {error}") from error
        self.rest = self.unpack.unconsumed_tail
        if self.unpack.eof:
            self.rest, self.unpack, self.began = self.unpack.unused_data, None, False
        return True

    def line(self) -> bytes | None:
        """A line without its end; None at the end of the stream."""
        seen = 0
        while (end := self.ready.find(b"\r\n", seen)) < 0:
            seen = max(0, len(self.ready) - 1)
            if not self._more():
                if self.ready:
                    raise DamagedArchive(f"{self.name}: a line is cut off")
                return None
        out = bytes(self.ready[:end])
        del self.ready[: end + 2]
        return out

    def take(self, n: int) -> bytes:
        while len(self.ready) < n:
            if not self._more():
                raise DamagedArchive(f"{self.name}: a record is cut off")
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out


def records(stream: BinaryIO, name: str = "archive") -> Iterator[dict]:
    """The records of one archive, each with its header fields and payload, digests verified."""
    source = _Inflated(stream, name)
    while (line := source.line()) is not None:
        if not line.startswith(b"WARC/"):
            raise DamagedArchive(f"{name}: no record begins with {line[:40]!r}")
        fields: dict[str, str] = {}
        while line := source.line():
            key, _, value = line.decode("utf-8", "replace").partition(":")
            fields[key.strip().lower()] = value.strip()
        if line is None or not fields.get("content-length", "").isdigit():
            raise DamagedArchive(f"{name}: a record without length")
        block = source.take(int(fields["content-length"]))
        if source.take(4) != b"\r\n\r\n":
            raise DamagedArchive(f"{name}: a record is longer than it says")
        head, _, payload = block.partition(b"\r\n\r\n")
        http = dict(x.lower().split(b": ", 1) for x in head.split(b"\r\n")[1:] if b": " in x)
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        kind = fields.get("warc-type")
        if kind == "response" and digest != sha1_of(payload):
            raise DamagedArchive(f"{name}: the payload of {fields.get('warc-record-id')} differs from its digest")
        yield {
            "page_id": _id_of(fields["warc-record-id"]),
            "url": fields.get("warc-target-uri"),
            "payload": payload if kind == "response" else None,
            "payload_bytes": int(http.get(b"content-length", len(payload))),
            "payload_digest": digest,
            "record_type": kind,
            "refers_to": _id_of(fields["warc-refers-to"]) if "warc-refers-to" in fields else None,
        }


READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_warc(spark: SparkSession, folder: str, files: DataFrame, payloads: bool = True) -> DataFrame:
    """Rows (`READ`) of the archives in `folder` that `files` (`file`) lists, a task reading one after another.

    `payloads=False` leaves the payloads out, after they have been verified. A
    damaged archive stops the job with `DamagedArchive`, which names it.
    """
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
         ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows, size = [], 0
                with store.open_input_stream(f"{base}/{file}", compression=None) as stream:
                    for row in records(stream, file):
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        size += len(row["payload"] or b"")
                        if len(rows) >= 1_000 or size >= READ_BYTES * 32:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    # Names are too small for Spark to see what reading them costs: a number of tasks is given.
    tasks = max(1, min(files.count(), MOST_TASKS))
    return files.select("file").repartitionByRange(tasks, "file").mapInArrow(run, READ)
