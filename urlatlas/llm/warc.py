"""WARC archives: a writer, and a sequential reader that holds one buffer at a time.

Every record is a gzip member of its own. A response record's block is an
HTTP head and the payload; a page whose payload another page has already is a
revisit, whose record names the response and carries its digest and length.
The reader decompresses incrementally, frames blocks by content length and
checks payload and block digests as the bytes pass.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlatlas.llm.common import stage
from urlatlas.llm.files import create, open_stream

#: Payloads shorter than this are never revisits.
LEAST_SHARED = 100
#: A task starts a new file beyond this size.
FILE_BYTES = 256 << 20
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(uri: str) -> int | None:
    number = uri.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def header_safe(url: str) -> str:
    """``url`` with white space and control characters as percent escapes, so that it fits a header line."""
    return "".join(c if c > " " and c != "\x7f" and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode("utf-8")) for c in url)


def write_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
                 revisit: bool, date: str) -> bytes:
    """One record as a gzip member. A URL that a header cannot hold as it is stands in a field of its own as well."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date)]
    if url is not None:
        uri = header_safe(url)
        fields.append(("WARC-Target-URI", uri))
        if uri != url:
            fields.append(("X-Target-URL", json.dumps(url)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
               ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(lines.encode("utf-8")) + pack.compress(block) + pack.compress(END) + pack.flush()


class Record(NamedTuple):
    """A record as read: ``size`` and ``digest`` are of the full payload, ``payload`` only if it was asked for."""
    page_id: int | None
    url: str | None
    kind: str
    refers_to: int | None
    size: int
    digest: str
    payload: bytes | None


class _Member:
    """The decompressed bytes of one gzip member at a time, read in bounded pieces."""

    def __init__(self, stream: BinaryIO, piece: int = 1 << 16):
        self.stream, self.piece = stream, piece
        self.raw, self.ready, self.unpack = b"", bytearray(), None

    def next_member(self) -> bool:
        if not self.raw:
            self.raw = self.stream.read(self.piece)
        self.ready, self.unpack = bytearray(), zlib.decompressobj(31)
        return bool(self.raw)

    def _more(self) -> bool:
        """Adds one piece to ``ready``; False at the member's end."""
        while True:
            if self.unpack.eof:
                return False
            if not self.raw:
                self.raw = self.stream.read(self.piece)
                if not self.raw:
                    raise ValueError("archive ends inside a record")
            got = self.unpack.decompress(self.raw, self.piece)
            self.raw = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
            if got:
                self.ready += got
                return True

    def until(self, mark: bytes) -> bytes:
        """Bytes up to and with ``mark``; a head is as long as its URL makes it."""
        seen = 0
        while (at := self.ready.find(mark, seen)) < 0:
            seen = max(0, len(self.ready) - len(mark) + 1)
            if not self._more():
                raise ValueError("damaged record head")
        out = bytes(self.ready[:at + len(mark)])
        del self.ready[:at + len(mark)]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes."""
        while n:
            if not self.ready and not self._more():
                raise ValueError("record is shorter than its content length")
            out = bytes(self.ready[:n])
            del self.ready[:n]
            n -= len(out)
            yield out

    def finish(self) -> None:
        """The member must end with the record's end mark."""
        while len(self.ready) <= len(END) and self._more():
            pass
        if self.ready != END or self._more():
            raise ValueError("record is longer than its content length")


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}


def read_records(stream: BinaryIO, keep_payload: bool = False) -> Iterator[Record]:
    """The records of an archive in order; ValueError where framing or a digest is wrong."""
    member = _Member(stream)
    while member.next_member():
        fields = _fields(member.until(END))
        length = int(fields["content-length"])
        http = member.until(END)
        size, block, kept = 0, hashlib.sha256(http), []
        payload = hashlib.sha256()
        for part in member.pieces(length - len(http)):
            block.update(part)
            payload.update(part)
            size += len(part)
            if keep_payload:
                kept.append(part)
        member.finish()
        named = fields["warc-payload-digest"].removeprefix("sha256:")
        full = int(_fields(http)["content-length"])
        revisit = fields["warc-type"] == "revisit"
        if fields["warc-block-digest"] != f"sha256:{block.hexdigest()}":
            raise ValueError("block digest does not fit")
        if not revisit and (named != payload.hexdigest() or full != size):
            raise ValueError("payload digest or length does not fit")
        url = json.loads(fields["x-target-url"]) if "x-target-url" in fields else fields.get("warc-target-uri")
        yield Record(page_of(fields["warc-record-id"]), url, fields["warc-type"],
                     page_of(fields["warc-refers-to"]) if revisit else None, full, named,
                     b"".join(kept) if keep_payload and not revisit else None)


WRITTEN = "path string, records long"


def _write_files(it: Iterator[pa.RecordBatch], folder: str, date: str, file_bytes: int) -> Iterator[pa.RecordBatch]:
    """Writes a task's ``(page_id, url, html, digest, refers_to, revisit)`` to files and names them."""
    out, at, n, done = None, 0, 0, []
    for b in it:
        for page_id, url, html, digest, refers_to, revisit in zip(*b.columns):
            if out is None:
                path, out = create(folder, "pages", ".warc.gz")
                at = n = 0
            record = write_record(page_id.as_py(), url.as_py(), html.as_py().encode("utf-8"), digest.as_py(),
                                  refers_to.as_py(), revisit.as_py(), date)
            out.write(record)
            at, n = at + len(record), n + 1
            if at >= file_bytes:
                out.close()
                done.append((path, n))
                out = None
    if out is not None:
        out.close()
        done.append((path, n))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["path", "records"])


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z",
                   least_shared: int = LEAST_SHARED, file_bytes: int = FILE_BYTES) -> list[tuple[str, int]]:
    """One record per row of ``pages (page_id, url, html)``; returns ``(path, records)`` of the files.

    Of equal payloads of at least ``least_shared`` bytes the smallest page id
    is the response and others revisit it (a null id never is the response
    while there is another; rows that repeat the response's id and payload
    are responses too). Null html is empty, a null url is left out, and any
    other comes back as it was. Page ids are whole numbers: others end the
    job with Spark's cast error. The html
    moves only if the table of repeated digests is too large to broadcast;
    rows of a digest that many pages share can then be split.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    shared = (rows.where(F.octet_length("html") >= least_shared).groupBy("digest")
              .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
              .select(F.col("digest").alias("shared_digest"), "first"))
    shared = stage(shared, folder, "shared")
    joined = rows.join(shared, F.col("digest") == F.col("shared_digest"), "left")
    revisit = F.col("shared_digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    ready = joined.select("page_id", "url", "html", "digest", F.when(revisit, F.col("first")).alias("refers_to"),
                          revisit.alias("revisit"))
    files = stage(ready.mapInArrow(lambda it: _write_files(it, folder, date, file_bytes), WRITTEN), folder, "files")
    return sorted((r["path"], r["records"]) for r in files.collect())  # a few files for each task


def _read_file(path: str, records: int, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    batch = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
    out, n = [], 0
    with open_stream(path) as stream:
        for r in read_records(stream):
            out.append((r.page_id, r.url, r.size, r.digest, r.kind, r.refers_to))
            n += 1
            if len(out) == rows:
                yield batch(out)
                out = []
    if n != records:
        raise ValueError(f"{path} has {n} records, {records} were written")
    if out:
        yield batch(out)


def read_archives(spark: SparkSession, files: list[tuple[str, int]]) -> DataFrame:
    """``(page_id, url, payload_bytes, payload_digest, record_type, refers_to)`` per record; a task reads one file."""
    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for k in b.column(0).to_pylist():
                yield from _read_file(*files[k])

    numbers = spark.range(0, len(files), 1, numPartitions=max(1, len(files)))
    return numbers.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, "
                                    "record_type string, refers_to long")
