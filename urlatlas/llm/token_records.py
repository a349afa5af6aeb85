"""Token ids as length-delimited binary records with a separate offset index.

A record frames one serialized sequence::

    length of the data   8 bytes, little-endian
    masked CRC of those  4 bytes
    data                 flags (1 byte), document id (8 bytes, signed), ids (2 or 4 bytes each)
    masked CRC of data   4 bytes

Ids take two bytes when the vocabulary fits them; the flags say so, and
whether there is a document id.

The index file has 16 bytes for each record: its offset and its length. A
checksum is CRC-32 rotated right by 15 bits plus a constant, so that a frame
inside a frame does not check. Files follow the order of document ids: the
table is range-partitioned by id, every task writes its range as one file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlatlas.llm.common import stage, text_of
from urlatlas.llm.files import create, open_file, open_stream
from urlatlas.llm.token_ids import encoder

#: Fixed value of the masked-checksum format.
MASK = 0xA282EAD8
HEAD, CRC, BODY, ENTRY = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<Bq"), struct.Struct("<QQ")

#: Words that a worker keeps the ids of, or twice as many.
WORDS = 500_000

FILES = "first_null boolean, first_id long, first_row long, path string, index string, records long, tokens long"


def masked_crc(data: bytes) -> bytes:
    c = zlib.crc32(data)
    return CRC.pack(((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF)


def frame(doc_id: int | None, ids: bytes, short: bool) -> bytes:
    """One framed record of ids given in little-endian 32-bit form; ``short`` stores two bytes of each."""
    if short:
        ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
    data = BODY.pack((doc_id is not None) | short << 1, doc_id or 0) + ids
    head = HEAD.pack(len(data))
    return b"".join([head, masked_crc(head), data, masked_crc(data)])


def _exactly(stream, n: int) -> bytes:
    got = stream.read(n)
    if len(got) != n:
        raise ValueError("record file ends inside a record")
    return got


def read_record(stream) -> tuple[int | None, bytes, int] | None:
    """The next record, checked: document id, ids in 32-bit form, size of the record; None at the end of the file."""
    head = stream.read(HEAD.size)
    if not head:
        return None
    if len(head) != HEAD.size or _exactly(stream, CRC.size) != masked_crc(head):
        raise ValueError("damaged record length")
    data = _exactly(stream, HEAD.unpack(head)[0])
    if _exactly(stream, CRC.size) != masked_crc(data):
        raise ValueError("damaged record data")
    flags, doc_id = BODY.unpack_from(data)
    ids = data[BODY.size:]
    if flags & 2:
        ids = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
    return (doc_id if flags & 1 else None), ids, len(data) + HEAD.size + 2 * CRC.size


def read_at(path: str, index: str, k: int) -> tuple[int | None, bytes, int]:
    """Record ``k`` of a file through its index: for reads in shuffled order."""
    with open_file(index) as f:
        f.seek(ENTRY.size * k)
        offset, _ = ENTRY.unpack(_exactly(f, ENTRY.size))
    with open_file(path) as f:
        f.seek(offset)
        return read_record(f)


class RecordFile(NamedTuple):
    """A written file; ``start`` counts the ids in all files before it."""
    path: str
    index_path: str
    records: int
    tokens: int
    start: int


def _write_file(it: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Writes a task's ``(id, row, text)`` as one file and tells what it wrote."""
    encode, end = encoder(tokenizer, WORDS).many, CRC.pack(end_id)
    short = max(encoder(tokenizer, WORDS).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16
    first, at, records, tokens = None, 0, 0, 0
    for b in it:
        doc_ids, row_numbers = b.column(0).to_pylist(), b.column(1).to_pylist()
        for doc_id, row, ids in zip(doc_ids, row_numbers, encode(b.column(2).to_pylist())):
            if first is None:
                first = (doc_id is None, doc_id or 0, row)
                path, out = create(folder, "records", ".bin")
                index, entries = create(folder, "records", ".idx")
            ids += end
            record = frame(doc_id, ids, short)
            out.write(record)
            entries.write(ENTRY.pack(at, len(record)))
            at, records, tokens = at + len(record), records + 1, tokens + len(ids) // 4
    if first is not None:
        out.close()
        entries.close()
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*first, path, index, records, tokens)], names=[
            "first_null", "first_id", "first_row", "path", "index", "records", "tokens"])


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id",
                  text_col: str = "text") -> list[RecordFile]:
    """Encodes every text (null: empty), appends ``end_id``, writes records in ascending id order.

    Null ids come first; rows of one id follow each other in the order they
    were read. The list has one entry per written file (one per task at most,
    none for an empty table), in order.
    """
    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _write_file(it, folder, tokenizer, end_id)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"),
                       text_of(text_col).alias("text"))
    ordered = rows.repartitionByRange("id", "row").sortWithinPartitions("id", "row")
    files = stage(ordered.mapInArrow(write, FILES), folder, "files")
    # one row per written file: bounded by the number of shuffle partitions
    found = sorted(files.collect(), key=lambda r: (not r.first_null, r.first_id, r.first_row))
    start, out = 0, []
    for r in found:
        out.append(RecordFile(r["path"], r["index"], r["records"], r["tokens"], start))
        start += r.tokens
    return out


def read_records(spark: SparkSession, files: list[RecordFile]) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every record, read in file order, one task per file.

    Every length, checksum and index entry is checked; ``start`` counts the ids before the record.
    """
    places = [tuple(f) for f in files]

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for k in b.column(0).to_pylist():
                yield from _read_file(RecordFile(*places[k]))

    numbers = spark.range(0, len(files), 1, numPartitions=max(1, len(files)))
    return numbers.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _read_file(f: RecordFile, rows: int = 5000) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    at, start, out = 0, f.start, []
    with open_stream(f.path) as stream, open_stream(f.index_path) as entries:
        while (record := read_record(stream)) is not None:
            doc_id, ids, size = record
            if _exactly(entries, ENTRY.size) != ENTRY.pack(at, size):
                raise ValueError("index does not fit the records")
            out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
            at, start = at + size, start + len(ids) // 4
            if len(out) == rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)
                out = []
    if start - f.start != f.tokens:
        raise ValueError("record file is shorter than it was written")
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)
