"""Arrow IPC stream files read by several tasks each.

A stream is a chain of messages, each a short header that tells the length of
its body.  A first pass walks the headers only (one short read a message, bodies
are skipped) and notes where every record batch lies and how many rows come before it.
Batches are then dealt to tasks in runs of about ``RANGE`` bytes; a task reads the schema, the
dictionaries that precede its run, and its own bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from relscope.sources.files import file_system

#: Bytes of consecutive record batches that one task reads at once, at least one batch.
RANGE = 32 << 20
INDEX_SQL = ("file string, root string, first_row long, start long, length long, schema_end long, "
             "dictionaries array<struct<start:long,length:long>>")
_DICT = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
INDEX = pa.schema([("file", pa.string()), ("root", pa.string()), ("first_row", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                   ("schema_end", pa.int64()), ("dictionaries", _DICT)])
# Fixed values of the format: kinds of messages, and the fields of the Message and RecordBatch tables.
SCHEMA, DICTIONARY, BATCH = 1, 2, 3
KIND, HEADER, BODY = 1, 2, 3


def _field(data: bytes, table: int, n: int) -> int | None:
    """Place of field n of a flatbuffer table, None where it has its default."""
    vtable = table - struct.unpack_from("<i", data, table)[0]
    if 4 + 2 * n >= struct.unpack_from("<H", data, vtable)[0]:
        return None
    offset = struct.unpack_from("<H", data, vtable + 4 + 2 * n)[0]
    return table + offset if offset else None


def message(data: bytes) -> tuple[int, int, int]:
    """(kind, body length, rows) told by a message's header; rows of record batches only."""
    table = struct.unpack_from("<I", data, 0)[0]
    kind_at, body_at, header_at = (_field(data, table, n) for n in (KIND, BODY, HEADER))
    kind = data[kind_at] if kind_at is not None else 0
    body = struct.unpack_from("<q", data, body_at)[0] if body_at is not None else 0
    rows = 0
    if kind == BATCH:
        header = header_at + struct.unpack_from("<I", data, header_at)[0]
        rows_at = _field(data, header, 0)
        rows = struct.unpack_from("<q", data, rows_at)[0] if rows_at is not None else 0
    return kind, body, rows


def messages(src) -> Iterator[tuple[int, int, int, int]]:
    """(kind, start, length, rows) of each message of a stream, bodies skipped."""
    at, size = 0, src.size()
    while at + 4 <= size:
        src.seek(at)
        head = src.read(8)
        first = struct.unpack_from("<I", head, 0)[0]
        prefix = 8 if first == 0xFFFFFFFF else 4  # streams of old writers have no marker
        length = struct.unpack_from("<i", head, prefix - 4)[0]
        if length == 0:
            return
        src.seek(at + prefix)
        kind, body, rows = message(src.read(length))
        total = prefix + length + body
        if at + total > size:
            raise ValueError(f"the stream ends inside a message at byte {at}")
        yield kind, at, total, rows
        at += total


def index_of(path: str, root: str, target: int) -> Iterator[tuple]:
    """Runs of record batches of one file, as rows of INDEX."""
    fs, p = file_system(path)
    with fs.open_input_file(p) as src:
        schema_end, dictionaries, row, run = 0, [], 0, None
        for kind, start, length, rows in messages(src):
            if kind == SCHEMA:
                schema_end = start + length
            elif kind == DICTIONARY:
                if run:
                    yield run
                    run = None
                dictionaries = [*dictionaries, {"start": start, "length": length}]
            elif kind == BATCH:
                if run and run[4] + length > target:
                    yield run
                    run = None
                run = (path, root, run[2] if run else row, run[3] if run else start, (run[4] if run else 0) + length, schema_end, dictionaries)
                row += rows
        if run:
            yield run


def index(paths: DataFrame, target: int = RANGE) -> DataFrame:
    """The runs of all files of ``paths`` (path, root), one short pass over each file's headers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, root in zip(*(batch.column(c).to_pylist() for c in ("path", "root"))):
                rows = list(index_of(path, root, target))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), INDEX)], schema=INDEX)

    return paths.select("path", "root").mapInArrow(run, INDEX_SQL)


def read_run(run: dict) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(position of its first row, record batch) of the batches of an index row."""
    fs, p = file_system(run["file"])
    with fs.open_input_file(p) as src:
        parts = [(0, run["schema_end"]), *[(d["start"], d["length"]) for d in run["dictionaries"]], (run["start"], run["length"])]
        pieces = []
        for start, length in parts:
            src.seek(start)
            pieces.append(src.read(length))
    row = run["first_row"]
    with pa.ipc.open_stream(pa.BufferReader(b"".join(pieces))) as reader:
        for batch in reader:
            yield row, batch
            row += batch.num_rows
