"""Operator 2: WARC records inside ZIP-packaged archives, read by ranges.

An archive is a ZIP file with two members: ``archive/data.warc.gz`` (stored; one
gzip member per record) and ``indexes/index.cdx`` (stored; one line per record:
page id, offset, length).  The reader finds the ZIP directory from the end of
the file (ZIP64 included), finds the members' bytes from their local headers,
reads the index, and range-reads records in bounded chunks; nothing is
extracted.

Files are reached with pyarrow's file systems, so archives live wherever the
shared folder does.  An archive is written under the name of its attempt and
then moved to the name of its partition: a retried or doubled task leaves one.

Defined cases: null html is an empty payload; payloads below ``min_revisit``
bytes are always responses; of equal longer payloads the least page_id is the
response (all rows with that id, should it repeat) and the rest are revisits;
null page_ids are revisits of a numbered page, or responses where there is
none; an empty table writes no archive and reads back no row.
"""

from __future__ import annotations

import hashlib
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relscope.llm.common import written
from relscope.session import scratch_dir

DATA_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdx"
CHUNK_BYTES = 4 << 20

# Fixed values of the ZIP format: signatures and record layouts.
EOCD, EOCD64_LOCATOR, EOCD64 = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06"
CENTRAL, LOCAL = b"PK\x01\x02", b"PK\x03\x04"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


def _file_system(uri: str):
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


# ------------------------------------------------------------------ records
def record_bytes(page_id, url: str | None, payload: bytes, digest: str, refers_to, is_revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header block and leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            "WARC-Target-URI: " + " ".join((url or "").split()),
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(block: bytes) -> tuple[dict[str, str], int]:
    end = block.index(b"\r\n\r\n")
    lines = block[:end].decode().split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, end + 4


def _page(urn: str) -> int | None:
    digits = urn.rpartition(":")[2].rstrip(">")
    return int(digits) if digits else None


def parse_record(raw: bytes) -> dict:
    """A record's page_id, url, payload, length and digest; a response's digest is checked against its payload."""
    warc, at = _headers(raw)
    block = raw[at:at + int(warc["content-length"])]
    http, body = _headers(block)
    kind, digest = warc["warc-type"], warc["warc-payload-digest"].removeprefix("sha256:")
    payload = block[body:] if kind == "response" else None
    if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {warc['warc-record-id']} doesn't match its digest")
    return {"page_id": _page(warc["warc-record-id"]), "url": warc["warc-target-uri"], "payload": payload,
            "payload_bytes": int(http["content-length"]), "payload_digest": digest, "record_type": kind,
            "refers_to": _page(warc["warc-refers-to"]) if kind == "revisit" else None}


# ------------------------------------------------------------------ writing
def write_archives(pages: DataFrame, folder: str, min_revisit: int = 100) -> DataFrame:
    """Writes page_id, url, html as one archive per partition below ``folder``; returns (path, records)."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha2("html", 256)).withColumn("long", F.octet_length("html") >= min_revisit)
    first = (p.where("long").groupBy(F.col("digest").alias("_digest"))
             .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    first = written(first, "warc-first")  # a written side leaves a hot payload's rows to the skew split
    typed = p.join(first, F.col("long") & (F.col("digest") == F.col("_digest")), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    typed = typed.select("page_id", "url", "html", "digest", F.when(revisit, F.col("first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, root = _file_system(folder)
        task = TaskContext.get()
        name = f"{root}/part-{task.partitionId():06d}.zip"
        aside = f"{name}.{task.taskAttemptId()}"
        index, n, at = [], 0, 0
        stream = archive = data = None
        for batch in batches:
            for row in batch.to_pylist():
                if archive is None:  # a partition without rows leaves no archive
                    target.create_dir(root, recursive=True)
                    stream = target.open_output_stream(aside)
                    archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
                    data = archive.open(DATA_MEMBER, "w", force_zip64=True)
                raw = record_bytes(row["page_id"], row["url"], row["html"].encode(), row["digest"], row["refers_to"],
                                   row["refers_to"] is not None)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                packed = packer.compress(raw) + packer.flush()
                data.write(packed)
                index.append(f"{'' if row['page_id'] is None else row['page_id']} {at} {len(packed)}\n")
                at, n = at + len(packed), n + 1
        if archive is not None:
            data.close()
            with archive.open(INDEX_MEMBER, "w", force_zip64=True) as out:
                out.writelines(x.encode() for x in index)
            archive.close()
            stream.close()
            target.move(aside, name)
            end = folder.rstrip("/") + name[len(root):]
            yield pa.RecordBatch.from_pydict({"path": [end], "records": pa.array([n], pa.int64())})

    return written(typed.mapInArrow(write, "path string, records long"), "warc-manifest")


# ------------------------------------------------------------------ reading
def read_members(read_at, size: int) -> dict[str, tuple[int, int]]:
    """Stored members of a ZIP file as {name: (first byte, length)}; ``read_at(offset, n)`` reads a range."""
    tail_at = max(0, size - FULL16 - 42)
    tail = read_at(tail_at, size - tail_at)
    end = tail.rfind(EOCD)
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, offset = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20:end - 16] == EOCD64_LOCATOR:
        at = struct.unpack_from("<Q", tail, end - 20 + 8)[0]
        wide = read_at(at, 56)
        if wide[:4] != EOCD64:
            raise ValueError("bad ZIP64 end of central directory")
        count, length, offset = struct.unpack_from("<QQQ", wide, 32)
    directory, members, at = read_at(offset, length), {}, 0
    for _ in range(count):
        if directory[at:at + 4] != CENTRAL:
            raise ValueError("bad central directory entry")
        method, packed, plain = *struct.unpack_from("<H", directory, at + 10), *struct.unpack_from("<II", directory, at + 20)
        n_name, n_extra, n_comment = struct.unpack_from("<HHH", directory, at + 28)
        local = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46:at + 46 + n_name].decode()
        extra = directory[at + 46 + n_name:at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # ZIP64: eight bytes for each field that is full, in this order
                wide, k = extra[4:4 + n], 0
                for field in ("plain", "packed", "local"):
                    if {"plain": plain, "packed": packed, "local": local}[field] == FULL32:
                        value, k = struct.unpack_from("<Q", wide, k)[0], k + 8
                        plain, packed, local = (value if field == "plain" else plain, value if field == "packed" else packed,
                                                value if field == "local" else local)
            extra = extra[4 + n:]
        if method == 0:
            head = read_at(local, 30)
            if head[:4] != LOCAL:
                raise ValueError(f"bad local header of {name}")
            members[name] = (local + 30 + sum(struct.unpack_from("<HH", head, 26)), packed)
        at += 46 + n_name + n_extra + n_comment
    return members


def read_archives(archives: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """All records of the archives in column ``path``: page_id, url, payload and what the query reports."""
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                target, name = _file_system(path)
                with target.open_input_file(name) as f:
                    members = read_members(lambda at, n: f.read_at(n, at), f.size())
                    base, _ = members[DATA_MEMBER]
                    at, left = members[INDEX_MEMBER]
                    rest, lengths, start, size = b"", [], base, 0
                    while left or rest:
                        part = f.read_at(min(left, 1 << 20), at) if left else b""
                        at, left = at + len(part), left - len(part)
                        *lines, rest = (rest + part).split(b"\n")
                        for line in lines:
                            lengths.append(int(line.rpartition(b" ")[2]))
                            size += lengths[-1]
                            if size >= chunk_bytes:
                                yield pa.RecordBatch.from_pydict({"path": [path], "start": [start], "lengths": [lengths]}, CHUNKS)
                                lengths, start, size = [], start + size, 0
                        if not left:
                            break
                    if lengths:
                        yield pa.RecordBatch.from_pydict({"path": [path], "start": [start], "lengths": [lengths]}, CHUNKS)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                target, name = _file_system(row["path"])
                with target.open_input_file(name) as f:
                    raw, at, out = f.read_at(sum(row["lengths"]), row["start"]), 0, []
                    for n in row["lengths"]:
                        out.append(parse_record(zlib.decompress(raw[at:at + n], 31)))
                        at += n
                    yield pa.RecordBatch.from_pylist(out, RECORDS)

    parts = archives.select("path").repartition(64, "path").mapInArrow(chunks, "path string, start long, lengths array<long>")
    spread = written(parts, "warc-chunks").repartition(64, "path", "start")
    return spread.mapInArrow(records, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, "
                                      "record_type string, refers_to long")


CHUNKS = pa.schema([("path", pa.string()), ("start", pa.int64()), ("lengths", pa.list_(pa.int64()))])
RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
                     ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages as archives in the shared folder and reads every record back."""
    return read_archives(write_archives(pages, scratch_dir(pages.sparkSession, "warc")))
