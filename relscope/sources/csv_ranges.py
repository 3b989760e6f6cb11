"""Multi-line CSV read in parallel, with exact positions.

A quoted value may hold line breaks, so a line alone doesn't tell whether it
starts a record; the number of quotes before it does.  Quotes come in pairs
(doubled ones inside a value too), so a line break lies inside a value exactly
if an odd number of quotes precede it in the file.  That makes the parity of quotes a prefix sum:

1. every byte range (Spark's own splits of the text) is summed up: its parity,
   and the records that end in it if it starts outside a value, and inside one;
2. running sums over the ranges of a file give each range its start state and
   the number of records before it;
3. every range then cuts its lines into records by itself.  A record that
   crosses a border leaves a piece in each range; only these pieces are shuffled and put together.

Needs RFC 4180 quoting: quotes around whole values, doubled inside them.  Quotes
that never close stop the read.  Blank lines between records don't count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPTIONS = {"header": True, "multiLine": True, "escape": '"'}
#: A range's summary: 0 and 1 are its start states, outside and inside a value.
SUMMARY = pa.schema([("file", pa.string()), ("start", pa.int64()), ("parity", pa.int32()), ("n0", pa.int64()), ("n1", pa.int64())])
PIECES = pa.schema([("file", pa.string()), ("row", pa.int64()), ("start", pa.int64()), ("record", pa.string())])

State = dict[str, tuple[list[int], list[int], list[int]]]


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """(file, start, first row, end row) of the ranges in a batch: lines of one range lie together."""
    files = batch.column("file").dictionary_encode()
    code, start = files.indices.to_numpy(zero_copy_only=False), batch.column("start").to_numpy(zero_copy_only=False)
    cuts = np.nonzero((np.diff(code) != 0) | (np.diff(start) != 0))[0] + 1
    edges = [0, *cuts.tolist(), len(code)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield files.dictionary[int(code[a])].as_py(), int(start[a]), a, b


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums up the ranges of a task, one row each."""
    now, parity, n = None, 0, [0, 0]

    def row():
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*now, parity, *n), SUMMARY)], schema=SUMMARY)

    for batch in batches:
        odd, blank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("odd", "blank"))
        for file, start, a, b in _runs(batch):
            if (file, start) != now:
                if now is not None:
                    yield row()
                now, parity, n = (file, start), 0, [0, 0]
            after = (parity + np.cumsum(odd[a:b])) % 2
            for state in (0, 1):
                n[state] += int(((after == state) & ~blank[a:b]).sum())
            parity = int(after[-1])
    if now is not None:
        yield row()


def _cut(states: State, pieces_only: bool):
    """Cuts the lines of ranges into whole records (no ``start``) and pieces of those that cross borders."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parity, number, open_lines, whole = None, 0, 0, [], True

        def left_over():  # the unfinished record at a range's end is a piece
            return [(now[0], number, now[1], "\n".join(open_lines))] if now is not None and open_lines else []

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECES)], schema=PIECES)

        for batch in batches:
            rows: list[tuple] = []
            odd = batch.column("odd").to_numpy(zero_copy_only=False)
            for file, start, a, b in _runs(batch):
                if (file, start) != now:
                    rows += left_over()
                    now, open_lines = (file, start), []
                    if file in states:
                        starts, inside, before = states[file]
                        at = int(np.searchsorted(starts, start))
                        if at == len(starts) or starts[at] != start:
                            raise ValueError(f"{file}: the ranges changed between the passes over it")
                        parity, number = inside[at], before[at]
                    elif start == 0:
                        parity, number = 0, 0
                    else:
                        raise ValueError(f"{file}: the ranges changed between the passes over it")
                    whole = parity == 0
                after = (parity + np.cumsum(odd[a:b])) % 2
                lines = batch.column("value").slice(a, b - a).to_pylist()
                begin = 0
                for end in np.nonzero(after == 0)[0].tolist():
                    if begin == end and not open_lines:
                        record = lines[end]
                    else:
                        record = "\n".join(open_lines + lines[begin:end + 1])
                        open_lines = []
                    begin = end + 1
                    if whole and record.rstrip("\r") == "":
                        continue
                    if not whole:
                        rows.append((file, number, start, record))
                    elif not pieces_only:
                        rows.append((file, number, None, record))
                    number, whole = number + 1, True
                open_lines = open_lines + lines[begin:]
                parity = int(after[-1])
            if rows:
                yield out(rows)
        rows = left_over()
        if rows:
            yield out(rows)

    return run


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _row, record): the text of every record below ``path`` and its number in its file; the header is number 0."""
    lines = spark.read.option("lineSep", "\n").text(path)
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    lines = lines.select(*place, odd.cast("int").alias("odd"), F.col("value").isin("", "\r").alias("blank"), "value")

    ranges = lines.select("file", "start", "odd", "blank").mapInArrow(_summaries, "file string, start long, parity int, n0 long, n1 long")
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("inside", F.coalesce(F.sum("parity").over(earlier) % 2, F.lit(0)))
    n = F.when(F.col("inside") == 0, F.col("n0")).otherwise(F.col("n1"))
    ranges = ranges.withColumn("before", F.coalesce(F.sum(n).over(earlier), F.lit(0)))
    ranges = ranges.withColumn("of", F.count("*").over(Window.partitionBy("file"))).withColumn("odd", F.sum("parity").over(Window.partitionBy("file")) % 2)
    # Files of several ranges, and broken ones: a few numbers per range of 128 MB.
    states: State = {}
    crossed = False
    for r in ranges.where("of > 1 OR odd = 1").orderBy("file", "start").collect():
        if r["odd"]:
            raise ValueError(f"{r['file']}: a quoted value never ends")
        starts, inside, before = states.setdefault(r["file"], ([], [], []))
        starts.append(r["start"])
        inside.append(int(r["inside"]))
        before.append(int(r["before"]))
        crossed |= bool(r["inside"])

    text = lines.select("file", "start", "odd", "value")
    schema = "file string, row long, start long, record string"
    out = text.mapInArrow(_cut(states, False), schema)
    if crossed:
        pieces = text.mapInArrow(_cut(states, True), schema).where("start IS NOT NULL")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "record"))), lambda p: p["record"]), "\n")
        out = out.where("start IS NULL").select("file", "row", "record").union(pieces.groupBy("file", "row").agg(joined.alias("record")))
    return out.select(F.col("file").alias("_file"), F.col("row").alias("_row"), "record")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings by the header (of the first file, the others' columns by position), with
    ``_file`` and ``_row``, the position in the file without the header."""
    names = spark.read.options(**OPTIONS).csv(path).columns
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    rows = csv_records(spark, path).where("_row > 0")
    # Line breaks inside values are told as one character, as Spark's reader does.
    record = F.replace(F.regexp_replace("record", "\r$", ""), F.lit("\r\n"), F.lit("\n"))
    rows = rows.select("_file", (F.col("_row") - 1).alias("_row"), F.from_csv(record, schema, {"escape": '"'}).alias("_c"))
    return rows.select(*[F.col(f"_c.c{i}").alias(n) for i, n in enumerate(names)], "_file", "_row")
