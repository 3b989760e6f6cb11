"""Argument-pair sources: CSV, Parquet and Arrow IPC stream files.

Rows get ``orig_idx`` (position in their file, unless the file has one) and
``pair_id`` (the identity every seeded shuffle hashes).  With
``identity="content"`` that is a hash of the row's content (``identity.py``): the
same pairs in rewritten, compacted or renamed files get the same orders, samples and prompts.
With ``"file"`` it is the file's name and the position, one narrow expression without a second look at the data.

Every format is read by as many tasks as its size asks for: Parquet by Spark's
reader, multi-line CSV by ranges (``csv_ranges.py``), Arrow streams by runs of
record batches (``arrow_ranges.py``).  No shuffle or limit of rows
happens here: both are deferred to the sampling operators, which do them
distributed and reproducibly.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relscope.sources import arrow_ranges
from relscope.sources.csv_ranges import read_csv
from relscope.sources.files import file_system, local_path
from relscope.sources.identity import content_ids

REQUIRED = ("arg1", "arg2", "support")
# Label-column spellings renamed on load.
PAIR_RENAMES = {"relevance human labeled": "relevance_human_labeled",
                "relevance: human labeled": "relevance_human_labeled"}


def check_inputs(df: DataFrame, required=REQUIRED) -> DataFrame:
    """Required columns must be present; raises before any job starts."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"Pair set is missing required columns: {missing}")
    return df


def check_unique_ids(df: DataFrame, key: str = "pair_id") -> DataFrame:
    """Raises when an id is missing or occurs twice: seeded orders, exclusion and
    label joins all rely on it."""
    bad = (df.groupBy(key).count().filter((F.col("count") > 1) | F.col(key).isNull())
           .select(key).limit(3).collect())
    if bad:
        raise ValueError(f"Pair ids are not unique: {[r[0] for r in bad]}")
    return df


#: Columns that make up a pair's content, as far as a source has them.
CONTENT = ("arg1", "arg2", "support", "type")


def _name_below(path: str):
    """Name of a row's file: its path below ``path`` (its base name when ``path`` is the file), so files of one
    name in different folders differ and moving the whole folder changes no name."""
    root = path.rstrip("/").split("://")[-1]
    root = root[len("file:"):] if root.startswith("file:") else root
    below = F.expr("substring(_file, instr(_file, _root) + length(_root) + 1)")
    return root, (F.when(F.col("_file").endswith(root), F.element_at(F.split("_file", "/"), -1))
                  .when(F.instr("_file", F.col("_root")) > 0, below).otherwise(F.col("_file")))


def _pair_ids(df: DataFrame, path: str, identity: str, stored_idx: bool = False) -> DataFrame:
    """pair_id of the rows (with ``_file`` and ``_row``, dropped here), unless they have one."""
    if identity not in ("file", "content"):
        raise ValueError(f"Unknown identity {identity!r}: 'file' or 'content'")
    if "pair_id" in df.columns:
        return df.drop("_file", "_row")
    if identity == "content":
        columns = [c for c in CONTENT if c in df.columns] + (["orig_idx"] if stored_idx else [])
        return content_ids(df, columns).drop("_file", "_row")
    root, name = _name_below(path)
    d = df.withColumn("_root", F.lit(root)).withColumn("_name", name)
    return (d.withColumn("pair_id", F.concat_ws("#", "_name", F.col("orig_idx").cast("string")))
            .drop("_file", "_row", "_root", "_name"))


def read_pairs_csv(spark: SparkSession, path: str, limit: int | None = None, identity: str = "file") -> DataFrame:
    df = check_inputs(read_csv(spark, path))
    for old, new in PAIR_RENAMES.items():
        if old in df.columns:
            df = df.withColumnRenamed(old, new)
    df = df.withColumn("support", F.col("support").try_cast("double").try_cast("long"))
    stored_idx = "orig_idx" in df.columns
    df = df.withColumn("orig_idx", F.col("orig_idx").try_cast("long") if stored_idx else F.col("_row"))
    if "relevance_human_labeled" in df.columns:
        df = df.withColumn("relevance_human_labeled",
                           F.col("relevance_human_labeled").try_cast("double"))
    return _limit(_pair_ids(df, path, identity, stored_idx), limit)


def _limit(df: DataFrame, limit: int | None) -> DataFrame:
    if limit is None:
        return df
    from relscope.operators.sampling import limit_sample
    return limit_sample(df, limit).drop("pos", "shuffle_key")


ARROW_PAIR_SCHEMA = T.StructType([
    T.StructField("arg1", T.StringType()), T.StructField("arg2", T.StringType()),
    T.StructField("support", T.LongType()), T.StructField("type", T.StringType()),
    T.StructField("source_file", T.StringType()), T.StructField("orig_idx", T.LongType()),
])


def read_pairs_arrow(spark: SparkSession, path: str, limit: int | None = None,
                     schema: T.StructType = ARROW_PAIR_SCHEMA, identity: str = "file",
                     range_bytes: int = arrow_ranges.RANGE) -> DataFrame:
    """Arrow IPC *stream* files, read batch by batch, a large file by several tasks.

    Only the file paths go through Spark's file listing (``binaryFile`` with
    the content column pruned).  Their message headers are indexed, then runs
    of record batches are dealt to tasks, which open the files with pyarrow; no
    file is ever held as one value."""
    from relscope.session import ship_package
    ship_package(spark)
    tasks = max(1, spark.sparkContext.defaultParallelism)
    files = spark.read.format("binaryFile").load(path).select("path", F.lit(path).alias("root"))
    runs = arrow_ranges.index(files.repartition(tasks, "path"), range_bytes).repartition(4 * tasks, "file", "start")
    target = pa.schema([(f.name, _arrow_type(f.dataType)) for f in schema.fields]
                       + [("_file", pa.string()), ("_row", pa.int64())])

    def read(batches):
        for indexed in batches:
            for run in indexed.to_pylist():
                for first, rb in arrow_ranges.read_run(run):
                    n = rb.num_rows
                    place = pa.array(range(first, first + n), pa.int64())
                    own = {"source_file": pa.array([os.path.basename(local_path(run["file"]))] * n, pa.string()),
                           "orig_idx": place, "_file": pa.array([run["file"]] * n, pa.string()), "_row": place}
                    cols = [own[f.name] if f.name in own
                            else rb.column(f.name).cast(f.type) if f.name in rb.schema.names
                            else pa.nulls(n, f.type) for f in target]
                    yield pa.RecordBatch.from_arrays(cols, schema=target)

    placed = T.StructType([*schema.fields, T.StructField("_file", T.StringType()), T.StructField("_row", T.LongType())])
    return _limit(_pair_ids(runs.mapInArrow(read, placed), path, identity), limit)


def read_pairs(spark: SparkSession, path: str, limit: int | None = None, identity: str = "file") -> DataFrame:
    """Pick the reader by extension: .csv, .parquet, otherwise Arrow stream."""
    p = path.rstrip("/")
    if p.endswith(".csv"):
        return read_pairs_csv(spark, path, limit, identity)
    if p.endswith(".parquet"):
        df = check_inputs(spark.read.parquet(path))
        # The reader numbers the rows of a file, however the file is split.
        stored_idx = "orig_idx" in df.columns
        df = df.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
        if not stored_idx:
            df = df.withColumn("orig_idx", F.col("_row"))
        return _limit(_pair_ids(df, path, identity, stored_idx), limit)
    return read_pairs_arrow(spark, path, limit, identity=identity)


def write_pairs_arrow(df: DataFrame, path: str, cols=("arg1", "arg2", "support", "type")) -> DataFrame:
    """Write each partition as one Arrow IPC stream file under ``path`` (a shared
    folder or a URI, used by this write alone); returns (file, rows) per file.

    A file is named by its partition and written under a hidden name of the
    attempt, then renamed: a repeated or speculative task replaces its own file
    and leaves no second copy of its rows."""
    from relscope.session import ship_package
    ship_package(df.sparkSession)
    cols = list(cols)
    sub = df.select(*cols)
    arrow_schema = pa.schema([(f.name, _arrow_type(f.dataType)) for f in sub.schema.fields])

    def write(batches):
        import pyarrow.ipc as ipc
        from pyspark import TaskContext
        task = TaskContext.get()
        fs, base = file_system(path)
        fs.create_dir(base, recursive=True)
        name = f"{base}/part-{task.partitionId():06d}.arrow"
        aside = f"{base}/_{task.taskAttemptId()}.arrow"
        n = 0
        with fs.open_output_stream(aside) as sink, ipc.new_stream(sink, arrow_schema) as w:
            for rb in batches:
                w.write_table(pa.Table.from_batches([rb]).cast(arrow_schema))
                n += rb.num_rows
        fs.move(aside, name)
        yield pa.RecordBatch.from_pydict({"file": [name], "rows": [n]})

    return sub.mapInArrow(write, "file string, rows long")


def _arrow_type(dt):
    if isinstance(dt, T.LongType):
        return pa.int64()
    if isinstance(dt, T.IntegerType):
        return pa.int32()
    if isinstance(dt, T.DoubleType):
        return pa.float64()
    return pa.string()
