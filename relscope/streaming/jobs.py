"""Incremental jobs with Structured Streaming.

``stream_predictions``: reply files arrive in a folder; each micro-batch is
parsed and decoded, and stored as one epoch: the parsed batches with their
status, and one row per pair.  A batch of replies that comes again (a file sent
twice, a producer that starts over) is dropped by keyed state, which outlives
restarts in the checkpoint.

``stream_run_summary``: predictions arrive; a stateful aggregation keeps the
counts per ``(run, strategy, gold, flags)`` -- bounded by
runs x classes^2, so no watermark is needed -- and each micro-batch writes
the small snapshot of an epoch; the run summary is computed from it with
the same code as the batch job, so streaming and batch results are equal.  A second
stream of expected batches joins the same state and gives each run's progress.

Output and checkpoint folders are the caller's: a restarted job that is given the
same ones resumes where it stopped.  An epoch has a folder of its own, which a
repeated epoch rewrites, so no row is stored twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relscope.operators import replies, scoring
from relscope.sources import files

#: Epochs whose snapshots stay: the last one, and those that a reader may still have open.
KEEP_EPOCHS = 3


def _folder(spark: SparkSession, path: str) -> str:
    """``path``, made if it isn't there: a stream over a folder without files is an empty one."""
    fs, where = files.hadoop(spark, path)
    fs.mkdirs(where)
    return path


def _run(spark: SparkSession, stream: DataFrame, store, checkpoint_dir: str, mode: str, state_partitions: int | None) -> None:
    """Runs a stateful stream until its sources are drained.  The state is small, so its store has
    ``state_partitions`` (default: the cluster's default parallelism) instead of the session's shuffle
    partitions; the number is fixed in the checkpoint at the first start."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(state_partitions or max(1, spark.sparkContext.defaultParallelism)))
    try:
        q = (stream.writeStream.outputMode(mode).foreachBatch(store)
             .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    q.awaitTermination()


def stream_predictions(spark: SparkSession, reply_dir: str, schema, out_dir: str,
                       checkpoint_dir: str, keys=("run_id", "strategy", "batch_id"),
                       max_files: int = 1, decoded_dir: str | None = None, replay_window: str | None = None,
                       state_partitions: int | None = None) -> str:
    """Parse reply files as they arrive; store the parsed batches, with their
    items, below ``out_dir`` and, with ``decoded_dir``, one row per pair of the good batches there
    (both partitioned by ``epoch``).  Runs until the folder is drained
    (``availableNow``); a later call with the same folders goes on with the files
    that came since.  Returns ``out_dir``.

    Of replies with equal keys the first one that came counts, whenever the others come: the
    state holds one key per batch, for ever, or for ``replay_window`` (an interval such as
    '30 days', by the files' times) if that is given."""
    keys = [k for k in keys if k in T._parse_datatype_string(schema).names] if isinstance(schema, str) else [k for k in keys if k in schema.names]
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(_folder(spark, reply_dir))
    if replay_window is None:
        fresh = src.dropDuplicates(keys)
    else:
        fresh = (src.withColumn("_arrived", F.col("_metadata.file_modification_time"))
                 .withWatermark("_arrived", replay_window).dropDuplicatesWithinWatermark(keys).drop("_arrived"))

    def store(batch: DataFrame, epoch: int) -> None:
        parsed = replies.parse_replies(batch, keys=keys)
        parsed.write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch}")
        if decoded_dir is not None:
            # From what was stored: the batch is parsed once.
            stored = spark.read.schema(parsed.schema).parquet(f"{out_dir}/epoch={epoch}")
            replies.decode_predictions(stored, keys=keys).write.mode("overwrite").parquet(f"{decoded_dir}/epoch={epoch}")

    _run(spark, fresh, store, checkpoint_dir, "append", state_partitions)
    return out_dir


def epochs(spark: SparkSession, folder: str) -> list[int]:
    """Finished epochs of a folder, in order; Spark's own success mark tells them from torn ones."""
    found = [int(n.split("=")[1]) for n in files.names(spark, folder) if n.startswith("epoch=")]
    return sorted(e for e in found if files.exists(spark, f"{folder}/epoch={e}/_SUCCESS"))


def _raw_schema(pred_schema, keys) -> T.StructType:
    by_name = {f.name: f.dataType for f in pred_schema.fields}
    fields = [T.StructField(c, by_name.get(c, T.IntegerType())) for c in (*keys, *scoring.RAW_CELL)]
    return T.StructType([*fields, T.StructField("_rows", T.LongType()), T.StructField("_total", T.LongType())])


def _snapshot(spark: SparkSession, cells_dir: str, schema: T.StructType, epoch: int | None = None) -> DataFrame:
    """Raw counts of an epoch (the last one by default); empty before the first."""
    known = epochs(spark, cells_dir)
    if epoch is None:
        if not known:
            return spark.createDataFrame([], schema)
        epoch = known[-1]
    return spark.read.schema(schema).parquet(f"{cells_dir}/epoch={epoch}")


def run_progress(raw: DataFrame, keys=("run_id",)) -> DataFrame:
    """Per run and strategy: pairs done, pairs expected and their share (null where nothing is expected)."""
    done = raw.groupBy(*keys, "strategy").agg(F.sum("_rows").alias("n_done"), F.sum("_total").alias("n_total"))
    return done.withColumn("progress", F.try_divide(F.col("n_done").cast("double"), F.col("n_total")))


def progress_at(spark: SparkSession, cells_dir: str, schema, keys=("run_id",), epoch: int | None = None) -> DataFrame:
    """Progress as it was at a kept epoch of ``stream_run_summary`` (``schema``: of its predictions)."""
    return run_progress(_snapshot(spark, cells_dir, _raw_schema(schema, keys), epoch), keys)


def stream_run_summary(spark: SparkSession, pred_dir: str, schema, cells_dir: str,
                       checkpoint_dir: str, keys=("run_id",), max_files: int = 1,
                       state_partitions: int | None = None, expected_dir: str | None = None,
                       keep_epochs: int = KEEP_EPOCHS) -> DataFrame:
    """Running counts per run while predictions arrive; returns the run
    summary computed from the last snapshot.  A later call with the same
    folders goes on with the files that came since; without any file the summary is empty.

    ``expected_dir`` is a second stream of Parquet files, one row per planned batch: the
    keys, ``strategy`` and ``n_items``.  Both streams feed one state, and the summary gets ``n_done``,
    ``n_total`` and ``progress``; a run that has no prediction yet isn't in the summary, but in
    ``progress_at``.

    Each epoch writes its own folder ``epoch=N`` under ``cells_dir``, so a reader
    never meets a snapshot that is being replaced; the last ``keep_epochs`` of them stay."""
    keys, raw_schema = list(keys), _raw_schema(schema, keys)
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(_folder(spark, pred_dir))
    rows = src.select(*[F.col(c).cast(raw_schema[c].dataType).alias(c) for c in (*keys, *scoring.RAW_CELL)],
                      F.lit(1).cast("long").alias("_rows"), F.lit(0).cast("long").alias("_total"))
    if expected_dir is not None:
        plan = T.StructType([*[f for f in raw_schema.fields if f.name in (*keys, "strategy")], T.StructField("n_items", T.LongType())])
        planned = spark.readStream.schema(plan).option("maxFilesPerTrigger", max_files).parquet(_folder(spark, expected_dir))
        flags = [F.lit(None).cast(raw_schema[c].dataType).alias(c) for c in scoring.RAW_CELL if c != "strategy"]
        rows = rows.unionByName(planned.select(*keys, "strategy", *flags, F.lit(0).cast("long").alias("_rows"),
                                               F.coalesce("n_items", F.lit(0).cast("long")).alias("_total")))
    counts = rows.groupBy(*keys, *scoring.RAW_CELL).agg(F.sum("_rows").alias("_rows"), F.sum("_total").alias("_total"))

    def store(batch: DataFrame, epoch: int) -> None:
        # complete mode hands over every count: a repeated epoch rewrites its own folder
        batch.write.mode("overwrite").parquet(f"{cells_dir}/epoch={epoch}")
        for old in epochs(spark, cells_dir)[:-max(1, keep_epochs)]:
            files.remove(spark, f"{cells_dir}/epoch={old}")

    _run(spark, counts, store, checkpoint_dir, "complete", state_partitions)
    raw = _snapshot(spark, cells_dir, raw_schema)
    cells = scoring.label_cells(raw.where("_rows > 0").drop("_total"), keys)
    summary = scoring.run_summary(cells, keys=keys, cells=cells)
    if expected_dir is None:
        return summary
    p = run_progress(raw, keys)
    names = [*keys, "strategy"]
    p = p.select(*[F.col(c).alias(f"_{c}") for c in names], "n_done", "n_total", "progress")
    return summary.join(p, [summary[c].eqNullSafe(p[f"_{c}"]) for c in names], "left").drop(*[f"_{c}" for c in names])
