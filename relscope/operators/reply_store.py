"""Model replies that outlive a killed run.

A store is a folder of small Parquet files, each the replies of one chunk of
calls.  A task writes a chunk under a hidden name and renames it, so a file is
there whole or not at all, and does so before any of its rows go on
downstream.  Replies are found again by ``prompt_key``, a hash of the prompt
and a scope (the run or the model), never by batch numbers: a run that is started
again with the same store calls the model only for prompts without a stored reply.

    store/run=<start>/part=<partition>/<attempt>-<chunk>.parquet

Where two attempts of a task called the same prompt (speculation), the store
holds both and readers take one, an answer before a failure.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relscope.sources import files

STORED = pa.schema([("prompt_key", pa.string()), ("reply", pa.string()), ("attempts", pa.int32()), ("error", pa.string())])
STORED_SQL = "prompt_key string, reply string, attempts int, error string"
#: A chunk is committed at this many calls or seconds, whichever comes first.
CHUNK, SECONDS = 64, 10.0

Call = Callable[[object, str], tuple[str | None, int, str | None]]


def prompt_key(prompt: Column, scope: str = "") -> Column:
    """Key of a prompt within a scope; a null prompt has a key of its own."""
    told = F.coalesce(F.concat(F.length(prompt).cast("string"), F.lit(":"), prompt), F.lit("-"))
    return F.sha2(F.concat(F.lit(f"{len(scope)}:{scope}"), told), 256)


def stored_replies(spark: SparkSession, store: str, failures: bool = True) -> DataFrame:
    """(prompt_key, reply, attempts, error): one row per prompt that the store holds; ``failures=False`` leaves failed calls out."""
    if not any(n.startswith(("run=", "compact=")) for n in files.names(spark, store)):
        return spark.createDataFrame([], STORED_SQL)
    rows = (spark.read.schema(STORED_SQL).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
            .parquet(store))
    if not failures:
        rows = rows.where("error IS NULL")
    best = F.min(F.struct(F.col("error").isNotNull().alias("failed"), "reply", "attempts", "error")).alias("_b")
    return rows.groupBy("prompt_key").agg(best).select("prompt_key", "_b.reply", "_b.attempts", "_b.error")


def compact_replies(spark: SparkSession, store: str) -> None:
    """Rewrites a store's many chunk files as few; not while a run uses the store.

    A crash on the way leaves rows twice, which readers take once."""
    old = [n for n in files.names(spark, store) if n.startswith(("run=", "compact="))]
    if not old:
        return
    stored_replies(spark, store).write.parquet(f"{store}/compact={uuid.uuid4().hex}")
    for n in old:
        files.remove(spark, f"{store}/{n}")


class ChunkWriter:
    """Commits the replies of one task, chunk by chunk."""

    def __init__(self, folder: str, attempt: int, chunk: int = CHUNK, seconds: float = SECONDS) -> None:
        self.fs, self.folder = files.file_system(folder)
        self.attempt, self.chunk, self.seconds = attempt, chunk, seconds
        self.rows: list[tuple] = []
        self.number, self.since = 0, time.monotonic()

    def earlier(self) -> dict[str, tuple]:
        """What earlier attempts of this task committed in this run."""
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq
        out: dict[str, tuple] = {}
        for f in self.fs.get_file_info(pafs.FileSelector(self.folder, allow_not_found=True)):
            if f.base_name.endswith(".parquet") and not f.base_name.startswith("."):
                with self.fs.open_input_file(f.path) as src:
                    for r in pq.read_table(src).to_pylist():
                        out[r["prompt_key"]] = (r["reply"], r["attempts"], r["error"])
        return out

    def add(self, key: str, result: tuple) -> None:
        self.rows.append((key, *result))
        if len(self.rows) >= self.chunk or time.monotonic() - self.since >= self.seconds:
            self.commit()

    def commit(self) -> None:
        import pyarrow.parquet as pq
        if self.rows:
            self.fs.create_dir(self.folder, recursive=True)
            name = f"{self.attempt}-{self.number:06d}.parquet"
            aside = f"{self.folder}/.{name}"
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows), STORED)]
            with self.fs.open_output_stream(aside) as sink:
                pq.write_table(pa.Table.from_arrays(columns, schema=STORED), sink)
            self.fs.move(aside, f"{self.folder}/{name}")
            self.rows, self.number = [], self.number + 1
        self.since = time.monotonic()


def durable_replies(prompts: DataFrame, call: Call, client_factory: Callable[[], object], store: str, scope: str = "",
                    retry_failed: bool = False, parallelism: int | None = None, chunk: int = CHUNK,
                    seconds: float = SECONDS, delay_seconds: float = 0.0) -> DataFrame:
    """Adds ``reply``, ``attempts``, ``error`` and ``resumed`` (the reply was in the store) to each prompt row.

    Stored replies are joined by key, the others called: equal prompts once,
    for they lie side by side in one sorted partition.  A task that is tried
    again reads what its own attempts committed before, so neither a killed
    run nor a lost executor repeats a committed call.  ``retry_failed`` calls
    again what failed in an earlier run."""
    spark = prompts.sparkSession
    tasks = parallelism or spark.sparkContext.defaultParallelism
    keyed = prompts.withColumn("_key", prompt_key(F.col("prompt"), scope)).repartition(tasks, "_key")
    known = stored_replies(spark, store, failures=not retry_failed)
    known = known.select(F.col("prompt_key").alias("_key"), "reply", "attempts", "error", F.lit(True).alias("resumed"))
    rows = keyed.join(known, "_key", "left").withColumn("resumed", F.col("resumed").isNotNull()).sortWithinPartitions("_key")
    given = list(prompts.columns)
    out = [*given, "reply", "attempts", "error", "resumed"]
    schema = T.StructType([f for f in rows.select(*out).schema])
    folder = f"{store.rstrip('/')}/run={time.time_ns()}-{uuid.uuid4().hex[:8]}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task = TaskContext.get()
        writer = ChunkWriter(f"{folder}/part={task.partitionId():06d}", task.taskAttemptId(), chunk, seconds)
        earlier, client, last = writer.earlier(), None, (None, None)
        try:
            for batch in batches:
                told = batch.column("resumed").to_pylist()
                results = list(zip(*(batch.column(c).to_pylist() for c in ("reply", "attempts", "error"))))
                for i, (key, prompt) in enumerate(zip(batch.column("_key").to_pylist(), batch.column("prompt").to_pylist())):
                    if told[i]:
                        continue
                    if key == last[0]:
                        results[i] = last[1]
                        continue
                    if key in earlier:
                        results[i] = earlier[key]
                    else:
                        client = client_factory() if client is None else client  # once per task
                        results[i] = call(client, prompt)
                        writer.add(key, results[i])
                        if delay_seconds:
                            time.sleep(delay_seconds)
                    last = (key, results[i])
                writer.commit()  # before any row goes on
                done = [pa.array([r[k] for r in results], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in given] + done + [batch.column("resumed")], names=out)
        finally:
            writer.commit()  # what was paid for stays, whatever ends the task

    return rows.select("_key", *out).mapInArrow(run, schema)
