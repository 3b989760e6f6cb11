"""Helpers shared by the operators: tables, written intermediates, offsets, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from relscope.session import scratch_dir

#: Words of every contract: runs of anything but space, tab and the line separators 0x0A-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of one table; a schema of the caller's columns only, so nothing clashes later."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


#: Shuffle files go when their query ends; else they stay until the driver collects its garbage, for all queries of a long job.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and safe from lost executors; its shuffle files are removed."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes the files of tables of ``written`` that nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def slices(batch: pa.RecordBatch, column: int, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in stretches of at most ``rows`` rows whose texts (in ``column``), but for a row alone, have at most ``size`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        fits = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
        end = max(at + 1, min(fits, at + rows))
        yield batch.slice(at, end - at)
        at = end


def n_words(text) -> F.Column:
    """Words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def offsets(parts: DataFrame, group: str, order: str, amount: str, span: int = 4096) -> DataFrame:
    """Adds ``before``: the sum of ``amount`` over the earlier parts of the group.

    ``parts`` has one row per (group, order).  Sums run within spans of
    ``span`` parts and then over the spans, so no window holds more than a
    4096th of a group's parts.
    """
    p = parts.withColumn("_span", F.expr(f"`{order}` div {span}"))
    totals = p.groupBy(group, "_span").agg(F.sum(amount).alias("_amount"))
    earlier = Window.partitionBy(group).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col(group).alias("_g"), F.col("_span").alias("_s"),
                           F.coalesce(F.sum("_amount").over(earlier), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(group, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("_in", F.coalesce(F.sum(amount).over(inner), F.lit(0)))
    return (p.join(totals, (p[group] == totals["_g"]) & (p["_span"] == totals["_s"]))
            .withColumn("before", (F.col("_base") + F.col("_in")).cast("long"))
            .drop("_span", "_in", "_g", "_s", "_base"))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (columns u, v): root is the least node reachable.

    Repeated contraction: every node moves to the least of itself and its
    neighbours, edges are renamed, loops dropped.  Least is by label in two
    rounds (which ends a star), by a fresh hash of the label in every third: on
    a chain, whatever its labels, that halves the nodes on average, so rounds
    grow with the logarithm of the longest chain.  Every join meets a written
    table on its other side, which leaves a hot node's rows to the skew split;
    minima combine before the shuffle.  Each round's tables are written, so no
    lineage builds up.
    """
    edges = written(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
                    .distinct(), f"{name}-edges")
    moved, turn = None, 0
    while not edges.isEmpty():
        turn += 1
        order = [F.xxhash64("u", F.lit(turn)).alias("o")] if turn % 3 == 0 else []
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        here, there = F.struct(*order, F.col("u").alias("x")), F.struct(*[F.xxhash64("v", F.lit(turn)).alias("o") for _ in order], F.col("v").alias("x"))
        step = written(both.groupBy("u").agg(F.min(there).alias("m")).select(F.col("u").alias("node"), F.least(here, "m")["x"].alias("to")), f"{name}-step")
        a = step.select(F.col("node").alias("u"), F.col("to").alias("a"))
        b = step.select(F.col("node").alias("v"), F.col("to").alias("b"))
        edges = written(edges.join(a, "u").join(b, "v").where("a <> b")
                        .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(),
                        f"{name}-edges")
        if moved is None:
            moved = step.select("node", F.col("to").alias("root"))
        else:
            moved = written(moved.join(step.select(F.col("node").alias("root"), "to"), "root", "left")
                            .select("node", F.coalesce("to", "root").alias("root")), f"{name}-moved")
    if turn > 2:  # a root by hash isn't the least
        least = written(moved.groupBy("root").agg(F.min("node").alias("least")), f"{name}-least")
        moved = written(moved.join(least, "root").select("node", F.col("least").alias("root")), f"{name}-moved")
    return moved if moved is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
