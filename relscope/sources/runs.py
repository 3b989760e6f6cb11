"""Run-summary files: read the dirty published format, append new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from relscope.schema import RUN_METADATA_COLS, RUN_METRIC_COLS
from relscope.sources.csv_ranges import read_csv
from relscope.sources.formats import stored_format

# Timestamp layouts seen in run files ("6/7/26 18:02" and
# "2026-06-29 14:07:34").
TIMESTAMP_FORMATS = ("M/d/yy H:mm", "yyyy-MM-dd HH:mm:ss")

_INT_COLS = {"few_shot_n", "limit_config", "batch_size", "delay_seconds", "max_retries"}
_DOUBLE_METRICS = {"accuracy", "macro_f1"} | {c for c in RUN_METRIC_COLS
                                            if c.startswith(("precision", "recall", "f1_score"))}


def parse_number(c: Column) -> Column:
    """'0,6998 ' -> 0.6998; blanks and junk -> null (never raises)."""
    cleaned = F.regexp_replace(F.trim(c), ",", ".")
    return F.when(cleaned != "", cleaned).try_cast("double")


_try_double = parse_number


def parse_timestamp(c: Column) -> Column:
    s = F.trim(c)
    out = None
    for fmt in TIMESTAMP_FORMATS:
        e = F.try_to_timestamp(s, F.lit(fmt))
        out = e if out is None else F.coalesce(out, e)
    return out


def read_runs(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Read run summaries: a Parquet overview as the evaluation job stores it
    (typed, with its ``run_seq``), or a CSV as strings, then typed without ever failing.

    For CSV ``run_seq`` numbers the rows by file, then position, so "first match wins"
    lookups stay reproducible, over several files too (their names tell the order)."""
    if (fmt or stored_format(spark, path)) == "parquet":
        stored = spark.read.parquet(path)
        return stored.withColumn("timestamp", parse_timestamp(F.col("timestamp").cast("string")))
    raw = read_csv(spark, path)
    order = Window.orderBy("_file", "_row")  # one row a run: result-sized
    raw = raw.withColumn("run_seq", (F.row_number().over(order) - 1).cast("long")).drop("_file", "_row")
    cols = []
    for c in raw.columns:
        if c == "timestamp":
            cols.append(parse_timestamp(F.col(c)).alias(c))
        elif c in _INT_COLS or (c in RUN_METRIC_COLS and c not in _DOUBLE_METRICS):
            cols.append(_try_double(F.col(c)).cast("long").alias(c))
        elif c in _DOUBLE_METRICS:
            cols.append(_try_double(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return raw.select(*cols)


def union_runs(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing summaries + new rows, aligned by name; missing columns become null."""
    return existing.unionByName(new, allowMissingColumns=True)


def overview_columns(df: DataFrame) -> DataFrame:
    """Project a run summary onto the published column order (missing -> null)."""
    cols = []
    for c in RUN_METADATA_COLS + RUN_METRIC_COLS:
        cols.append(F.col(c) if c in df.columns else F.lit(None).alias(c))
    return df.select(*cols)
