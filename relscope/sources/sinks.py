"""Sinks: predictions, run summaries, annotated runs, comparisons, report, annotation sample.

Row-sized outputs are written in parallel (predictions as committed runs, see
``run_store``); result-sized ones (comparisons, report) are coalesced to one
file after they are already small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relscope.functions.labels import support_label
from relscope.schema import COMPARISON_COLS
from relscope.sources import run_store

# Published column names of the per-pair prediction file.
PUBLISHED_NAMES = {"support": "support [true value]", "h1": "relevance human labeled",
                   "h2": "relevance human labeled #2"}


def rename_outputs(df: DataFrame) -> DataFrame:
    """Canonical names -> the published ones (support -> 'support [true value]', ...)."""
    return df.withColumnsRenamed({k: v for k, v in PUBLISHED_NAMES.items() if k in df.columns})


def with_support_label(df: DataFrame) -> DataFrame:
    return df.withColumn("support_label", support_label("support"))


def write_predictions(df: DataFrame, path: str, fmt: str = "parquet", run_id: str | None = None, meta: dict | None = None) -> str:
    """Per-pair predictions of one or more runs as one commit of the folder's run store.

    A run is named by ``run_id`` or the column of that name; writing it again
    replaces its rows only, rows of other runs stay, and a write that dies is
    never seen.  CSV files carry the published column names.  Returns the version."""
    if fmt == "csv":
        df = rename_outputs(with_support_label(df))
    return run_store.commit_runs(df, path, fmt, run_id, meta)


def append_run_summary(summary: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append new summary rows; existing rows are never read or rewritten.
    Nothing is written for an empty summary (Spark writes no data files)."""
    w = summary.write.mode("append")
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    else:
        w.parquet(path)


def write_annotated_runs(runs: DataFrame, path: str) -> None:
    """Annotated runs in one file (result-sized); what computes them stays parallel."""
    runs.repartition(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_comparisons(comparisons: DataFrame, path: str) -> None:
    """z-test table in the published column order (result-sized: one file)."""
    (comparisons.orderBy("spec_seq").select(*COMPARISON_COLS).coalesce(1)
     .write.mode("overwrite").option("header", True).option("escape", '"').csv(path))


def write_report(lines: DataFrame, path: str) -> None:
    """The assembled Markdown report, title, headings and blank lines included, as one text file."""
    from relscope.operators.comparisons import REPORT_ORDER, assembled_report
    (assembled_report(lines).orderBy(*REPORT_ORDER).select("line").coalesce(1)
     .write.mode("overwrite").text(path))


def annotation_sample(pairs: DataFrame, n: int = 100, seed: int = 42) -> DataFrame:
    """Balanced sample over the three classes with an empty ``relevance``
    column for annotators."""
    from relscope.operators.sampling import stratified_sample
    s = stratified_sample(pairs, n, (0, 1, 2), seed)
    return (with_support_label(s).withColumn("relevance", F.lit(None).cast("double"))
            .drop("shuffle_key"))


def write_annotation_sample(pairs: DataFrame, path: str, n: int = 100, seed: int = 42) -> None:
    (annotation_sample(pairs, n, seed).coalesce(1).write.mode("overwrite")
     .option("header", True).option("escape", '"').csv(path))
