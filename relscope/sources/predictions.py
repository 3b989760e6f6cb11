"""Per-pair prediction files and human label files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relscope.sources import run_store
from relscope.sources.formats import stored_format

# Column names as written in prediction and label files, and the
# canonical names used by the operators.
PREDICTION_RENAMES = {
    "support [true value]": "support",
    "relevance human labeled": "h1",
    "relevance_human_labeled": "h1",
    "relevance human labeled #2": "h2",
}
LABEL_RENAMES = {
    "relevance human labeled": "h1",
    "relevance: human labeled": "h1",
    "relevance_human_labeled": "h1",
    "#2_relevance: human labeled": "h2",
    "relevance human labeled #2": "h2",
    "support human labeled": "support_human",
}
_CSV = {"header": True, "multiLine": True, "escape": '"'}

_TYPES = {"orig_idx": "long", "run_id": "long", "support": "long", "pred_attack": "int", "pred_support": "int",
          "pred_neither": "int", "pred_relevance": "double", "h1": "double", "h2": "double",
          "support_human": "long", "relevance": "double"}


def _typed(df: DataFrame, renames: dict[str, str], as_stored=()) -> DataFrame:
    cols = []
    for c in df.columns:
        name = renames.get(c, c)
        e = F.col(f"`{c}`")
        if name in _TYPES and name not in as_stored:
            # int(float(v)) semantics: '1.0' -> 1; junk -> null, never an error.
            # Whole numbers are tried first: a double would change ids above 2^53.
            number = e.try_cast("double")
            e = number if _TYPES[name] == "double" else F.coalesce(e.try_cast(_TYPES[name]), number.try_cast(_TYPES[name]))
        cols.append(e.alias(name))
    return df.select(*cols)


def read_predictions(spark: SparkSession, path: str, fmt: str | None = None, runs="current") -> DataFrame:
    """Read per-pair predictions into the canonical prediction columns: a folder of committed runs
    (``runs``: the current ones, 'all', or a list of run ids), or a plain file or folder (CSV
    with the published header, or Parquet, told by the files unless ``fmt`` says).  ``pair_id`` is the
    original index as text when the file has no pair id."""
    as_stored = ()
    if run_store.is_store(spark, path):
        df, as_stored = run_store.read_runs_of(spark, path, runs), ("run_id",)  # a run's id may be any text
    elif (fmt or stored_format(spark, path)) == "parquet":
        df = spark.read.parquet(path)
    else:
        df = spark.read.options(**_CSV).option("inferSchema", False).csv(path)
    df = _typed(df, PREDICTION_RENAMES, as_stored)
    if "pair_id" not in df.columns and "orig_idx" in df.columns:
        df = df.withColumn("pair_id", F.col("orig_idx").cast("string"))
    return df


def read_human_labels(spark: SparkSession, path: str) -> DataFrame:
    """Read a label file: BOM dropped by the CSV reader, both header spellings
    mapped to ``h1`` / ``h2`` / ``support_human``."""
    df = spark.read.options(**_CSV).option("encoding", "UTF-8").csv(path)
    # A leading BOM may survive on the first header depending on the reader.
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return _typed(df, LABEL_RENAMES)
