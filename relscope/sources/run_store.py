"""Predictions of many runs in one folder, as committed versions.

    path/_versions/__version=<v>/__run=<run id>/strategy=<s>/part-...   staged rows
    path/_commits/<seq>-<v>.json                                        one commit: its runs

Rows are staged by an ordinary Spark write under a version of their own; then
one small file, renamed into place, makes all its runs visible at once.  A
write that dies before that (or halfway) leaves files that no reader ever
lists.  Writing a run again adds a commit that replaces that run's rows and
no other's, so runs of several models live side by side.

Readers see committed runs only: all of them, chosen ones, or (the default) the
current ones, that is for each strategy what the last commit holding it wrote.
A commit stores its schema, so reading needs no look at file footers.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relscope.sources import files

VERSIONS, COMMITS = "_versions", "_commits"
_CSV = {"header": True, "escape": '"', "quoteAll": False, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


@dataclass(frozen=True)
class Commit:
    """One commit: its place in the order, version, format, schema and rows by (run, strategy)."""

    seq: int
    version: str
    fmt: str
    schema: T.StructType
    rows: dict[tuple[str, str], int]
    meta: dict


def is_store(spark: SparkSession, path: str) -> bool:
    return files.exists(spark, f"{path.rstrip('/')}/{COMMITS}")


def commits(spark: SparkSession, path: str) -> list[Commit]:
    """All commits in order: one small file a write, so the driver reads as many as there were writes."""
    folder = f"{path.rstrip('/')}/{COMMITS}"
    if not files.exists(spark, folder):
        return []
    if not any(n.endswith(".json") for n in files.names(spark, folder)):
        return []
    found = []
    for line in spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(folder).collect():
        c = json.loads(line[0])
        rows = {(r["run"], r["strategy"]): r["rows"] for r in c["runs"]}
        found.append(Commit(c["seq"], c["version"], c["format"], T.StructType.fromJson(c["schema"]), rows, c["meta"]))
    return sorted(found, key=lambda c: (c.seq, c.version))


def commit_runs(df: DataFrame, path: str, fmt: str = "parquet", run_id: str | None = None, meta: dict | None = None) -> str:
    """Writes the rows of one or more runs and commits them; returns the version.

    ``df`` has ``strategy`` and, unless ``run_id`` names the one run, may have a
    ``run_id`` column with many; without either the version is the run's id.
    Each run in ``df`` replaces its own earlier rows, all strategies of it."""
    spark, root = df.sparkSession, path.rstrip("/")
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    if run_id is not None:
        df = df.withColumn("run_id", F.lit(run_id))
    elif "run_id" not in df.columns:
        df = df.withColumn("run_id", F.lit(version))
    if "strategy" not in df.columns:
        raise ValueError("Predictions need a strategy column")
    folder = f"{root}/{VERSIONS}/__version={version}"
    staged = df.withColumn("__run", F.coalesce(F.col("run_id").cast("string"), F.lit("")))
    # The strategy names the folder and stays in the rows, like the run.
    staged = staged.withColumn("__strategy", F.coalesce("strategy", F.lit("")))
    # One file or few a run and strategy, and a large run in many: AQE merges and splits what the hint deals out.
    w = staged.hint("rebalance", "__run", "__strategy").write.partitionBy("__run", "__strategy").format(fmt)
    (w.options(**_CSV) if fmt == "csv" else w).save(folder)
    schema = df.schema
    back = _read(spark, [folder], f"{root}/{VERSIONS}", fmt, schema).groupBy("__run", "__strategy").count()
    runs = [{"run": r[0] or "", "strategy": r[1] or "", "rows": r[2]} for r in back.collect()]  # one row a run and strategy
    _publish(spark, root, version, fmt, schema, runs, meta or {})
    return version


def _publish(spark: SparkSession, root: str, version: str, fmt: str, schema: T.StructType, runs: list[dict], meta: dict) -> None:
    before = [int(n.split("-")[0]) for n in files.names(spark, f"{root}/{COMMITS}") if n.endswith(".json")]
    seq = max(before, default=0) + 1
    fs, where = files.hadoop(spark, f"{root}/{COMMITS}")
    fs.mkdirs(where)
    told = {"seq": seq, "version": version, "format": fmt, "schema": schema.jsonValue(), "runs": runs, "meta": meta}
    files.write_whole(spark, f"{root}/{COMMITS}/{seq:012d}-{version}.json", json.dumps(told))


def _read(spark: SparkSession, folders: list[str], base: str, fmt: str, schema: T.StructType) -> DataFrame:
    names = [T.StructField(c, T.StringType()) for c in ("__version", "__run", "__strategy")]
    if fmt != "csv":
        return spark.read.schema(T.StructType([*schema, *names])).option("basePath", base).format(fmt).load(folders)
    texts = [T.StructField(f.name, T.StringType()) for f in schema]
    rows = spark.read.schema(T.StructType([*texts, *names])).option("basePath", base).options(**_CSV, multiLine=True).csv(folders)
    return rows.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema], *[n.name for n in names])


def visible(spark: SparkSession, path: str, runs="current") -> dict[tuple[str, str], Commit]:
    """(run, strategy) -> the commit that holds its rows now.  ``runs``: 'current', 'all' or a list of run ids."""
    last_of_run: dict[str, Commit] = {}
    last_of_strategy: dict[str, Commit] = {}
    for c in commits(spark, path):
        for run, strategy in c.rows:
            last_of_run[run] = c
            last_of_strategy[strategy] = c
    out = {}
    for run, c in last_of_run.items():
        for r, strategy in c.rows:
            if r != run:
                continue
            if runs == "all" or (runs == "current" and last_of_strategy[strategy] is c) or (not isinstance(runs, str) and run in {str(x) for x in runs}):
                out[(run, strategy)] = c
    return out


def _escaped(spark: SparkSession, value: str) -> str:
    """A partition value as Spark writes it in a folder's name."""
    catalog = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    return catalog.escapePathName(value) if value else catalog.DEFAULT_PARTITION_NAME()


def read_runs_of(spark: SparkSession, path: str, runs="current") -> DataFrame:
    """Rows of the visible runs, columns aligned by name over the commits (missing ones null).

    Folders are chosen by the commits, not listed, so files of torn, replaced
    or concurrent writes are never met; scans of one format and schema are one relation."""
    root = path.rstrip("/")
    chosen = visible(spark, root, runs)
    kinds: dict[tuple[str, str], tuple[T.StructType, list[str]]] = {}
    for (run, strategy), c in sorted(chosen.items(), key=lambda kv: (kv[1].seq, kv[0])):
        folder = f"{root}/{VERSIONS}/__version={c.version}/__run={_escaped(spark, run)}/__strategy={_escaped(spark, strategy)}"
        kinds.setdefault((c.fmt, c.schema.json()), (c.schema, []))[1].append(folder)
    parts = [_read(spark, folders, f"{root}/{VERSIONS}", fmt, schema).drop("__version", "__run", "__strategy")
             for (fmt, _), (schema, folders) in kinds.items()]
    if not parts:
        every = commits(spark, root)
        return spark.createDataFrame([], every[-1].schema if every else "run_id string, strategy string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def list_runs(spark: SparkSession, path: str) -> DataFrame:
    """One row per visible run and strategy: run, strategy, rows, seq, version, current, meta (JSON)."""
    now = visible(spark, path, "current")
    rows = [(run, s, c.rows[(run, s)], c.seq, c.version, (run, s) in now, json.dumps(c.meta, sort_keys=True))
            for (run, s), c in sorted(visible(spark, path, "all").items())]
    return spark.createDataFrame(rows, "run string, strategy string, rows long, seq long, version string, current boolean, meta string")


def vacuum(spark: SparkSession, path: str, older_than_seconds: float = 86_400) -> list[str]:
    """Deletes version folders that no visible run needs (torn writes, replaced runs) and that were started
    longer ago than that, so a write under way keeps its rows.  Returns their names."""
    root = path.rstrip("/")
    needed = {c.version for c in visible(spark, root, "all").values()}
    gone = []
    for name in files.names(spark, f"{root}/{VERSIONS}"):
        version = name.split("=", 1)[-1]
        if version not in needed and int(version.split("-")[0]) < time.time_ns() - older_than_seconds * 1e9:
            files.remove(spark, f"{root}/{VERSIONS}/{name}")
            gone.append(version)
    return gone
