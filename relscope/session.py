"""Session construction and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on: ANSI arithmetic (division by zero raises, so the
# operators use try_divide), UTC timestamps (so the DuckDB oracle agrees), and
# AQE so shuffle partition counts follow the data at run time.
_BASE_CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int | None = None,
                  app_name: str = "relscope", extra: dict | None = None) -> SparkSession:
    """Session for local runs and tests.  On a cluster, use the cluster's
    session: shuffle partitions are then left to the cluster default and AQE
    (coalescing, skew-join splitting) sizes them from the measured data."""
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(_BASE_CONF)
    if shuffle_partitions is None and master.startswith("local"):
        inner = master[master.find("[") + 1:master.find("]")] if "[" in master else "1"
        shuffle_partitions = os.cpu_count() if inner == "*" else int(inner)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a fresh local one only when unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        # Only local runs and tests may get a machine-local folder; a cluster
        # must name a shared one, or written intermediates would be lost with
        # the executor that wrote them.
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="relscope-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new, unique path (not yet created) below the shared checkpoint folder.

    Used for written intermediate tables (cutting lineage) and for the
    round trips of the source / sink queries.  Never a machine-local temp dir
    unless the session names none.
    """
    root = _checkpoint_root(spark)
    return os.path.join(root, "relscope", f"{name}-{uuid.uuid4().hex[:12]}")


def persisted(df, name: str):
    """Write a frame (replies, or any intermediate worth keeping) to the shared
    checkpoint folder and read it back: it is computed once, the lineage is cut, and a lost
    executor later never recomputes what is behind it."""
    path = scratch_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def values_frame(spark: SparkSession, rows, schema: str):
    """A small fixed table as a JVM-side local relation (SQL VALUES).

    Unlike ``createDataFrame`` on a Python list, no Python worker is involved
    when the plan runs, and Catalyst sees the exact size (so it can broadcast)."""
    cols = [c.strip().split(" ", 1) for c in schema.split(",")]
    names = [c[0] for c in cols]
    casts = ", ".join(f"CAST(`{n}` AS {t}) AS `{n}`" for n, t in cols)
    if not rows:
        nulls = ", ".join(f"CAST(NULL AS {t}) AS `{n}`" for n, t in cols)
        return spark.sql(f"SELECT {nulls} WHERE FALSE")
    vals = ", ".join("(" + ", ".join(_sql_literal(v) for v in r) + ")" for r in rows)
    alias = ", ".join(f"`{n}`" for n in names)
    return spark.sql(f"SELECT {casts} FROM VALUES {vals} AS t({alias})")


_SHIPPED: set[str] = set()
#: Bytes of an Arrow batch on its way to Python: by rows alone, 10,000 long texts are held at once by the JVM and by Python.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def ship_package(spark: SparkSession) -> None:
    """Make ``relscope`` importable in the Python workers (``addPyFile`` of a
    zip of the package, once per application) -- what ``--py-files`` does
    when the package is not installed on the executors.  Arrow batches are
    bounded by ``BATCH_BYTES`` unless the session names a bound of its own."""
    if spark.conf.get(BATCH_BYTES[0], None) is None:
        spark.conf.set(*BATCH_BYTES)
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import zipfile

    import relscope
    pkg = os.path.dirname(os.path.abspath(relscope.__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="relscope-pyfiles-"), "relscope.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(app)
