"""The format of stored tables, told by their files."""

from __future__ import annotations

from pyspark.sql import SparkSession


def stored_format(spark: SparkSession, path: str) -> str:
    """'parquet' if the first data file at ``path`` (a file or a folder, partitioned or not) is one, else 'csv'."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True)
    while files.hasNext():
        name = files.next().getPath().getName()
        if not name.startswith(("_", ".")):
            return "parquet" if name.endswith(".parquet") else "csv"
    return "parquet" if path.rstrip("/").endswith(".parquet") else "csv"
