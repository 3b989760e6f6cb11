"""Files beside Spark's own readers and writers: in tasks by pyarrow, on the driver by Hadoop's file systems."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def local_path(path: str) -> str:
    return path[len("file:"):] if path.startswith("file:") else path


def file_system(path: str):
    """(pyarrow file system, path in it) of a local path or a URI; for use in tasks."""
    import pyarrow.fs as pafs
    if "://" in path and not path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), "/" + local_path(path).strip("/")


def hadoop(spark: SparkSession, path: str):
    """(Hadoop file system, Path) of ``path``; for use on the driver."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = hadoop(spark, path)
    return fs.exists(where)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    fs, where = hadoop(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []


def write_whole(spark: SparkSession, path: str, text: str) -> None:
    """A text file that others see whole or not at all: written under a hidden name, then renamed."""
    fs, where = hadoop(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    if not fs.rename(aside, where):
        fs.delete(aside, False)
        raise OSError(f"cannot write {path}")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder or file that this library wrote."""
    fs, where = hadoop(spark, path)
    fs.delete(where, True)
