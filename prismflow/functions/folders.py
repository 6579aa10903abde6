"""Small text files in any file system that Spark writes to."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def located(folder: str | Path) -> str:
    """A folder as Spark takes it: URIs as they are, local paths made absolute."""
    return str(folder).rstrip("/") if "://" in str(folder) else Path(folder).absolute().as_posix()


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path if "://" in path else f"file://{path}")
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A file's text, or None where there is none."""
    at, fs = _at(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Put a file in place whole, over one that is there: readers see the old text or the new."""
    made, fs = _at(spark, f"{path}-{uuid.uuid4().hex}.tmp")
    out = fs.create(made)
    out.write(bytearray(text.encode()))
    out.close()
    target, _ = _at(spark, path)
    old, _ = _at(spark, f"{path}-{uuid.uuid4().hex}.old")
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"{path} cannot be replaced")
    if not fs.rename(made, target):
        raise OSError(f"{path} cannot be written")
    fs.delete(old, False)
