"""What files there are and what is in them, found by Spark on any file system that it reads.

Listing reads no file. Files that are new or changed are read once, by tasks: row counts and wavelengths come
from a file's footer, segments from its Time, Step and Sequence columns; wavelength columns are not decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismflow.functions.names import META, wavelength_of

SUMMARY = (
    "path string, n_wavelengths long, wavelength_min double, wavelength_max double, time_min double, time_max double, n_rows long, "
    "segments array<struct<Step:long,Sequence:long,n_rows:long,step_time_max:double>>, problem string"
)


def list_files(spark: SparkSession, root: str, pattern: str = "**/*.parquet") -> DataFrame:
    """path, size and mtime_ns (to the millisecond) of files under a folder whose names match a pattern; with `**/` at any depth."""
    deep, name = "/" in pattern, pattern.rsplit("/", 1)[-1]
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root)
    path = F.regexp_replace("path", "^file:/+", "/")
    rows = found.select(path.alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))
    if deep:
        return rows
    base = root.split("://")[-1].rstrip("/")
    return rows.filter(F.regexp_replace("path", r"/[^/]*$", "").endswith(base))


def _segments(time: np.ndarray, step: np.ndarray, sequence: np.ndarray) -> list[dict]:
    """Rows and the largest StepTime of each (Step, Sequence): the time since its run of rows began."""
    order = np.argsort(time, kind="stable")
    time, step, sequence = time[order], step[order], sequence[order]
    begins = np.ones(len(time), dtype=bool)
    begins[1:] = (step[1:] != step[:-1]) | (sequence[1:] != sequence[:-1])
    since = time - time[begins][np.cumsum(begins) - 1] if len(time) else time
    out: dict[tuple, list[float]] = {}
    for key, t in zip(zip(step.tolist(), sequence.tolist()), since.tolist()):
        n, most = out.get(key, (0, 0.0))
        out[key] = [n + 1, max(most, t)]
    return [{"Step": int(a), "Sequence": int(b), "n_rows": n, "step_time_max": most} for (a, b), (n, most) in out.items()]


def _summary(content) -> dict:
    file = pq.ParquetFile(pa.BufferReader(content))
    names = file.schema_arrow.names
    if lacking := [m for m in META if m not in names]:
        raise ValueError(f"required columns are missing: {', '.join(lacking)}")
    waves = [wavelength_of(n) for n in names if n not in META]
    if not waves:
        raise ValueError("there is no wavelength column")
    points = file.read(columns=list(META))
    time, step, sequence = (points[m].to_numpy().astype(float) for m in META)
    ends = (float(time.min()), float(time.max())) if len(time) else (None, None)
    return {"n_wavelengths": len(waves), "wavelength_min": min(waves), "wavelength_max": max(waves), "time_min": ends[0], "time_max": ends[1], "n_rows": file.metadata.num_rows, "segments": _segments(time, step, sequence)}


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("Step", pa.int64()), ("Sequence", pa.int64()), ("n_rows", pa.int64()), ("step_time_max", pa.float64())]))
    schema = pa.schema([("path", pa.string()), ("n_wavelengths", pa.int64()), *[(c, pa.float64()) for c in ("wavelength_min", "wavelength_max", "time_min", "time_max")], ("n_rows", pa.int64()), ("segments", kind), ("problem", pa.string())])
    for batch in batches:
        rows = []
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            try:
                rows.append({"path": path} | _summary(content.as_buffer()))
            except (ValueError, OSError, pa.ArrowException) as e:  # told with the file's name, see summaries()
                rows.append({"path": path, "problem": str(e)[:200]})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def summaries(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A row for each file: wavelengths, time range, rows and segments, or what is wrong with it."""
    found = spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")
    return found.mapInArrow(_summaries, SUMMARY)
