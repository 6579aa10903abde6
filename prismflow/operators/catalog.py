"""Dataset catalog and run registry: summaries, incremental scan, metadata, runs.

Tables are Parquet versions in a folder or URI; a change writes a new version and then moves one small pointer
file. One writer at a time.
"""

from __future__ import annotations

import json
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismflow.functions.folders import exists, located, read_text, write_text
from prismflow.functions.lineage import cut
from prismflow.sources.listing import list_files, summaries

FILES = "stem string, path string, size long, mtime_ns long, n_wavelengths long, wavelength_min double, wavelength_max double, time_min double, time_max double, n_rows long"
SEGMENTS = "stem string, Step long, Sequence long, n_rows long, step_time_max double"
RUNS = "run_id string, kind string, created_at double, status string, config_json string, error string, updated_at double"


def file_summary(frame: DataFrame) -> DataFrame:
    """Per source: wavelengths, time range and rows of a long table."""
    return frame.groupBy("source").agg(
        F.count_distinct("wavelength").alias("n_wavelengths"), F.min("wavelength").alias("wavelength_min"), F.max("wavelength").alias("wavelength_max"),
        F.min("Time").alias("time_min"), F.max("Time").alias("time_max"), F.count_distinct("row_index").alias("n_rows"),
    )


def segment_summary(timed: DataFrame) -> DataFrame:
    """Per source, Step and Sequence: rows and the largest StepTime."""
    points = timed.select("source", "row_index", "Step", "Sequence", "StepTime").distinct()
    return points.groupBy("source", "Step", "Sequence").agg(F.count(F.lit(1)).alias("n_rows"), F.max("StepTime").alias("step_time_max"))


def catalog_list(files: DataFrame, segments: DataFrame, metadata: DataFrame, key: str = "source") -> DataFrame:
    """Files with numbers of steps and segments, and their metadata where there is any."""
    counts = segments.groupBy(key).agg(F.count_distinct("Step").alias("n_steps"), F.count(F.lit(1)).alias("n_segments"))
    return files.join(counts, key, "left").join(metadata, key, "left")


def catalog_diff(old: DataFrame, new: DataFrame, key: str, identity: list[str]) -> DataFrame:
    """key and state of every entry on either side: new, changed, gone or same, by the identity columns."""
    a = old.select(key, F.struct(*identity).alias("was"))
    b = new.select(key, F.struct(*identity).alias("now"))
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("was") == F.col("now"), "same").otherwise("changed")
    return a.join(b, key, "full").select(key, state.alias("state"))


def existing_stems(files: DataFrame, stems) -> DataFrame:
    """Those of the given stems, a list or a table's column stem, that the catalog has."""
    if isinstance(stems, DataFrame):
        return files.select("stem").distinct().join(stems.select("stem"), "stem", "left_semi")
    return files.filter(F.col("stem").isin(list(stems))).select("stem").distinct()


def selection_ranges(frame: DataFrame) -> DataFrame:
    """One row: the ranges of wavelengths and times of a long table, and its steps in order."""
    ends = [f(c).alias(f"{c.lower()}_{n}") for c in ("wavelength", "Time") for n, f in (("min", F.min), ("max", F.max))]
    return frame.agg(*ends, F.array_sort(F.collect_set("Step")).alias("steps"))


def segment_rows(timed: DataFrame, step: int, sequence: int) -> DataFrame:
    """Rows of one (Step, Sequence) in StepTime order; ValueError where there is none."""
    rows = timed.filter((F.col("Step") == step) & (F.col("Sequence") == sequence))
    if not rows.limit(1).count():
        raise ValueError(f"no rows of step {step}, sequence {sequence}")
    return rows.orderBy("StepTime")


class Catalog:
    """files, segments, file_metadata and runs in a folder."""

    def __init__(self, spark: SparkSession, folder: str | Path):
        self.spark, self.folder = spark, located(folder)

    def _pointer(self) -> dict:
        return json.loads(read_text(self.spark, f"{self.folder}/current.json") or "{}")

    def _swap(self, changes: dict) -> None:
        write_text(self.spark, f"{self.folder}/current.json", json.dumps(self._pointer() | changes))

    def _write(self, df: DataFrame, name: str) -> str:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def table(self, name: str, schema: str) -> DataFrame:
        path = self._pointer().get(name)
        return self.spark.read.schema(schema).parquet(path) if path else self.spark.createDataFrame([], schema)

    @property
    def files(self) -> DataFrame:
        return self.table("files", FILES)

    @property
    def segments(self) -> DataFrame:
        return self.table("segments", SEGMENTS)

    def update(self, root: str | Path, glob: str = "**/*.parquet") -> int:
        """Read new and changed files under a folder or URI, forget those that went; the number of files read."""
        stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
        now = cut(list_files(self.spark, located(root), glob).withColumn("stem", stem))
        if now.groupBy("stem").count().filter("count > 1").limit(1).count():
            raise ValueError("file stems must be unique")
        state = cut(catalog_diff(self.files.select("stem", "path", "size", "mtime_ns"), now, "stem", ["path", "size", "mtime_ns"]))
        stay = state.filter("state = 'same'").select("stem")
        files, segments = self.files.join(stay, "stem", "left_semi"), self.segments.join(stay, "stem", "left_semi")
        fresh = now.join(state.filter("state in ('new', 'changed')"), "stem", "left_semi")
        paths = sorted(r["path"] for r in fresh.select("path").collect())  # of files to read, as Spark's reader takes them
        if paths:
            found = cut(summaries(self.spark, paths))
            wrong = found.filter("problem is not null").agg(F.min(F.struct("path", "problem"))).first()[0]
            if wrong:
                raise ValueError(f"{wrong['path']}: {wrong['problem']}")
            found = found.join(fresh, "path")
            files = files.unionByName(found.select(*[c.split()[0] for c in FILES.split(", ")]))
            segments = segments.unionByName(found.select("stem", F.inline("segments")))
        self._swap({"files": self._write(files, "files"), "segments": self._write(segments, "segments")})
        return len(paths)

    def set_metadata(self, table: DataFrame) -> None:
        """Replace metadata (stem and any columns)."""
        self._swap({"metadata": self._write(table, "metadata"), "metadata_schema": table._jdf.schema().toDDL()})

    @property
    def metadata(self) -> DataFrame:
        pointer = self._pointer()
        return self.table("metadata", pointer.get("metadata_schema", "stem string"))

    def listing(self) -> DataFrame:
        return catalog_list(self.files, self.segments, self.metadata, "stem")

    def without_metadata(self) -> DataFrame:
        return self.files.join(self.metadata, "stem", "left_anti").select("stem")

    def without_file(self) -> DataFrame:
        return self.metadata.join(self.files, "stem", "left_anti").select("stem")

    # -- runs: an append-only log of states, the latest of each run counts ------------------------------
    def log_run(self, kind: str, status: str, config: dict | None = None, run_id: str | None = None, error: str = "") -> str:
        """Record a run's state; a new run gets an id."""
        run_id, now = run_id or uuid.uuid4().hex, time.time()
        row = self.spark.createDataFrame([(run_id, kind, now, status, json.dumps(config or {}), error[:200], now)], RUNS)
        row.coalesce(1).write.mode("append").parquet(f"{self.folder}/runs")
        return run_id

    def runs(self) -> DataFrame:
        """The latest state of each run, newest runs first."""
        if not exists(self.spark, f"{self.folder}/runs"):
            return self.spark.createDataFrame([], RUNS)
        log = self.spark.read.schema(RUNS).parquet(f"{self.folder}/runs")
        state = F.max(F.struct("updated_at", "status", "error")).alias("s")
        first = F.min(F.struct("created_at", "config_json")).alias("f")
        return log.groupBy("run_id").agg(state, first, F.max("kind").alias("kind")).select("run_id", "kind", "f.created_at", "s.status", "f.config_json", "s.error").orderBy(F.desc("created_at"))

    def find_run(self, kind: str, config: dict) -> str | None:
        """A succeeded run of the same kind and settings, the newest, or None. Settings of a transform run hold the identities of its files, see identities()."""
        same = self.runs().filter((F.col("kind") == kind) & (F.col("config_json") == json.dumps(config)) & (F.col("status") == "succeeded"))
        row = same.orderBy(F.desc("created_at")).first()
        return row["run_id"] if row else None

    def identities(self, stems) -> list[list]:
        """Path, size and time of change of catalogued files in stem order: what a run over them depends on."""
        rows = self.files.join(existing_stems(self.files, stems), "stem", "left_semi").orderBy("stem").collect()
        return [[r["path"], r["size"], r["mtime_ns"]] for r in rows]

    def find_transform(self, fit_run: str, stems, settings: dict) -> str | None:
        """A succeeded transform of the same fit run, settings and files as these are now, or None."""
        return self.find_run("transform", self.transform_config(fit_run, stems, settings))

    def transform_config(self, fit_run: str, stems, settings: dict) -> dict:
        """What to record with a transform run, so that find_transform() finds it."""
        return {"fit_run": fit_run, "files": self.identities(stems), "settings": settings}

    def fail_interrupted(self) -> int:
        """Runs that were left running are failed; their number."""
        left = [r["run_id"] for r in self.runs().filter(F.col("status").isin("running", "queued")).collect()]
        for run_id in left:
            self.log_run("", "failed", run_id=run_id, error="interrupted")
        return len(left)
