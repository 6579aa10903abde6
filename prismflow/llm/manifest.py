"""A small state beside a folder's runs: one JSON file for each change, put in place whole, of which the last counts.

Names of batches stand inside the state, never in a path, so they may be any text. One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Manifest:
    """The state in a folder that all executors share; files that no state names, of a writer that failed, are never read."""

    def __init__(self, spark: SparkSession, folder: str, empty: dict):
        self.spark, self.folder, self.empty = spark, folder, empty

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def read(self) -> dict:
        path, fs = self._at("manifests")
        names = sorted(n for x in (fs.listStatus(path) if fs.exists(path) else []) if (n := x.getPath().getName()).endswith(".json"))
        if not names:
            return {"number": 0} | self.empty
        return json.loads(self.spark.sparkContext.wholeTextFiles(f"{self.folder}/manifests/{names[-1]}", 1).first()[1])

    def commit(self, state: dict, **changes) -> dict:
        """Put a state in place that follows the given one; RuntimeError if another did so first."""
        new = state | changes | {"number": state["number"] + 1}
        made, fs = self._at(f"manifests/{uuid.uuid4().hex}.tmp")
        target, _ = self._at(f"manifests/{new['number']:09d}.json")
        out = fs.create(made)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(made, target):
            raise RuntimeError(f"another writer has changed {self.folder}")
        return new

    def delete(self, names: list[str]) -> None:
        """Delete runs that no state names any more."""
        for name in names:
            path, fs = self._at(name)
            fs.delete(path, True)
