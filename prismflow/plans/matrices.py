"""Dense matrices as stored blocks: samples by features, or components by features, read by ranges of rows.

A matrix is Parquet rows of blocks, each with its place and its numbers as bytes, in the order of row ranges, so
that a reader of some rows skips files and row groups by their statistics. Beside it lies the table of its rows'
names, and a small file of its shape. Numbers are kept as float64 or float32; missing ones are NaN.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismflow.functions.folders import located, read_text, write_text
from prismflow.functions.lineage import cut
from prismflow.functions.order import numbered
from prismflow.operators.pca import PcaModel

#: Rows and features of a block: 2 MB of float64.
ROWS, FEATURES = 256, 1024
KINDS = ("float64", "float32")
BLOCK = "row_block long, first_row long, n_rows int, first_feature long, n_features int, data binary"


@dataclass(frozen=True)
class Matrix:
    """A stored matrix: rows from 1 in the order of their names, features from 1."""

    spark: SparkSession
    folder: str
    n_rows: int
    n_features: int
    kind: str
    block_rows: int
    block_features: int

    @staticmethod
    def open(spark: SparkSession, folder: str | Path) -> Matrix:
        text = read_text(spark, f"{located(folder)}/shape.json")
        if text is None:
            raise FileNotFoundError(f"{folder}: there is no matrix")
        return Matrix(spark, located(folder), **json.loads(text))

    @property
    def names(self) -> DataFrame:
        """row and source."""
        return self.spark.read.parquet(f"{self.folder}/names")

    def blocks(self, first: int = 1, stop: int | None = None, features: tuple[int, int] | None = None) -> DataFrame:
        """The blocks that hold rows first to stop - 1 and features of a closed range; no others are read."""
        stop = self.n_rows + 1 if stop is None else stop
        found = self.spark.read.schema(BLOCK).parquet(f"{self.folder}/blocks")
        found = found.filter(F.col("row_block").between((first - 1) // self.block_rows, (stop - 2) // self.block_rows))
        if features is not None:
            found = found.filter((F.col("first_feature") <= features[1]) & (F.col("first_feature") > features[0] - self.block_features))
        return found

    def read(self, first: int = 1, stop: int | None = None, features: tuple[int, int] | None = None) -> DataFrame:
        """source, feature_id and value of rows first to stop - 1, null where missing."""
        stop = self.n_rows + 1 if stop is None else stop
        low, high = features or (1, self.n_features)
        kind = np.dtype(self.kind)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in batch.to_pylist():
                    x = np.frombuffer(b["data"], dtype=kind).reshape(b["n_rows"], b["n_features"])
                    rows = np.arange(b["first_row"], b["first_row"] + len(x))
                    ids = np.arange(b["first_feature"], b["first_feature"] + x.shape[1])
                    some, ours = (rows >= first) & (rows < stop), (ids >= low) & (ids <= high)
                    x = x[some][:, ours].astype(np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows[some], ours.sum())), pa.array(np.tile(ids[ours], some.sum())), pa.array(x.reshape(-1), from_pandas=True)], names=["row", "feature_id", "value"])

        cells = self.blocks(first, stop, features).mapInArrow(run, "row long, feature_id long, value double")
        return cells.join(self.names, "row").select("source", "feature_id", "value")

    def row(self, number: int) -> np.ndarray:
        """One row's numbers, as stored; it alone, and the others of its blocks, are read."""
        out = np.full(self.n_features, np.nan, dtype=self.kind)
        for b in self.blocks(number, number + 1).collect():  # one for each range of features
            x = np.frombuffer(b["data"], dtype=self.kind).reshape(b["n_rows"], b["n_features"])
            out[b["first_feature"] - 1 : b["first_feature"] - 1 + x.shape[1]] = x[number - b["first_row"]]
        return out


def write_matrix(facts: DataFrame, n_features: int, folder: str | Path, sources: DataFrame | None = None, kind: str = "float64") -> Matrix:
    """Store facts (source, feature_id, value) as a matrix with a row for each source, in source order."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}")
    spark, folder = facts.sparkSession, located(folder)
    names = numbered((facts if sources is None else sources).select("source").distinct(), "source", name="row")
    names.select(F.col("row").cast("long"), "source").write.mode("overwrite").parquet(f"{folder}/names")
    names = spark.read.parquet(f"{folder}/names")
    n_rows = names.count()
    # every row has a cell in each range of features, so that a row or range without any value is there too
    ranges = F.explode(F.sequence(F.lit(0), F.lit((n_features - 1) // FEATURES))).alias("column_block")
    marks = names.select("row", ranges, F.lit(None).cast("long").alias("feature_id"), F.lit(None).cast("double").alias("value")) if n_features else names.limit(0).select("row", F.lit(0).alias("column_block"), F.lit(None).cast("long").alias("feature_id"), F.lit(None).cast("double").alias("value"))
    cells = facts.join(names, "source").select("row", F.floor((F.col("feature_id") - 1) / FEATURES).cast("int").alias("column_block"), "feature_id", F.col("value").cast("double").alias("value"))
    cells = cells.unionByName(marks).withColumn("row_block", F.floor((F.col("row") - 1) / ROWS).cast("long"))

    height, length = ROWS, FEATURES

    def dense(group: pa.Table) -> pa.Table:
        block, column = group["row_block"][0].as_py(), group["column_block"][0].as_py()
        row = group["row"].to_numpy() - 1 - block * height
        width = min(length, n_features - column * length)
        x = np.full((int(row.max()) + 1, width), np.nan, dtype=kind)
        there = group["feature_id"].is_valid().to_numpy()
        at = group["feature_id"].drop_null().to_numpy() - 1 - column * length
        x[row[there], at] = group["value"].to_numpy()[there]
        return pa.table({"row_block": [block], "first_row": [block * height + 1], "n_rows": pa.array([len(x)], pa.int32()), "first_feature": [column * length + 1], "n_features": pa.array([width], pa.int32()), "data": pa.array([x.tobytes()], pa.binary())})

    blocks = cut(cells.groupBy("row_block", "column_block").applyInArrow(dense, BLOCK))
    blocks.repartitionByRange("row_block").sortWithinPartitions("row_block", "first_feature").write.mode("overwrite").option("parquet.block.size", 16 << 20).parquet(f"{folder}/blocks")
    shape = {"n_rows": n_rows, "n_features": n_features, "kind": kind, "block_rows": ROWS, "block_features": FEATURES}
    write_text(spark, f"{folder}/shape.json", json.dumps(shape))
    return Matrix.open(spark, folder)


def write_components(spark: SparkSession, model: PcaModel, folder: str | Path, kind: str = "float64") -> Matrix:
    """Store a model's components, a row for each."""
    rows = model.component_table(spark).select(F.col("component").alias("source"), "feature_id", F.col("coefficient").alias("value"))
    return write_matrix(rows, len(model.columns), folder, kind=kind)
