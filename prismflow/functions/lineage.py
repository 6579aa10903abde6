"""Cut a plan's lineage where later stages read it several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir (a temporary one in local sessions)."""
    return f"{_root(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def _root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="prismflow-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def cut(frame: DataFrame) -> DataFrame:
    """The frame written as Parquet to the folder that all executors share, and read again by columns."""
    spark, path = frame.sparkSession, scratch(frame.sparkSession, "cut")
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
