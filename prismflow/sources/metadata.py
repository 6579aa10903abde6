"""Metadata CSV: text cells, trimmed, then cast strictly to declared kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("category", "string", "number", "integer", "datetime")
#: Directives of strftime patterns and what they are in Spark's.
_PATTERN = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%f": "SSSSSS"}


def spark_pattern(pattern: str) -> str:
    """A strftime pattern as Spark writes it."""
    for a, b in _PATTERN.items():
        pattern = pattern.replace(a, b)
    if "%" in pattern:
        raise ValueError(f"unsupported directive in {pattern}")
    return pattern


def _typed(text: Column, kind: str, pattern: str | None) -> Column:
    if kind in ("category", "string"):
        return text
    if kind == "number":
        return text.try_cast("double")
    if kind == "integer":
        return text.try_cast("long")
    if kind == "datetime":
        return F.try_to_timestamp(text, F.lit(spark_pattern(pattern))).cast("timestamp_ntz") if pattern else text.try_cast("timestamp_ntz")
    raise ValueError(f"unknown kind: {kind}")


def read_metadata(spark: SparkSession, path: str, key: str, columns: dict[str, str], patterns: dict[str, str] | None = None) -> DataFrame:
    """stem and the declared columns. Empty cells are null; a cell that does not fit its kind, an empty or a repeated key is a ValueError."""
    raw = spark.read.option("header", True).option("inferSchema", False).option("encoding", "UTF-8").csv(path)
    raw = raw.toDF(*[c.removeprefix("\ufeff") for c in raw.columns])  # a byte-order mark
    lacking = [c for c in (key, *columns) if c not in raw.columns]
    if lacking:
        raise ValueError(f"columns are missing: {', '.join(lacking)}")
    cell = lambda c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
    text = raw.select(cell(key).alias("stem"), *[cell(c).alias(c) for c in columns])
    out = text.select("stem", *[_typed(F.col(f"`{c}`"), kind, (patterns or {}).get(c)).alias(c) for c, kind in columns.items()])
    lost = [F.count_if(F.col(f"t.`{c}`").isNotNull() & F.col(f"o.`{c}`").isNull()).alias(c) for c in columns]
    facts = text.select(F.struct("*").alias("t"), F.struct("stem", *[_typed(F.col(f"`{c}`"), kind, (patterns or {}).get(c)).alias(c) for c, kind in columns.items()]).alias("o"))
    found = facts.agg(F.count_if(F.col("t.stem").isNull()).alias("__empty"), F.count(F.lit(1)).alias("__n"), F.count_distinct("t.stem").alias("__keys"), *lost).first()
    if found["__empty"] or found["__n"] != found["__keys"]:
        raise ValueError("keys must be unique and not empty")
    wrong = [c for c in columns if found[c]]
    if wrong:
        raise ValueError(f"cells do not fit their kind: {', '.join(wrong)}")
    return out
