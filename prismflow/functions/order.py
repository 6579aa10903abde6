"""Places of rows in an order, without a window over all of them."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismflow.functions.lineage import cut
from prismflow.functions.names import new_name

_PLACES = 33  # bits of monotonically_increasing_id() below the partition's number


def numbered(frame: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """The rows with their place (from 1) in ascending order of columns, nulls first; rows alike in these in any order.

    Ranges of the order are sorted as partitions and stored with each row's place in its own; places over all need
    only the partitions' numbers of rows, one number for each.
    """
    spark, at = frame.sparkSession, new_name()
    stored = cut(frame.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftright(at, _PLACES)
    sizes = sorted((r[0], r[1]) for r in stored.groupBy(part).count().collect())
    before = [0, *accumulate(n for _, n in sizes)]
    inside = F.col(at).bitwiseAND(F.lit((1 << _PLACES) - 1))
    if len(sizes) <= 1:
        return stored.withColumn(name, inside + 1).drop(at)
    key, offset = new_name(), new_name()
    offsets = spark.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], f"{key} long, {offset} long")
    placed = stored.join(offsets, part == F.col(key))
    return placed.withColumn(name, inside + F.col(offset) + 1).drop(at, key, offset)
