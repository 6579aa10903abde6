"""Exact order statistics of all features at once, by counting in value ranges.

A value becomes a 64-bit integer of the same order, so that ranges are cut by its leading bits. The first round
counts every feature's values by their leading BITS bits; a rank then lies in one range, whose least and greatest
value bound the next round, which cuts what these have not in common. A round leaves of each rank a 2 ** BITS-th
of its range's width or less, so 64 / BITS + 1 rounds are the most; only rows in a range that still holds a
wanted rank are kept for the next. A range of one value is done, one of at most SORTED rows is sorted. No
group ever holds more of a feature's values than that.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismflow.functions.lineage import cut
from prismflow.functions.quantiles import missing

#: Bits by which a round cuts a range; rows of a range that are sorted together, at most.
BITS, SORTED = 12, 4096
_SIGN = np.int64(2**63 - 1)


def nearest_place(q: float) -> Column:
    """Place (from 0) of a quantile among n sorted values: round-half-up of (n - 1) * q."""
    return F.floor((F.col("n") - 1) * F.lit(q) + 0.5)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values as integers of the same order; -0.0 counts as 0.0."""
    for b in batches:
        bits = (b.column("value").to_numpy(zero_copy_only=False) + 0.0).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("feature_id"), pa.array(bits ^ ((bits >> 63) & _SIGN))], names=["feature_id", "k"])


def _valued(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = []
            for name in names:
                k = b.column(name).fill_null(0).to_numpy(zero_copy_only=False)
                columns.append(pa.array((k ^ ((k >> 63) & _SIGN)).view(np.float64), mask=b.column(name).is_null().to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([b.column("feature_id"), *columns], names=["feature_id", *names])

    return run


def _chosen(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """For each rank asked for (feature_id, range, name, place) the part of its range that holds it: lo, hi, rows, and its place there."""
    before = F.sum("rows").over(Window.partitionBy("feature_id", "range").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    parts = counts.withColumn("before", F.coalesce(before, F.lit(0)))
    both = asked.join(parts, ["feature_id", "range"])
    mine = both.filter((F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("rows")))
    return mine.select("feature_id", "name", (F.col("place") - F.col("before")).alias("place"), "lo", "hi", "rows")


def _counted(rows: DataFrame) -> DataFrame:
    """Rows (feature_id, range, bucket, k) counted by bucket, with the least and greatest k of each."""
    return rows.groupBy("feature_id", "range", "bucket").agg(F.count(F.lit(1)).alias("rows"), F.min("k").alias("lo"), F.max("k").alias("hi"))


def quantiles(facts: DataFrame, places: dict[str, Column]) -> DataFrame:
    """feature_id and a column for each name: the value at that place (from 0, an expression of n) of the feature's sorted values.

    Features without values have no row.
    """
    present = facts.filter(~missing("value")).select("feature_id", F.col("value").cast("double").alias("value"))
    kind = facts.schema["feature_id"].dataType.simpleString()
    rows = present.mapInArrow(_keyed, f"feature_id {kind}, k long")
    counts = cut(_counted(rows.select("feature_id", F.lit(0).cast("long").alias("range"), F.shiftright("k", 64 - BITS).alias("bucket"), "k")))
    each = F.inline(F.array(*[F.struct(F.lit(name).alias("name"), place.cast("long").alias("place")) for name, place in places.items()]))
    asked = counts.groupBy("feature_id", "range").agg(F.sum("rows").alias("n")).select("feature_id", "range", each)
    done: list[DataFrame] = []
    while True:
        found = cut(_chosen(counts, asked))
        done.append(found.filter("lo = hi").select("feature_id", "name", F.col("lo").alias("k")))
        left = found.filter("lo < hi")
        sizes = left.agg(F.count(F.lit(1)).alias("n"), F.max("rows").alias("most")).first()
        if not sizes["n"]:
            break
        # ranges of a feature are the same or apart, so a row is in one at most
        cut_at = F.greatest(F.lit(0), F.length(F.bin(F.col("lo").bitwiseXOR(F.col("hi")))) - BITS)
        ranges = left.select("feature_id", F.col("lo").alias("range"), F.col("hi").alias("end"), cut_at.alias("shift"), (F.col("rows") <= SORTED).alias("few")).distinct()
        inside = F.col("k").between(F.col("range"), F.col("end"))
        both = rows.select("feature_id", "k").join(ranges, "feature_id").filter(inside)
        kept = cut(both.select("feature_id", "range", "few", F.expr("shiftright(k, shift)").alias("bucket"), "k"))
        small = kept.filter("few")
        place = (F.row_number().over(Window.partitionBy("feature_id", "range").orderBy("k")) - 1).cast("long")
        wanted = left.filter(F.col("rows") <= SORTED).select("feature_id", F.col("lo").alias("range"), "name", "place")
        done.append(small.select("feature_id", "range", "k", place.alias("place")).join(wanted, ["feature_id", "range", "place"]).select("feature_id", "name", "k"))
        if sizes["most"] <= SORTED:
            break
        rows = kept.filter(~F.col("few"))
        counts = cut(_counted(rows.select("feature_id", "range", "bucket", "k")))
        asked = left.filter(F.col("rows") > SORTED).select("feature_id", F.col("lo").alias("range"), "name", "place")
    names = list(places)
    every = reduce(DataFrame.unionByName, done)
    wide = every.groupBy("feature_id").agg(*[F.max(F.when(F.col("name") == n, F.col("k"))).alias(n) for n in names])
    return cut(wide.mapInArrow(_valued(names), f"feature_id {kind}, " + ", ".join(f"{n} double" for n in names)))


def nearest_quantiles(facts: DataFrame, shares: dict[str, float]) -> DataFrame:
    """feature_id and a column for each name: the value of nearest place to that share."""
    return quantiles(facts, {n: nearest_place(q) for n, q in shares.items()})


def medians(facts: DataFrame) -> DataFrame:
    """feature_id and median: the middle value, or the mean of the two in the middle."""
    both = quantiles(facts, {"below": F.floor((F.col("n") - 1) / 2), "above": F.floor(F.col("n") / 2)})
    return both.select("feature_id", (F.col("below") / 2 + F.col("above") / 2).alias("median"))
