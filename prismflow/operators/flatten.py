"""Flatten: one feature per (wavelength, Step, Sequence, StepTime), one vector per source.

The canonical form is long: a feature table (feature_id, name, coordinates) and a fact table (source,
feature_id, value) in which absence means missing. Wide frames are made at the edge only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismflow.functions.lineage import cut
from prismflow.functions.names import feature_name, feature_of
from prismflow.functions.order import numbered
from prismflow.functions.quantiles import missing
from prismflow.operators.rows import Rows

AXES = ("wavelength", "Step", "Sequence", "StepTime")
#: Widest frame that to_wide() makes unless told otherwise.
MAX_WIDE = 5000


def last_of_duplicates(frame: DataFrame) -> DataFrame:
    """One value per (source, coordinates): of several rows the last in (Time, row_index) order.

    Rows are chosen among time points, of which there are far fewer than values.
    """
    points = frame.select("source", "row_index", "Time", "Step", "Sequence", "StepTime").distinct()
    last = points.groupBy("source", "Step", "Sequence", "StepTime").agg(F.max_by("row_index", F.struct("Time", "row_index")).alias("row_index"))
    return frame.join(last.select("source", "row_index"), ["source", "row_index"], "left_semi").select("source", *AXES, "value")


def feature_grid(frame: DataFrame) -> DataFrame:
    """Sorted union of (Step, Sequence, StepTime) over all sources."""
    return frame.select("Step", "Sequence", "StepTime").distinct()


def _axes(frame: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The grid's points with their place, the wavelengths with theirs, and the number of points: axes, not data."""
    grid = numbered(feature_grid(frame), "Step", "Sequence", "StepTime")
    return grid, numbered(frame.select("wavelength").distinct(), "wavelength", name="band"), grid.count()


def _feature_id(points: int):
    # places in (wavelength, Step, Sequence, StepTime) order
    return ((F.col("band") - 1).cast("long") * points + F.col("place")).alias("feature_id")


def feature_table(frame: DataFrame) -> DataFrame:
    """feature_id (from 1, in axis order) and coordinates of all features: the grid times the wavelengths."""
    grid, waves, points = _axes(frame)
    return grid.join(waves, F.lit(True)).select(_feature_id(points), *AXES)


def flatten(frame: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts (source, feature_id, value; NaN becomes null) and the feature table of a preprocessed long table."""
    grid, waves, points = _axes(frame)
    rows = last_of_duplicates(frame).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    facts = rows.join(grid, ["Step", "Sequence", "StepTime"]).join(waves, "wavelength").select("source", _feature_id(points), "value")
    return facts, grid.join(waves, F.lit(True)).select(_feature_id(points), *AXES)


def flatten_rows(rows: Rows) -> tuple[DataFrame, DataFrame]:
    """Facts (source, feature_id, value, and exact where the rows have it) and the feature table of preprocessed rows.

    Duplicates and the grid are settled among time points; each row then meets its place in the grid once, and its
    values leave it as facts, whose wavelength is their place in the row.
    """
    points = rows.frame.select("source", "row_index", "Time", "Step", "Sequence", "StepTime")
    grid = numbered(feature_grid(points), "Step", "Sequence", "StepTime")
    n = grid.count()
    last = points.groupBy("source", "Step", "Sequence", "StepTime").agg(F.max_by("row_index", F.struct("Time", "row_index")).alias("row_index"))
    place = cut(last.join(grid, ["Step", "Sequence", "StepTime"]).select("source", "row_index", "place"))
    cells = [F.col("values")] + ([F.col("exact")] if rows.exact else [])
    missing_row = F.transform(F.sequence(F.lit(1), F.lit(len(rows.waves))), lambda _: F.lit(None).cast("double"))
    zipped = F.arrays_zip(F.coalesce("values", missing_row).alias("values"), *cells[1:])
    each = rows.frame.join(place, ["source", "row_index"]).select("source", "place", F.posexplode(zipped).alias("band", "x"))
    value = F.when(~F.isnan("x.values"), F.col("x.values")).alias("value")
    facts = each.select("source", (F.col("band").cast("long") * n + F.col("place")).alias("feature_id"), value, *([F.col("x.exact").alias("exact")] if rows.exact else []))
    spark = rows.frame.sparkSession
    waves = spark.createDataFrame([(k, w, kind) for k, (w, kind) in enumerate(zip(rows.waves, rows.kinds))], "band long, wavelength double, kind string")
    features = grid.join(waves, F.lit(True)).select((F.col("band") * n + F.col("place")).alias("feature_id"), *AXES, *(["kind"] if rows.exact else []))
    return facts, features


def null_ratios(facts: DataFrame, features: DataFrame, sources: DataFrame) -> DataFrame:
    """feature_id and the share of sources where it is missing."""
    n = sources.agg(F.count(F.lit(1)).alias("sources"))
    present = facts.filter(~missing("value")).groupBy("feature_id").agg(F.count(F.lit(1)).alias("present"))
    counts = features.select("feature_id").join(present, "feature_id", "left").join(F.broadcast(n), F.lit(True))  # n is one row
    return counts.select("feature_id", (1 - F.coalesce("present", F.lit(0)) / F.col("sources")).alias("ratio"), "sources", F.coalesce("present", F.lit(0)).alias("present"))


def prune_sparse(facts: DataFrame, features: DataFrame, sources: DataFrame, max_null_ratio: float) -> tuple[DataFrame, DataFrame]:
    """Facts and features of which at most the given share is missing (inclusive)."""
    kept = null_ratios(facts, features, sources).filter((F.col("sources") - F.col("present")) / F.col("sources") <= max_null_ratio).select("feature_id")
    return facts.join(kept, "feature_id", "left_semi"), features.join(kept, "feature_id", "left_semi")


def name_table(features: DataFrame) -> DataFrame:
    """feature_id and feature, its name, made in tasks; ValueError where two features get one name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in AXES))
            yield pa.RecordBatch.from_arrays([b.column("feature_id"), pa.array([feature_name(*r) for r in rows], pa.string())], names=["feature_id", "feature"])

    kind = features.schema["feature_id"].dataType.simpleString()
    named = cut(features.select("feature_id", *AXES).mapInArrow(run, f"feature_id {kind}, feature string"))
    if named.groupBy("feature").count().filter("count > 1").limit(1).count():
        raise ValueError("duplicate flattened feature names")
    return named


def named_features(features: DataFrame) -> list[tuple[int, str]]:
    """(feature_id, name) in feature order. Driver-side: for wide frames and models, which hold arrays by feature."""
    found = name_table(features).toArrow().sort_by("feature_id")
    return list(zip(found["feature_id"].to_pylist(), found["feature"].to_pylist()))


def to_wide(facts: DataFrame, features: DataFrame, sources: DataFrame, limit: int = MAX_WIDE) -> DataFrame:
    """source and a column per feature, a row per source in source order."""
    names = named_features(features)
    if len(names) > limit:
        raise ValueError(f"{len(names)} features; a wide frame of more than {limit} columns must be asked for")
    if not names:
        return sources.select("source").orderBy("source")
    exact = "exact" in facts.columns
    cell = F.first(F.struct("value", "exact")) if exact else F.first("value")
    wide = sources.select("source").join(facts, "source", "left").groupBy("source").pivot("feature_id", [k for k, _ in names]).agg(cell)
    kinds = dict(features.select("feature_id", "kind").collect()) if exact else {}
    column = lambda k: F.col(f"`{k}`") if not exact else F.col(f"`{k}`.value") if kinds[k] == "double" else F.col(f"`{k}`.exact").cast(kinds[k])
    return wide.select("source", *[column(k).alias(n) for k, n in names]).orderBy("source")


def from_wide(wide: DataFrame, index: tuple[str, ...] = ("source",)) -> tuple[DataFrame, DataFrame]:
    """Facts and features of a wide frame, whose feature names give the coordinates."""
    names = [c for c in wide.columns if c not in index]
    features = feature_frame(wide.sparkSession, names)
    pairs = F.array(*[F.struct(F.lit(k + 1).cast("long").alias("feature_id"), F.col(f"`{n}`").cast("double").alias("value")) for k, n in enumerate(names)])
    return wide.select(*index, F.explode(pairs).alias("x")).select(*index, "x.feature_id", "x.value"), features


def feature_frame(spark: SparkSession, names: list[str]) -> DataFrame:
    """Feature table of named features in the given order."""
    rows = [(k + 1, n, *feature_of(n)) for k, n in enumerate(names)]
    return spark.createDataFrame(rows, "feature_id long, feature string, wavelength double, Step long, Sequence long, StepTime double")


def flatten_to_long(wide: DataFrame, value_name: str = "intensity", index: tuple[str, ...] = ()) -> DataFrame:
    """source, index columns, Step, Sequence, StepTime, wavelength and the value, a row per feature."""
    reserved = {"source", *AXES, value_name}
    if len(reserved) < 6 or reserved & set(index):
        raise ValueError("value and index names must differ from the coordinates")
    facts, features = from_wide(wide, ("source", *index))
    return facts.join(features, "feature_id").select("source", *index, "Step", "Sequence", "StepTime", "wavelength", F.col("value").alias(value_name))


def flatten_to_wide(wide: DataFrame, drop_all_null_rows: bool = False, index: tuple[str, ...] = ()) -> DataFrame:
    """source, index columns, Step, Sequence, StepTime and a column per wavelength."""
    long = flatten_to_long(wide, "intensity", index)
    waves = sorted({feature_of(c)[0] for c in wide.columns if c not in ("source", *index)})
    keys = ["source", *index, "Step", "Sequence", "StepTime"]
    out = long.groupBy(*keys).pivot("wavelength", waves).agg(F.first("intensity"))
    names = [(str(w), f"{w:.1f}nm") for w in waves]
    out = out.select(*keys, *[F.col(f"`{a}`").alias(b) for a, b in names])
    if drop_all_null_rows:
        out = out.filter(F.coalesce(*[F.col(f"`{b}`") for _, b in names]).isNotNull())
    return out.orderBy("source", "Step", "Sequence", "StepTime")


def reshape_components(components: DataFrame, features: DataFrame) -> DataFrame:
    """Coefficients (component, feature_id, coefficient) at their coordinates; axes must form a full product."""
    counts = features.agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(a).alias(a) for a in AXES]).first()
    product = 1
    for a in AXES:
        product *= counts[a]
    if product != counts["n"]:
        raise ValueError("features are not the product of their axes")
    joined = components.join(features, "feature_id")
    return joined.select("StepTime", "Step", "Sequence", "wavelength", "component", "coefficient").orderBy("Step", "Sequence", "StepTime", "component", "wavelength")


def aggregate_loadings(components: DataFrame, method: str, by: str = "wavelength") -> DataFrame:
    """Mean, root mean square or mean absolute coefficient of each (component, key)."""
    ways = {"mean": F.avg("coefficient"), "rms": F.sqrt(F.avg(F.col("coefficient") * F.col("coefficient"))), "abs_mean": F.avg(F.abs("coefficient"))}
    if method not in ways:
        raise ValueError("method must be mean, rms or abs_mean")
    return components.groupBy("component", by).agg(ways[method].alias("coefficient")).orderBy("component", by)
