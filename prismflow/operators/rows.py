"""Preprocessing of whole rows: a time point's values stay one array until they become facts.

Time, step and segment are settled among time points, which are as many as rows; an array is read where its
values are needed. Wavelengths are the array's places, so what concerns them is known before any row is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismflow.config import PreprocessConfig
from prismflow.functions.lineage import cut
from prismflow.functions.quantiles import missing
from prismflow.functions.transforms import intensity
from prismflow.operators import preprocess as pp

#: Values of a series' piece that are smoothed together in a task, about.
PIECE_VALUES = 4_000_000


@dataclass(frozen=True)
class Rows:
    """source, row_index, Time, Step, Sequence and values, an array of doubles by wavelength (null: all missing).

    kinds are the types of the wavelength columns over all files; where some are whole numbers or decimals the
    frame also has exact, an array of decimals, null for other columns.
    """

    frame: DataFrame
    waves: list[float]
    kinds: list[str]

    @property
    def exact(self) -> bool:
        return "exact" in self.frame.columns

    def with_values(self, values: Column) -> Rows:
        """Changed values: what was exact is no longer known."""
        return replace(self, frame=self.frame.drop("exact").withColumn("values", values), kinds=["double"] * len(self.kinds))

    def of(self, frame: DataFrame) -> Rows:
        return replace(self, frame=frame)


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Arrays of values as a matrix, and which of them are there; a null array is a row of missing values."""
    whole = column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.drop_null().flatten()
    v, known = np.zeros((len(column), width)), np.zeros((len(column), width), dtype=bool)
    v[whole] = flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, width)
    known[whole] = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, width)
    return v, known


def _lists(v: np.ndarray, known: np.ndarray) -> pa.ListArray:
    ends = np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(v.reshape(-1), mask=~known.reshape(-1)))


def smooth_time(rows: Rows, window: float) -> Rows:
    """Each value becomes the mean over rows of its (source, Step, Sequence) within `window` in Time.

    A segment's rows, or a piece of them with the edges that windows reach, are averaged as one matrix.
    """
    keys, width, names = ["source", "Step", "Sequence"], len(rows.waves), rows.frame.columns
    pieces = pp.in_pieces(rows.frame.drop("exact"), keys, "Time", window, max(64, PIECE_VALUES // max(1, width)))
    names = [c for c in names if c != "exact"]

    def run(group: pa.Table) -> pa.Table:
        x = group["Time"].to_numpy().astype(float)
        order = np.argsort(x, kind="stable")
        group, x = group.take(pa.array(order)), x[order]
        mean, there = pp.window_means(*_matrix(group["values"].combine_chunks(), width), *pp.window_bounds(x, window))
        own = group["own"].to_numpy()
        out = group.set_column(group.schema.get_field_index("values"), "values", _lists(mean, there))
        return out.filter(pa.array(own)).select(names)

    schema = rows.frame.select(*names).schema
    return replace(rows, frame=pieces.groupBy(*keys, "piece").applyInArrow(run, schema), kinds=["double"] * width)


def smooth_wavelength(rows: Rows, window: float) -> Rows:
    """Each value becomes the mean over its row's values at most `window` apart; the windows are the same in every row."""
    waves, frame = np.array(rows.waves), rows.frame.drop("exact")
    order = np.argsort(waves, kind="stable")
    first, stop = pp.window_bounds(waves[order], window)
    at = frame.columns.index("values")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, known = _matrix(b.column("values"), len(waves))
            mean, there = pp.window_means(v[:, order].T, known[:, order].T, first, stop)
            v[:, order], known[:, order] = mean.T, there.T
            columns = [*b.columns[:at], _lists(v, known), *b.columns[at + 1 :]]
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return replace(rows, frame=frame.mapInArrow(run, frame.schema), kinds=["double"] * len(waves))


def _unsound(reference: Column) -> Column:
    return missing(reference) | (reference == 0) | (F.abs(reference) == float("inf"))


def normalize_time(rows: Rows, bounds: tuple[float, float]) -> Rows:
    """Values over the mean of their (source, Step, Sequence, wavelength) in a closed range of Time."""
    keys = ["source", "Step", "Sequence"]
    inside = rows.frame.filter(F.col("Time").between(*bounds)).select(*keys, F.posexplode("values").alias("band", "v"))
    each = inside.groupBy(*keys, "band").agg(F.avg("v").alias("mean"))
    means = each.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("band", "mean"))).alias("m"))
    means = cut(means.select(*keys, F.transform("m", lambda x: x.mean).alias("reference")))
    segments = rows.frame.select(*keys).distinct().join(means, keys, "left")
    wrong = F.col("reference").isNull() | (F.size("reference") < len(rows.waves)) | F.exists("reference", _unsound)
    if segments.filter(wrong).limit(1).count():
        raise ValueError("t_normalization_range: a reference mean is absent, 0 or not finite")
    joined = replace(rows, frame=rows.frame.join(means, keys))
    divided = joined.with_values(F.zip_with("values", "reference", lambda v, r: v / r))
    return divided.of(divided.frame.drop("reference"))


def normalize_wavelength(rows: Rows, bounds: tuple[float, float]) -> Rows:
    """Values over the mean of their row in a closed range of wavelengths."""
    places = [k for k, w in enumerate(rows.waves) if bounds[0] <= w <= bounds[1]]
    some = F.filter(F.array(*[F.get("values", F.lit(k)) for k in places]), lambda v: v.isNotNull()) if places else F.array().cast("array<double>")
    total = F.aggregate("part", F.lit(0.0), lambda s, v: s + v)
    frame = rows.frame.withColumn("part", some)
    frame = cut(frame.withColumn("reference", F.when(F.size("part") > 0, total / F.size("part"))).drop("part"))
    if frame.filter(_unsound(F.col("reference"))).limit(1).count():
        raise ValueError("w_normalization_range: a reference mean is absent, 0 or not finite")
    divided = rows.of(frame).with_values(F.transform("values", lambda v: v / F.col("reference")))
    return divided.of(divided.frame.drop("reference"))


def downsample_wavelength(rows: Rows, stride: int) -> Rows:
    """Every stride-th wavelength."""
    order = sorted(range(len(rows.waves)), key=lambda k: rows.waves[k])[::stride]
    taken = F.array(*[F.lit(k) for k in order])
    columns = [c for c in ("values", "exact") if c in rows.frame.columns]
    pick = lambda c: F.when(F.col(c).isNotNull(), F.transform(taken, lambda k: F.get(F.col(c), k)))
    frame = rows.frame.withColumns({c: pick(c) for c in columns})
    return Rows(frame, [rows.waves[k] for k in order], [rows.kinds[k] for k in order])


def transform_intensity(rows: Rows, kind: str, scale: float) -> Rows:
    """Element-wise transform of values; log1p checks its domain first."""
    if kind == "none":
        return rows
    if kind == "log1p":
        least = rows.frame.agg(F.min(F.array_min(F.transform("values", lambda v: v / scale)))).first()[0]
        if least is not None and least <= -1:
            raise ValueError("log1p needs value / scale above -1")
    return rows.with_values(F.transform("values", lambda v: intensity(v, kind, scale)))


def preprocess(rows: Rows, config: PreprocessConfig) -> Rows:
    """All stages in their fixed order, on rows that load_rows() checked and filtered by step and wavelength; adds StepTime."""
    points = pp.step_times(rows.frame.select(*pp.ROW))
    keep = ["source", "row_index", "StepTime"]
    if config.edge_trim is not None:
        points = pp.edge_trim(points, config.edge_trim)
    points = cut(points.select(*pp.ROW, "StepTime"))
    rows = rows.of(rows.frame.join(points.select(*keep), ["source", "row_index"]))
    heavy = config.t_smoothing_window is not None or config.t_normalization_range or config.w_normalization_range
    if config.t_smoothing_window is not None:
        rows = smooth_time(rows, config.t_smoothing_window)
    if config.w_smoothing_window is not None:
        rows = smooth_wavelength(rows, config.w_smoothing_window)
    if heavy:
        rows = rows.of(cut(rows.frame))
    if config.t_normalization_range:
        rows = normalize_time(rows, config.t_normalization_range)
    if config.w_normalization_range:
        rows = normalize_wavelength(rows, config.w_normalization_range)
    if config.t_downsampling_stride > 1:
        rows = rows.of(pp.downsample_time(rows.frame, config.t_downsampling_stride, points.select("Time")))
    if config.w_downsampling_stride > 1:
        rows = downsample_wavelength(rows, config.w_downsampling_stride)
    return transform_intensity(rows, config.intensity_transform, config.intensity_transform_scale)
