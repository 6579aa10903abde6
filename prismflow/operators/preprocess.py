"""Operators on the long spectral table (source, row_index, Time, Step, Sequence, wavelength, value).

Each declares a DataFrame plan over all sources at once; nothing loops over files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismflow.functions.lineage import cut
from prismflow.functions.names import new_name
from prismflow.functions.order import numbered
from prismflow.functions.quantiles import missing
from prismflow.functions.transforms import intensity

ROW = ("source", "row_index", "Time", "Step", "Sequence")
#: Points of a series that are smoothed together, about; a longer one is cut in ranges that overlap by a window.
SERIES = 65_536


def filter_steps(frame: DataFrame, steps) -> DataFrame:
    """Rows of the given steps; None keeps all, an empty list none."""
    return frame if steps is None else frame.filter(F.col("Step").isin(list(steps)))


def filter_wavelengths(frame: DataFrame, bounds: tuple[float, float] | None) -> DataFrame:
    """Rows of wavelengths in closed bounds."""
    return frame if bounds is None else frame.filter(F.col("wavelength").between(*bounds))


def step_times(frame: DataFrame) -> DataFrame:
    """Adds StepTime and ReverseStepTime: time since the start and until the end of a row's segment.

    A segment is a run of rows, in (Time, row_index) order, of constant (Step, Sequence). The windows run
    over time points, not over wavelengths, and the result is joined back.
    """
    points = frame.select(*ROW).distinct()
    line = Window.partitionBy("source").orderBy("Time", "row_index")
    changed = F.coalesce((F.col("Step") != F.lag("Step").over(line)) | (F.col("Sequence") != F.lag("Sequence").over(line)), F.lit(True))
    marked = points.withColumn("changed", changed.cast("int"))
    marked = marked.withColumn("segment", F.sum("changed").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    segment = Window.partitionBy("source", "segment")
    timed = marked.select("source", "row_index", (F.col("Time") - F.min("Time").over(segment)).alias("StepTime"), (F.max("Time").over(segment) - F.col("Time")).alias("ReverseStepTime"))
    return frame.join(timed, ["source", "row_index"])


def edge_trim(frame: DataFrame, bounds: tuple[float, float] | None, action: str = "drop") -> DataFrame:
    """Drops rows, or blanks their values, less than bounds away from their segment's start and end."""
    if bounds is None:
        return frame
    near = (F.col("StepTime") < bounds[0]) | (F.col("ReverseStepTime") < bounds[1])
    if action == "drop":
        return frame.filter(~near)
    if action == "null":
        return frame.withColumn("value", F.when(~near, F.col("value")))
    raise ValueError("action must be drop or null")


def window_bounds(x: np.ndarray, window: float) -> tuple[np.ndarray, np.ndarray]:
    """For each point of a sorted axis the first point at most `window` away, and the one after the last."""
    first, stop = np.searchsorted(x, x - window, side="left"), np.searchsorted(x, x + window, side="right")
    # rounding of x -/+ window may take a point wrongly in or out: the distance itself decides
    last = len(x) - 1
    while (wrong := np.abs(x[first] - x) > window).any():
        first = first + wrong
    while (more := (first > 0) & (np.abs(x[np.maximum(first - 1, 0)] - x) <= window)).any():
        first = first - more
    while (wrong := np.abs(x[stop - 1] - x) > window).any():
        stop = stop - wrong
    while (more := (stop <= last) & (np.abs(x[np.minimum(stop, last)] - x) <= window)).any():
        stop = stop + more
    return first, stop


def window_means(value: np.ndarray, known: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means of known values over rows first to stop - 1 of a matrix, column by column, and where there is one."""
    finite = known & np.isfinite(value)
    edge = np.zeros((1, value.shape[1]))
    sums = np.concatenate([edge, np.cumsum(np.where(finite, value, 0.0), axis=0)])
    if finite.all():
        return (sums[stop] - sums[first]) / (stop - first)[:, None], np.ones(value.shape, dtype=bool)
    counts, odd = (np.concatenate([edge.astype(np.int64), np.cumsum(m, axis=0)]) for m in (known, known & ~finite))
    n = counts[stop] - counts[first]
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = (sums[stop] - sums[first]) / n
    for i, j in zip(*np.nonzero(odd[stop] > odd[first])):  # windows that hold NaN or infinite values
        some = slice(first[i], stop[i])
        mean[i, j] = value[some, j][known[some, j]].mean()
    return mean, n > 0


def _means_within(axis: np.ndarray, value: np.ndarray, known: np.ndarray, window: float) -> tuple[np.ndarray, np.ndarray]:
    """For each point the mean of known values at most `window` away on the axis, and whether there is one."""
    order = np.argsort(axis, kind="stable")
    mean, there = window_means(value[order, None], known[order, None], *window_bounds(axis[order], window))
    out, found = np.empty(len(order)), np.empty(len(order), dtype=bool)
    out[order], found[order] = mean[:, 0], there[:, 0]
    return out, found


def in_pieces(frame: DataFrame, keys: list[str], axis: str, window: float, most: int) -> DataFrame:
    """The rows with `piece`, a range of the axis within their keys, and `own`; rows near a range's end also stand, not own, in the next.

    Ranges hold about `most` rows or four windows, whichever is longer, so that a series of any length is many
    groups, of which each has all that its own rows' windows reach.
    """
    lo, hi, n = new_name(), new_name(), new_name()
    sizes = frame.groupBy(*keys).agg(F.min(axis).alias(lo), F.max(axis).alias(hi), F.count(F.lit(1)).alias(n))
    sizes = cut(sizes)
    if not sizes.filter(F.col(n) > most).limit(1).count():
        return frame.withColumn("piece", F.lit(0).cast("long")).withColumn("own", F.lit(True))
    names = [new_name() for _ in keys]
    sizes = sizes.select(*[F.col(c).alias(m) for c, m in zip(keys, names)], lo, hi, n)
    joined = frame.join(sizes, [F.col(c).eqNullSafe(F.col(m)) for c, m in zip(keys, names)])
    x, span = F.col(axis).cast("double"), (F.col(hi) - F.col(lo)).cast("double")
    length = F.greatest(span / F.ceil(F.col(n) / most), F.lit(4.0 * window))
    pieces = F.greatest(F.lit(1), F.ceil(span / length))
    at = F.least(F.floor((x - F.col(lo)) / length), pieces - 1)
    reach = F.lit(window * (1 + 1e-9)) + F.abs(x) * 1e-12  # a row too many in a piece changes nothing
    one = lambda piece, own: F.struct(piece.cast("long").alias("piece"), F.lit(own).alias("own"))
    before = F.when((at > 0) & (x - (F.col(lo) + at * length) <= reach), one(at - 1, False))
    after = F.when((at < pieces - 1) & (F.col(lo) + (at + 1) * length - x <= reach), one(at + 1, False))
    each = F.inline(F.filter(F.array(one(at, True), before, after), lambda p: p.isNotNull()))
    return joined.select(*frame.columns, each)


def _smoothed(frame: DataFrame, keys: list[str], axis: str, window: float, most: int | None = None) -> DataFrame:
    """Each value becomes the mean over points of its keys at most `window` apart on the axis.

    The points of a key, or of a piece of it where there are more than `most`, come together as one array, which is
    averaged in one pass over its sorted axis.
    """
    rest = [c for c in frame.columns if c not in keys]
    pieces = frame.withColumn("piece", F.lit(0).cast("long")).withColumn("own", F.lit(True)) if most is None else in_pieces(frame, keys, axis, window, most)
    rows = pieces.groupBy(*keys, "piece").agg(F.collect_list(F.struct(*rest, "own")).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("row")
            points, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            x = points.field(axis).to_numpy(zero_copy_only=False).astype(float)
            v, known = points.field("value"), points.field("value").is_valid().to_numpy(zero_copy_only=False)
            v = v.fill_null(0.0).to_numpy(zero_copy_only=False)
            mean, there = np.zeros(len(x)), np.zeros(len(x), dtype=bool)
            for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist()):
                mean[lo:hi], there[lo:hi] = _means_within(x[lo:hi], v[lo:hi], known[lo:hi], window)
            means = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(mean, mask=~there))
            yield pa.RecordBatch.from_arrays([*batch.columns, means], names=[*batch.schema.names, "means"])

    schema = T.StructType([*rows.schema.fields, T.StructField("means", T.ArrayType(T.DoubleType()))])
    each = rows.mapInArrow(run, schema).select(*keys, F.explode(F.arrays_zip("row", "means")).alias("x")).filter("x.row.own")
    value = {"value": F.col("x.means").alias("value")}
    return each.select(*[F.col(c) if c in keys else value.get(c, F.col(f"x.row.{c}").alias(c)) for c in frame.columns])


def smooth_time(frame: DataFrame, window: float | None, keep: DataFrame | None = None) -> DataFrame:
    """Each value becomes the mean over points of its (source, Step, Sequence, wavelength) within `window` in Time.

    keep (source, row_index) restricts which rows are returned, not which are averaged over.
    """
    if window is None:
        return frame
    out = _smoothed(frame, ["source", "Step", "Sequence", "wavelength"], "Time", window, SERIES)
    return out if keep is None else out.join(keep, ["source", "row_index"], "left_semi")


def smooth_wavelength(frame: DataFrame, window: float | None) -> DataFrame:
    """Each value becomes the mean over wavelengths of its row at most `window` apart.

    A row's wavelengths, as many as its file has columns, are averaged as one array.
    """
    if window is None:
        return frame
    return _smoothed(frame, [c for c in frame.columns if c not in ("wavelength", "value")], "wavelength", window)


def _divided(frame: DataFrame, keys: list[str], inside, what: str, check: bool) -> DataFrame:
    reference = F.avg(F.when(inside, F.col("value")))
    if check:
        means = frame.groupBy(*keys).agg(reference.alias("reference"))
        wrong = missing("reference") | (F.col("reference") == 0) | (F.abs("reference") == float("inf"))
        if means.filter(wrong).limit(1).count():
            raise ValueError(f"{what}: a reference mean is absent, 0 or not finite")
    return frame.withColumn("value", F.try_divide(F.col("value"), reference.over(Window.partitionBy(*keys))))


def normalize_time(frame: DataFrame, bounds: tuple[float, float] | None, check: bool = True) -> DataFrame:
    """Values over the mean of their (source, Step, Sequence, wavelength) in a closed range of Time."""
    if bounds is None:
        return frame
    return _divided(frame, ["source", "Step", "Sequence", "wavelength"], F.col("Time").between(*bounds), "t_normalization_range", check)


def normalize_wavelength(frame: DataFrame, bounds: tuple[float, float] | None, check: bool = True) -> DataFrame:
    """Values over the mean of their row in a closed range of wavelengths."""
    if bounds is None:
        return frame
    return _divided(frame, ["source", "row_index"], F.col("wavelength").between(*bounds), "w_normalization_range", check)


def _strided(values: DataFrame, name: str, stride: int) -> DataFrame:
    """Every stride-th of the sorted distinct values; these are grid axes, not data rows."""
    return numbered(values.select(name).distinct(), name).filter((F.col("place") - 1) % stride == 0).select(name)


def downsample_time(frame: DataFrame, stride: int, times: DataFrame | None = None) -> DataFrame:
    """Rows at every stride-th distinct Time of all sources (of `times`, if given)."""
    return frame if stride == 1 else frame.join(_strided(frame if times is None else times, "Time", stride), "Time", "left_semi")


def downsample_wavelength(frame: DataFrame, stride: int) -> DataFrame:
    """Rows at every stride-th distinct wavelength."""
    return frame if stride == 1 else frame.join(_strided(frame, "wavelength", stride), "wavelength", "left_semi")


def transform_intensity(frame: DataFrame, kind: str = "none", scale: float = 1.0) -> DataFrame:
    """Element-wise transform of values; log1p checks its domain first."""
    if kind == "log1p":
        least = frame.agg(F.min(F.col("value") / scale)).first()[0]
        if least is not None and least <= -1:
            raise ValueError("log1p needs value / scale above -1")
    return frame.withColumn("value", intensity(F.col("value"), kind, scale))
