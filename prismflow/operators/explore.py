"""Looking at single segments and at scores: views of one (Step, Sequence), tables that keep an order, trajectories.

A view reads the facts of its segment only. Scores need every feature, but what is made from them, and the
loadings that make it, are those of the segment.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismflow.api import Flattened
from prismflow.functions.names import natural_key, new_name
from prismflow.functions.order import numbered
from prismflow.operators import preprocess as pp
from prismflow.operators.pca import PcaModel, component_contribution, partial_scores, prepare, q_contribution, reconstruct, residual, scores_long
from prismflow.operators.rows import Rows
from prismflow.operators.tables import cell_text

VIEWS = ("preprocessed", "contribution", "reconstruction", "residual", "q_contribution")


def segments(features: DataFrame) -> DataFrame:
    """Step, Sequence, and the numbers of time points and wavelengths of each."""
    return features.groupBy("Step", "Sequence").agg(F.count_distinct("StepTime").alias("n_times"), F.count_distinct("wavelength").alias("n_wavelengths"))


def segment_features(features: DataFrame, step: int, sequence: int) -> DataFrame:
    """feature_id, StepTime and wavelength of one segment; ValueError where there is none."""
    found = features.filter((F.col("Step") == step) & (F.col("Sequence") == sequence)).select("feature_id", "StepTime", "wavelength")
    if not found.limit(1).count():
        raise ValueError(f"no feature of step {step}, sequence {sequence}")
    return found


def _chosen(data: Flattened, sources: Sequence[str] | None) -> DataFrame:
    return data.sources.select("source") if sources is None else data.sources.select("source").filter(F.col("source").isin(list(sources)))


def raw_view(rows: Rows, step: int, sequence: int) -> DataFrame:
    """source, StepTime, wavelength and value of one segment, as the files have it; files without it have no rows."""
    mine = (F.col("Step") == step) & (F.col("Sequence") == sequence)
    points = pp.step_times(rows.frame.select(*pp.ROW)).filter(mine).select("source", "row_index", "StepTime")
    waves = F.array(*[F.lit(w) for w in rows.waves])
    cells = rows.frame.filter(mine).join(points, ["source", "row_index"]).select("source", "StepTime", F.posexplode("values").alias("band", "value"))
    return cells.select("source", "StepTime", F.get(waves, F.col("band")).alias("wavelength"), "value")


def segment_view(view: str, data: Flattened, step: int, sequence: int, model: PcaModel | None = None, component: int = 1, selector=0.9, sources: Sequence[str] | None = None) -> DataFrame:
    """source, StepTime, wavelength and value of one segment, for all sources or some.

    preprocessed: the facts, null where missing. contribution: a component's part of the reconstruction.
    reconstruction: from components 1 to `component`, with the facts beside it as `preprocessed`. residual: what is
    left of the prepared facts after it. q_contribution: squared residuals of the components that the selector uses.
    Sources that the model's imputation drops have rows in the first view only; see dropped_sources().
    """
    if view not in VIEWS:
        raise ValueError(f"view must be one of {', '.join(VIEWS)}")
    axis, wanted = segment_features(data.features, step, sequence), _chosen(data, sources)
    grid = wanted.join(axis, F.lit(True))
    mine = data.facts.join(axis.select("feature_id"), "feature_id", "left_semi").select("source", "feature_id", "value")
    shown = grid.join(mine, ["source", "feature_id"], "left")
    if view == "preprocessed":
        return shown.select("source", "StepTime", "wavelength", "value")
    if model is None:
        raise ValueError(f"the view {view} needs a model")
    if not 1 <= component <= model.n_component:
        raise ValueError("no such component")
    prepared = prepare(model, data.facts.join(wanted, "source", "left_semi").select("source", "feature_id", "value"))
    only = np.array(axis.select("feature_id").toArrow()["feature_id"].to_pylist())  # some of the features of a model, whose arrays the driver holds
    if view == "contribution":
        found = component_contribution(model, scores_long(model, prepared, component), component, only)
    elif view == "reconstruction":
        found = reconstruct(model, scores_long(model, prepared, component), component, only)
    elif view == "residual":
        found = residual(model, prepared, component, only)
    else:
        found = q_contribution(model, prepared, selector, only).withColumnRenamed("contribution", "value")
    found = found.join(axis, "feature_id")
    if view == "reconstruction":
        found = found.join(mine.withColumnRenamed("value", "preprocessed"), ["source", "feature_id"], "left")
        return found.select("source", "StepTime", "wavelength", "value", "preprocessed")
    return found.select("source", "StepTime", "wavelength", "value")


def dropped_sources(model: PcaModel, data: Flattened, sources: Sequence[str] | None = None) -> DataFrame:
    """source of those that the model's missing-value and outlier stages leave out."""
    wanted = _chosen(data, sources)
    kept = prepare(model, data.facts.join(wanted, "source", "left_semi").select("source", "feature_id", "value")).select("source").distinct()
    return wanted.join(kept, "source", "left_anti")


def trajectories(model: PcaModel, data: Flattened, x: int, y: int, sources: Sequence[str] | None = None) -> DataFrame:
    """source, point (from 1), Step, Sequence, StepTime, x and y: two scores as they build up; the last point is the score."""
    wanted = _chosen(data, sources)
    prepared = prepare(model, data.facts.join(wanted, "source", "left_semi").select("source", "feature_id", "value"))
    both = partial_scores(model, prepared, data.features, sorted({x, y}))
    place = numbered(both.select("Step", "Sequence", "StepTime").distinct(), "Step", "Sequence", "StepTime", name="point")
    of = lambda c, name: F.max(F.when(F.col("component") == c, F.col("score"))).alias(name)
    keys = ["Step", "Sequence", "StepTime"]
    return both.groupBy("source", *keys).agg(of(x, "x"), of(y, "y")).join(place, keys).select("source", "point", *keys, "x", "y")


def in_natural_order(table: DataFrame, stem: str = "stem") -> DataFrame:
    """The rows with `place` (from 1), in natural order of a text column."""
    key = new_name()
    return numbered(table.withColumn(key, natural_key(F.col(stem))), key, stem).drop(key)


def shown_files(shown: DataFrame, files: DataFrame) -> DataFrame:
    """What is known of the files shown (place, stem), each with its place; unknown ones have nulls and an empty path."""
    joined = shown.select("place", "stem").join(files, "stem", "left")
    return joined.select("place", *[F.coalesce("path", F.lit("")).alias(c) if c == "path" else F.col(f"`{c}`") for c in joined.columns if c != "place"])


def score_table(scores: DataFrame, samples: DataFrame, x: int, y: int) -> DataFrame:
    """place, x, y and sample (what the samples' table has, whatever its columns' names) of scored samples (source, place).

    scores has source and a column for each component, as transforms give them.
    """
    lacking = [c for c in (f"pca-{x}", f"pca-{y}") if c not in scores.columns]
    if lacking:
        raise ValueError(f"no such scores: {', '.join(lacking)}")
    two = scores.select(F.col("source").alias("of"), F.col(f"`pca-{x}`").alias("x"), F.col(f"`pca-{y}`").alias("y"))
    packed = samples.select(F.col("place").alias("place"), F.col("source").alias("key"), F.struct(*[F.col(f"`{c}`") for c in samples.columns if c != "place"]).alias("sample"))
    return packed.join(two, F.col("key") == F.col("of")).select("place", "x", "y", "sample")


def point_table(points: DataFrame, columns: dict[str, str]) -> DataFrame:
    """place and a text column for each header, formatted like table cells; columns names what each header shows, fields with dots."""
    chosen = points.select("place", *[F.col(c).alias(f"c{k}") for k, c in enumerate(columns.values())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [pa.array([cell_text(v) for v in b.column(f"c{k}").to_pylist()], pa.string()) for k in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([b.column("place"), *texts], names=b.schema.names)

    found = chosen.mapInArrow(run, "place long, " + ", ".join(f"c{k} string" for k in range(len(columns))))
    return found.toDF("place", *columns)
