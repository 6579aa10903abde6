"""Fit and transform runs with their artifacts, size estimate, and the monitoring view."""

from __future__ import annotations

from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismflow.api import Flattened, align_features, preprocess_and_flatten
from prismflow.config import MahalanobisConfig, SpeConfig
from prismflow.functions.folders import located, read_text, write_text
from prismflow.operators import flatten as fl
from prismflow.operators.pca import PcaModel, fit_pca, resolve_used_components, transform_pca
from prismflow.operators.preprocess import transform_intensity

#: Without a number of components a fit keeps those that reach this share of variance, of at most so many.
KEEP_VARIANCE, MOST_COMPONENTS = 0.99, 1000
#: Bytes that a fit takes for each value, by its stages.
BYTES = {"plain": 10 * 8, "stages": 16 * 8, "kmeans": 24 * 8}


def fit_run(spark: SparkSession, paths, folder: str | Path, n_component: int | None = None, impute: str = "drop", scaling: str = "none", mahalanobis: MahalanobisConfig = MahalanobisConfig(), spe: SpeConfig = SpeConfig(), **settings) -> PcaModel:
    """Flatten, fit and score files; features, samples, scores and the model go to a folder."""
    data = preprocess_and_flatten(spark, paths, **settings)
    model = fit_pca(data.facts, data.names(), max_n_component=MOST_COMPONENTS, impute=impute, scaling=scaling, n_component=n_component)
    if n_component is None:
        model = model.truncated(resolve_used_components(model.explained_variance_ratio, KEEP_VARIANCE))
    folder = located(folder)
    fl.feature_frame(spark, model.columns).select("feature", *fl.AXES).write.mode("overwrite").parquet(f"{folder}/features")
    stem = F.regexp_extract("source", r"([^/]+?)(?:\.[^./]*)?$", 1)
    data.sources.select("source", stem.alias("stem")).write.mode("overwrite").parquet(f"{folder}/samples")
    _scored(model, data, mahalanobis, spe).write.mode("overwrite").parquet(f"{folder}/scores")
    write_text(spark, f"{folder}/model.json", model.to_json())
    return model


def _scored(model: PcaModel, data: Flattened, mahalanobis: MahalanobisConfig | None, spe: SpeConfig | None) -> DataFrame:
    return transform_pca(model, data.facts, mahalanobis, spe)


def transform_run(spark: SparkSession, paths, fit_folder: str | Path, folder: str | Path, intensity_transform: str = "none", intensity_transform_scale: float = 1.0, mahalanobis: MahalanobisConfig | None = MahalanobisConfig(), spe: SpeConfig | None = SpeConfig(), **settings) -> DataFrame:
    """Score new files with a fitted run: nothing is thinned or pruned, features follow the model, the transform comes last."""
    text = read_text(spark, f"{located(fit_folder)}/model.json")
    if text is None:
        raise FileNotFoundError(f"{fit_folder}: there is no model")
    model = PcaModel.from_json(text)
    fixed = {"t_downsampling_stride": 1, "w_downsampling_stride": 1, "max_null_ratio": 1.0, "intensity_transform": "none"}
    data = align_features(preprocess_and_flatten(spark, paths, **(settings | fixed)), model)
    facts = transform_intensity(data.facts, intensity_transform, intensity_transform_scale)
    path = f"{located(folder)}/scores"
    _scored(model, Flattened(facts, data.features, data.sources), mahalanobis, spe).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def fit_bytes(segments: DataFrame, n_files: int, n_wavelengths: int, t_stride: int = 1, w_stride: int = 1, stages: str = "plain") -> int:
    """Estimate of a fit's memory from a catalog's segments: most rows of each (Step, Sequence), thinned."""
    most = segments.groupBy("Step", "Sequence").agg(F.max("n_rows").alias("n")).agg(F.sum(F.ceil(F.col("n") / t_stride))).first()[0] or 0
    return int(most) * -(-n_wavelengths // w_stride) * n_files * BYTES[stages]


def monitoring(scores: DataFrame, listing: DataFrame, mahalanobis: MahalanobisConfig = MahalanobisConfig(), spe: SpeConfig = SpeConfig()) -> DataFrame:
    """A row per catalogued file: state exceeding, normal or unscored, and which limits it exceeds."""
    flags = scores.select("source", F.col(mahalanobis.exceeds_ucl_column).alias("t2_exceeds"), F.col(spe.exceeds_ucl_column).alias("q_exceeds"))
    joined = listing.join(flags, listing["path"] == flags["source"], "left")
    state = F.when(F.col("source").isNull(), "unscored").when(F.col("t2_exceeds") | F.col("q_exceeds"), "exceeding").otherwise("normal")
    return joined.select("stem", state.alias("state"), "t2_exceeds", "q_exceeds")


def compare_models(a: PcaModel, b: PcaModel, relative: bool = False) -> dict[str, float]:
    """Largest differences of two models of the same features, components aligned in sign; relative: over the larger of both values, 0 for two zeros."""
    signs = np.sign((a.components * b.components).sum(axis=1, keepdims=True))
    signs[signs == 0] = 1

    def gap(x: np.ndarray, y: np.ndarray) -> float:
        off, size = np.abs(x - y), np.maximum(np.abs(x), np.abs(y))
        return float(np.divide(off, size, out=np.zeros_like(off), where=size > 0).max() if relative else off.max())

    return {"components": gap(a.components, signs * b.components), "explained_variance": gap(a.explained_variance, b.explained_variance), "mean": gap(a.mean, b.mean)}
