"""The public calls: files to facts, facts to a model, model to scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismflow.config import MahalanobisConfig, PreprocessConfig, SpeConfig
from prismflow.functions.lineage import cut
from prismflow.functions.order import numbered
from prismflow.operators import flatten as fl
from prismflow.operators.pca import PcaModel, fit_pca, transform_pca
from prismflow.operators.rows import preprocess
from prismflow.sources.spectra import load_rows


@dataclass
class Flattened:
    """Facts, features (with ids from 1 in axis order) and sources of a set of files."""

    facts: DataFrame
    features: DataFrame
    sources: DataFrame

    def names(self) -> list[str]:
        return [n for _, n in fl.named_features(self.features)]

    def wide(self, limit: int = fl.MAX_WIDE) -> DataFrame:
        return fl.to_wide(self.facts, self.features, self.sources, limit)


def _renumbered(facts: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features numbered anew, without gaps, in axis order."""
    ids = numbered(features, *fl.AXES, name="new_id")
    rest = [c for c in facts.columns if c not in ("source", "feature_id")]
    facts = facts.join(ids.select("feature_id", "new_id"), "feature_id").select("source", F.col("new_id").alias("feature_id"), *rest)
    return facts, ids.select(F.col("new_id").alias("feature_id"), *[c for c in features.columns if c != "feature_id"])


def preprocess_and_flatten(spark: SparkSession, paths, **settings) -> Flattened:
    """Scan, check, preprocess and flatten files; features missing in too many sources are left out.

    Facts of files with whole numbers or decimals, which no stage has changed, also hold the exact value.
    """
    config = PreprocessConfig(**settings)
    rows = load_rows(spark, paths, config)
    sources = rows.frame.select("source").distinct()
    data = Flattened(*fl.flatten_rows(preprocess(rows, config)), sources)
    if config.max_null_ratio < 1:  # the bound is inclusive: 1 drops nothing
        return materialize_and_drop_sparse(data, config.max_null_ratio) if config.materialize_once else drop_sparse(data, config.max_null_ratio)
    return materialize_flattened(data) if config.materialize_once else data


def materialize_flattened(data: Flattened) -> Flattened:
    """The same facts and features, stored, so that later stages read them instead of the files."""
    return Flattened(cut(data.facts), cut(data.features), data.sources)


def drop_sparse(data: Flattened, max_null_ratio: float) -> Flattened:
    """Features of which at most the given share of sources is missing, numbered anew."""
    return Flattened(*_renumbered(*fl.prune_sparse(data.facts, data.features, data.sources, max_null_ratio)), data.sources)


def materialize_and_drop_sparse(data: Flattened, max_null_ratio: float) -> Flattened:
    """Stored facts without sparse features: read once to count, once to keep."""
    return drop_sparse(materialize_flattened(data), max_null_ratio)


def flatten_pca(spark: SparkSession, paths=None, *, flattened: Flattened | None = None, n_component: int | None = None, impute_strategy: str = "drop", impute_kmeans_n_clusters: int | None = None, scaling_strategy: str = "none", **settings) -> PcaModel:
    """Fit PCA on files or on what preprocess_and_flatten() returned."""
    if (paths is None) == (flattened is None):
        raise ValueError("give either paths or flattened")
    data = preprocess_and_flatten(spark, paths, **settings) if flattened is None else flattened
    return fit_pca(data.facts, data.names(), max_n_component=None, impute=impute_strategy, kmeans_n_clusters=impute_kmeans_n_clusters, scaling=scaling_strategy, n_component=n_component)


def append_pca_scores(model: PcaModel, flattened: Flattened, *, mahalanobis: MahalanobisConfig | None = None, spe: SpeConfig | None = None, with_features: bool = False) -> DataFrame:
    """Scores of each source, with the T2 and Q blocks, and the prepared features before them, that are asked for."""
    if flattened.features.count() != len(model.columns):
        raise ValueError("the model has another number of features")
    return transform_pca(model, flattened.facts, mahalanobis, spe, with_features)


def reshape_pca_components(model: PcaModel, flattened: Flattened) -> DataFrame:
    """A model's coefficients at the coordinates of the features: StepTime, Step, Sequence, wavelength, component, coefficient."""
    if flattened.features.count() != len(model.columns):
        raise ValueError("the model has another number of features")
    return fl.reshape_components(model.component_table(flattened.features.sparkSession), flattened.features)


def align_features(flattened: Flattened, model: PcaModel) -> Flattened:
    """Facts of new files on the model's features; features they lack are missing, none in common is a ValueError."""
    spark = flattened.facts.sparkSession
    mine = fl.name_table(flattened.features).withColumnRenamed("feature_id", "old")
    theirs = fl.feature_frame(spark, model.columns)
    ids = theirs.select("feature_id", "feature").join(mine, "feature").select(F.col("feature_id").alias("new_id"), "old")
    if not ids.limit(1).count():
        raise ValueError("no feature of the model is present")
    facts = flattened.facts.join(ids, F.col("feature_id") == F.col("old")).select("source", F.col("new_id").alias("feature_id"), "value")
    return Flattened(facts, theirs.drop("feature"), flattened.sources)
