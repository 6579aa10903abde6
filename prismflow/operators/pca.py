"""PCA over facts: fit from partial aggregates, model, scores, T2, Q, contributions, reconstruction.

Fitting never gathers the data: Spark reduces facts to a covariance matrix (few features) or a matrix of
inner products of sources (few sources). Where both are many, leading components come from a randomized range
finder of at most six passes of the sources' vectors past a thin block, summed in Spark, with a bound of its error.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismflow.config import IMPUTATIONS, OUTLIERS, MahalanobisConfig, SpeConfig, count, one_of, significance
from prismflow.functions.distributions import chi2_upper, f_upper, normal_upper
from prismflow.functions.lineage import cut
from prismflow.operators import stats

#: Largest order of the matrix that is solved on the driver (8 bytes * order ** 2); beyond it components are iterated.
MAX_ORDER = 4000
#: Directions beside those asked for, most passes over the data, the relative residual at which passes end, and the relative error of variances from which a warning tells.
SPARE, PASSES, SETTLED, ACCEPTED = 20, 6, 1e-9, 1e-6
#: Values of the sample from which k-means takes its first centers, at most; rounds, at most.
SEED_VALUES, KMEANS_ROUNDS = 5_000_000, 100
#: Bytes of a model's table that is broadcast, at most; a larger one is joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Components whose scores are summed side by side; values of a part of a matrix that is summed in Spark.
TOGETHER, PART = 64, 4096
#: Features of a block of loadings; sources that meet one block as a group; values that a task makes at once.
BLOCK, GROUP, VALUES = 512, 4096, 1 << 18
#: A Q below this share of a source's norm is summed from its residuals, as a difference would lose its digits.
SMALL_Q = 1e-7
_NEAR_ZERO = 1e-12
_FENCES = {"lower": "outlier_lower_bounds", "upper": "outlier_upper_bounds", "p1": "winsor_lower_bounds", "p99": "winsor_upper_bounds"}


def resolve_used_components(ratios: np.ndarray, selector) -> int:
    """Number of components: as many as it takes to reach a share of the variance, of at most a cap; None for all."""
    whole = isinstance(selector, (int, np.integer)) and not isinstance(selector, (bool, np.bool_))
    part = isinstance(selector, (float, np.floating)) and 0 < selector <= 1
    if not (selector is None or part or (whole and selector >= 1)):
        raise ValueError("the selector must be None, an integer of at least 1 or a number in (0, 1]")
    share, cap = (float(selector), len(ratios)) if part else (np.inf, int(selector) if whole else len(ratios))
    return min(1 + int((np.cumsum(ratios) < share).sum()), cap, len(ratios))


@dataclass
class PcaModel:
    """Fitted stages and components. Arrays are in the order of columns; small enough for the driver."""

    columns: list[str]
    components: np.ndarray
    mean: np.ndarray
    explained_variance: np.ndarray
    explained_variance_ratio: np.ndarray
    singular_values: np.ndarray
    n_samples: int
    noise_variance: float
    impute: str = "drop"
    fills: np.ndarray | None = None
    centroids: np.ndarray | None = None
    outlier: str | None = None
    iqr_multiplier: float = 1.5
    fences: dict[str, np.ndarray] = field(default_factory=dict)
    scaling: str = "none"
    centers: np.ndarray | None = None
    scales: np.ndarray | None = None
    whiten: bool = False

    @property
    def n_component(self) -> int:
        return len(self.components)

    @property
    def score_columns(self) -> list[str]:
        return [f"pca-{k + 1}" for k in range(self.n_component)]

    # -- tables of the fitted state -------------------------------------------------------------
    def component_table(self, spark: SparkSession, used: int | None = None) -> DataFrame:
        """component, feature_id, coefficient."""
        w = self.components if used is None else self.components[:used]
        j, f = np.indices(w.shape).reshape(2, -1)
        return sized(spark, {"component": j + 1, "feature_id": f + 1, "coefficient": w.reshape(-1)})

    def coefficient_table(self, spark: SparkSession, first: int, stop: int) -> DataFrame:
        """feature_id and w, its coefficients of components first to stop - 1, counted from 0."""
        w = np.ascontiguousarray(self.components[first:stop].T)
        return sized(spark, {"feature_id": np.arange(1, len(w) + 1), "w": _lists(w)})

    def feature_state(self, spark: SparkSession) -> DataFrame:
        n = len(self.columns)
        centers, scales = np.zeros(n) if self.centers is None else self.centers, np.ones(n) if self.scales is None else self.scales
        return sized(spark, {"feature_id": np.arange(1, n + 1), "mean": self.mean, "center": centers, "scale": scales})

    def explained_variance_table(self, spark: SparkSession) -> DataFrame:
        total = np.cumsum(self.explained_variance_ratio)
        rows = [(j + 1, self.score_columns[j], float(self.explained_variance[j]), float(self.explained_variance_ratio[j]), float(total[j])) for j in range(self.n_component)]
        return spark.createDataFrame(rows, "component long, pca_column string, explained_variance double, explained_variance_ratio double, cumulative_explained_variance double")

    def component_coefficients(self, spark: SparkSession, component: int) -> DataFrame:
        """Features by falling absolute coefficient, rounded to four places."""
        w = self.components[component - 1]
        order = np.argsort(-np.abs(w), kind="stable")
        return spark.createDataFrame([(self.columns[f], round(float(w[f]), 4)) for f in order], "feature string, coefficient double")

    def contribution_ranking(self, spark: SparkSession, selector=None) -> DataFrame:
        """Features by the ratio-weighted sum of squared coefficients of the used components."""
        k = resolve_used_components(self.explained_variance_ratio, selector)
        parts = self.explained_variance_ratio[:k, None] * self.components[:k] ** 2
        total, order = parts.sum(axis=0), np.argsort(-parts.sum(axis=0), kind="stable")
        used = float(np.cumsum(self.explained_variance_ratio)[k - 1])
        rows = [(r + 1, self.columns[f], float(total[f]), k, used) for r, f in enumerate(order)]
        return spark.createDataFrame(rows, "rank long, feature string, contribution double, used_components long, used_cumulative_explained_variance double")

    # -- limits ---------------------------------------------------------------------------------
    def variances(self, k: int) -> np.ndarray:
        lam = self.explained_variance[:k]
        if not np.isfinite(lam).all() or (lam <= _NEAR_ZERO * self.explained_variance.max()).any():
            raise ValueError("a used component has almost no variance")
        return np.ones(k) if self.whiten else lam

    def mahalanobis_threshold(self, alpha: float = 0.01, selector=0.9) -> float:
        k, n = resolve_used_components(self.explained_variance_ratio, selector), self.n_samples
        significance(alpha)
        self.variances(k)
        if n - k <= 0:
            raise ValueError("as many components as samples leave no degree of freedom")
        return k * (n + 1) * (n - 1) / (n * (n - k)) * f_upper(alpha, k, n - k)

    def spe_threshold(self, alpha: float = 0.01, selector=0.9) -> float:
        k = resolve_used_components(self.explained_variance_ratio, selector)
        significance(alpha)
        rank = min(self.n_samples, len(self.columns))
        rest, unfitted = self.explained_variance[k:], max(0, rank - self.n_component)
        theta = [float((rest**i).sum() + unfitted * self.noise_variance**i) for i in (1, 2, 3)]
        total = float(self.explained_variance.sum() + unfitted * self.noise_variance)
        if theta[0] <= _NEAR_ZERO * total:
            raise ValueError("no component is left to vary outside the model")
        h = 1 - 2 * theta[0] * theta[2] / (3 * theta[1] ** 2)
        z = normal_upper(alpha)
        inner = z * np.sqrt(2 * theta[1] * h * h) / theta[0] + 1 + theta[1] * h * (h - 1) / theta[0] ** 2
        if h <= 0 or inner <= 0:  # a scaled chi-square of the same two moments
            return theta[1] / theta[0] * chi2_upper(alpha, theta[0] ** 2 / theta[1])
        return float(theta[0] * inner ** (1 / h))

    def truncated(self, k: int) -> PcaModel:
        """The model of the leading k components; more than there are is a ValueError."""
        if count(k, "components") > self.n_component:
            raise ValueError(f"the model has {self.n_component} components")
        unfitted = max(0, min(self.n_samples, len(self.columns)) - self.n_component)
        left = self.n_component - k + unfitted
        noise = float(self.explained_variance[k:].sum() + unfitted * self.noise_variance) / left if left else 0.0
        return replace(self, components=self.components[:k], explained_variance=self.explained_variance[:k], explained_variance_ratio=self.explained_variance_ratio[:k], singular_values=self.singular_values[:k], noise_variance=noise)

    # -- JSON -----------------------------------------------------------------------------------
    def to_payload(self) -> dict:
        """Nested plain values, in the layout of transform payloads."""
        n = len(self.columns)
        by = lambda x: None if x is None else {c: float(v) for c, v in zip(self.columns, x)}
        return {
            "columns": list(self.columns),
            "n_component": self.n_component,
            # the key names of transform payloads are fixed values
            "impute_model": {
                "impute_strategy": self.impute, "impute_values": by(self.fills) or {}, "impute_kmeans_n_clusters": None if self.centroids is None else len(self.centroids),
                "impute_kmeans_centroids": [] if self.centroids is None else [by(c) for c in self.centroids],
            },
            "outlier_model": {"outlier_strategy": self.outlier, "iqr_multiplier": self.iqr_multiplier} | {name: by(self.fences.get(k)) or {} for k, name in _FENCES.items()},
            "scaling_model": {"strategy": self.scaling, "centers": by(np.zeros(n) if self.centers is None else self.centers), "scales": by(np.ones(n) if self.scales is None else self.scales)},
            "pca_column_names": self.score_columns,
            "pca": {
                "components": self.components.tolist(), "mean": self.mean.tolist(), "explained_variance": self.explained_variance.tolist(),
                "explained_variance_ratio": self.explained_variance_ratio.tolist(), "singular_values": self.singular_values.tolist(),
                "n_features_in": len(self.columns), "n_samples": self.n_samples, "noise_variance": self.noise_variance, "whiten": self.whiten,
            },
        }

    def to_json(self) -> str:
        return json.dumps(self.to_payload())

    @classmethod
    def from_payload(cls, data: dict) -> PcaModel:
        """KeyError where a part is missing, ValueError where shapes differ."""
        columns, pca = data["columns"], data["pca"]
        impute, outlier, scaling = data["impute_model"], data["outlier_model"], data["scaling_model"]
        arrange = lambda d: None if not d else np.array([d[c] for c in columns], dtype=float)
        arrays = {k: np.array(pca[k], dtype=float) for k in ("components", "mean", "explained_variance", "explained_variance_ratio", "singular_values")}
        if arrays["components"].shape != (data["n_component"], len(columns)) or len(arrays["mean"]) != len(columns):
            raise ValueError("components, mean and columns have different shapes")
        fences = {k: arrange(outlier[name]) for k, name in _FENCES.items() if outlier[name]}
        centroids = impute["impute_kmeans_centroids"]
        return cls(
            columns=list(columns), **arrays, n_samples=pca["n_samples"], noise_variance=pca["noise_variance"], impute=impute["impute_strategy"], fills=arrange(impute["impute_values"]),
            centroids=np.array([arrange(c) for c in centroids]) if centroids else None, outlier=outlier["outlier_strategy"], iqr_multiplier=outlier["iqr_multiplier"], fences=fences, scaling=scaling["strategy"],
            centers=arrange(scaling["centers"]), scales=arrange(scaling["scales"]), whiten=pca["whiten"],
        )

    @classmethod
    def from_json(cls, text: str) -> PcaModel:
        return cls.from_payload(json.loads(text))


def sized(spark: SparkSession, columns: dict) -> DataFrame:
    """A table of arrays, with a hint to broadcast it in joins if its bytes are few."""
    table = pa.table(columns)
    frame = spark.createDataFrame(table)
    return F.broadcast(frame) if table.nbytes <= BROADCAST_BYTES else frame


def _lists(matrix: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as a list column."""
    ends = np.arange(len(matrix) + 1) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(matrix.reshape(-1)))


def _arrays(table: DataFrame, names: tuple[str, ...], n: int) -> dict[str, np.ndarray]:
    """Columns of a small per-feature table as arrays in feature order."""
    found = table.select("feature_id", *[F.col(c).cast("double").alias(c) for c in names]).toArrow()
    at, out = found["feature_id"].to_numpy() - 1, {}
    for c in names:
        out[c] = np.zeros(n)
        out[c][at] = found[c].to_numpy()
    return out


def _vectors(facts: DataFrame) -> DataFrame:
    """source and x, the values of complete facts in feature order; stored, as rounds read it again and again."""
    rows = facts.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("feature_id", "value"))).alias("x"))
    return cut(rows.select("source", F.transform("x", lambda e: e.value).alias("x")))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(vectors: DataFrame, partial, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all tasks of a matrix that partial(matrices of rows) makes in each; its parts are added up in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = partial(_matrix(b.column("x")) for b in batches if b.num_rows)
        if total is not None:
            flat = np.ascontiguousarray(total, dtype=float).reshape(-1)
            for at in range(0, len(flat), PART):
                yield pa.RecordBatch.from_arrays([pa.array([at // PART]), pa.array([flat[at : at + PART].tobytes()], pa.binary())], names=["part", "values"])

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v) for v in rows["values"].to_pylist())
        return pa.table({"part": rows["part"][:1], "values": pa.array([total.tobytes()], pa.binary())})

    found = vectors.select("x").mapInArrow(run, "part long, values binary").groupBy("part").applyInArrow(add, "part long, values binary").toArrow()
    out = np.zeros(shape[0] * shape[1])
    for part, values in zip(found["part"].to_pylist(), found["values"].to_pylist()):
        piece = np.frombuffer(values)
        out[part * PART : part * PART + len(piece)] = piece
    return out.reshape(shape)


def _first_centers(points: np.ndarray, k: int) -> np.ndarray:
    """k rows of a bounded sample, far apart, by a fixed seed."""
    rng = np.random.default_rng(0)
    centers = points[[int(rng.integers(len(points)))]]
    while len(centers) < k:
        gap = ((points[:, None] - centers) ** 2).sum(axis=2).min(axis=1)
        centers = np.vstack([centers, points[rng.choice(len(points), p=gap / gap.sum()) if gap.sum() > 0 else len(centers)]])
    return centers


def fit_centroids(facts: DataFrame, features: int, k: int) -> np.ndarray:
    """K-means over complete facts at any size: first centers from a bounded sample, then rounds of assignment and means in Spark."""
    vectors = _vectors(facts)
    n = vectors.count()
    if not n:
        raise ValueError("k-means needs a complete sample")
    k = min(k, n)
    few = vectors.orderBy(F.xxhash64("source"), "source").limit(max(k, SEED_VALUES // max(1, features)))
    centers = _first_centers(_matrix(few.select("x").toArrow()["x"].combine_chunks()), k)
    for _ in range(KMEANS_ROUNDS):
        shared = facts.sparkSession.sparkContext.broadcast(centers)

        def partial(matrices, shared=shared):
            old, total = shared.value, None
            half = (old**2).sum(axis=1) / 2
            for x in matrices:
                label = (half - x @ old.T).argmin(axis=1)
                sums = np.zeros((len(old), x.shape[1] + 1))
                np.add.at(sums, label, np.hstack([x, np.ones((len(x), 1))]))
                total = sums if total is None else total + sums
            return total

        sums = _summed(vectors, partial, (k, features + 1))
        shared.unpersist()
        new = np.where(sums[:, -1:] > 0, sums[:, :-1] / np.maximum(sums[:, -1:], 1), centers)
        if np.allclose(new, centers, rtol=0, atol=1e-12):
            break
        centers = new
    else:
        warnings.warn(f"k-means did not settle in {KMEANS_ROUNDS} rounds", stacklevel=2)
    return centers


def _leading(facts: DataFrame, mean: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Variances and directions of the k leading components, the variance of all, and a bound of the variances' errors.

    A randomized range finder: each pass takes the covariance's image of a thin block, which is summed in Spark,
    and what is new in it, orthogonal to all before, is the next block. The best directions within all blocks
    (Rayleigh-Ritz) come from inner products already taken; what the last image has outside bounds their error.
    The driver holds PASSES blocks of features by (k + SPARE) numbers.
    """
    features, spark = len(mean), facts.sparkSession
    most = min(n, features)
    width = min(k + SPARE, most)
    vectors = _vectors(facts)
    total = float(facts.groupBy("feature_id").agg(F.var_samp("value").alias("v")).agg(F.sum("v")).first()[0] or 0.0)
    block = np.linalg.qr(np.random.default_rng(0).normal(size=(features, width)))[0]
    basis, inner = np.zeros((features, 0)), np.zeros((0, 0))
    while True:
        shared = spark.sparkContext.broadcast((mean, block))

        def partial(matrices, shared=shared):
            (center, q), sums = shared.value, None
            for x in matrices:
                c = x - center
                image = c.T @ (c @ q)
                sums = image if sums is None else sums + image
            return sums

        rest = _summed(vectors, partial, (features, block.shape[1])) / max(1, n - 1)
        shared.unpersist()
        before, basis = basis.shape[1], np.hstack([basis, block])
        across = np.zeros((basis.shape[1], block.shape[1]))
        for _ in range(2):  # twice, as the first leaves rounding behind
            part = basis.T @ rest
            across, rest = across + part, rest - basis @ part
        grown = np.zeros((basis.shape[1], basis.shape[1]))
        grown[:before, :before], grown[:, before:], grown[before:, :] = inner, across, across.T
        grown[before:, before:] = (across[before:] + across[before:].T) / 2
        inner = grown
        values, turn = np.linalg.eigh(inner)
        values, turn = values[::-1], turn[:, ::-1]
        left = np.linalg.norm(rest @ turn[before:, :k], axis=0)
        scale = max(float(values[0]), 1e-300)
        settled = (left <= SETTLED * scale).all()
        spare = min(block.shape[1], most - basis.shape[1])
        if settled or spare <= 0 or basis.shape[1] >= PASSES * width:
            break
        u, size, _ = np.linalg.svd(rest, full_matrices=False)
        block = u[:, : max(1, min(spare, int((size > 1e-14 * scale).sum())))]
        block = np.linalg.qr(block - basis @ (basis.T @ block))[0]
    # an error of a variance is at most its residual, and of a well separated one the residual's square over the gap
    others = values[None, : k + 1] - values[:k, None]
    others[np.arange(k), np.arange(k)] = np.inf
    gap = np.abs(others).min(axis=1)
    with np.errstate(divide="ignore"):
        bound = float(np.minimum(left, np.where(gap > 2 * left, left**2 / (gap - left), np.inf)).max())
    if not settled and spare > 0 and bound > ACCEPTED * scale:
        warnings.warn(f"leading components are known to {bound / scale:.1e} of the largest variance after {PASSES} passes", stacklevel=2)
    return np.maximum(values[:k], 0), (basis @ turn[:, :k]).T, total, bound


def _symmetric(entries: DataFrame, value: str, place, order: int) -> np.ndarray:
    """A matrix from its upper triangle (a, b, value); place gives the rows of names."""
    found, out = entries.select("a", "b", value).toArrow(), np.zeros((order, order))
    a, b = (place(found[c].to_numpy()) for c in ("a", "b"))
    out[a, b] = out[b, a] = found[value].to_numpy()
    return out


def fit_components(facts: DataFrame, n_features: int, n_component: int | None) -> dict:
    """Components of complete facts, by the smaller of the two matrices, or iterated where both are large."""
    n = facts.select("source").distinct().count()
    most = min(n, n_features)
    if n == 0:
        raise ValueError("no complete sample is left")
    k = most if n_component is None else n_component
    if k > most:
        raise ValueError(f"n_component must not exceed {most}")
    mean = _arrays(facts.groupBy("feature_id").agg(F.avg("value").alias("m")), ("m",), n_features)["m"]
    total = None
    if most > MAX_ORDER:
        values, components, total, _ = _leading(facts, mean, n, k)
    elif n_features <= n:
        matrix = _symmetric(stats.covariance(facts), "covariance", lambda a: a - 1, n_features) if n > 1 else np.zeros((n_features, n_features))
        values, vectors = np.linalg.eigh(matrix)
        values, components = np.maximum(values[::-1], 0), vectors[:, ::-1].T
    else:
        names = [r[0] for r in facts.select("source").distinct().orderBy("source").collect()]
        at = {s: i for i, s in enumerate(names)}
        values, vectors = np.linalg.eigh(_symmetric(stats.gram(facts), "product", lambda a: np.array([at[s] for s in a.tolist()], dtype=int), n))
        values = np.maximum(values[::-1], 0) / max(1, n - 1)
        weights = vectors[:, ::-1].T
        spark = facts.sparkSession
        means, raw = sized(spark, {"feature_id": np.arange(1, n_features + 1), "m": mean}), []
        for first in range(0, k, TOGETHER):  # so many sums side by side in one pass
            some = range(min(TOGETHER, k - first))
            table = sized(spark, {"name": pa.array([str(s) for s in names]), "u": _lists(np.ascontiguousarray(weights[first : first + len(some)].T))})
            parts = facts.join(table, F.col("source").cast("string") == F.col("name")).join(means, "feature_id")
            sums = parts.groupBy("feature_id").agg(*[F.sum(F.get("u", F.lit(j)) * (F.col("value") - F.col("m"))).alias(f"c{j}") for j in some])
            raw += _arrays(sums, tuple(f"c{j}" for j in some), n_features).values()
        raw = np.stack(raw)
        norms = np.linalg.norm(raw, axis=1, keepdims=True)
        components = np.zeros((k, n_features))
        for j in range(k):  # a direction without variance gets any orthonormal one
            row = raw[j] / norms[j] if norms[j] > 1e-9 * max(norms.max(), 1e-300) else np.random.default_rng(j).normal(size=n_features)
            if norms[j] <= 1e-9 * max(norms.max(), 1e-300):
                row = row - components[:j].T @ (components[:j] @ row)
                row = row / np.linalg.norm(row)
            components[j] = row
    everything = float(values.sum()) if total is None else total
    left = float(values[k:most].sum()) if total is None else max(0.0, everything - float(values[:k].sum()))
    largest = np.abs(components).argmax(axis=1)
    components = components * np.sign(components[np.arange(len(components)), largest])[:, None]
    return {
        "components": components[:k], "mean": mean, "explained_variance": values[:k], "explained_variance_ratio": values[:k] / everything if everything > 0 else np.zeros(k),
        "singular_values": np.sqrt(values[:k] * max(1, n - 1)), "n_samples": n, "noise_variance": left / (most - k) if k < most else 0.0,
    }


def fit_pca(
    facts: DataFrame, features: list[str], max_n_component: int | None = 100, impute: str = "drop", kmeans_n_clusters: int | None = None,
    outlier: str | None = None, iqr_multiplier: float = 1.5, scaling: str = "robust", n_component: int | None = None,
) -> PcaModel:
    """Fit missing-value, outlier and scaling stages, each on the previous one's output, then PCA.

    facts hold feature_id 1 to len(features), in the order of the names.
    """
    one_of(impute, "impute", IMPUTATIONS)
    one_of(outlier, "outlier", OUTLIERS)
    if kmeans_n_clusters is not None and impute != "kmeans":
        raise ValueError("kmeans_n_clusters needs impute='kmeans'")
    spark, n = facts.sparkSession, len(features)
    sources, table = facts.select("source").distinct(), spark.range(1, n + 1).withColumnRenamed("id", "feature_id")
    state: dict = {"columns": features, "impute": impute, "outlier": outlier, "iqr_multiplier": iqr_multiplier, "scaling": scaling}
    now = stats.clean(facts)
    if impute == "drop":
        now = stats.drop_missing(now, n)
    elif impute == "median":
        fills = stats.fit_medians(now, table)
        state["fills"] = _arrays(fills, ("fill",), n)["fill"]
        now = stats.fill_missing(now, fills, sources)
    else:
        clusters = 8 if kmeans_n_clusters is None else count(kmeans_n_clusters, "kmeans_n_clusters")
        state["centroids"] = fit_centroids(stats.drop_missing(now, n), n, clusters)
        now = stats.fill_from_centroids(now, centroid_table(spark, state["centroids"]), sources)
    if outlier:
        bounds = cut(stats.fit_outliers(now, iqr_multiplier))
        state["fences"] = _arrays(bounds, ("lower", "upper", "p1", "p99"), n)
        now = stats.winsorize(now, bounds) if outlier == "winsorize" else stats.drop_outliers(now, bounds)
    if scaling != "none":
        fitted = cut(stats.fit_scaling(now, scaling))
        arrays = _arrays(fitted, ("center", "scale"), n)
        state |= {"centers": arrays["center"], "scales": arrays["scale"]}
        now = stats.apply_scaling(now, fitted)
    now = cut(now)
    samples = now.select("source").distinct().count()
    limit = min(samples, n, max_n_component or n)
    return PcaModel(**state, **fit_components(now, n, limit if n_component is None else n_component))


def centroid_table(spark: SparkSession, centroids: np.ndarray) -> DataFrame:
    c, f = np.indices(centroids.shape).reshape(2, -1)
    return sized(spark, {"cluster": pa.array(c, pa.int32()), "feature_id": f + 1, "center": centroids.reshape(-1)})


def _feature_rows(spark: SparkSession, **arrays: np.ndarray) -> DataFrame:
    n = len(next(iter(arrays.values())))
    return sized(spark, {"feature_id": np.arange(1, n + 1), **{a: np.asarray(v, dtype=float) for a, v in arrays.items()}})


def prepare(model: PcaModel, facts: DataFrame) -> DataFrame:
    """Facts after the model's missing-value and outlier stages: (source, feature_id, value), unscaled."""
    spark, sources = facts.sparkSession, facts.select("source").distinct()
    n = len(model.columns)
    now = stats.clean(facts)
    if model.impute == "drop":
        now = stats.drop_missing(now, n)
    elif model.impute == "median":
        now = stats.fill_missing(now, _feature_rows(spark, fill=model.fills), sources)
    else:
        now = stats.fill_from_centroids(now, centroid_table(spark, model.centroids), sources)
    if model.outlier:
        bounds = _feature_rows(spark, **model.fences)
        now = stats.winsorize(now, bounds) if model.outlier == "winsorize" else stats.drop_outliers(now, bounds)
    return now


def scaled(model: PcaModel, prepared: DataFrame) -> DataFrame:
    """Prepared facts in the space of the components, with the feature's mean, center and scale."""
    return prepared.join(model.feature_state(prepared.sparkSession), "feature_id").withColumn("z", (F.col("value") - F.col("center")) / F.col("scale"))


def _sums(model: PcaModel, prepared: DataFrame, used: int | None) -> DataFrame:
    """source, s (scores of the used components, not whitened) and norm (squared distance from the mean in the scaled space)."""
    z, k, parts = scaled(model, prepared), model.n_component if used is None else used, []
    gap = F.col("z") - F.col("mean")
    for first in range(0, k, TOGETHER):
        stop = min(first + TOGETHER, k)
        sums = [F.sum(gap * F.get("w", F.lit(j))).alias(f"s{j}") for j in range(stop - first)]
        rows = z.join(model.coefficient_table(prepared.sparkSession, first, stop), "feature_id").groupBy("source").agg(F.sum(gap * gap).alias("norm"), *sums)
        parts.append(rows.select("source", "norm", F.lit(first).alias("first"), F.array(*[F.col(f"s{j}") for j in range(stop - first)]).alias("s")))
    if len(parts) == 1:
        return parts[0].select("source", "norm", "s")
    every = reduce(DataFrame.unionByName, parts).groupBy("source").agg(F.first("norm").alias("norm"), F.sort_array(F.collect_list(F.struct("first", "s"))).alias("s"))
    return every.select("source", "norm", F.flatten(F.transform("s", lambda x: x.s)).alias("s"))


def score_vectors(model: PcaModel, prepared: DataFrame, used: int | None = None) -> DataFrame:
    """source and s, its scores as an array."""
    found = _sums(model, prepared, used).select("source", "s")
    if not model.whiten:
        return found
    deviations = F.array(*[F.lit(float(np.sqrt(v))) for v in model.explained_variance[:used]])
    return found.select("source", F.zip_with("s", deviations, lambda x, d: x / d).alias("s"))


def scores_long(model: PcaModel, prepared: DataFrame, used: int | None = None) -> DataFrame:
    """source, component, score."""
    each = score_vectors(model, prepared, used).select("source", F.posexplode("s").alias("place", "score"))
    return each.select("source", (F.col("place") + 1).cast("long").alias("component"), "score")


def t_squared(scores: DataFrame, variances: DataFrame) -> DataFrame:
    """source, t2: squared scores over variances (component, variance), summed."""
    return scores.join(variances, "component").groupBy("source").agg(F.sum(F.col("score") * F.col("score") / F.col("variance")).alias("t2"))


@dataclass
class _Image:
    """What takes score vectors to features: value = (s @ weights + mean) * scale + center, at the places of `ids`."""

    ids: np.ndarray
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    center: np.ndarray

    @property
    def nbytes(self) -> int:
        return self.weights.nbytes + 4 * self.mean.nbytes

    def part(self, some: slice) -> _Image:
        return _Image(self.ids[some], np.ascontiguousarray(self.weights[:, some]), self.mean[some], self.scale[some], self.center[some])

    def of(self, s: np.ndarray) -> np.ndarray:
        return (s @ self.weights + self.mean) * self.scale + self.center

    @staticmethod
    def made(model: PcaModel, first: int, stop: int, only: np.ndarray | None) -> _Image:
        at = np.arange(len(model.columns)) if only is None else np.sort(np.asarray(only)) - 1
        stretch = np.sqrt(model.explained_variance[first:stop]) if model.whiten else np.ones(stop - first)
        state = [np.zeros(len(model.columns)) if x is None else x for x in (model.mean, model.centers)]
        scales = np.ones(len(model.columns)) if model.scales is None else model.scales
        return _Image(at + 1, (model.components[first:stop] * stretch[:, None])[:, at], state[0][at], scales[at], state[1][at])


def _rows_of(sources: pa.Array, ids: np.ndarray, values: np.ndarray) -> list[pa.Array]:
    """A matrix of sources by features as columns of its cells."""
    n, m = values.shape
    return [sources.take(pa.array(np.repeat(np.arange(n), m))), pa.array(np.tile(ids, n)), pa.array(values.reshape(-1))]


def _imaged(vectors: DataFrame, image: _Image) -> DataFrame:
    """source, feature_id, value of all sources and the image's features, from vectors (source, s).

    Tasks multiply blocks of vectors by blocks of loadings, so there are never more rows than values. An image of
    few bytes is broadcast; of a larger one each block meets the vectors in groups of sources of a bounded number.
    """
    spark, kind = vectors.sparkSession, vectors.schema["source"].dataType.simpleString()
    schema, names = f"source {kind}, feature_id long, value double", ["source", "feature_id", "value"]
    starts = range(0, len(image.ids), BLOCK)
    if image.nbytes <= BROADCAST_BYTES:
        shared = spark.sparkContext.broadcast([image.part(slice(at, at + BLOCK)) for at in starts])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                s = _matrix(batch.column("s")) if batch.num_rows else None
                for lo in range(0, batch.num_rows, VALUES // BLOCK):
                    some = slice(lo, lo + VALUES // BLOCK)
                    for part in shared.value:
                        yield pa.RecordBatch.from_arrays(_rows_of(batch.column("source")[some], part.ids, part.of(s[some])), names=names)

        return vectors.select("source", "s").mapInArrow(run, schema)
    rows = [image.part(slice(at, at + BLOCK)) for at in starts]
    binary = lambda x: np.ascontiguousarray(x).tobytes()
    table = pa.table({"block": pa.array(range(len(rows)), pa.int32())} | {n: pa.array([binary(getattr(r, n)) for r in rows], pa.binary()) for n in ("ids", "weights", "mean", "scale", "center")})
    groups = max(1, -(-vectors.count() // GROUP))
    blocks = spark.createDataFrame(table).select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
    spread = vectors.select("source", "s", F.pmod(F.xxhash64("source"), F.lit(groups)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(len(rows) - 1))).alias("block"))

    def multiply(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], left.schema.field("source").type), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        of = lambda n, kind=float: np.frombuffer(right[n][0].as_py(), dtype=kind)
        ids = of("ids", np.int64)
        part = _Image(ids, of("weights").reshape(-1, len(ids)), of("mean"), of("scale"), of("center"))
        return pa.table(_rows_of(left["source"].combine_chunks(), ids, part.of(_matrix(left["s"].combine_chunks()))), names=names)

    return spread.groupBy("block", "part").cogroup(blocks.groupBy("block", "part")).applyInArrow(multiply, schema)


def _gathered(scores: DataFrame, first: int, stop: int) -> DataFrame:
    """source and s, its scores of components first to stop - 1 (from 0) as an array; NaN where one is missing."""
    mine = scores.filter(F.col("component").between(first + 1, stop))
    by = F.map_from_entries(F.collect_list(F.struct(F.col("component").cast("long").alias("c"), "score")))
    each = F.transform(F.sequence(F.lit(first + 1).cast("long"), F.lit(stop).cast("long")), lambda j: F.coalesce(F.try_element_at("by", j), F.lit(float("nan"))))
    return mine.groupBy("source").agg(by.alias("by")).select("source", each.alias("s"))


def reconstruct(model: PcaModel, scores: DataFrame, selector=None, only: np.ndarray | None = None) -> DataFrame:
    """source, feature_id, value in the original scale, from scores (source, component, score); NaN where a used score is missing.

    only, if given, are the ids of the features that are made; no others are read.
    """
    k = resolve_used_components(model.explained_variance_ratio, selector)
    return _imaged(_gathered(scores, 0, k), _Image.made(model, 0, k, only))


def component_contribution(model: PcaModel, scores: DataFrame, component: int, only: np.ndarray | None = None) -> DataFrame:
    """source, feature_id, value: a component's part of the reconstruction, scaled back without its center."""
    image = _Image.made(model, component - 1, component, only)
    image.mean, image.center = np.zeros(len(image.ids)), np.zeros(len(image.ids))
    return _imaged(_gathered(scores, component - 1, component), image)


def _beside_fitted(model: PcaModel, prepared: DataFrame, k: int, only: np.ndarray | None) -> DataFrame:
    """Prepared facts (of some features) with mean, center, scale, z and zhat, their place on the used components' plane."""
    spark = prepared.sparkSession
    some = prepared if only is None else prepared.join(sized(spark, {"feature_id": np.sort(np.asarray(only))}), "feature_id")
    facts = scaled(model, some)
    if 8 * k * len(model.columns) > BROADCAST_BYTES:
        back = reconstruct(model, scores_long(model, prepared, k), k, only).withColumnRenamed("value", "fitted")
        return facts.join(back, ["source", "feature_id"]).withColumn("zhat", (F.col("fitted") - F.col("center")) / F.col("scale"))
    both = facts.join(model.coefficient_table(spark, 0, k), "feature_id").join(_sums(model, prepared, k).select("source", "s"), "source")
    dot = F.aggregate(F.zip_with("s", "w", lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    return both.withColumn("zhat", dot + F.col("mean"))


def q_contribution(model: PcaModel, prepared: DataFrame, selector=0.9, only: np.ndarray | None = None) -> DataFrame:
    """source, feature_id, contribution: squared residual in the scaled space; their sum over features is Q."""
    k = resolve_used_components(model.explained_variance_ratio, selector)
    gap = F.col("z") - F.col("zhat")
    return _beside_fitted(model, prepared, k, only).select("source", "feature_id", (gap * gap).alias("contribution"))


def q_statistic(model: PcaModel, prepared: DataFrame, selector=0.9) -> DataFrame:
    """source, q: the sum of its squared residuals, from its norm and scores, without a row for each residual.

    With scores s = W c of a centered row c, |c - W's|^2 = |c|^2 - s'(2 - WW')s, whether or not the components are
    orthonormal. Where that is a small difference of large numbers the residuals themselves are summed.
    """
    k = resolve_used_components(model.explained_variance_ratio, selector)
    w = model.components[:k]
    inner = 2 * np.eye(k) - w @ w.T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s, norm = _matrix(b.column("s")), b.column("norm").to_numpy(zero_copy_only=False)
                q = norm - ((s @ inner) * s).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("source"), pa.array(q), pa.array(q <= SMALL_Q * norm)], names=["source", "q", "small"])

    kind = prepared.schema["source"].dataType.simpleString()
    found = cut(_sums(model, prepared, k).mapInArrow(run, f"source {kind}, q double, small boolean"))
    small = found.filter("small").select("source")
    sound = found.filter("not small").select("source", "q")
    if not small.limit(1).count():
        return sound
    again = q_contribution(model, prepared.join(small, "source", "left_semi"), k).groupBy("source").agg(F.sum("contribution").alias("q"))
    return sound.unionByName(again)


def q_consistent(contributions: DataFrame, scores: DataFrame, q_column: str, tolerance: float = 0.01) -> DataFrame:
    """source and whether its contributions sum to its Q within a relative tolerance."""
    sums = contributions.groupBy("source").agg(F.sum("contribution").alias("s"))
    return sums.join(scores.select("source", F.col(q_column).alias("q")), "source").select("source", (F.abs(F.col("s") - F.col("q")) <= tolerance * F.abs("q")).alias("consistent"))


def residual(model: PcaModel, prepared: DataFrame, selector=0.9, only: np.ndarray | None = None) -> DataFrame:
    """source, feature_id, value: prepared minus reconstructed, in the original scale."""
    k = resolve_used_components(model.explained_variance_ratio, selector)
    fitted = F.col("zhat") * F.col("scale") + F.col("center")
    return _beside_fitted(model, prepared, k, only).select("source", "feature_id", (F.col("value") - fitted).alias("value"))


def partial_scores(model: PcaModel, prepared: DataFrame, features: DataFrame, components: list[int]) -> DataFrame:
    """source, component, Step, Sequence, StepTime, score: scores as they build up over the time points."""
    spark = prepared.sparkSession
    if any(not 1 <= c <= model.n_component for c in components):
        raise ValueError("no such component")
    whole = stats.complete_sources(prepared, len(model.columns))
    if prepared.join(whole, "source", "left_anti").limit(1).count():
        raise ValueError("partial scores need a value for every feature")
    w = model.component_table(spark).filter(F.col("component").isin(components))
    z = scaled(model, prepared).join(w, "feature_id").join(features, "feature_id")
    keys = ["source", "component", "Step", "Sequence", "StepTime"]
    at = z.groupBy(*keys).agg(F.sum((F.col("z") - F.col("mean")) * F.col("coefficient")).alias("part"))
    line = Window.partitionBy("source", "component").orderBy("Step", "Sequence", "StepTime").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return at.withColumn("score", F.sum("part").over(line)).drop("part")


def transform_pca(model: PcaModel, facts: DataFrame, mahalanobis: MahalanobisConfig | None = None, spe: SpeConfig | None = None, with_features: bool = False, allow_empty: bool = False) -> DataFrame:
    """source, the prepared features if asked for, pca-1 to pca-k and, if asked for, the T2 and Q blocks (value, limit, exceeds).

    Where no source is left to score that is a ValueError, or an empty table if that is allowed.
    """
    spark = facts.sparkSession
    extra = [c for config in (mahalanobis, spe) if config for c in config.columns]
    if len({*extra, "source", *model.score_columns, *model.columns}) < len(extra) + 1 + model.n_component + len(model.columns):
        raise ValueError("output columns collide")
    prepared = cut(prepare(model, facts))
    if not allow_empty and not prepared.limit(1).count():
        raise ValueError("no row is left to score")
    long = scores_long(model, prepared)
    out = long.groupBy("source").pivot("component", list(range(1, model.n_component + 1))).agg(F.first("score"))
    out = out.select("source", *[F.col(f"`{k + 1}`").alias(n) for k, n in enumerate(model.score_columns)])
    if with_features:
        places = list(range(1, len(model.columns) + 1))
        wide = prepared.groupBy("source").pivot("feature_id", places).agg(F.first("value"))
        out = wide.select("source", *[F.col(f"`{p}`").alias(c) for p, c in zip(places, model.columns)]).join(out, "source")
    if mahalanobis:
        k = resolve_used_components(model.explained_variance_ratio, mahalanobis.cumulative_explained_variance)
        limit = model.mahalanobis_threshold(mahalanobis.alpha, k)
        table = spark.createDataFrame([(j + 1, float(v)) for j, v in enumerate(model.variances(k))], "component long, variance double")
        d, u, x = mahalanobis.columns
        out = out.join(t_squared(long, table).select("source", F.col("t2").alias(d)), "source").withColumn(u, F.lit(limit)).withColumn(x, F.col(d) > limit)
    if spe:
        k = resolve_used_components(model.explained_variance_ratio, spe.cumulative_explained_variance)
        limit = model.spe_threshold(spe.alpha, k)
        q = q_statistic(model, prepared, k).withColumnRenamed("q", spe.spe_column)
        out = out.join(q, "source").withColumn(spe.ucl_column, F.lit(limit)).withColumn(spe.exceeds_ucl_column, F.col(spe.spe_column) > limit)
    return out


def fit_and_transform_pca(facts: DataFrame, features: list[str], mahalanobis: MahalanobisConfig | None = None, spe: SpeConfig | None = None, with_features: bool = False, **fit) -> tuple[PcaModel, DataFrame]:
    """A model of facts, and their scores by it."""
    model = fit_pca(facts, features, **fit)
    return model, transform_pca(model, facts, mahalanobis, spe, with_features)


def loading_pairs(components: DataFrame, m: int, n: int, key: str = "feature_id") -> DataFrame:
    """Coefficients of two components side by side: key, pc_m, pc_n."""
    of = lambda c, name: components.filter(F.col("component") == c).select(key, F.col("coefficient").alias(name))
    return of(m, "pc_m").join(of(n, "pc_n"), key)


def parameter_table(model: PcaModel, features: DataFrame) -> DataFrame:
    """The fitted state of each feature at its coordinates: mean, center, scale, and fill and fences where the model has these."""
    found = {k: v for k, v in (("fill", model.fills), *model.fences.items()) if v is not None}
    state = model.feature_state(features.sparkSession)
    if found:
        state = state.join(_feature_rows(features.sparkSession, **found), "feature_id")
    return features.join(state, "feature_id")


def score_points(scores: DataFrame, listing: DataFrame, x: int, y: int, key: str = "source") -> DataFrame:
    """A point per source: its scores of two components beside its listing's columns, if it has any."""
    two = scores.filter(F.col("component").isin(x, y)).groupBy(key).pivot("component", [x, y]).agg(F.first("score"))
    return two.select(key, F.col(f"`{x}`").alias("x"), F.col(f"`{y}`").alias("y")).join(listing, key, "left")
