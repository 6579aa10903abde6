"""PCA stages, limits, contributions and serialisation against numpy and closed forms."""

import math

import numpy as np
import pytest

from prismflow.functions.distributions import chi2_upper, f_upper, normal_upper
from prismflow.operators import pca
from prismflow.operators.flatten import reshape_components
from prismflow.plans.runs import compare_models


def facts_of(spark, x):
    rows = [(f"s{i:02d}", j + 1, None if np.isnan(v) else float(v)) for i, row in enumerate(x) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "source string, feature_id long, value double")


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(3)
    x = r.normal(size=(30, 2)) @ r.normal(size=(2, 5)) + 0.1 * r.normal(size=(30, 5))
    x[4, 2] = x[9, 0] = np.nan
    x[12, 3] = 40
    return x


NAMES = [f"f{k}" for k in range(5)]


def test_covariance_and_gram_agree_with_svd(spark):
    r = np.random.default_rng(1)
    for shape in ((20, 6), (6, 20)):
        x = r.normal(size=shape)
        model = pca.fit_pca(facts_of(spark, x), [f"f{k}" for k in range(shape[1])], scaling="none", n_component=4)
        c = x - x.mean(axis=0)
        _, s, vt = np.linalg.svd(c, full_matrices=False)
        assert np.allclose(model.explained_variance, s[:4] ** 2 / (shape[0] - 1))
        assert np.allclose(np.abs(np.sum(model.components * vt[:4], axis=1)), 1)
        assert np.isclose(model.noise_variance, (s[4:] ** 2 / (shape[0] - 1)).mean())


@pytest.mark.parametrize("impute,outlier,scaling", [("drop", None, "robust"), ("median", "winsorize", "z-score"), ("kmeans", "drop", "pareto"), ("median", None, "minmax")])
def test_stages_and_identities(spark, data, impute, outlier, scaling):
    facts = facts_of(spark, data)
    model = pca.fit_pca(facts, NAMES, impute=impute, outlier=outlier, scaling=scaling)
    prepared = pca.prepare(model, facts).cache()
    scores = pca.scores_long(model, prepared)
    back = {(r[0], r[1]): r[2] for r in pca.reconstruct(model, scores).collect()}
    own = {(r["source"], r["feature_id"]): r["value"] for r in prepared.collect()}
    assert back.keys() == own.keys() and all(abs(back[k] - own[k]) < 1e-8 for k in own)  # all components give all back
    left = {(r[0], r[1]): r[2] for r in pca.residual(model, prepared, 2).collect()}
    two = {(r[0], r[1]): r[2] for r in pca.reconstruct(model, scores, 2).collect()}
    assert all(abs(own[k] - two[k] - left[k]) < 1e-8 for k in own)
    parts = {}
    for c in (1, 2):
        for r in pca.component_contribution(model, scores, c).collect():
            parts[r[0], r[1]] = parts.get((r[0], r[1]), 0) + r[2]
    base = model.mean * model.scales + model.centers
    assert all(abs(parts[k] + base[k[1] - 1] - two[k]) < 1e-8 for k in own)
    again = pca.PcaModel.from_json(model.to_json())
    assert max(compare_models(model, again).values()) == 0 and again.impute == impute and again.outlier == outlier
    axes = spark.createDataFrame([(f + 1, 1, 1, float(f // 2)) for f in range(5)], "feature_id long, Step long, Sequence long, StepTime double")
    ends = {(r["source"], r["component"]): r["score"] for r in pca.partial_scores(model, prepared, axes, [1, 2]).filter("StepTime = 2").collect()}
    full = {(r["source"], r["component"]): r["score"] for r in scores.collect()}
    assert all(abs(v - full[k]) < 1e-9 for k, v in ends.items())


def test_limits(spark, data):
    model = pca.fit_pca(facts_of(spark, data), NAMES, impute="median", scaling="z-score")
    n = model.n_samples
    assert math.isclose(model.mahalanobis_threshold(0.01, 2), 2 * (n + 1) * (n - 1) / (n * (n - 2)) * f_upper(0.01, 2, n - 2))
    assert model.spe_threshold(0.01, 2) > model.spe_threshold(0.05, 2) > 0
    assert model.truncated(2).noise_variance == pytest.approx(model.explained_variance[2:].mean())
    assert model.truncated(2).spe_threshold(0.01, 2) > 0
    with pytest.raises(ValueError):
        model.spe_threshold(0.01, 5)
    with pytest.raises(ValueError):
        model.mahalanobis_threshold(0)
    for bad in (True, 0, 1.5, "x"):
        with pytest.raises(ValueError):
            pca.resolve_used_components(model.explained_variance_ratio, bad)


def test_distributions():
    assert f_upper(0.05, 2, 10) == pytest.approx(4.10282101513, rel=1e-10)
    assert f_upper(1e-300, 2, 10) == pytest.approx(5e60, rel=1e-9)  # (1 + f / 5) ** -5
    assert f_upper(0.9, 2, 10) == pytest.approx(5 * (0.9**-0.2 - 1), rel=1e-9)
    assert chi2_upper(0.05, 3) == pytest.approx(7.81472790325, rel=1e-10)
    assert chi2_upper(1e-100, 2) == pytest.approx(200 * math.log(10), rel=1e-10)
    assert normal_upper(0.025) == pytest.approx(1.95996398454, rel=1e-10)


def test_fit_refusals(spark, data):
    facts = facts_of(spark, data)
    for bad in ({"impute": "mean"}, {"outlier": "x"}, {"scaling": "x"}, {"kmeans_n_clusters": 3}, {"n_component": 9}):
        with pytest.raises(ValueError):
            pca.fit_pca(facts, NAMES, **bad)
    with pytest.raises(ValueError):
        pca.fit_pca(facts_of(spark, np.full((3, 5), np.nan)), NAMES)
    with pytest.raises(KeyError):
        pca.PcaModel.from_payload({"columns": []})


def test_reshape(spark):
    axes = [(1, 400.0, 1, 1, 0.0), (2, 400.0, 1, 1, 1.0), (3, 401.0, 1, 1, 0.0), (4, 401.0, 1, 1, 1.0)]
    table = spark.createDataFrame(axes, "feature_id long, wavelength double, Step long, Sequence long, StepTime double")
    w = spark.createDataFrame([(1, f, f / 10) for f in range(1, 5)], "component long, feature_id long, coefficient double")
    assert [(r["StepTime"], r["wavelength"], r["coefficient"]) for r in reshape_components(w, table).collect()] == [(0.0, 400.0, 0.1), (0.0, 401.0, 0.3), (1.0, 400.0, 0.2), (1.0, 401.0, 0.4)]
    with pytest.raises(ValueError):
        reshape_components(w, table.filter("feature_id < 4"))


def test_stream_scores_equal_batch(spark, data, tmp_path):
    from prismflow.streaming.scoring import score_stream

    facts = facts_of(spark, data)
    model = pca.fit_pca(facts, NAMES, impute="median", scaling="z-score", n_component=2)
    facts.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(facts.schema).parquet(str(tmp_path / "in"))
    score_stream(stream, model, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination(120)
    key = lambda df: sorted((r["source"], round(r["pca-1"], 9)) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(pca.transform_pca(model, facts))
