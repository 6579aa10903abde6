"""Reconstruction, residuals and Q in blocks, against numpy; bounds turned down so that small data takes every path."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismflow.operators import pca
from prismflow.operators.pca import PcaModel, component_contribution, prepare, q_contribution, q_statistic, reconstruct, residual, score_vectors, scores_long, transform_pca
from prismflow.config import SpeConfig

N, FEATURES, K = 23, 37, 5


def model_of(orthonormal=True, whiten=False):
    r = np.random.default_rng(2)
    w = np.linalg.qr(r.normal(size=(FEATURES, K)))[0].T if orthonormal else r.normal(size=(K, FEATURES))
    lam = np.array([9.0, 4.0, 2.0, 1.0, 0.5])
    return PcaModel(
        columns=[f"f{k}" for k in range(FEATURES)], components=w, mean=r.normal(size=FEATURES), explained_variance=lam, explained_variance_ratio=lam / lam.sum() * 0.95, singular_values=np.sqrt(lam),
        n_samples=50, noise_variance=0.1, scaling="z-score", centers=r.normal(size=FEATURES), scales=1 + r.random(FEATURES), whiten=whiten,
    )


def data():
    return np.random.default_rng(3).normal(size=(N, FEATURES)) * 3


def facts_of(spark, x):
    return spark.createDataFrame([(f"s{i}", j + 1, float(v)) for i, row in enumerate(x) for j, v in enumerate(row)], "source string, feature_id long, value double").repartition(3)


def numpy_of(model, x, k):
    z = (x - model.centers) / model.scales
    s = (z - model.mean) @ model.components[:k].T
    zhat = s @ model.components[:k] + model.mean
    return z, s, zhat, zhat * model.scales + model.centers


def cells(df, value, shape=(N, FEATURES)):
    rows = df.collect()
    out = np.full(shape, np.nan)
    for r in rows:
        out[int(r["source"][1:]), r["feature_id"] - 1] = r[value]
    return len(rows), out


@pytest.fixture(params=["plain", "blocks", "grouped"])
def bounds(request, monkeypatch):
    if request.param != "plain":
        monkeypatch.setattr(pca, "BLOCK", 8)
        monkeypatch.setattr(pca, "VALUES", 32)
        monkeypatch.setattr(pca, "TOGETHER", 2)
    if request.param == "grouped":
        monkeypatch.setattr(pca, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(pca, "GROUP", 5)
    return request.param


@pytest.mark.parametrize("orthonormal,whiten", [(True, False), (False, False), (True, True)])
def test_against_numpy(spark, bounds, orthonormal, whiten):
    model, x, k = model_of(orthonormal, whiten), data(), 4
    facts = facts_of(spark, x)
    z, s, zhat, fitted = numpy_of(model, x, k)
    scores = scores_long(model, facts)
    deviations = np.sqrt(model.explained_variance) if whiten else np.ones(K)
    got = {r["source"]: r["s"] for r in score_vectors(model, facts, k).collect()}
    assert all(np.allclose(got[f"s{i}"], s[i] / deviations[:k]) for i in range(N))
    n, back = cells(reconstruct(model, scores, k), "value")
    assert n == N * FEATURES and np.allclose(back, fitted)
    assert np.allclose(cells(residual(model, facts, k), "value")[1], x - fitted)
    assert np.allclose(cells(q_contribution(model, facts, k), "contribution")[1], (z - zhat) ** 2)
    q = {r["source"]: r["q"] for r in q_statistic(model, facts, k).collect()}
    assert np.allclose([q[f"s{i}"] for i in range(N)], ((z - zhat) ** 2).sum(axis=1))
    part = cells(component_contribution(model, scores, 3), "value")[1]
    assert np.allclose(part, np.outer((z - model.mean) @ model.components[2], model.components[2]) * model.scales)


def test_only_some_features(spark, bounds):
    model, x, only = model_of(), data(), np.array([30, 2, 9])
    facts = facts_of(spark, x)
    _, _, _, fitted = numpy_of(model, x, K)
    scores = scores_long(model, facts)
    for df, want in ((reconstruct(model, scores, None, only), fitted), (residual(model, facts, K, only), x - fitted)):
        n, got = cells(df, "value")
        assert n == N * 3 and np.allclose(got[:, only - 1], want[:, only - 1]) and np.isnan(np.delete(got, only - 1, axis=1)).all()


def test_small_q_keeps_its_digits(spark):
    """A source almost on the plane: its Q is far below the rounding of its norm."""
    model = model_of()
    z = np.random.default_rng(4).normal(size=(3, K)) @ model.components * 1e5 + model.mean
    z[1] += 1e-4 * np.linalg.svd(model.components)[2][-1]
    z[2] += np.linalg.svd(model.components)[2][-1]
    facts = facts_of(spark, z * model.scales + model.centers)
    q = {r["source"]: r["q"] for r in q_statistic(model, facts, K).collect()}
    assert q["s0"] < 1e-15 and abs(q["s1"] - 1e-8) < 1e-11 and abs(q["s2"] - 1) < 1e-6


def test_missing_scores_give_nan(spark):
    model = model_of()
    scores = spark.createDataFrame([("a", c, float(c)) for c in range(1, K + 1)] + [("b", 1, None), ("b", 2, 1.0), ("c", 2, 1.0)], "source string, component long, score double")
    back = reconstruct(model, scores, 2).toPandas()
    assert len(back) == 3 * FEATURES and back[back.source == "a"].value.notna().all() and np.isnan(back[back.source != "a"].value.astype(float)).all()
    assert np.isfinite(component_contribution(model, scores.filter("source = 'c'"), 2).toPandas().value).all()


def test_q_makes_no_row_for_each_residual(spark, capsys):
    model, facts = model_of(), facts_of(spark, data())
    scored = transform_pca(model, facts, spe=SpeConfig(3))
    assert scored.count() == N
    q_statistic(model, facts, 3).explain()
    reconstruct(model, scores_long(model, facts)).explain()
    plan = capsys.readouterr().out
    assert "Generate explode" not in plan.split("MapInArrow")[0]


def test_truncated_refuses_more_than_it_has():
    with pytest.raises(ValueError):
        model_of().truncated(K + 1)
    assert model_of().truncated(K).n_component == K


def test_prepare_then_whole_transform(spark, bounds):
    model, x = model_of(), data()
    model.impute, model.fills = "median", np.zeros(FEATURES)
    facts = facts_of(spark, x).withColumn("value", F.when(F.col("feature_id") != 5, F.col("value")))
    x[:, 4] = 0
    z, _, zhat, _ = numpy_of(model, x, 3)
    got = {r["source"]: r["spe"] for r in transform_pca(model, facts, spe=SpeConfig(3)).collect()}
    assert np.allclose([got[f"s{i}"] for i in range(N)], ((z - zhat) ** 2).sum(axis=1)) and prepare(model, facts).count() == N * FEATURES
