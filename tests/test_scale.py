"""Plans that hold at any size, with bounds turned down so that small data meets them, against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prismflow.api import append_pca_scores, flatten_pca, preprocess_and_flatten
from prismflow.functions.names import natural_key
from prismflow.operators import pca, stats
from prismflow.operators import preprocess as pp
from prismflow.operators.catalog import Catalog
from prismflow.plans.queries import QUERIES
from prismflow.plans.views import source_name, spectral_files
from prismflow.sources.spectra import load

SF = "/root/testdata/sf0.001"


def facts_of(spark, x):
    return spark.createDataFrame([(f"s{i}", j + 1, float(v)) for i, row in enumerate(x) for j, v in enumerate(row)], "source string, feature_id long, value double")


def test_covariance_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(stats, "COVARIANCE_SOURCES", 7)
    r = np.random.default_rng(3)
    x = r.normal(size=(31, 1100)) + 5
    got = stats.covariance(facts_of(spark, x)).toPandas()
    want, out = np.cov(x.T), np.zeros((1100, 1100))
    out[got["a"] - 1, got["b"] - 1] = got["covariance"]
    assert len(got) == 1100 * 1101 // 2 and np.allclose(np.triu(out), np.triu(want), atol=1e-9)


def test_no_pair_join_in_covariance(spark, capsys):
    stats.covariance(facts_of(spark, np.ones((4, 3)))).explain()
    assert "MapInArrow" in capsys.readouterr().out


def test_many_samples_and_features(spark, monkeypatch):
    """Leading components where neither matrix may be solved on the driver."""
    monkeypatch.setattr(pca, "MAX_ORDER", 10)
    r = np.random.default_rng(1)
    x = r.normal(size=(60, 4)) * [9, 5, 3, 2] @ r.normal(size=(4, 80)) + r.normal(size=(60, 80)) * 0.3
    model = pca.fit_pca(facts_of(spark, x), [f"f{k}" for k in range(80)], scaling="none", n_component=3)
    c = x - x.mean(axis=0)
    _, s, v = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(model.explained_variance, s[:3] ** 2 / 59, rtol=1e-7)
    assert np.allclose(np.abs((model.components * v[:3]).sum(axis=1)), 1, atol=1e-7)
    assert np.allclose(model.explained_variance_ratio, s[:3] ** 2 / (s**2).sum(), rtol=1e-7)
    assert np.isclose(model.noise_variance, (s[3:] ** 2 / 59).sum() / (60 - 3), rtol=1e-6)


def test_k_means_in_spark(spark, monkeypatch):
    monkeypatch.setattr(pca, "SEED_VALUES", 300)
    r = np.random.default_rng(5)
    true = r.normal(size=(4, 6)) * 20
    x = true[np.arange(200) % 4] + r.normal(size=(200, 6)) * 0.1
    found = pca.fit_centroids(facts_of(spark, x), 6, 4)
    want = np.array([x[np.arange(200) % 4 == k].mean(axis=0) for k in range(4)])
    order = [int(((found - w) ** 2).sum(axis=1).argmin()) for w in want]
    assert sorted(order) == [0, 1, 2, 3] and np.allclose(found[order], want, atol=1e-9)


@pytest.mark.parametrize("window", [0.1, 0.30000000000000004, 1.5])
def test_smoothing_edges_and_odd_values(spark, window):
    """The distance itself decides at the edges of a window; nulls are left out, NaN and infinity are not."""
    r = np.random.default_rng(7)
    waves = np.concatenate([400 + np.arange(40) * 0.1, [410.0, 410.0, 411.5]])
    values = [None if k % 9 == 4 else float("nan") if k == 20 else float("inf") if k == 30 else float(v) for k, v in enumerate(r.normal(size=len(waves)))]
    rows = [("a", 0, 0.0, 1, 1, float(w), v) for w, v in zip(waves, values)] + [("a", k, float(w), 1, 1, 500.0, v) for k, (w, v) in enumerate(zip(waves, values), 1)]
    frame = spark.createDataFrame(rows, "source string, row_index long, Time double, Step long, Sequence long, wavelength double, value double")
    want = []
    for w in waves:
        near = [v for u, v in zip(waves, values) if abs(u - w) <= window and v is not None]
        want.append((w, np.mean(near) if near else None))
    same = lambda a, b: a is None and b is None or a is not None and b is not None and (np.isnan(a) and np.isnan(b) or a == b or abs(a - b) < 1e-9)
    by = lambda df, axis: sorted(((x[axis], x["value"]) for x in df.collect()), key=lambda t: (t[0], str(t[1])))
    for df, axis in ((pp.smooth_wavelength(frame.filter("row_index = 0"), window), "wavelength"), (pp.smooth_time(frame.filter("row_index > 0"), window), "Time")):
        got = by(df, axis)
        assert all(a[0] == b[0] and same(a[1], b[1]) for a, b in zip(got, sorted(want, key=lambda t: (t[0], str(t[1]))))) and len(got) == len(want)
        assert df.columns == frame.columns


def test_long_numbers_sort_as_numbers(spark):
    names = ["a2", "a10", "a" + "9" * 45, "a1" + "0" * 45, "a", "a007", "a7b", "b1"]
    got = [r["n"] for r in spark.createDataFrame([(n,) for n in reversed(names)], "n string").orderBy(natural_key(F.col("n")), "n").collect()]
    assert got == ["a", "a2", "a007", "a7b", "a10", "a" + "9" * 45, "a1" + "0" * 45, "b1"]


def test_files_by_uri(spark):
    """Paths that only Spark opens give the rows that local ones give."""
    paths = spectral_files(spark, SF)
    key = lambda df: sorted(map(tuple, df.select(source_name(), "Time", "wavelength", "value").collect()))
    assert key(load(spark, [f"file://{p}" for p in paths])) == key(load(spark, paths)) and len(paths) == 10


def test_fit_of_files(spark):
    got = QUERIES["file_fit_and_score"](spark, SF).toPandas()
    data = preprocess_and_flatten(spark, spectral_files(spark, SF), t_smoothing_window=1.0, max_null_ratio=0.0)
    wide = data.facts.withColumn("source", source_name()).toPandas().pivot(index="source", columns="feature_id", values="value")
    x = wide.to_numpy()
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    scores = got.set_index("source").loc[wide.index, ["pca-1", "pca-2", "pca-3"]].to_numpy()
    assert np.allclose(np.abs(scores), np.abs(u[:, :3] * s[:3]), atol=1e-6)


def test_scores_beside_features(spark):
    r = np.random.default_rng(0)
    facts, names = facts_of(spark, r.normal(size=(9, 4))), ["a", "b", "c", "d"]
    model, out = pca.fit_and_transform_pca(facts, names, with_features=True, scaling="none", n_component=2)
    assert out.columns == ["source", *names, "pca-1", "pca-2"] and out.count() == 9
    with pytest.raises(ValueError):
        pca.transform_pca(model, facts.filter("feature_id < 4"))
    prepared = facts.filter("source <> 's1' or feature_id < 3")
    with pytest.raises(ValueError):
        pca.partial_scores(model, prepared, spark.createDataFrame([(k, 1, 1, 0.0) for k in (1, 2, 3, 4)], "feature_id long, Step long, Sequence long, StepTime double"), [1])


def test_transform_runs_are_found_by_their_files(spark, tmp_path):
    for k in range(2):
        pd.DataFrame({"Time": [0.0, 1.0], "Step": [1, 1], "Sequence": [1, 1], "400.0nm": [1.0, 2.0]}).to_parquet(tmp_path / f"f{k}.parquet", index=False)
    catalog = Catalog(spark, tmp_path / "catalog")
    catalog.update(tmp_path, "f*.parquet")
    config = catalog.transform_config("fit", ["f0", "f1"], {"a": 1})
    run = catalog.log_run("transform", "succeeded", config)
    assert catalog.find_transform("fit", ["f1", "f0"], {"a": 1}) == run
    assert catalog.find_transform("fit", ["f0"], {"a": 1}) is None and catalog.find_transform("other", ["f0", "f1"], {"a": 1}) is None
    pd.DataFrame({"Time": [0.0], "Step": [1], "Sequence": [1], "400.0nm": [1.0]}).to_parquet(tmp_path / "f0.parquet", index=False)
    catalog.update(tmp_path, "f*.parquet")
    assert catalog.find_transform("fit", ["f0", "f1"], {"a": 1}) is None


def test_append_scores_takes_features(spark):
    data = preprocess_and_flatten(spark, spectral_files(spark, SF), target_steps=[0], max_null_ratio=0.0)
    model = flatten_pca(spark, flattened=data, n_component=2)
    assert len(append_pca_scores(model, data, with_features=True).columns) == 1 + len(model.columns) + 2


@pytest.mark.parametrize("decay", ["fast", "slow", "steps"])
def test_leading_components_in_few_passes(spark, monkeypatch, decay):
    """Within a 1e-6 of an SVD after six passes at most, and the bound holds."""
    monkeypatch.setattr(pca, "MAX_ORDER", 10)
    r = np.random.default_rng(8)
    n, f, k = 300, 240, 4
    sizes = {"fast": 0.7 ** np.arange(f), "slow": 1 / (1 + np.arange(f)), "steps": np.where(np.arange(f) < k, 5 - np.arange(f), 0.05)}[decay]
    x = np.linalg.qr(r.normal(size=(n, f)))[0] * sizes @ np.linalg.qr(r.normal(size=(f, f)))[0].T * 30 + r.normal(size=f)
    facts = facts_of(spark, x).cache()
    passes, summed = [], pca._summed
    monkeypatch.setattr(pca, "_summed", lambda *a: passes.append(1) or summed(*a))
    values, components, total, bound = pca._leading(facts, x.mean(axis=0), n, k)
    _, s, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    want = s**2 / (n - 1)
    assert len(passes) <= 6 and np.isclose(total, want.sum())
    assert np.abs(values - want[:k]).max() <= max(bound, 1e-12 * want[0]) * 1.01 and np.allclose(values, want[:k], rtol=1e-6)
    assert np.allclose(np.abs((components * v[:k]).sum(axis=1)), 1, atol=1e-6) and np.allclose(components @ components.T, np.eye(k), atol=1e-9)


def test_a_flat_spectrum_is_told(spark, monkeypatch):
    """Where nothing leads, six passes can't tell which direction does, and a warning says so."""
    monkeypatch.setattr(pca, "MAX_ORDER", 10)
    monkeypatch.setattr(pca, "SPARE", 0)
    x = np.random.default_rng(9).normal(size=(200, 150))
    with pytest.warns(UserWarning, match="leading components"):
        pca._leading(facts_of(spark, x), x.mean(axis=0), 200, 1)


def test_many_components_of_few_sources(spark, monkeypatch):
    """More components than are summed side by side."""
    monkeypatch.setattr(pca, "TOGETHER", 3)
    x = np.random.default_rng(10).normal(size=(9, 30))
    model = pca.fit_pca(facts_of(spark, x), [f"f{k}" for k in range(30)], scaling="none", n_component=8)
    _, s, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(model.explained_variance, s[:8] ** 2 / 8) and np.allclose(np.abs((model.components * v[:8]).sum(axis=1)), 1)
