"""Files to facts against numpy, and every refusal."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prismflow.api import align_features, append_pca_scores, flatten_pca, preprocess_and_flatten
from prismflow.config import MahalanobisConfig, PreprocessConfig, SpeConfig
from prismflow.functions.names import feature_name, feature_of, natural_key, wavelength_of
from prismflow.operators import flatten as fl
from prismflow.sources.spectra import resolve_paths

WAVES = [400.0, 401.0, 402.5, 405.0]


@pytest.fixture(scope="module")
def frames():
    r = np.random.default_rng(11)
    out = {}
    for k in range(6):
        df = pd.DataFrame({"Time": np.arange(7.0), "Step": [1, 1, 1, 1, 2, 2, 2], "Sequence": [1] * 7} | {f"{w:.1f}nm": r.random(7) + 5 for w in WAVES})
        out[f"s-{k}"] = df.iloc[:-1] if k == 3 else df
    return out


@pytest.fixture(scope="module")
def paths(frames, tmp_path_factory):
    root = tmp_path_factory.mktemp("spectra data")  # a blank in the path
    for name, df in frames.items():
        df.to_parquet(root / f"{name}.parquet", index=False)
    return sorted(root.glob("*.parquet"))


def by_hand(frames, change=lambda df: df):
    out = {}
    for name, df in frames.items():
        df = df.copy()
        seg = ((df["Step"] != df["Step"].shift()) | (df["Sequence"] != df["Sequence"].shift())).cumsum()
        df["StepTime"] = df["Time"] - df.groupby(seg)["Time"].transform("min")
        df["Reverse"] = df.groupby(seg)["Time"].transform("max") - df["Time"]
        for _, r in change(df).iterrows():
            for w in WAVES:
                if f"{w:.1f}nm" in r:
                    out[name, feature_name(w, r["Step"], r["Sequence"], r["StepTime"])] = r[f"{w:.1f}nm"]
    return out


def got(data):
    names = dict(fl.named_features(data.features))
    return {(r["source"].split("/")[-1][:-8], names[r["feature_id"]]): r["value"] for r in data.facts.collect()}


def close(a, b):
    assert a.keys() == b.keys()
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_plain_flatten(spark, paths, frames):
    data = preprocess_and_flatten(spark, paths, max_null_ratio=1.0)
    close(got(data), by_hand(frames))
    wide = data.wide()
    assert wide.columns[0] == "source" and wide.count() == 6
    assert wide.columns[1:] == sorted(wide.columns[1:], key=feature_of)
    assert [r["source"] for r in wide.collect()] == [p.as_posix() for p in paths]


def test_sparse_features_go(spark, paths):
    assert preprocess_and_flatten(spark, paths, max_null_ratio=0.1).features.count() == 24
    assert preprocess_and_flatten(spark, paths, max_null_ratio=0.2).features.count() == 28


def test_trim_range_and_strides(spark, paths, frames):
    data = preprocess_and_flatten(spark, paths, edge_trim=(1.0, 1.0), wavelength_range=(401, 405), w_downsampling_stride=2, t_downsampling_stride=2, max_null_ratio=1.0)
    kept = lambda df: df[(df["StepTime"] >= 1) & (df["Reverse"] >= 1)]
    times = sorted({t for df in frames.values() for (_, t) in [(0, 0)] for t in kept(_timed(df))["Time"]})[::2]
    close(got(data), by_hand(frames, lambda df: kept(df)[kept(df)["Time"].isin(times)].drop(columns=["400.0nm", "402.5nm"])))


def _timed(df):
    df = df.copy()
    seg = ((df["Step"] != df["Step"].shift()) | (df["Sequence"] != df["Sequence"].shift())).cumsum()
    df["StepTime"] = df["Time"] - df.groupby(seg)["Time"].transform("min")
    df["Reverse"] = df.groupby(seg)["Time"].transform("max") - df["Time"]
    return df


def test_smoothing_and_normalization(spark, paths, frames):
    def change(df):
        names = [f"{w:.1f}nm" for w in WAVES]
        x = df[names].to_numpy()
        for _, g in df.groupby(["Step", "Sequence"]):
            at = [df.index.get_loc(i) for i in g.index]
            t = g["Time"].to_numpy()
            x[at] = np.array([df[names].to_numpy()[at][np.abs(t - u) <= 1].mean(axis=0) for u in t])
        x = np.array([x[:, [abs(v - w) <= 1.5 for v in WAVES]].mean(axis=1) for w in WAVES]).T
        for _, g in df.groupby(["Step", "Sequence"]):
            at = [df.index.get_loc(i) for i in g.index]
            inside = g["Time"].between(0, 5).to_numpy()
            x[at] = x[at] / x[at][inside].mean(axis=0)
        x = x / x[:, [0, 1]].mean(axis=1, keepdims=True)
        return df.assign(**dict(zip(names, np.arcsinh(x / 2).T)))

    data = preprocess_and_flatten(spark, paths, t_smoothing_window=1.0, w_smoothing_window=1.5, t_normalization_range=(0, 5), w_normalization_range=(400, 401), intensity_transform="asinh", intensity_transform_scale=2.0, max_null_ratio=1.0)
    close(got(data), by_hand(frames, change))


def test_fit_and_score_end_to_end(spark, paths):
    data = preprocess_and_flatten(spark, paths)
    model = flatten_pca(spark, flattened=data, n_component=3)
    wide = data.wide().toPandas()
    x = wide[model.columns].to_numpy()
    c = x - x.mean(axis=0)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(model.explained_variance, s[:3] ** 2 / 5)
    assert np.allclose(np.abs(model.components @ vt[:3].T), np.eye(3), atol=1e-8)
    scored = append_pca_scores(model, data, mahalanobis=MahalanobisConfig(2), spe=SpeConfig(2)).toPandas().set_index("source").loc[wide["source"]]
    t = c @ model.components.T
    assert np.allclose(scored[model.score_columns].to_numpy(), t)
    assert np.allclose(scored["mahalanobis_sq"], (t[:, :2] ** 2 / model.explained_variance[:2]).sum(axis=1))
    assert np.allclose(scored["spe"], ((c - t[:, :2] @ model.components[:2]) ** 2).sum(axis=1))
    assert (scored["mahalanobis_exceeds_ucl"] == (scored["mahalanobis_sq"] > scored["mahalanobis_ucl"])).all()


def test_new_files_align(spark, paths):
    model = flatten_pca(spark, paths[:4], n_component=1, impute_strategy="median", max_null_ratio=1.0)
    few = preprocess_and_flatten(spark, paths[4:], target_steps=[1], max_null_ratio=1.0)
    assert append_pca_scores(model, align_features(few, model)).count() == 2
    with pytest.raises(ValueError):
        align_features(few, flatten_pca(spark, paths, wavelength_range=(400, 400), target_steps=[2], n_component=1))


@pytest.mark.parametrize("settings", [{"edge_trim": (1,)}, {"edge_trim": "ab"}, {"wavelength_range": (5, 1)}, {"t_smoothing_window": 0}, {"w_smoothing_window": True}, {"t_normalization_range": (0, float("nan"))}, {"intensity_transform": "log"}, {"intensity_transform_scale": -1}, {"t_downsampling_stride": 0}, {"w_downsampling_stride": 1.5}, {"max_null_ratio": 2}, {"workers": 0}, {"workers": None}, {"stem_uniqueness": "no"}])
def test_refused_settings(settings):
    with pytest.raises(ValueError):
        PreprocessConfig(**settings)


def test_refused_paths(tmp_path, paths):
    with pytest.raises(FileNotFoundError):
        resolve_paths([tmp_path / "none.parquet"])
    for bad in ([], "x.parquet", [tmp_path]):
        with pytest.raises(ValueError):
            resolve_paths(bad)
    (tmp_path / paths[0].name).write_bytes(b"")
    with pytest.raises(ValueError):
        resolve_paths([paths[0], tmp_path / paths[0].name], "error")
    with pytest.warns(UserWarning):
        resolve_paths([paths[0], tmp_path / paths[0].name], "warn")


def _file(tmp_path, **change):
    df = pd.DataFrame({"Time": [0.0, 1.0], "Step": [1, 1], "Sequence": [1, 1], "400.0nm": [1.0, 2.0]} | change)
    df = df[[c for c in df if df[c].notna().any() or c != "gone"]]
    p = tmp_path / "a.parquet"
    df.to_parquet(p, index=False)
    return [p]


@pytest.mark.parametrize("change", [{"400.0nm": [1.0, None]}, {"400.0nm": [1.0, float("inf")]}, {"400nm": [1.0, 2.0]}, {"note": ["x", "y"]}, {"Step": ["a", "b"]}])
def test_refused_values(spark, tmp_path, change):
    with pytest.raises(ValueError):
        preprocess_and_flatten(spark, _file(tmp_path, **change))


def test_other_refusals(spark, tmp_path, paths):
    with pytest.raises(ValueError):
        preprocess_and_flatten(spark, _file(tmp_path, Time=[0.0, 0.0]), validate_metadata_uniqueness=True)
    with pytest.raises(ValueError):
        preprocess_and_flatten(spark, paths, validate_metadata_alignment=True)
    with pytest.raises(ValueError):
        preprocess_and_flatten(spark, paths, wavelength_range=(1, 2))
    with pytest.raises(ValueError):
        preprocess_and_flatten(spark, paths, t_normalization_range=(90, 91))
    with pytest.raises(ValueError):
        preprocess_and_flatten(spark, _file(tmp_path, **{"400.0nm": [-5.0, 1.0]}), intensity_transform="log1p")
    with pytest.raises(ValueError):
        flatten_pca(spark)
    # values outside the chosen range are not looked at
    p = _file(tmp_path, **{"500.0nm": [None, 1.0]})
    assert preprocess_and_flatten(spark, p, wavelength_range=(400, 410)).facts.count() == 2


def test_names(spark):
    assert feature_name(400, 1, 2, 0.125) == "400.0nm_1_2_0.12" and feature_name(400, 1, 2, 2.675) == "400.0nm_1_2_2.67"
    assert feature_of("400.0nm_1_2_0.12") == (400.0, 1, 2, 0.12) and wavelength_of("400.0nm") == 400
    for bad in ("400nm", "nannm", "x", "400.00nm"):
        with pytest.raises(ValueError):
            wavelength_of(bad)
    df = spark.createDataFrame([("run-10",), ("run-2",), ("Run-1",)], "s string")
    assert [r[0] for r in df.orderBy(natural_key(F.col("s"))).collect()] == ["Run-1", "run-2", "run-10"]


def test_unflatten_round_trip(spark, paths):
    data = preprocess_and_flatten(spark, paths, max_null_ratio=1.0)
    long = fl.flatten_to_long(data.wide())
    assert long.columns == ["source", "Step", "Sequence", "StepTime", "wavelength", "intensity"] and long.filter("intensity is not null").count() == data.facts.count()
    wide = fl.flatten_to_wide(data.wide(), drop_all_null_rows=True)
    assert wide.columns[4:] == [f"{w:.1f}nm" for w in WAVES] and wide.count() == 6 * 7 - 1
    with pytest.raises(ValueError):
        fl.flatten_to_long(data.wide(), "Step")
    with pytest.raises(ValueError):
        data.wide(limit=3)


def test_scan_reads_what_is_asked_for(spark, paths):
    from prismflow.sources.spectra import load

    frame = load(spark, paths, PreprocessConfig(target_steps=[1, 2], wavelength_range=(401, 403)))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    read = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert read and all("400.0nm" not in line and "405.0nm" not in line for line in read)
    assert any("In(Step, [1,2])" in line for line in read)


def test_segment_rows(spark, paths):
    from prismflow.operators.catalog import segment_rows
    from prismflow.operators.preprocess import step_times
    from prismflow.sources.spectra import load

    timed = step_times(load(spark, paths[:1]))
    assert [r["StepTime"] for r in segment_rows(timed, 2, 1).filter("wavelength = 400").collect()] == [0.0, 1.0, 2.0]
    with pytest.raises(ValueError):
        segment_rows(timed, 9, 9)
