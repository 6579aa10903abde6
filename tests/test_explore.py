"""Segment views, trajectories and order-keeping tables, on files with a gap, against each other and against saved scores."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prismflow.api import append_pca_scores, flatten_pca, preprocess_and_flatten
from prismflow.operators import explore, tables
from prismflow.operators.pca import prepare, q_statistic
from prismflow.plans.runs import compare_models
from prismflow.sources.spectra import load_rows

WAVES = [400.0, 401.0, 402.5, 405.0, 410.0]
SHORT = "s-03"


@pytest.fixture(scope="module")
def paths(tmp_path_factory):
    root, r = tmp_path_factory.mktemp("explore"), np.random.default_rng(11)
    for k in range(8):
        factors = r.normal(size=2)
        df = pd.DataFrame({"Time": np.arange(7.0), "Step": [1] * 4 + [2] * 3, "Sequence": 1})
        for j, w in enumerate(WAVES):
            df[f"{w:.1f}nm"] = 5 + factors[0] * np.arange(7) / 7 + factors[1] * j + 0.1 * r.normal(size=7)
        (df.iloc[:-1] if k == 3 else df).to_parquet(root / f"s-{k:02d}.parquet", index=False)
    return sorted(root.glob("*.parquet"))


@pytest.fixture(scope="module")
def data(spark, paths):
    return preprocess_and_flatten(spark, paths, max_null_ratio=1.0)


@pytest.fixture(scope="module", params=["median", "drop"])
def fitted(request, spark, data):
    return request.param, flatten_pca(spark, flattened=data, n_component=3, impute_strategy=request.param, scaling_strategy="z-score")


def cells(df, value="value"):
    return {(r["source"].split("/")[-1][:-8], r["StepTime"], r["wavelength"]): r[value] for r in df.collect()}


def test_views_fit_together(spark, data, fitted):
    impute, model = fitted
    view = lambda name, **k: explore.segment_view(name, data, 2, 1, model, **k)
    given = cells(view("preprocessed"))
    assert len(given) == 8 * 3 * 5 and sum(v is None for v in given.values()) == 5
    second = view("reconstruction", component=2).cache()
    back, beside = cells(second), cells(second, "preprocessed")
    left, one, part = cells(view("residual", component=2)), cells(view("reconstruction", component=1)), cells(view("contribution", component=2))
    kept = {k for k in given if impute == "median" or k[0] != SHORT}
    assert set(back) == set(left) == set(one) == set(part) == kept
    for k in kept:
        assert beside[k] == given[k] and np.isfinite(left[k]) and np.isclose(part[k], back[k] - one[k], atol=1e-9)
        if given[k] is not None:
            assert np.isclose(back[k] + left[k], given[k])
    dropped = [r[0].split("/")[-1][:-8] for r in explore.dropped_sources(model, data).collect()]
    assert dropped == ([] if impute == "median" else [SHORT])


def test_q_contributions_of_all_segments_sum_to_q(spark, data, fitted):
    _, model = fitted
    sums = {}
    for r in explore.segments(data.features).collect():
        for k, v in cells(explore.segment_view("q_contribution", data, r["Step"], r["Sequence"], model, selector=2)).items():
            sums[k[0]] = sums.get(k[0], 0) + v
    q = {r["source"].split("/")[-1][:-8]: r["q"] for r in q_statistic(model, prepare(model, data.facts), 2).collect()}
    assert sums.keys() == q.keys() and all(np.isclose(sums[k], q[k]) for k in q)


def test_some_sources_and_refusals(spark, data, fitted, paths):
    _, model = fitted
    some = [paths[0].as_posix(), paths[5].as_posix()]
    got = cells(explore.segment_view("residual", data, 1, 1, model, component=1, sources=some))
    every = cells(explore.segment_view("residual", data, 1, 1, model, component=1))
    assert len(got) == 2 * 4 * 5 and all(np.isclose(every[k], v) for k, v in got.items())
    for wrong in (("no view", 1, 1, model, 1), ("residual", 9, 9, model, 1), ("residual", 1, 1, None, 1), ("residual", 1, 1, model, 4)):
        with pytest.raises(ValueError):
            explore.segment_view(wrong[0], data, wrong[1], wrong[2], wrong[3], component=wrong[4])


def test_raw_view(spark, paths):
    got = cells(explore.raw_view(load_rows(spark, paths), 2, 1))
    for k, p in enumerate(paths):
        df = pd.read_parquet(p)
        for _, r in df[df.Step == 2].iterrows():
            for w in WAVES:
                assert got.pop((f"s-{k:02d}", r["Time"] - 4, w)) == r[f"{w:.1f}nm"]
    assert not got
    assert explore.raw_view(load_rows(spark, paths), 7, 7).count() == 0


def test_a_view_makes_only_its_segment(spark, data, fitted, capsys):
    """The segment's features alone are made and joined; scores come from all."""
    _, model = fitted
    view = explore.segment_view("reconstruction", data, 2, 1, model, component=2)
    assert view.count() == view.select("source").distinct().count() * 15
    only = np.array([1, 2])
    from prismflow.operators.pca import _Image

    image = _Image.made(model, 0, 2, only)
    assert image.weights.shape == (2, 2) and image.nbytes < 8 * model.components[:2].size


def test_trajectories_end_at_the_saved_scores(spark, data, fitted):
    impute, model = fitted
    lines = explore.trajectories(model, data, 2, 1).toPandas()
    scores = append_pca_scores(model, data).toPandas().set_index("source")
    assert set(lines.source) == set(scores.index) and len(lines) == 7 * len(scores) and len(scores) == (8 if impute == "median" else 7)
    for source, line in lines.groupby("source"):
        line = line.sort_values("point")
        assert list(line.point) == list(range(1, 8)) and list(line.Step) == [1] * 4 + [2] * 3 and list(line.StepTime) == [0, 1, 2, 3, 0, 1, 2]
        assert np.isclose(line.x.iloc[-1], scores.loc[source, "pca-2"]) and np.isclose(line.y.iloc[-1], scores.loc[source, "pca-1"])


def test_score_and_point_tables(spark):
    samples = spark.createDataFrame([("run-10", "A", 1.23456789, datetime.datetime(2024, 5, 6, 7, 8, 9)), ("run-2", None, None, None), ("Run-1", "B", 2.0e-7, None)], "source string, `pca-1` string, x double, `place.` timestamp")
    ordered = explore.in_natural_order(samples, "source")
    assert {r["source"]: r["place"] for r in ordered.collect()} == {"Run-1": 1, "run-2": 2, "run-10": 3}
    scores = spark.createDataFrame([("run-2", 0.5, -1.0, 3.0), ("run-10", 1e9, 2.0, 4.0)], "source string, `pca-1` double, `pca-2` double, `pca-3` double")
    points = explore.score_table(scores, ordered, 3, 1)
    got = {r["place"]: (r["x"], r["y"], r["sample"]["pca-1"]) for r in points.collect()}
    assert got == {2: (3.0, 0.5, None), 3: (4.0, 1e9, "A")}
    with pytest.raises(ValueError):
        explore.score_table(scores, ordered, 3, 4)
    texts = explore.point_table(points, {"file": "sample.source", "lot": "sample.`pca-1`", "x": "sample.x", "when": "sample.`place.`", "PC3": "x", "PC1": "y"})
    assert texts.columns == ["place", "file", "lot", "x", "when", "PC3", "PC1"]
    assert sorted(tuple(r) for r in texts.collect()) == [(2, "run-2", "", "", "", "3", "0.5"), (3, "run-10", "A", "1.23457", "2024-05-06 07:08:09", "4", "1e+09")]


def test_shown_files_keep_their_places(spark):
    shown = spark.createDataFrame([(1, "b"), (2, "ghost"), (3, "a")], "place long, stem string")
    files = spark.createDataFrame([("a", "/x/a.parquet", 7), ("b", "/x/b.parquet", 9), ("c", "/x/c.parquet", 1)], "stem string, path string, n long")
    got = sorted(tuple(r) for r in explore.shown_files(shown, files).select("place", "stem", "path", "n").collect())
    assert got == [(1, "b", "/x/b.parquet", 9), (2, "ghost", "", None), (3, "a", "/x/a.parquet", 7)]


def test_csv_has_a_byte_order_mark(spark, tmp_path):
    tables.export(spark.createDataFrame([(1, "é", [1])], "a long, b string, c array<int>").coalesce(1), str(tmp_path / "t"), "csv")
    text = next((tmp_path / "t").glob("part-*.csv")).read_bytes()
    assert text.startswith(b"\xef\xbb\xbfa,b\n1,") and text.decode("utf-8-sig").splitlines() == ["a,b", "1,é"]


def test_relative_differences(spark, data, fitted):
    import dataclasses

    _, model = fitted
    other = dataclasses.replace(model, components=-model.components, explained_variance=model.explained_variance * 1.01)
    assert compare_models(model, other)["components"] == 0 and np.isclose(compare_models(model, other, relative=True)["explained_variance"], 0.01 / 1.01)


def test_a_stream_batch_without_a_source_that_scores(spark, data, fitted, tmp_path):
    from prismflow.streaming.scoring import score_stream

    impute, model = fitted
    if impute != "drop":
        return
    source = tmp_path / "in"
    one = data.facts.filter(F.col("source").contains("s-01")).select("source", "feature_id", "value")
    one.filter("feature_id < 3").coalesce(1).write.parquet(str(source))
    one.coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(one.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    score_stream(stream, model, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
