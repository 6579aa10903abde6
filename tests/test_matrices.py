"""Stored matrices: round trips, ranges, and what a range reads."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismflow.operators.pca import PcaModel
from prismflow.plans import matrices
from prismflow.plans.matrices import Matrix, write_components, write_matrix


def facts_of(spark, x):
    rows = [(f"s{i:03d}", j + 1, float(v)) for i, row in enumerate(x) for j, v in enumerate(row) if not np.isnan(v)]
    return spark.createDataFrame(rows, "source string, feature_id long, value double").repartition(3)


def array_of(df, rows, columns, first=0):
    out = np.full((rows, columns), np.nan)
    for r in df.collect():
        if r["value"] is not None:
            out[int(r["source"][1:]) - first, r["feature_id"] - 1] = r["value"]
    return out


@pytest.fixture
def x(monkeypatch):
    monkeypatch.setattr(matrices, "ROWS", 8)
    monkeypatch.setattr(matrices, "FEATURES", 5)
    x = np.random.default_rng(1).normal(size=(37, 13))
    x[3, :] = x[:, 7] = x[30, 2] = x[36, 12] = np.nan
    x[9, 10:] = np.nan
    return x


@pytest.mark.parametrize("kind", ["float64", "float32"])
def test_round_trip(spark, tmp_path, x, kind):
    sources = spark.createDataFrame([(f"s{i:03d}",) for i in range(37)], "source string")
    write_matrix(facts_of(spark, x), 13, tmp_path / "m", sources, kind)
    m = Matrix.open(spark, f"file://{(tmp_path / 'm').as_posix()}")
    assert (m.n_rows, m.n_features, m.kind) == (37, 13, kind)
    want = x.astype(kind)
    whole = m.read()
    assert whole.count() == 37 * 13 and np.array_equal(array_of(whole, 37, 13).astype(kind), want, equal_nan=True)
    for row in (1, 4, 8, 9, 37):
        assert np.array_equal(m.row(row), want[row - 1], equal_nan=True) and m.row(row).dtype == np.dtype(kind)


def test_ranges_read_their_blocks_only(spark, tmp_path, x, capsys):
    m = write_matrix(facts_of(spark, x), 13, tmp_path / "m", spark.createDataFrame([(f"s{i:03d}",) for i in range(37)], "source string"))
    for first, stop in ((1, 9), (8, 10), (20, 38), (37, 38)):
        got = m.read(first, stop)
        assert got.count() == (stop - first) * 13
        assert np.array_equal(array_of(got, stop - first, 13, first - 1), x[first - 1 : stop - 1], equal_nan=True)
    assert m.blocks(1, 9).count() == 3 and m.blocks(8, 10).count() == 6 and m.blocks(1, 9, (6, 6)).count() == 1
    some = m.read(1, 9, (4, 6))
    assert some.count() == 8 * 3 and set(r[0] for r in some.select("feature_id").distinct().collect()) == {4, 5, 6}
    m.read(1, 9).explain("formatted")
    assert "GreaterThanOrEqual(row_block" in capsys.readouterr().out


def test_components(spark, tmp_path):
    w = np.random.default_rng(2).normal(size=(3, 40))
    lam = np.ones(3)
    model = PcaModel([f"f{k}" for k in range(40)], w, np.zeros(40), lam, lam / 3, lam, 9, 0.0)
    m = write_components(spark, model, tmp_path / "c")
    assert m.n_rows == 3 and all(np.array_equal(m.row(k + 1), w[k]) for k in range(3))


def test_odd_matrices(spark, tmp_path, x):
    none = spark.createDataFrame([], "source string, feature_id long, value double")
    assert write_matrix(none, 4, tmp_path / "n").read().count() == 0
    only = write_matrix(none, 7, tmp_path / "o", spark.createDataFrame([("a",)], "source string"))
    assert only.read().count() == 7 and only.read().filter(F.col("value").isNotNull()).count() == 0
    with pytest.raises(ValueError):
        write_matrix(none, 4, tmp_path / "k", kind="float16")
    with pytest.raises(FileNotFoundError):
        Matrix.open(spark, tmp_path / "nowhere")
