"""Rows before facts: exact values, types that differ between files, places in an order, long series in pieces."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismflow import api
from prismflow.api import materialize_and_drop_sparse, materialize_flattened, preprocess_and_flatten
from prismflow.functions.order import numbered
from prismflow.operators import flatten as fl
from prismflow.operators import preprocess as pp
from prismflow.operators import rows as rw
from prismflow.sources.spectra import common_type, load, load_rows

BIG = 2**53 + 1


def written(folder, name, columns):
    n = len(next(iter(columns.values())))
    table = pa.table({"Time": pa.array(np.arange(n, dtype=float)), "Step": pa.array([1] * n), "Sequence": pa.array([1] * n)} | columns)
    pq.write_table(table, folder / f"{name}.parquet")
    return folder / f"{name}.parquet"


def values(data, column="exact"):
    return {(r["source"].split("/")[-1][:-8], r["feature_id"]): r[column] for r in data.facts.collect()}


def test_whole_numbers_stay_exact_beside_floats(spark, tmp_path):
    path = written(tmp_path, "a", {"500.0nm": pa.array([BIG, BIG + 1]), "600.0nm": pa.array([1.5, 2.5]), "700.0nm": pa.array([7, 8], pa.int32())})
    data = preprocess_and_flatten(spark, [path], max_null_ratio=1.0)
    assert values(data) == {("a", 1): BIG, ("a", 2): BIG + 1, ("a", 3): None, ("a", 4): None, ("a", 5): 7, ("a", 6): 8}
    wide = data.wide()
    assert [f.dataType for f in wide.schema.fields[1:]] == [T.LongType()] * 2 + [T.DoubleType()] * 2 + [T.LongType()] * 2
    assert list(wide.first())[1:] == [BIG, BIG + 1, 1.5, 2.5, 7, 8]
    pruned = preprocess_and_flatten(spark, [path], max_null_ratio=0.1)
    assert values(pruned) == values(data) and pruned.wide().first() == wide.first()
    smooth = preprocess_and_flatten(spark, [path], max_null_ratio=1.0, intensity_transform="sqrt")
    assert "exact" not in smooth.facts.columns and "kind" not in smooth.features.columns


def test_decimals_and_unsigned(spark, tmp_path):
    from decimal import Decimal

    path = written(tmp_path, "a", {"500.0nm": pa.array([Decimal("12345678901234567890.25"), None], pa.decimal128(30, 2)), "600.0nm": pa.array([2**64 - 1, 3], pa.uint64())})
    with pytest.raises(ValueError):
        preprocess_and_flatten(spark, [path], max_null_ratio=1.0)  # a null
    path = written(tmp_path, "a", {"500.0nm": pa.array([Decimal("12345678901234567890.25"), Decimal("0.5")], pa.decimal128(30, 2)), "600.0nm": pa.array([2**64 - 1, 3], pa.uint64())})
    data = preprocess_and_flatten(spark, [path], max_null_ratio=1.0)
    assert values(data) == {("a", 1): Decimal("12345678901234567890.25"), ("a", 2): Decimal("0.50"), ("a", 3): 2**64 - 1, ("a", 4): 3}
    assert [f.dataType.simpleString() for f in data.wide().schema.fields[1:]] == ["decimal(30,2)"] * 2 + ["decimal(20,0)"] * 2


@pytest.mark.parametrize("turn", [False, True])
def test_types_that_differ_between_files(spark, tmp_path, turn):
    columns = [{"500.0nm": pa.array([1, 2])}, {"500.0nm": pa.array([1.5, 2.5])}]
    names = ["a", "b"] if not turn else ["b", "a"]
    paths = [written(tmp_path, n, c) for n, c in zip(names, columns)]
    data = preprocess_and_flatten(spark, paths, max_null_ratio=1.0)
    want = {(names[0], 1): 1.0, (names[0], 2): 2.0, (names[1], 1): 1.5, (names[1], 2): 2.5}
    assert values(data, "value") == want and "exact" not in data.facts.columns
    assert load(spark, paths).count() == 4


def test_common_types():
    d = T.DecimalType
    for types, want in [
        ([T.ByteType(), T.IntegerType()], T.LongType()), ([T.LongType(), T.FloatType()], T.DoubleType()), ([d(20, 0), T.LongType()], d(20, 0)), ([d(10, 4), d(12, 2)], d(14, 4)),
        ([d(38, 10), T.LongType()], d(38, 10)), ([d(38, 30), T.LongType()], T.DoubleType()), ([d(5, 5), T.DoubleType()], T.DoubleType()),
    ]:
        assert common_type(types) == want


def test_materialized_and_deferred_agree(spark, tmp_path):
    r = np.random.default_rng(1)
    paths = [written(tmp_path, f"f{k}", {f"{400 + w:.1f}nm": pa.array(r.random(5 - (k == 2))) for w in range(3)}) for k in range(3)]
    now, later = (preprocess_and_flatten(spark, paths, materialize_once=m, max_null_ratio=0.2) for m in (True, False))
    assert values(now, "value") == values(later, "value") and now.features.count() == later.features.count() == 12
    raw = preprocess_and_flatten(spark, paths, materialize_once=False, max_null_ratio=1.0)
    assert values(materialize_flattened(raw), "value") == values(raw, "value")
    assert values(materialize_and_drop_sparse(raw, 0.2), "value") == values(now, "value")


def test_rows_and_long_stages_agree(spark, tmp_path, monkeypatch):
    """The same stages on arrays and on the long table, cut in pieces that windows reach across."""
    r = np.random.default_rng(2)
    paths = []
    for k in range(3):
        n = 60 + 7 * k
        df = pd.DataFrame({"Time": np.sort(r.integers(0, 40, n) / 2.0 + r.integers(0, 2, n) * 0.1), "Step": np.repeat([1, 2], [n // 2, n - n // 2]), "Sequence": 1})
        for w in range(9):
            df[f"{400 + w * 0.7:.1f}nm"] = r.random(n) + 1
        df.to_parquet(tmp_path / f"f{k}.parquet", index=False)
        paths.append(tmp_path / f"f{k}.parquet")
    long, rows = load(spark, paths), load_rows(spark, paths)
    flat = lambda x: {(q["source"], q["row_index"], round(q["wavelength"], 6)): q["value"] for q in x.collect()}

    def unrolled(x):
        waves = spark.createDataFrame([(k, w) for k, w in enumerate(x.waves)], "band int, wavelength double")
        return x.frame.select("source", "row_index", F.posexplode("values").alias("band", "value")).join(waves, "band")

    plain = flat(pp.smooth_time(long, 1.3))
    for most in (7, 10_000):
        monkeypatch.setattr(rw, "PIECE_VALUES", most * 9)
        monkeypatch.setattr(pp, "SERIES", most)
        if most == 7:
            monkeypatch.setattr(rw, "max", lambda a, b: b, raising=False)
        both = flat(unrolled(rw.smooth_time(rows, 1.3))), flat(pp.smooth_time(long, 1.3))
        for got in both:
            assert got.keys() == plain.keys() and all(np.isclose(got[k], plain[k], rtol=1e-12) for k in got)
    for got, want in [
        (rw.smooth_wavelength(rows, 1.5), pp.smooth_wavelength(long, 1.5)), (rw.normalize_time(rows, (0.0, 18.0)), pp.normalize_time(long, (0.0, 18.0))),
        (rw.normalize_wavelength(rows, (400.5, 403.0)), pp.normalize_wavelength(long, (400.5, 403.0))), (rw.downsample_wavelength(rows, 2), pp.downsample_wavelength(long, 2)),
        (rw.transform_intensity(rows, "log1p", 2.0), pp.transform_intensity(long, "log1p", 2.0)),
    ]:
        a, b = flat(unrolled(got)), flat(want)
        assert a.keys() == b.keys() and all(np.isclose(a[k], b[k], rtol=1e-12) for k in a)
    for wrong in (lambda: rw.normalize_time(rows, (900.0, 901.0)), lambda: rw.normalize_wavelength(rows, (900.0, 901.0)), lambda: rw.transform_intensity(rows.with_values(F.transform("values", lambda v: v - 9)), "log1p", 1.0)):
        with pytest.raises(ValueError):
            wrong()


def test_a_long_series_is_many_groups(spark):
    """A million points of one series, in pieces of which none is large, against numpy."""
    n, window = 1_000_000, 2.5
    frame = spark.range(n).select(F.lit("a").alias("source"), F.col("id").alias("row_index"), (F.col("id") * 1.0).alias("Time"), F.lit(1).alias("Step"), F.lit(1).alias("Sequence"), F.lit(400.0).alias("wavelength"), (F.col("id") % 7 * 1.0).alias("value"))
    pieces = pp.in_pieces(frame, ["source", "Step", "Sequence", "wavelength"], "Time", window, 10_000)
    sizes = pieces.groupBy("piece").agg(F.count("*").alias("n"), F.count_if("own").alias("own")).toPandas()
    assert len(sizes) >= 99 and sizes.n.max() < 10_100 and sizes.own.sum() == n and sizes.n.sum() < n + 10 * len(sizes)
    got = pp.smooth_time(frame, window).agg(F.sum("value"), F.count("*"), F.sum(F.col("value") * F.col("row_index"))).first()
    v = np.arange(n) % 7 * 1.0
    sums = np.concatenate([[0], np.cumsum(v)])
    lo, hi = np.maximum(np.arange(n) - 2, 0), np.minimum(np.arange(n) + 3, n)
    mean = (sums[hi] - sums[lo]) / (hi - lo)
    assert got[1] == n and np.isclose(got[0], mean.sum()) and np.isclose(got[2], (mean * np.arange(n)).sum(), rtol=1e-9)


def test_places_without_a_window(spark, capsys):
    r = np.random.default_rng(3)
    pairs = sorted({(int(a), float(b)) for a, b in zip(r.integers(0, 50, 4000), r.integers(0, 90, 4000))})
    frame = spark.createDataFrame([(a, b, f"{a}|{b}") for a, b in pairs], "a long, b double, text string").repartition(7)
    got = numbered(frame, "a", "b")
    got.explain()
    assert "Window" not in capsys.readouterr().out
    assert sorted((r["place"], r["a"], r["b"]) for r in got.collect()) == [(k + 1, a, b) for k, (a, b) in enumerate(pairs)]
    assert got.columns == ["a", "b", "text", "place"] and numbered(frame.limit(0), "a").count() == 0
    assert {r["place"] for r in numbered(frame.filter("a = 3"), "b").collect()} == set(range(1, sum(a == 3 for a, _ in pairs) + 1))


def test_many_features_by_name(spark):
    """Names of 200,000 features are made in tasks and looked up without a list on the driver."""
    axis = spark.range(200_000).select((F.col("id") + 1).alias("feature_id"), (400.0 + F.col("id") % 100).alias("wavelength"), F.lit(1).cast("long").alias("Step"), F.lit(1).cast("long").alias("Sequence"), F.floor(F.col("id") / 100).cast("double").alias("StepTime"))
    named = fl.name_table(axis)
    assert named.count() == 200_000 and named.filter("feature = '437.0nm_1_1_12.00'").first()["feature_id"] == 1238
    twice = axis.limit(5).unionByName(axis.limit(5).withColumn("feature_id", F.col("feature_id") + 9))
    with pytest.raises(ValueError):
        fl.name_table(twice)


def test_no_window_over_an_axis(spark, tmp_path, capsys):
    paths = [written(tmp_path, f"f{k}", {"400.0nm": pa.array([1.0, 2.0]), "401.0nm": pa.array([1.0, 2.0])}) for k in range(2)]
    rows = load_rows(spark, paths)
    frame = pp.step_times(load(spark, paths))
    fl.flatten(frame)[0].explain()
    fl.flatten_rows(rw.preprocess(rows, api.PreprocessConfig()))[0].explain()
    pp.downsample_time(frame, 2).explain()
    assert "SinglePartition" not in capsys.readouterr().out
