"""The table layer, metadata, catalog and runs."""

import math
import os
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import types as T

from prismflow.operators import tables
from prismflow.operators.catalog import Catalog
from prismflow.operators.tables import TableState
from prismflow.plans.runs import fit_bytes, fit_run, monitoring, transform_run
from prismflow.sources.metadata import read_metadata, spark_pattern


@pytest.fixture(scope="module")
def frame(spark):
    rows = [
        (0, "k1", "Alpha", "a", 3, 0.5, datetime(2026, 1, 1), "first"), (1, "k2", "beta", "b", None, 2.25, datetime(2026, 3, 1, 12), None),
        (2, "k3", "Gamma", None, 1, None, datetime(2026, 2, 1), "third"), (3, "k4", "alphabet", "a", 2, 1.0, None, "fourth"),
    ]
    return spark.createDataFrame(rows, "pos int, key string, name string, `group` string, count long, score double, when timestamp, note string")


@pytest.mark.parametrize(
    "state,keys",
    [
        (TableState(), "k1 k2 k3 k4"), (TableState(search="alpha"), "k1 k4"), (TableState(search="ALPHA fourth"), "k4"), (TableState(text={"name": "et b"}), "k2 k4"), (TableState(values={"group": ["a"]}), "k1 k4"),
        (TableState(lower={"count": 2}), "k1 k4"), (TableState(upper={"count": 2.5}), "k3 k4"), (TableState(lower={"count": 2**70}), ""), (TableState(upper={"count": 2**70}), "k1 k3 k4"),
        (TableState(lower={"score": 1}, upper={"score": 2.25}), "k2 k4"), (TableState(lower={"score": -(10**400)}), "k1 k2 k4"), (TableState(only_null=["group"]), "k3"), (TableState(text={"note": "ir"}), "k1 k3"),
    ],
)
def test_filters(frame, state, keys):
    assert [r["key"] for r in tables.filter_table(frame, state).orderBy("pos").collect()] == keys.split()


def test_exact_integer_bounds(spark):
    big = spark.createDataFrame([(9007199254740992,), (9007199254740993,)], "n long")
    assert tables.filter_table(big, TableState(lower={"n": 9007199254740993})).count() == 1


def test_sort_and_page(frame):
    rows, page, pages, n = tables.page_of(frame, TableState(sort="count", page_size=3, page=9), "pos")
    assert (page, pages, n) == (2, 2, 4) and [r["key"] for r in rows.collect()] == ["k2"]
    rows, *_ = tables.page_of(frame, TableState(sort="count", descending=True), "pos")
    assert [r["key"] for r in rows.collect()] == ["k1", "k4", "k3", "k2"]


def test_counts_and_histograms(spark, frame):
    assert [tuple(r) for r in tables.value_counts(frame, "group").collect()] == [("a", 2), ("b", 1)]
    many = spark.createDataFrame([(x,) for x in "aaabbccdefg"], "v string")
    assert [tuple(r) for r in tables.top_values(many, "v").collect()] == [("a", 3), ("b", 2), ("c", 2), ("d", 1), ("e", 1), ("Others", 2)]
    ints = spark.createDataFrame([(x,) for x in range(41)], "v long")
    found = tables.histogram(ints, "v").collect()
    assert sum(r["count"] for r in found) == 41 and found[0]["upper"] - found[0]["lower"] == 3
    floats = spark.createDataFrame([(x,) for x in [0.0, 0.5, 1.0, math.nan, math.inf, None]], "v double")
    assert [(r["bin"], r["count"]) for r in tables.histogram(floats, "v", 2).collect()] == [(0, 1), (1, 2)]
    assert tables.histogram(floats.filter("v > 5 and v < 6"), "v").count() == 0
    assert [tuple(r) for r in tables.missing_counts(floats, ["v"]).collect()] == [("v", 1, 1)]


def test_merge(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, l string"), spark.createDataFrame([(2, "p"), (3, "q")], "k int, r string")
    assert {(x["k"], x["_merge"]) for x in tables.merge(a, b, ["k"], "full", True).collect()} == {(1, "left_only"), (2, "both"), (3, "right_only")}
    assert tables.merge(a, b, ["k"], "left", addons=["r"]).columns == ["k", "l", "r"]
    with pytest.raises(ValueError):
        tables.merge(a, a, ["k"])


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2])], "a int, b array<int>")
    tables.export(df, str(tmp_path / "c"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["a"]
    tables.export(df, str(tmp_path / "p"), "parquet")
    assert spark.read.parquet(str(tmp_path / "p")).columns == ["a", "b"]
    assert tables.numeric_columns(spark.createDataFrame([], T.StructType([T.StructField("d", T.DecimalType(3, 0)), T.StructField("x", T.DoubleType()), T.StructField("s", T.StringType())]))) == ["x"]


def test_metadata(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("file_name,lot,date,yield_pct,note\n run-1 , A ,2026-01-02 03:04,99.5,x\nghost,B,2026-02-01 00:00,,y\n")
    rows = read_metadata(spark, str(p), "file_name", {"lot": "category", "date": "datetime", "yield_pct": "number"}, {"date": "%Y-%m-%d %H:%M"}).orderBy("stem").collect()
    assert [tuple(r) for r in rows] == [("ghost", "B", datetime(2026, 2, 1), None), ("run-1", "A", datetime(2026, 1, 2, 3, 4), 99.5)]
    for text in ("file_name,v\na,1\na,2\n", "file_name,v\n,1\n", "file_name,v\na,x\n", "name,v\na,1\n"):
        p.write_text(text)
        with pytest.raises(ValueError):
            read_metadata(spark, str(p), "file_name", {"v": "number"})
    with pytest.raises(ValueError):
        spark_pattern("%j")


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    root, r = tmp_path_factory.mktemp("files"), np.random.default_rng(5)
    for k in range(12):
        pd.DataFrame({"Time": np.arange(5.0), "Step": [1, 1, 1, 2, 2], "Sequence": 1} | {f"{w}.0nm": r.random(5) for w in (400, 401)}).to_parquet(root / f"run-{k}.parquet", index=False)
    return root


def test_catalog(spark, files, tmp_path):
    c = Catalog(spark, tmp_path / "catalog")
    assert c.files.count() == 0
    assert c.update(files) == 12 and c.update(files) == 0
    os.utime(files / "run-3.parquet", ns=(1, 1))
    (files / "run-11.parquet").rename(files / "other-11.parquet")
    assert c.update(files) == 2 and c.files.count() == 12
    one = c.segments.filter("stem = 'run-3'").orderBy("Step").collect()
    assert [(r["Step"], r["n_rows"], r["step_time_max"]) for r in one] == [(1, 3, 2.0), (2, 2, 1.0)]
    c.set_metadata(spark.createDataFrame([("run-1", "A"), ("ghost", "B")], "stem string, lot string"))
    listed = {r["stem"]: r for r in c.listing().collect()}
    assert listed["run-1"]["lot"] == "A" and listed["run-2"]["lot"] is None and listed["run-1"]["n_segments"] == 2
    assert [r[0] for r in c.without_file().collect()] == ["ghost"] and c.without_metadata().count() == 11
    assert fit_bytes(c.segments, 12, 2) == 5 * 2 * 12 * 80
    run = c.log_run("fit", "running", {"a": 1})
    assert c.fail_interrupted() == 1 and c.runs().first()["status"] == "failed"
    c.log_run("fit", "succeeded", run_id=run)
    assert [(r["run_id"], r["status"], r["kind"]) for r in c.runs().collect()] == [(run, "succeeded", "fit")]


def test_runs(spark, files, tmp_path):
    paths = sorted(files.glob("*.parquet"))
    model = fit_run(spark, paths[:10], tmp_path / "fit", n_component=2)
    assert model.n_component == 2 and spark.read.parquet(str(tmp_path / "fit/features")).count() == 10
    assert spark.read.parquet(str(tmp_path / "fit/samples")).filter("stem = 'run-1'").count() == 1
    scores = transform_run(spark, paths, tmp_path / "fit", tmp_path / "score")
    assert scores.count() == 12
    c = Catalog(spark, tmp_path / "catalog")
    c.update(files)
    states = [r["state"] for r in monitoring(scores.limit(11), c.listing()).collect()]
    assert len(states) == 12 and states.count("unscored") == 1


def test_state_from_parameters(frame):
    state = tables.parse_state({"q": "alpha", "sort": "-count", "page": "2", "size": "1", "min.count": "1", "max.score": "2", "in.group": "a,b", "text.note": "f", "null.when": "1"}, frame.schema)
    assert state == TableState(search="alpha", text={"note": "f"}, values={"group": ["a", "b"]}, lower={"count": 1}, upper={"score": 2.0}, only_null=["when"], sort="count", descending=True, page=2, page_size=1)
    for bad in ({"x": "1"}, {"min.none": "1"}, {"sort": "none"}):
        with pytest.raises(ValueError):
            tables.parse_state(bad, frame.schema)


def test_small_views(spark, frame):
    assert [r["value"] for r in tables.options(frame, "group").collect()] == ["a", "b"]
    chart = tables.control_chart_order(frame, "count", "key").orderBy("place").collect()
    assert [r["key"] for r in chart] == ["k3", "k4", "k1", "k2"]
    assert [tables.cell_text(v) for v in (None, 1.23456789, datetime(2026, 1, 2, 3, 4, 5), 7, "x")] == ["", "1.23457", "2026-01-02 03:04:05", "7", "x"]
    assert sum(r["count"] for r in tables.time_histogram(frame, "when").collect()) == 3
    wide = tables.pivot_first(frame, ["count"], "group", "score", ["a", "b"])
    assert wide.columns == ["count", "a", "b"] and wide.filter("a = 0.5").count() == 1


def test_find_run(spark, tmp_path):
    c = Catalog(spark, tmp_path)
    assert c.find_run("fit", {"a": 1}) is None
    run = c.log_run("fit", "succeeded", {"a": 1})
    assert c.find_run("fit", {"a": 1}) == run and c.find_run("fit", {"a": 2}) is None
