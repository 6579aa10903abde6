"""Order statistics by counting in ranges, against numpy, with the bounds turned down so that small data takes every round."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismflow.operators import ranks, stats


def facts_of(spark, features):
    rows = [(f"s{i}", k, v) for k, values in features.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "source string, feature_id long, value double").repartition(3)


def features():
    r = np.random.default_rng(4)
    out = {
        1: r.normal(size=400), 2: r.integers(-3, 4, 300).astype(float), 3: np.array([7.0]), 4: np.array([1.0, 2.0]), 5: 10.0 ** r.uniform(-300, 300, 500) * r.choice([-1, 1], 500),
        6: np.full(200, 0.1), 7: np.concatenate([np.zeros(250), r.normal(size=5)]), 8: 1 + r.integers(0, 50, 400) * 2.0**-52, 9: np.array([-0.0, 0.0, 0.0, -1e-320, 1e-320]), 11: np.concatenate([r.normal(size=50), [np.inf, -np.inf]]),
    }
    out = {k: [float(x) for x in v] for k, v in out.items()}
    out[1][::7] = [None] * len(out[1][::7])
    out[2][::5] = [float("nan")] * len(out[2][::5])
    out[10] = [None, float("nan")]
    return out


def known(values):
    return np.sort(np.array([v for v in values if v is not None and not np.isnan(v)]))


SHARES = {"p0": 0.0, "p1": 0.01, "q1": 0.25, "mid": 0.5, "q3": 0.75, "p99": 0.99, "p100": 1.0}


@pytest.mark.parametrize("bits,most", [(12, 4096), (12, 0), (3, 0), (5, 16), (1, 40)])
def test_nearest_quantiles(spark, monkeypatch, bits, most):
    monkeypatch.setattr(ranks, "BITS", bits)
    monkeypatch.setattr(ranks, "SORTED", most)
    every = features()
    if bits == 1:  # a round a bit
        every = {k: every[k] for k in (2, 4)}
    got = {r["feature_id"]: r for r in ranks.nearest_quantiles(facts_of(spark, every), SHARES).collect()}
    want = {k: known(v) for k, v in every.items()}
    assert set(got) == {k for k, v in want.items() if len(v)}
    for k, r in got.items():
        for name, q in SHARES.items():
            assert r[name] == want[k][int(np.floor((len(want[k]) - 1) * q + 0.5))], (k, name)


def test_medians(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SORTED", 8)
    every = {k: v for k, v in features().items() if k not in (5, 11)}
    got = {r["feature_id"]: r["median"] for r in ranks.medians(facts_of(spark, every)).collect()}
    assert all(np.isclose(got[k], np.median(known(v)), rtol=1e-15, atol=0) for k, v in every.items() if len(known(v)))
    assert 10 not in got


def test_features_without_values_keep_their_rows(spark):
    facts = facts_of(spark, {1: [1.0, 2.0, 4.0], 2: [None, float("nan")]})
    scaling = {r["feature_id"]: (r["center"], r["scale"]) for r in stats.fit_scaling(facts, "robust").collect()}
    assert scaling == {1: (2.0, 2.0), 2: (0.0, 1.0)}  # of three values the quartiles are the ends
    assert {r["feature_id"]: r["lower"] for r in stats.fit_outliers(facts).collect()}[2] is None
    assert {r["feature_id"]: r["fill"] for r in stats.fit_medians(facts, facts.select("feature_id").distinct()).collect()} == {1: 2.0, 2: 0.0}


def test_empty_facts(spark):
    none = spark.createDataFrame([], "source string, feature_id long, value double")
    assert ranks.nearest_quantiles(none, SHARES).count() == 0 and ranks.medians(none).count() == 0 and stats.fit_outliers(none).count() == 0


def test_no_group_holds_a_feature(spark, monkeypatch, capsys):
    """Of a feature with many values only as many as SORTED meet in a window, and nothing collects lists."""
    monkeypatch.setattr(ranks, "SORTED", 100)
    facts = spark.range(60_000).select(F.col("id").alias("source"), (F.col("id") % 2 + 1).alias("feature_id"), (F.hash("id") / 7.0).alias("value"))
    groups, window = [], ranks._counted

    def seen(rows):
        groups.append(rows.groupBy("feature_id", "range").count().agg(F.max("count")).first()[0])
        return window(rows)

    monkeypatch.setattr(ranks, "_counted", seen)
    got = {r["feature_id"]: r["q"] for r in ranks.nearest_quantiles(facts, {"q": 0.3}).collect()}
    rows = facts.toPandas()
    for k in (1, 2):
        v = np.sort(rows[rows.feature_id == k].value.to_numpy())
        assert got[k] == v[int(np.floor((len(v) - 1) * 0.3 + 0.5))]
    assert len(groups) >= 2 and groups[1] < groups[0] / 2
    ranks.nearest_quantiles(facts, {"q": 0.3}).explain()
    assert "collect_list" not in capsys.readouterr().out
