"""Queries over the whole of their table, against brute force; and over short vectors, against SQL."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from prismflow.operators import stats
from prismflow.plans.queries import ORACLES, PART_ORACLES, QUERIES
from prismflow.plans.views import embedding_facts
from test_oracles import SF, tidy_rows


def matrix_of(facts):
    """Sources and features in order, and their values (NaN: missing)."""
    rows = facts.collect()
    sources, features = sorted({r["source"] for r in rows}), sorted({r["feature_id"] for r in rows})
    x = np.full((len(sources), len(features)), np.nan)
    for r in rows:
        if r["value"] is not None:
            x[sources.index(r["source"]), features.index(r["feature_id"])] = r["value"]
    return sources, features, x


def test_gram_has_every_pair(spark):
    got = {(r["a"], r["b"]): r["product"] for r in QUERIES["gram"](spark, SF).collect()}
    sources, _, x = matrix_of(embedding_facts(spark, SF))
    whole = ~np.isnan(x).any(axis=1)
    names, x = [s for s, w in zip(sources, whole) if w], x[whole]
    c = x - x.mean(axis=0)
    product = c @ c.T
    assert len(got) == len(names) * (len(names) + 1) // 2 > 10_000
    assert all(abs(got[a, names[j]] - product[i, j]) < 1e-8 for i, a in enumerate(names) for j in range(i, len(names)))


def test_gram_blocks(spark, monkeypatch):
    """Several blocks of sources and runs of features, names as sources."""
    monkeypatch.setattr(stats, "GRAM_SOURCES", 5)
    r = np.random.default_rng(2)
    x = r.normal(size=(23, 2100))
    facts = spark.createDataFrame([(f"s{i}", j + 1, float(v)) for i, row in enumerate(x) for j, v in enumerate(row)], "source string, feature_id long, value double")
    got = {(r["a"], r["b"]): r["product"] for r in stats.gram(facts).collect()}
    c = x - x.mean(axis=0)
    assert got.keys() == {(a, b) for a in (f"s{i}" for i in range(23)) for b in (f"s{j}" for j in range(23)) if a <= b}
    assert all(abs(v - c[int(a[1:])] @ c[int(b[1:])]) < 1e-6 for (a, b), v in got.items())


def shuffled(spark, job):
    """Bytes that a job's stages write to shuffles, and its result."""
    status, bus = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def stages():
        bus.waitUntilEmpty(30_000)
        found = status.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return {(found.apply(k).stageId(), found.apply(k).attemptId()): found.apply(k).shuffleWriteBytes() for k in range(found.size())}

    before = stages()
    result = job()
    return sum(n for k, n in stages().items() if k not in before), result


def test_gram_shuffles_blocks_once(spark, monkeypatch):
    """Four times the sources shuffle about four times the bytes; every pair is there once, whatever the number of blocks."""
    monkeypatch.setattr(stats, "GRAM_SOURCES", 4)
    monkeypatch.setattr(stats, "GRAM_BLOCKS", 8)
    r, bytes_of = np.random.default_rng(5), {}
    for n in (48, 192):
        x = r.normal(size=(n, 1000))  # one run of features, in blocks that compression does not find again
        names, features = np.repeat([f"s{i:03d}" for i in range(n)], 1000), np.tile(np.arange(1, 1001), n)
        facts = spark.createDataFrame(pa.table({"source": names.tolist(), "feature_id": features, "value": x.reshape(-1)}))
        bytes_of[n], rows = shuffled(spark, lambda: stats.gram(facts).collect())
        c = x - x.mean(axis=0)
        assert len(rows) == n * (n + 1) // 2 == len({(a, b) for a, b, _ in rows})
        assert all(a <= b and abs(v - c[int(a[1:])] @ c[int(b[1:])]) < 1e-9 for a, b, v in rows)
    assert 0 < bytes_of[192] < 6 * bytes_of[48]


def test_gram_does_not_shuffle_facts_by_feature(spark, tmp_path):
    """Facts too large to broadcast are shuffled to their blocks, and the blocks once; the few means come to the facts."""
    n, width = 150, 200
    x = np.random.default_rng(6).normal(size=(n, width))
    facts = pa.table({"source": np.repeat(np.arange(n), width), "feature_id": np.tile(np.arange(1, width + 1), n), "value": x.reshape(-1)})
    pq.write_table(facts, tmp_path / "facts.parquet")
    known = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")  # stands for tables beyond it
    try:
        written, rows = shuffled(spark, lambda: stats.gram(spark.read.parquet(str(tmp_path / "facts.parquet"))).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known)
    c = x - x.mean(axis=0)
    assert len(rows) == n * (n + 1) // 2 and all(abs(v - c[a] @ c[b]) < 1e-9 for a, b, v in rows)
    assert 16 < written / (n * width) < 30  # a value has 8 bytes, as a fact and in its block; a shuffle by feature adds 16


@pytest.mark.parametrize("names", [[f"s{k}" for k in range(9)], list(range(9))])
def test_dense_block_is_the_same_in_any_order(names):
    """Tasks that make a block once more, from cells that arrive in another order, have the same sources in the same rows."""
    cells = pa.table({"block": pa.array([0] * 27, pa.int32()), "run": [0] * 27, "source": [s for s in names for _ in range(3)], "feature_id": [1, 2, 3] * 9, "c": np.arange(27.0)})
    one, other = stats._dense_block(cells, 1024), stats._dense_block(cells.take(np.random.default_rng(1).permutation(27)), 1024)
    assert one.equals(other) and one["sources"][0].as_py() == sorted(names)
    assert np.frombuffer(one["matrix"][0].as_py()).reshape(9, 4)[:, 1:].tolist() == np.arange(27.0).reshape(9, 3).tolist()


@pytest.fixture(scope="module")
def short(tmp_path_factory):
    """The embeddings' table with vectors of 8 components: all that FACTS in SQL states."""
    folder, t = tmp_path_factory.mktemp("short"), pq.read_table(f"{SF}/embeddings.parquet")
    vectors = pa.array([v[:8] for v in t["embedding"].to_pylist()], pa.list_(pa.float32()))
    pq.write_table(t.set_column(t.schema.get_field_index("embedding"), "embedding", vectors), str(folder / "embeddings.parquet"))
    pq.write_table(pq.read_table(f"{SF}/labels.parquet"), str(folder / "labels.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", sorted(k for k, sql in PART_ORACLES.items() if "FROM embeddings" in sql))
def test_part_in_sql(spark, short, name):
    ours = QUERIES[name](spark, short)
    ours, c = ours.toPandas(), duckdb.connect()
    for t in ("embeddings", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{short}/{t}.parquet'")
    twin, columns = c.sql(PART_ORACLES[name]).df(), sorted(ours.columns)
    assert len(ours) and sorted(twin.columns) == columns
    assert tidy_rows(ours[columns]) == tidy_rows(twin[columns])


@pytest.fixture(scope="module")
def whole(spark):
    sources, features, x = matrix_of(embedding_facts(spark, SF))
    assert features == list(range(1, 65)) and np.isnan(x[:, 8:]).any(axis=0).all()
    return sources, x


def by_feature(df, *columns):
    rows = {r["feature_id"]: [r[c] for c in columns] for r in df.collect()}
    return np.array([rows[k] for k in sorted(rows)]).T


def test_statistics_of_all_components(spark, whole):
    sources, x = whole
    center, scale = by_feature(QUERIES["scale_z"](spark, SF), "center", "scale")
    assert len(center) == 64 and np.allclose(center, np.nanmean(x, axis=0), atol=1e-6) and np.allclose(scale, np.nanstd(x, axis=0, ddof=1), atol=1e-6)
    low, high = by_feature(QUERIES["iqr_bounds"](spark, SF), "lower", "upper")
    gone = ((x < low - 1e-6) | (x > high + 1e-6)).any(axis=1)
    assert {r[0] for r in QUERIES["outlier_drop"](spark, SF).select("source").distinct().collect()} == {s for s, g in zip(sources, gone) if not g}
    filled = matrix_of(QUERIES["median_impute"](spark, SF))[2]
    assert filled.shape == x.shape and np.allclose(filled, np.where(np.isnan(x), np.nanmedian(x, axis=0), x))
    full = x[~np.isnan(x).any(axis=1)]
    assert QUERIES["drop_missing"](spark, SF).count() == full.size > 0
    got = {(r["a"], r["b"]): r["covariance"] for r in QUERIES["covariance"](spark, SF).collect()}
    want = np.cov(full.T)
    assert len(got) == 64 * 65 // 2 and all(abs(v - want[a - 1, b - 1]) < 1e-8 for (a, b), v in got.items())


def test_pca_of_all_components(spark, whole):
    sources, x = whole
    keep = ~np.isnan(x).any(axis=1)
    z = (x[keep] - x[keep].mean(axis=0)) / x[keep].std(axis=0, ddof=1)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    got = {(r["source"], r["component"]): r["score"] for r in QUERIES["fit_and_score"](spark, SF).collect()}
    names = [n for n, k in zip(sources, keep) if k]
    assert len(got) == 3 * len(names)
    assert np.allclose(np.abs([[got[n, c] for c in (1, 2, 3)] for n in names]), np.abs(u[:, :3] * s[:3]), atol=1e-6)


def in_sql(name, folder, *tables):
    c = duckdb.connect()
    for t in tables:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c.sql(ORACLES[name]).df()


def test_wide_and_long_of_all_features(spark):
    features = {r["feature_id"]: (r["wavelength"], r["Step"], r["Sequence"], r["StepTime"]) for r in QUERIES["feature_table"](spark, SF).collect()}
    value = {(r["source"], r["feature_id"]): r["value"] for r in QUERIES["flatten_long"](spark, SF).collect()}
    sources = sorted({s for s, _ in value})
    cell = {(s, *at): value.get((s, k)) for s in sources for k, at in features.items()}
    wide = QUERIES["flatten_wide"](spark, SF).toPandas()
    assert tidy_rows(wide) == sorted((s, *[value.get((s, k)) for k in sorted(features)]) for s in sources)
    long = QUERIES["unflatten_long"](spark, SF).collect()
    assert len(long) == len(cell) and {(r["source"], r["wavelength"], r["Step"], r["Sequence"], r["StepTime"]): r["intensity"] for r in long} == cell
    back = QUERIES["unflatten_wide"](spark, SF).toPandas()
    waves = sorted({at[0] for at in features.values()})
    assert list(back.columns) == ["source", "Step", "Sequence", "StepTime", *[f"w{w:g}" for w in waves]] and len(waves) == 7
    points = {(s, *at[1:]) for s in sources for at in features.values()}
    key = lambda row: row[:4]
    assert sorted(tidy_rows(back), key=key) == sorted(((*p, *[cell[p[0], w, *p[1:]] for w in waves]) for p in points), key=key)

    twin = in_sql("flatten_wide", SF, "lineitem")
    assert list(wide.columns) == list(twin.columns) and tidy_rows(wide) == tidy_rows(twin)
    twin = in_sql("unflatten_wide", SF, "lineitem")
    assert list(back.columns) == list(twin.columns) and tidy_rows(back) == tidy_rows(twin)
    twin = in_sql("unflatten_long", SF, "lineitem")
    assert sorted((tuple(r[c] for c in twin.columns) for r in long), key=str) == sorted(tidy_rows(twin), key=str)


def test_filter_of_all_orders(spark):
    folder = SF.replace("0.001", "0.01")
    ours = QUERIES["table_filter"](spark, folder).toPandas()
    orders = pq.read_table(f"{folder}/orders.parquet").to_pandas()
    urgent = orders["o_orderpriority"].str.lower().str.contains("urgent") & orders["o_orderstatus"].isin(["F", "O"])
    want = orders[urgent & orders["o_totalprice"].between(50000, 300000)]
    assert tidy_rows(ours) == tidy_rows(want[list(ours.columns)]) and ours["o_orderkey"].max() > 4000
    twin = in_sql("table_filter", folder, "orders")
    assert tidy_rows(ours) == tidy_rows(twin[list(ours.columns)])
