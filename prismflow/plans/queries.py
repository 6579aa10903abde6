"""Registered queries of the spectral engine and their DuckDB twins, side by side."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismflow.api import append_pca_scores, flatten_pca, preprocess_and_flatten, reshape_pca_components, Flattened
from prismflow.config import MahalanobisConfig, SpeConfig
from prismflow.functions.names import natural_key
from prismflow.operators import flatten as fl
from prismflow.operators import preprocess as pp
from prismflow.operators import explore, ranks, stats, tables
from prismflow.operators.pca import PcaModel, loading_pairs, parameter_table, score_points, fit_pca, prepare, q_contribution, q_statistic, transform_pca, reconstruct, scores_long, t_squared, partial_scores, residual, component_contribution
from prismflow.plans.views import BEYOND, EVENTS, FACTS, FILLED, SHORT, SPECTRA, TIMED, WHOLE_FACTS, WIDTH, embedding_facts, facts_sql, embedding_width, event_points, source_name, spectra, spectral_files, table
from prismflow.sources.spectra import bad_values, load, load_rows, repeated_keys, resolve_paths, scan, unaligned_keys

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: The same SQL for vectors of SHORT components; tests run it on such a table.
PART_ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None, short: bool = False) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL of its twin; short: that SQL is for vectors of SHORT components, and a twin for WIDTH is made from it."""

    def keep(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if short:
            PART_ORACLES[key] = oracle
        elif oracle:
            ORACLES[key] = oracle
        return f

    return keep


def _widened(sql: str) -> str:
    """SQL for vectors of SHORT components as SQL for WIDTH components."""
    for narrow, wide in ((_values(SHORT), _values(WIDTH)), (_centroids(SHORT), _centroids(WIDTH)), (FACTS, WHOLE_FACTS), (f"range(3, {SHORT + 4})", f"range(3, {WIDTH + 4})")):
        sql = sql.replace(narrow, wide)
    return sql


def _r(column: str, places: int = 6) -> F.Column:
    return F.round(column, places).alias(column)


#: Features of the given tables' spectra.
FEATURES = 196

LONG = ["source", "Time", "Step", "Sequence", "wavelength"]
_LONG = 'source, "Time", "Step", "Sequence", wavelength'


_FLAT = f"""{TIMED}, flat AS (
    SELECT source, wavelength, "Step", "Sequence", "StepTime", arg_max(value, ("Time", row_index)) AS value FROM timed GROUP BY ALL),
    grid AS (SELECT DISTINCT "Step", "Sequence", "StepTime" FROM timed), waves AS (SELECT DISTINCT wavelength FROM timed),
    features AS (SELECT row_number() OVER (ORDER BY wavelength, "Step", "Sequence", "StepTime") AS feature_id, wavelength, "Step", "Sequence", "StepTime" FROM grid, waves),
    facts AS (SELECT source, feature_id, value FROM flat JOIN features USING (wavelength, "Step", "Sequence", "StepTime"))"""


# -- files, checks, projection, filter ---------------------------------------------------------------
@query(f"""WITH {FILLED} SELECT {_LONG}, value FROM spectra""")
def file_scan(spark, sf_dir):
    return load(spark, spectral_files(spark, sf_dir)).select(source_name(), *LONG[1:], "value")


@query(f"""WITH {FILLED} SELECT source, count(DISTINCT row_index) AS n_rows, CAST(0 AS BIGINT) AS n_bad FROM spectra GROUP BY source""")
def file_validate(spark, sf_dir):
    wide, waves = scan(spark, resolve_paths(spectral_files(spark, sf_dir)))
    return bad_values(wide, waves).select(source_name(), "n_rows", "n_bad")


@query(f"""WITH {_FLAT.replace(SPECTRA, FILLED).replace("FROM timed GROUP BY ALL)", 'FROM timed WHERE NOT ("StepTime" < 1 OR "ReverseStepTime" < 1) GROUP BY ALL)').replace("FROM timed), waves", 'FROM timed WHERE NOT ("StepTime" < 1 OR "ReverseStepTime" < 1)), waves')}
SELECT source, feature_id, value FROM facts""")
def file_flatten(spark, sf_dir):
    data = preprocess_and_flatten(spark, spectral_files(spark, sf_dir), edge_trim=(1.0, 1.0), max_null_ratio=1.0)
    return data.facts.select(source_name(), "feature_id", "value")


_WHOLE = f"""{_FLAT.replace(SPECTRA, FILLED.replace("avg(l_quantity)", f"CAST(sum(l_orderkey) + {BEYOND} AS BIGINT)").replace("wavelength, l_quantity", "wavelength, l_orderkey"))}"""


@query(f"""WITH {_WHOLE} SELECT source, feature_id, value AS exact FROM facts""")
def file_flatten_exact(spark, sf_dir):
    """Whole numbers beyond 2 ** 53, from files to facts unchanged."""
    data = preprocess_and_flatten(spark, spectral_files(spark, sf_dir, whole_numbers=True), max_null_ratio=1.0)
    return data.facts.select(source_name(), "feature_id", F.col("exact").cast("long").alias("exact"))


@query(f"""WITH {_WHOLE} SELECT feature_id, count(*) AS n, CAST(sum(CAST(value AS HUGEINT) * 1000000007) AS VARCHAR) AS sum FROM facts GROUP BY feature_id""")
def file_sums_exact(spark, sf_dir):
    """Sums of whole numbers beyond 2 ** 63."""
    data = preprocess_and_flatten(spark, spectral_files(spark, sf_dir, whole_numbers=True), max_null_ratio=1.0)
    scaled = data.facts.withColumn("exact", (F.col("exact").cast("decimal(20,0)") * F.lit(1000000007).cast("decimal(10,0)")).cast("decimal(38,0)"))
    return stats.exact_sums(scaled).select("feature_id", "n", F.col("sum").cast("string").alias("sum"))


@query()
def file_fit_and_score(spark, sf_dir):
    """Files to scores with limits; eigenvectors are beyond SQL, tests compare them with a matrix library."""
    data = preprocess_and_flatten(spark, spectral_files(spark, sf_dir), t_smoothing_window=1.0, max_null_ratio=0.0)
    model = flatten_pca(spark, flattened=data, n_component=3, scaling_strategy="z-score")
    return append_pca_scores(model, data, mahalanobis=MahalanobisConfig(2), spe=SpeConfig(2)).withColumn("source", source_name())


@query(f"""WITH {SPECTRA}, p AS (SELECT DISTINCT source, row_index, "Time", "Step", "Sequence" FROM spectra),
w AS (SELECT p.source, p.row_index, max(CASE WHEN value IS NULL OR isnan(value) OR isinf(value) THEN 1 WHEN value IS NOT NULL THEN 0 END) AS bad, count(value) AS n FROM p LEFT JOIN spectra s ON s.source = p.source AND s.row_index = p.row_index GROUP BY ALL)
SELECT source, count(*) AS n_rows, count(*) FILTER (bad = 1 OR n < 7) AS n_bad FROM w GROUP BY source""")
def scan_validate(spark, sf_dir):
    waves = [401.0 + k for k in range(7)]
    wide = spectra(spark, sf_dir).groupBy("source", "Time", "Step", "Sequence").pivot("wavelength", waves).agg(F.first("value"))
    return bad_values(wide, [str(w) for w in waves])


@query(f"""WITH {SPECTRA}, early AS (SELECT * FROM spectra WHERE source <> 's3' OR "Time" < 20) SELECT "Step", "Sequence", "Time", count(DISTINCT source) AS n_sources FROM early GROUP BY ALL HAVING count(DISTINCT source) <> 10""")
def metadata_alignment(spark, sf_dir):
    early = spectra(spark, sf_dir).filter("source <> 's3' or Time < 20")  # a file that ends early
    return unaligned_keys(early, 10)


@query("""SELECT l_orderkey AS source, CAST(l_linenumber AS DOUBLE) AS "Time", CAST(l_quantity AS BIGINT) % 5 AS "Step", CAST(1 AS BIGINT) AS "Sequence", count(*) AS n FROM (SELECT l_suppkey AS l_orderkey, l_linenumber, l_quantity FROM lineitem) GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    keys = rows.select(F.col("l_suppkey").alias("source"), F.col("l_linenumber").cast("double").alias("Time"), (F.col("l_quantity").cast("long") % 5).alias("Step"), F.lit(1).cast("long").alias("Sequence"))
    return repeated_keys(keys)


@query(f"""WITH {SPECTRA} SELECT {_LONG}, value FROM spectra WHERE "Step" IN (0, 2)""")
def target_steps(spark, sf_dir):
    return pp.filter_steps(spectra(spark, sf_dir), [0, 2]).select(*LONG, "value")


@query(f"""WITH {SPECTRA} SELECT {_LONG}, value FROM spectra WHERE wavelength BETWEEN 402 AND 405.5""")
def wavelength_range(spark, sf_dir):
    return pp.filter_wavelengths(spectra(spark, sf_dir), (402.0, 405.5)).select(*LONG, "value")


@query(f"""WITH {TIMED} SELECT {_LONG}, "StepTime", "ReverseStepTime" FROM timed""")
def step_time(spark, sf_dir):
    return pp.step_times(spectra(spark, sf_dir)).select(*LONG, "StepTime", "ReverseStepTime")


@query(f"""WITH {TIMED.replace(SPECTRA, EVENTS)} SELECT source, row_index, round("StepTime", 4) AS "StepTime", round("ReverseStepTime", 4) AS "ReverseStepTime" FROM timed""")
def event_segments(spark, sf_dir):
    return pp.step_times(event_points(spark, sf_dir)).select("source", "row_index", _r("StepTime", 4), _r("ReverseStepTime", 4))


@query(f"""WITH {TIMED} SELECT {_LONG}, value FROM timed WHERE NOT ("StepTime" < 1 OR "ReverseStepTime" < 2)""")
def edge_trim_drop(spark, sf_dir):
    return pp.edge_trim(pp.step_times(spectra(spark, sf_dir)), (1.0, 2.0)).select(*LONG, "value")


@query(f"""WITH {TIMED} SELECT {_LONG}, CASE WHEN NOT ("StepTime" < 1 OR "ReverseStepTime" < 2) THEN value END AS value FROM timed""")
def edge_trim_null(spark, sf_dir):
    return pp.edge_trim(pp.step_times(spectra(spark, sf_dir)), (1.0, 2.0), "null").select(*LONG, "value")


@query(f"""WITH {SPECTRA}, t AS (SELECT "Time", row_number() OVER (ORDER BY "Time") - 1 AS k FROM (SELECT DISTINCT "Time" FROM spectra))
SELECT {_LONG}, value FROM spectra WHERE "Time" IN (SELECT "Time" FROM t WHERE k % 3 = 0)""")
def t_stride(spark, sf_dir):
    return pp.downsample_time(spectra(spark, sf_dir), 3).select(*LONG, "value")


@query(f"""WITH {SPECTRA}, t AS (SELECT wavelength, row_number() OVER (ORDER BY wavelength) - 1 AS k FROM (SELECT DISTINCT wavelength FROM spectra))
SELECT {_LONG}, value FROM spectra WHERE wavelength IN (SELECT wavelength FROM t WHERE k % 2 = 0)""")
def w_stride(spark, sf_dir):
    return pp.downsample_wavelength(spectra(spark, sf_dir), 2).select(*LONG, "value")


# -- smoothing, normalization, transforms -------------------------------------------------------------
@query(f"""WITH {SPECTRA} SELECT a.source, a."Time", a."Step", a."Sequence", a.wavelength, round(avg(b.value), 6) AS value
FROM spectra a JOIN spectra b ON a.source = b.source AND a."Step" = b."Step" AND a."Sequence" = b."Sequence" AND a.wavelength = b.wavelength AND abs(a."Time" - b."Time") <= 1
GROUP BY ALL""")
def t_smooth(spark, sf_dir):
    return pp.smooth_time(spectra(spark, sf_dir), 1.0).select(*LONG, _r("value"))


@query(f"""WITH {EVENTS} SELECT a.source, a.row_index, round(avg(b.value), 6) AS value
FROM spectra a JOIN spectra b ON a.source = b.source AND a."Step" = b."Step" AND abs(a."Time" - b."Time") <= 86400 GROUP BY ALL""")
def event_band_mean(spark, sf_dir):
    return pp.smooth_time(event_points(spark, sf_dir), 86400.0).select("source", "row_index", _r("value"))


@query(f"""WITH {SPECTRA} SELECT a.source, a."Time", a."Step", a."Sequence", a.wavelength, round(avg(b.value), 6) AS value
FROM spectra a JOIN spectra b ON a.source = b.source AND a.row_index = b.row_index AND abs(a.wavelength - b.wavelength) <= 1.5 GROUP BY ALL""")
def w_smooth(spark, sf_dir):
    return pp.smooth_wavelength(spectra(spark, sf_dir), 1.5).select(*LONG, _r("value"))


@query(f"""WITH {SPECTRA} SELECT {_LONG}, round(value / avg(value) FILTER ("Time" BETWEEN 0 AND 100) OVER (PARTITION BY source, "Step", "Sequence", wavelength), 6) AS value FROM spectra""")
def t_norm(spark, sf_dir):
    return pp.normalize_time(spectra(spark, sf_dir), (0.0, 100.0)).select(*LONG, _r("value"))


@query(f"""WITH {SPECTRA} SELECT {_LONG}, round(value / avg(value) FILTER (wavelength BETWEEN 401 AND 404) OVER (PARTITION BY source, row_index), 6) AS value FROM spectra""")
def w_norm(spark, sf_dir):
    return pp.normalize_wavelength(spectra(spark, sf_dir), (401.0, 404.0)).select(*LONG, _r("value"))


for _kind, _sql in (("sqrt", "sign(x) * sqrt(abs(x))"), ("log1p", "ln(1 + x / 2)"), ("asinh", "asinh(x / 2)")):

    @query(f"""WITH {SPECTRA}, y AS (SELECT *, {"value" if _kind == "log1p" else "value - 25"} AS x FROM spectra) SELECT {_LONG}, round({_sql}, 6) AS value FROM y""", f"xf_{_kind}")
    def _transform(spark, sf_dir, kind=_kind):
        shifted = spectra(spark, sf_dir).withColumn("value", F.col("value") - (0 if kind == "log1p" else 25))
        return pp.transform_intensity(shifted, kind, 2.0).select(*LONG, _r("value"))


# -- flatten ------------------------------------------------------------------------------------------
def _flattened(spark, sf_dir):
    frame = pp.step_times(spectra(spark, sf_dir))
    return (*fl.flatten(frame), frame.select("source").distinct())


@query(f"""WITH {TIMED} SELECT DISTINCT "Step", "Sequence", "StepTime" FROM timed""")
def feature_grid(spark, sf_dir):
    return fl.feature_grid(pp.step_times(spectra(spark, sf_dir)))


@query(f"""WITH {_FLAT} SELECT * FROM features""")
def feature_table(spark, sf_dir):
    return fl.feature_table(pp.step_times(spectra(spark, sf_dir)))


@query(f"""WITH {_FLAT} SELECT * FROM facts""")
def flatten_long(spark, sf_dir):
    return _flattened(spark, sf_dir)[0].select("source", "feature_id", "value")


@query(f"""WITH {TIMED} SELECT source, wavelength, "Step", "Sequence", "StepTime", arg_max(value, ("Time", row_index)) AS value FROM timed GROUP BY ALL""")
def dup_keep_last(spark, sf_dir):
    return fl.last_of_duplicates(pp.step_times(spectra(spark, sf_dir)))


def _wide_columns() -> str:
    """A column for each feature; the given tables have seven wavelengths at each of FEATURES / 7 places of the grid."""
    return ", ".join(f"max(value) FILTER (feature_id = {k}) AS f{k}" for k in range(1, FEATURES + 1))


@query(f"""WITH {_FLAT} SELECT source, {_wide_columns()} FROM facts GROUP BY source""")
def flatten_wide(spark, sf_dir):
    facts, features, sources = _flattened(spark, sf_dir)
    wide = fl.to_wide(facts, features, sources)
    return wide.toDF("source", *[f"f{k}" for k in range(1, len(wide.columns))])


@query(f"""WITH {_FLAT} SELECT source, feature_id, value FROM facts WHERE feature_id IN (SELECT feature_id FROM facts WHERE value IS NOT NULL GROUP BY 1 HAVING (10 - count(*)) / 10 <= 0.1)""")
def null_prune(spark, sf_dir):
    return fl.prune_sparse(*_flattened(spark, sf_dir), 0.1)[0].select("source", "feature_id", "value")


@query(f"""WITH {_FLAT} SELECT s.source, "Step", "Sequence", "StepTime", wavelength, value AS intensity
FROM (SELECT DISTINCT source FROM timed) s CROSS JOIN features f LEFT JOIN facts ON facts.source = s.source AND facts.feature_id = f.feature_id""")
def unflatten_long(spark, sf_dir):
    facts, features, sources = _flattened(spark, sf_dir)
    return fl.flatten_to_long(fl.to_wide(facts, features, sources))


@query(f"""WITH {_FLAT} SELECT s.source, "Step", "Sequence", "StepTime", {", ".join(f"max(value) FILTER (wavelength = {w}) AS w{w}" for w in range(401, 408))}
FROM (SELECT DISTINCT source FROM timed) s CROSS JOIN features f LEFT JOIN facts ON facts.source = s.source AND facts.feature_id = f.feature_id GROUP BY ALL""")
def unflatten_wide(spark, sf_dir):
    facts, features, sources = _flattened(spark, sf_dir)
    wide = fl.flatten_to_wide(fl.to_wide(facts, features, sources))
    return wide.toDF(*[f"w{float(c[:-2]):g}" if c.endswith("nm") else c for c in wide.columns])


@query(f"""WITH {_FLAT}, s AS (SELECT source, row_number() OVER (ORDER BY source) AS row FROM (SELECT DISTINCT source FROM timed))
SELECT s.source, f.feature_id, value FROM s CROSS JOIN features f LEFT JOIN facts ON facts.source = s.source AND facts.feature_id = f.feature_id WHERE row BETWEEN 3 AND 7""")
def matrix_rows(spark, sf_dir):
    """Facts stored as a dense matrix, and a range of its rows read back."""
    from prismflow.functions.lineage import scratch
    from prismflow.plans.matrices import write_matrix

    facts, features, sources = _flattened(spark, sf_dir)
    return write_matrix(facts, features.count(), scratch(spark, "matrix"), sources).read(3, 8)


# -- statistics before PCA ----------------------------------------------------------------------------
def _near(q: float) -> str:
    return f"list_sort(list(value) FILTER (value IS NOT NULL))[CAST(floor((count(value) - 1) * {q} + 0.5) AS BIGINT) + 1]"


_SCALES = {
    "z": ("z-score", "avg(value)", "stddev_samp(value)"),
    "pareto": ("pareto", "avg(value)", "sqrt(stddev_samp(value))"),
    "minmax": ("minmax", "min(value)", "max(value) - min(value)"),
    "robust": ("robust", "median(value)", f"{_near(0.75)} - {_near(0.25)}"),
}
for _name, (_strategy, _center, _scale) in _SCALES.items():

    @query(f"""WITH {FACTS} SELECT feature_id, round(coalesce({_center}, 0), 6) AS center, round(coalesce(nullif({_scale}, 0), 1), 6) AS scale FROM facts GROUP BY feature_id""", f"scale_{_name}", short=True)
    def _scaling(spark, sf_dir, strategy=_strategy):
        return stats.fit_scaling(embedding_facts(spark, sf_dir), strategy).select("feature_id", _r("center"), _r("scale"))


@query(f"""WITH {FACTS}, s AS (SELECT feature_id, avg(value) AS c, stddev_samp(value) AS d FROM facts GROUP BY 1) SELECT source, feature_id, round((value - c) / d, 6) AS value FROM facts JOIN s USING (feature_id)""", short=True)
def scale_apply(spark, sf_dir):
    facts = embedding_facts(spark, sf_dir)
    return stats.apply_scaling(facts, stats.fit_scaling(facts, "z-score")).select("source", "feature_id", _r("value"))


_BOUNDS = f"""q AS (SELECT feature_id, {_near(0.25)} AS q1, {_near(0.75)} AS q3, {_near(0.01)} AS p1, {_near(0.99)} AS p99 FROM facts GROUP BY feature_id),
    bounds AS (SELECT feature_id, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper, p1, p99 FROM q),
    flagged AS (SELECT DISTINCT source FROM facts JOIN bounds USING (feature_id) WHERE value < lower OR value > upper)"""


@query(f"""WITH {FACTS} SELECT feature_id, {_near(0.1)} AS q10, {_near(0.9)} AS q90 FROM facts GROUP BY feature_id""", short=True)
def nearest_quantiles(spark, sf_dir):
    return ranks.nearest_quantiles(embedding_facts(spark, sf_dir), {"q10": 0.1, "q90": 0.9})


@query(f"""WITH {FACTS}, {_BOUNDS} SELECT feature_id, round(lower, 6) AS lower, round(upper, 6) AS upper, p1, p99 FROM bounds""", short=True)
def iqr_bounds(spark, sf_dir):
    return stats.fit_outliers(embedding_facts(spark, sf_dir)).select("feature_id", _r("lower"), _r("upper"), "p1", "p99")


@query(f"""WITH {FACTS}, {_BOUNDS} SELECT f.source, feature_id, CASE WHEN f.source IN (SELECT source FROM flagged) AND value IS NOT NULL THEN greatest(least(value, p99), p1) ELSE value END AS value
FROM facts f JOIN bounds USING (feature_id)""", short=True)
def winsorize(spark, sf_dir):
    facts = embedding_facts(spark, sf_dir)
    return stats.winsorize(facts, stats.fit_outliers(facts))


@query(f"""WITH {FACTS}, {_BOUNDS} SELECT * FROM facts WHERE source NOT IN (SELECT source FROM flagged)""", short=True)
def outlier_drop(spark, sf_dir):
    facts = embedding_facts(spark, sf_dir)
    return stats.drop_outliers(facts, stats.fit_outliers(facts)).select("source", "feature_id", "value")


@query(f"""WITH {FACTS}, m AS (SELECT feature_id, median(value) AS fill FROM facts GROUP BY 1) SELECT source, feature_id, round(coalesce(value, fill), 9) AS value FROM facts JOIN m USING (feature_id)""", short=True)
def median_impute(spark, sf_dir):
    facts = embedding_facts(spark, sf_dir)
    medians = stats.fit_medians(facts, facts.select("feature_id").distinct())
    return stats.fill_missing(facts, medians, facts.select("source").distinct()).select("source", "feature_id", _r("value", 9))


@query(f"""WITH {FACTS} SELECT source, feature_id, value FROM (SELECT *, count(value) OVER (PARTITION BY source) AS n, count(*) OVER (PARTITION BY source) AS m FROM facts) WHERE n = m""", short=True)
def drop_missing(spark, sf_dir):
    return stats.drop_missing(embedding_facts(spark, sf_dir), embedding_width(spark, sf_dir)).select("source", "feature_id", "value")


def _centroids(n: int) -> str:
    return "VALUES " + ", ".join(f"({c}, {f}, {((c * 5 + f * 3) % 7 - 3) / 10})" for c in range(3) for f in range(1, n + 1))


@query(f"""WITH {FACTS}, c(cluster, feature_id, center) AS ({_centroids(SHORT)}),
    d AS (SELECT source, cluster, sum((value - CAST(center AS DOUBLE)) ** 2) AS d FROM facts JOIN c USING (feature_id) WHERE value IS NOT NULL GROUP BY ALL),
    n AS (SELECT source, cluster FROM d QUALIFY row_number() OVER (PARTITION BY source ORDER BY round(d, 12), cluster) = 1)
    SELECT source, f.feature_id, coalesce(f.value, CAST(center AS DOUBLE)) AS value FROM facts f JOIN n USING (source) JOIN c ON c.cluster = n.cluster AND c.feature_id = f.feature_id""", short=True)
def centroid_fill(spark, sf_dir):
    facts = embedding_facts(spark, sf_dir)
    rows = [(c, f, ((c * 5 + f * 3) % 7 - 3) / 10) for c in range(3) for f in range(1, embedding_width(spark, sf_dir) + 1)]
    centroids = spark.createDataFrame(rows, "cluster int, feature_id long, center double")
    return stats.fill_from_centroids(facts, centroids, facts.select("source").distinct())


_CENTERED = f"""{FACTS}, whole AS (SELECT * FROM facts WHERE source NOT IN (SELECT source FROM facts WHERE value IS NULL)),
    centered AS (SELECT source, feature_id, value - avg(value) OVER (PARTITION BY feature_id) AS c, count(*) OVER (PARTITION BY feature_id) AS n FROM whole)"""


@query(f"""WITH {_CENTERED} SELECT x.feature_id AS a, y.feature_id AS b, round(sum(x.c * y.c) / (any_value(x.n) - 1), 9) AS covariance FROM centered x JOIN centered y ON x.source = y.source AND x.feature_id <= y.feature_id GROUP BY ALL""", short=True)
def covariance(spark, sf_dir):
    return stats.covariance(stats.drop_missing(embedding_facts(spark, sf_dir), embedding_width(spark, sf_dir))).select("a", "b", _r("covariance", 9))


@query(f"""WITH {_CENTERED}, few AS (SELECT * FROM centered) SELECT x.source AS a, y.source AS b, round(sum(x.c * y.c), 9) AS product FROM few x JOIN few y ON x.feature_id = y.feature_id AND x.source <= y.source GROUP BY ALL""", short=True)
def gram(spark, sf_dir):
    facts = stats.drop_missing(embedding_facts(spark, sf_dir), embedding_width(spark, sf_dir))
    return stats.gram(facts).select("a", "b", _r("product", 9))


# -- model operators with literal arrays, so that both engines hold the same numbers ---------------------
def _literal_model(n: int = 8) -> PcaModel:
    """Three orthonormal components over n features (8 or more), with round-number state; each run of six features has the same loadings."""
    runs = (n - 2) // 6
    basis = np.zeros((3, n))
    for at in range(0, 6 * runs, 6):
        basis[0, [at, at + 1]], basis[1, [at + 2, at + 3]], basis[2, [at + 4, at + 5]] = (0.6, 0.8), (0.8, -0.6), (0.6, 0.8)
    basis /= np.sqrt(runs)
    lam = np.array([4.0, 2.0, 1.0])
    return PcaModel(
        columns=[f"f{k}" for k in range(1, n + 1)], components=basis, mean=np.arange(n) / 100, explained_variance=lam, explained_variance_ratio=lam / 8, singular_values=np.sqrt(lam * 99),
        n_samples=100, noise_variance=0.2, scaling="z-score", centers=np.arange(n) / 50, scales=1 + np.arange(n) / 10,
    )


def _model(spark: SparkSession, sf_dir: str) -> PcaModel:
    return _literal_model(embedding_width(spark, sf_dir))


@functools.cache
def _values(n: int) -> str:
    """SQL of the facts of n components and of the literal model over them."""
    m = _literal_model(n)
    w = ", ".join(f"({j + 1}, {f + 1}, {m.components[j, f]})" for j in range(3) for f in range(n))
    s = ", ".join(f"({f + 1}, {m.mean[f]}, {m.centers[f]}, {m.scales[f]})" for f in range(n))
    lam = ", ".join(f"({j + 1}, {v})" for j, v in enumerate(m.explained_variance))
    return f"""{_CENTERED.replace(FACTS, facts_sql(n))}, w AS (SELECT component, feature_id, CAST(c AS DOUBLE) AS c FROM (VALUES {w}) t(component, feature_id, c)),
    st AS (SELECT feature_id, CAST(mean AS DOUBLE) AS mean, CAST(center AS DOUBLE) AS center, CAST(scale AS DOUBLE) AS scale FROM (VALUES {s}) t(feature_id, mean, center, scale)),
    lam AS (SELECT component, CAST(v AS DOUBLE) AS v FROM (VALUES {lam}) t(component, v)),
    z AS (SELECT source, feature_id, value, (value - center) / scale AS z, mean, center, scale FROM whole JOIN st USING (feature_id)),
    scores AS (SELECT source, component, sum((z - mean) * c) AS score FROM z JOIN w USING (feature_id) GROUP BY ALL),
    back AS (SELECT source, feature_id, sum(score * c) + any_value(mean) AS zhat FROM scores JOIN w USING (component) JOIN st USING (feature_id) GROUP BY ALL),
    recon AS (SELECT source, feature_id, zhat, zhat * scale + center AS fitted FROM back JOIN st USING (feature_id))"""


_MODEL = _values(SHORT)


@query(f"""WITH {_MODEL} SELECT source, CAST(component AS BIGINT) AS component, round(score, 6) AS score FROM scores""", short=True)
def scores_literal(spark, sf_dir):
    model = _model(spark, sf_dir)
    return scores_long(model, prepare(model, embedding_facts(spark, sf_dir))).select("source", "component", _r("score"))


@query(f"""WITH {_MODEL} SELECT source, round(sum(score * score / v), 6) AS t2 FROM scores JOIN lam USING (component) GROUP BY source""", short=True)
def t2_literal(spark, sf_dir):
    model = _model(spark, sf_dir)
    lam = spark.createDataFrame([(j + 1, float(v)) for j, v in enumerate(model.explained_variance)], "component long, variance double")
    return t_squared(scores_long(model, prepare(model, embedding_facts(spark, sf_dir))), lam).select("source", _r("t2"))


@query(f"""WITH {_MODEL} SELECT source, round(sum((z - zhat) ** 2), 6) AS spe FROM z JOIN back USING (source, feature_id) GROUP BY source""", short=True)
def spe_literal(spark, sf_dir):
    model = _model(spark, sf_dir)
    return q_statistic(model, prepare(model, embedding_facts(spark, sf_dir)), 3).select("source", F.round("q", 6).alias("spe"))


@query(f"""WITH {_MODEL} SELECT source, feature_id, round((z - zhat) ** 2, 6) AS contribution FROM z JOIN back USING (source, feature_id)""", short=True)
def q_contribution_literal(spark, sf_dir):
    model = _model(spark, sf_dir)
    return q_contribution(model, prepare(model, embedding_facts(spark, sf_dir)), 3).select("source", "feature_id", _r("contribution"))


@query(f"""WITH {_MODEL} SELECT source, CAST(feature_id AS BIGINT) AS feature_id, round(fitted, 6) AS value FROM recon""", short=True)
def reconstruct_literal(spark, sf_dir):
    model = _model(spark, sf_dir)
    return reconstruct(model, scores_long(model, prepare(model, embedding_facts(spark, sf_dir)))).select("source", "feature_id", _r("value"))


@query(f"""WITH {_MODEL} SELECT source, feature_id, round(value - fitted, 6) AS value FROM z JOIN recon USING (source, feature_id)""", short=True)
def residual_literal(spark, sf_dir):
    model = _model(spark, sf_dir)
    return residual(model, prepare(model, embedding_facts(spark, sf_dir)), 3).select("source", "feature_id", _r("value"))


@query(f"""WITH {_MODEL} SELECT source, CAST(feature_id AS BIGINT) AS feature_id, round(score * c * scale, 6) AS value FROM scores JOIN w USING (component) JOIN st USING (feature_id) WHERE component = 2""", short=True)
def component_contribution_literal(spark, sf_dir):
    model = _model(spark, sf_dir)
    return component_contribution(model, scores_long(model, prepare(model, embedding_facts(spark, sf_dir))), 2).select("source", "feature_id", _r("value"))


@query(f"""WITH {_MODEL}, part AS (SELECT source, component, CAST((feature_id - 1) // 2 AS DOUBLE) AS "StepTime", sum((z - mean) * c) AS p FROM z JOIN w USING (feature_id) WHERE component <= 2 GROUP BY ALL)
SELECT source, CAST(component AS BIGINT) AS component, "StepTime", round(sum(p) OVER (PARTITION BY source, component ORDER BY "StepTime" ROWS UNBOUNDED PRECEDING), 6) AS score FROM part""", short=True)
def partial_scores_literal(spark, sf_dir):
    model = _model(spark, sf_dir)
    axes = spark.createDataFrame([(f + 1, 1, 1, float(f // 2)) for f in range(len(model.columns))], "feature_id long, Step long, Sequence long, StepTime double")
    return partial_scores(model, prepare(model, embedding_facts(spark, sf_dir)), axes, [1, 2]).select("source", "component", "StepTime", _r("score"))


@query(f"""WITH {_CENTERED}, v AS (SELECT feature_id, sum(c * c) / (any_value(n) - 1) AS v FROM centered GROUP BY 1),
    r AS (SELECT row_number() OVER (ORDER BY v DESC, feature_id) AS k, v, v / sum(v) OVER () AS share FROM v)
SELECT CAST(k AS BIGINT) AS component, 'pca-' || k AS pca_column, round(v, 9) AS explained_variance, round(share, 9) AS explained_variance_ratio, round(sum(share) OVER (ORDER BY k), 9) AS cumulative_explained_variance FROM r WHERE k <= 3""", short=True)
def explained_variance(spark, sf_dir):
    """Of a model whose components are the three features that vary most."""
    width = embedding_width(spark, sf_dir)
    rows = stats.drop_missing(embedding_facts(spark, sf_dir), width).groupBy("feature_id").agg(F.var_samp("value").alias("v")).toPandas()
    rows = rows.sort_values(["v", "feature_id"], ascending=[False, True])
    lam, at = rows["v"].to_numpy()[:3], rows["feature_id"].to_numpy()[:3] - 1
    model = PcaModel(columns=[f"f{k}" for k in range(width)], components=np.eye(width)[at], mean=np.zeros(width), explained_variance=lam, explained_variance_ratio=lam / rows["v"].sum(), singular_values=np.sqrt(lam), n_samples=1, noise_variance=0.0)
    return model.explained_variance_table(spark).select("component", "pca_column", *[_r(c, 9) for c in ("explained_variance", "explained_variance_ratio", "cumulative_explained_variance")])


@query()
def fit_and_score(spark, sf_dir):
    """PCA of the embeddings; eigenvectors are beyond SQL, tests compare them with a matrix library."""
    facts = embedding_facts(spark, sf_dir)
    model = fit_pca(facts, [f"f{k}" for k in range(1, embedding_width(spark, sf_dir) + 1)], scaling="z-score", n_component=3)
    return scores_long(model, prepare(model, facts))


# eigenvectors are beyond SQL, but sums that do not depend on them are not: they settle variances, scores and limits
_WHOLE_SUMS = f"""{_CENTERED}, v AS (SELECT x.feature_id AS a, y.feature_id AS b, sum(x.c * y.c) / (any_value(x.n) - 1) AS c FROM centered x JOIN centered y ON x.source = y.source GROUP BY ALL)"""


def _fitted(spark, sf_dir, **fit) -> tuple[PcaModel, DataFrame]:
    facts, width = embedding_facts(spark, sf_dir), embedding_width(spark, sf_dir)
    return fit_pca(facts, [f"f{k}" for k in range(1, width + 1)], scaling="none", **fit), facts


@query(f"""WITH {_WHOLE_SUMS}, s AS (SELECT x.a, y.b, sum(x.c * y.c) AS c FROM v x JOIN v y ON x.b = y.a GROUP BY ALL)
SELECT any_value(n) AS n_samples, round((SELECT sum(c) FROM v WHERE a = b), 9) AS sum_1, round((SELECT sum(c * c) FROM v), 9) AS sum_2, round((SELECT sum(s.c * v.c) FROM s JOIN v ON s.a = v.b AND s.b = v.a), 9) AS sum_3 FROM centered""", short=True)
def fit_variances(spark, sf_dir):
    """Sums of the first three powers of a fit's variances: traces of powers of the covariance."""
    model, _ = _fitted(spark, sf_dir)
    lam = model.explained_variance
    return spark.createDataFrame([(model.n_samples, *[round(float((lam**p).sum()), 9) for p in (1, 2, 3)])], "n_samples long, sum_1 double, sum_2 double, sum_3 double")


@query(f"""WITH {_CENTERED} SELECT source, round(sum(c * c), 6) AS norm FROM centered GROUP BY source""", short=True)
def fit_norms(spark, sf_dir):
    """Squared scores of all components, which are a centered row's norm."""
    model, facts = _fitted(spark, sf_dir)
    scores = scores_long(model, prepare(model, facts))
    return scores.groupBy("source").agg(F.round(F.sum(F.col("score") * F.col("score")), 6).alias("norm"))


@query(f"""WITH {_CENTERED} SELECT source, feature_id, round(value, 6) AS value FROM whole""", short=True)
def fit_reconstruction(spark, sf_dir):
    """All components give every value back."""
    model, facts = _fitted(spark, sf_dir)
    return reconstruct(model, scores_long(model, prepare(model, facts))).select("source", "feature_id", _r("value"))


@query(f"""WITH {_CENTERED} SELECT sum(c * c) > 0 AS fitted, round(sum(c * c), 5) AS total, round(sum(c * c), 5) AS kept_and_left FROM centered""", short=True)
def fit_split(spark, sf_dir):
    """T2 times variances and Q of five components, summed over all sources, are the sum of squares."""
    model, facts = _fitted(spark, sf_dir)
    prepared = prepare(model, facts)
    kept = scores_long(model, prepared, 5).agg(F.sum(F.col("score") * F.col("score"))).first()[0]
    left = q_statistic(model, prepared, 5).agg(F.sum("q")).first()[0]
    total = float(model.explained_variance.sum()) * (model.n_samples - 1)
    return spark.createDataFrame([(total > 0, round(total, 5), round(kept + left, 5))], "fitted boolean, total double, kept_and_left double")


_FILE_FACTS = f"""{_FLAT.replace(SPECTRA, FILLED)}, every AS (SELECT feature_id FROM facts GROUP BY 1 HAVING count(*) = 10),
    moved AS (SELECT source, feature_id, value - avg(value) OVER (PARTITION BY feature_id) AS c FROM facts SEMI JOIN every USING (feature_id))"""


@query(f"""WITH {_FILE_FACTS} SELECT source, round(sum(c * c), 5) AS norm, count(*) AS n_features FROM moved GROUP BY source""")
def file_fit_norms(spark, sf_dir):
    """Files to a model of all components and back to scores."""
    data = preprocess_and_flatten(spark, spectral_files(spark, sf_dir), max_null_ratio=0.0)
    model = flatten_pca(spark, flattened=data)
    scores = append_pca_scores(model, data)
    norm = sum((F.col(f"`{c}`") * F.col(f"`{c}`") for c in model.score_columns), F.lit(0.0))
    return scores.select(source_name(), F.round(norm, 5).alias("norm"), F.lit(len(model.columns)).cast("long").alias("n_features"))


@query(f"""WITH {_FILE_FACTS} SELECT source, round(sum(c * c), 5) AS norm FROM moved GROUP BY source""")
def file_runs(spark, sf_dir):
    """A fit run over files, its artifacts in a folder, and a transform run over the same files by that folder."""
    from prismflow.functions.lineage import scratch
    from prismflow.plans.runs import fit_run, transform_run

    paths, folder = spectral_files(spark, sf_dir), scratch(spark, "run")
    n = len(paths)
    model = fit_run(spark, paths, folder, n_component=n - 1, max_null_ratio=0.0, mahalanobis=MahalanobisConfig(2), spe=SpeConfig(2))
    scores = transform_run(spark, paths, folder, f"{folder}-again", mahalanobis=MahalanobisConfig(2), spe=SpeConfig(2))
    norm = sum((F.col(f"`{c}`") * F.col(f"`{c}`") for c in model.score_columns), F.lit(0.0))
    return scores.select(source_name(), F.round(norm, 5).alias("norm"))


#: With the upper one per cent point of the normal distribution, and one residual variance, 1, beside two components.
_SPE_LIMIT = "power(2.3263478740408408 * sqrt(2.0 / 9) + 7.0 / 9, 3)"


@query(f"""WITH {_MODEL}, r AS (SELECT source, feature_id, sum(score * c) + any_value(mean) AS zhat FROM scores JOIN w USING (component) JOIN st USING (feature_id) WHERE component <= 2 GROUP BY ALL),
    q AS (SELECT source, sum((z - zhat) ** 2) AS q FROM z JOIN r USING (source, feature_id) GROUP BY source)
SELECT source, round(q, 6) AS spe, round({_SPE_LIMIT}, 6) AS spe_ucl, q > {_SPE_LIMIT} AS spe_exceeds_ucl FROM q""", short=True)
def monitor_spe(spark, sf_dir):
    config = SpeConfig(2)
    out = transform_pca(replace(_model(spark, sf_dir), noise_variance=0.0), embedding_facts(spark, sf_dir), spe=config)
    return out.select("source", F.round(config.spe_column, 6).alias("spe"), F.round(config.ucl_column, 6).alias("spe_ucl"), F.col(config.exceeds_ucl_column).alias("spe_exceeds_ucl"))


def _grid_model(spark, sf_dir, steps: list[int] | None = None) -> tuple[PcaModel, Flattened]:
    """Two components of round numbers over the features of the flattened spectra."""
    frame = pp.step_times(pp.filter_steps(spectra(spark, sf_dir), steps))
    data = Flattened(*fl.flatten(frame), frame.select("source").distinct())
    n = data.features.count()
    w = np.array([[((c * 7 + f * 3) % 11 - 5) / 10 for f in range(1, n + 1)] for c in (1, 2)])
    lam, k = np.array([2.0, 1.0]), np.arange(1, n + 1)
    model = PcaModel(columns=[f"f{f}" for f in k], components=w, mean=k / 100, explained_variance=lam, explained_variance_ratio=lam / 4, singular_values=np.sqrt(lam * 9), n_samples=10, noise_variance=0.1, impute="median", fills=k / 10, scaling="z-score", centers=k / 50, scales=1 + k / 10)
    return model, data


_COEFFICIENTS = 'w AS (SELECT CAST(c AS BIGINT) AS component, f.*, ((c * 7 + feature_id * 3) % 11 - 5) / 10 AS coefficient FROM features f, range(1, 3) t(c))'


@query(f"""WITH {_FLAT.replace("FROM spectra)", 'FROM spectra WHERE "Step" = 0)')}, {_COEFFICIENTS} SELECT "StepTime", "Step", "Sequence", wavelength, component, CAST(coefficient AS DOUBLE) AS coefficient FROM w""")
def reshape_components(spark, sf_dir):
    return reshape_pca_components(*_grid_model(spark, sf_dir, [0]))  # the axes of one step form a full product


@query(f"""WITH {_FLAT}, {_COEFFICIENTS} SELECT feature_id, CAST(max(coefficient) FILTER (component = 1) AS DOUBLE) AS pc_m, CAST(max(coefficient) FILTER (component = 2) AS DOUBLE) AS pc_n FROM w GROUP BY feature_id""")
def loading_scatter(spark, sf_dir):
    model, _ = _grid_model(spark, sf_dir)
    return loading_pairs(model.component_table(spark), 1, 2)


@query(f"""WITH {_FLAT}, {_COEFFICIENTS}, s AS (SELECT feature_id, sum(coefficient * coefficient / (2 * component)) AS k FROM w GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY round(k, 9) DESC, feature_id) AS BIGINT) AS rank, 'f' || feature_id AS feature, round(k, 6) AS contribution FROM s""")
def contribution_rank_literal(spark, sf_dir):
    model, _ = _grid_model(spark, sf_dir)
    return model.contribution_ranking(spark).select("rank", "feature", _r("contribution"))


for _method, _agg in (("mean", "avg(coefficient)"), ("rms", "sqrt(avg(coefficient * coefficient))"), ("abs_mean", "avg(abs(coefficient))")):

    @query(f"""WITH {_FLAT}, {_COEFFICIENTS} SELECT component, wavelength, round({_agg}, 9) AS coefficient FROM w GROUP BY ALL""", f"loading_{_method}")
    def _loading(spark, sf_dir, method=_method):
        model, data = _grid_model(spark, sf_dir)
        placed = model.component_table(spark).join(data.features, "feature_id")
        return fl.aggregate_loadings(placed, method).select("component", "wavelength", _r("coefficient", 9))


@query(f"""WITH {_FLAT} SELECT f.*, round(feature_id / 100, 9) AS mean, round(feature_id / 50, 9) AS center, round(1 + feature_id / 10, 9) AS scale, round(feature_id / 10, 9) AS fill FROM features f""")
def model_parameters(spark, sf_dir):
    return parameter_table(*(x if k == 0 else x.features for k, x in enumerate(_grid_model(spark, sf_dir)))).select("feature_id", *fl.AXES, *[_r(c, 9) for c in ("mean", "center", "scale", "fill")])


@query(f"""WITH {_MODEL}, n AS (SELECT doc_id AS source, CAST(max(quality) AS BIGINT) AS lot FROM labels GROUP BY 1)
SELECT source, round(max(score) FILTER (component = 1), 6) AS x, round(max(score) FILTER (component = 3), 6) AS y, any_value(lot) AS lot FROM scores LEFT JOIN n USING (source) GROUP BY source""", short=True)
def score_scatter(spark, sf_dir):
    model = _model(spark, sf_dir)
    listing = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("source")).agg(F.max("quality").cast("long").alias("lot"))
    return score_points(scores_long(model, prepare(model, embedding_facts(spark, sf_dir))), listing, 1, 3).select("source", _r("x"), _r("y"), "lot")


@query("""SELECT DISTINCT c_name AS stem FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)""")
def known_stems(spark, sf_dir):
    """Names of customers and suppliers that are asked for; those of customers with orders are known."""
    from prismflow.operators.catalog import existing_stems

    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    files = table(spark, sf_dir, "customer").join(orders, "c_custkey", "left_semi").select(F.col("c_name").alias("stem"))
    asked = table(spark, sf_dir, "customer").select(F.col("c_name").alias("stem")).unionByName(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("stem")))
    return existing_stems(files, asked)


@query("""SELECT o_orderkey, coalesce(o_custkey, c_custkey) AS o_custkey, c_name, CASE WHEN c_custkey IS NULL THEN 'left_only' WHEN o_orderkey IS NULL THEN 'right_only' ELSE 'both' END AS _merge
FROM (SELECT o_orderkey, o_custkey + 7 AS o_custkey FROM orders) o FULL JOIN customer c ON o_custkey = c_custkey""")
def merge_named_keys(spark, sf_dir):
    """Orders under shifted customers: some have none, and customers without orders."""
    left = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") + 7).alias("o_custkey"))
    right = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return tables.merge(left, right, left_on=["o_custkey"], right_on=["c_custkey"], how="full", indicator=True)


# -- views of one segment, score tables ---------------------------------------------------------------------
_VIEWED = f"""{_FLAT}, {_COEFFICIENTS},
    st AS (SELECT feature_id, feature_id / 100 AS mean, feature_id / 50 AS center, 1 + feature_id / 10 AS scale, feature_id / 10 AS fill FROM features),
    whole AS (SELECT s.source, f.feature_id, value AS given, coalesce(value, fill) AS value FROM (SELECT DISTINCT source FROM timed) s CROSS JOIN features f JOIN st USING (feature_id) LEFT JOIN facts ON facts.source = s.source AND facts.feature_id = f.feature_id),
    z AS (SELECT source, feature_id, given, value, (value - center) / scale AS z, mean, center, scale FROM whole JOIN st USING (feature_id)),
    scores AS (SELECT source, component, sum((z - mean) * coefficient) AS score FROM z JOIN w USING (feature_id) GROUP BY ALL),
    part AS (SELECT source, feature_id, component, score * coefficient AS part FROM scores JOIN w USING (component)),
    sums AS (SELECT source, feature_id, sum(part) FILTER (component = 1) AS a, sum(part) FILTER (component = 2) AS b FROM part GROUP BY ALL),
    fit AS (SELECT z.*, mean + a AS one, mean + a + b AS two, b * scale AS second FROM z JOIN sums USING (source, feature_id)),
    seen AS (SELECT fit.*, "StepTime", wavelength FROM fit JOIN features USING (feature_id) WHERE "Step" = 1 AND "Sequence" = 2)"""


def _view(spark, sf_dir, view: str, **choice) -> DataFrame:
    model, data = _grid_model(spark, sf_dir)
    return explore.segment_view(view, data, 1, 2, model, **choice)


@query(f"""WITH {TIMED.replace(SPECTRA, FILLED)} SELECT source, "StepTime", wavelength, value FROM timed WHERE "Step" = 1 AND "Sequence" = 2""")
def explore_raw(spark, sf_dir):
    rows = load_rows(spark, spectral_files(spark, sf_dir))
    return explore.raw_view(rows, 1, 2).select(source_name(), "StepTime", "wavelength", "value")


@query(f"""WITH {_VIEWED} SELECT source, "StepTime", wavelength, given AS value FROM seen""")
def explore_preprocessed(spark, sf_dir):
    return _view(spark, sf_dir, "preprocessed")


@query(f"""WITH {_VIEWED} SELECT source, "StepTime", wavelength, round(second, 4) AS value FROM seen""")
def explore_contribution(spark, sf_dir):
    return _view(spark, sf_dir, "contribution", component=2).select("source", "StepTime", "wavelength", _r("value", 4))


@query(f"""WITH {_VIEWED} SELECT source, "StepTime", wavelength, round(two * scale + center, 4) AS value, given AS preprocessed FROM seen""")
def explore_reconstruction(spark, sf_dir):
    return _view(spark, sf_dir, "reconstruction", component=2).select("source", "StepTime", "wavelength", _r("value", 4), "preprocessed")


@query(f"""WITH {_VIEWED} SELECT source, "StepTime", wavelength, round(value - (one * scale + center), 4) AS value FROM seen""")
def explore_residual(spark, sf_dir):
    return _view(spark, sf_dir, "residual", component=1).select("source", "StepTime", "wavelength", _r("value", 4))


@query(f"""WITH {_VIEWED} SELECT source, "StepTime", wavelength, round((z - two) * (z - two), 2) AS value FROM seen""")
def explore_q_contribution(spark, sf_dir):
    return _view(spark, sf_dir, "q_contribution", selector=2).select("source", "StepTime", "wavelength", _r("value", 2))


@query(f"""WITH {_VIEWED}, steps AS (SELECT source, component, "Step", "Sequence", "StepTime", sum((z - mean) * coefficient) AS p FROM z JOIN w USING (feature_id) GROUP BY ALL),
    run AS (SELECT source, component, "Step", "Sequence", "StepTime", sum(p) OVER (PARTITION BY source, component ORDER BY "Step", "Sequence", "StepTime" ROWS UNBOUNDED PRECEDING) AS s, dense_rank() OVER (ORDER BY "Step", "Sequence", "StepTime") AS point FROM steps)
SELECT source, point, "Step", "Sequence", "StepTime", round(max(s) FILTER (component = 2), 4) AS x, round(max(s) FILTER (component = 1), 4) AS y FROM run GROUP BY ALL""")
def score_trajectories(spark, sf_dir):
    model, data = _grid_model(spark, sf_dir)
    return explore.trajectories(model, data, 2, 1).select("source", "point", "Step", "Sequence", "StepTime", _r("x", 4), _r("y", 4))


_NAMED = """n AS (SELECT s_name AS source, s_suppkey % 3 AS "pca-1", 's' || (s_suppkey % 10) AS file, CAST(row_number() OVER (ORDER BY s_suppkey) AS BIGINT) AS place FROM supplier)"""


def _samples(spark, sf_dir) -> DataFrame:
    """Suppliers as samples, each of one of the spectra's sources, with a column named like a score."""
    named = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("source"), (F.col("s_suppkey") % 3).alias("pca-1"), F.concat(F.lit("s"), F.col("s_suppkey") % 10).alias("file"))
    return explore.in_natural_order(named, "source")


def _sample_scores(spark, sf_dir) -> DataFrame:
    """Scores of suppliers, those of their source; a third has none."""
    model, data = _grid_model(spark, sf_dir)
    wide = transform_pca(model, data.facts)
    named = _samples(spark, sf_dir).filter("`pca-1` <> 0").select(F.col("source").alias("name"), "file")
    return named.join(wide, named["file"] == wide["source"]).select(F.col("name").alias("source"), "pca-1", "pca-2")


@query(f"""WITH {_VIEWED}, {_NAMED} SELECT place, n.source, "pca-1" AS lot, round(a.score, 4) AS x, round(b.score, 4) AS y FROM n JOIN scores a ON a.source = file AND a.component = 2 JOIN scores b ON b.source = file AND b.component = 1 WHERE "pca-1" <> 0""")
def score_listing(spark, sf_dir):
    found = explore.score_table(_sample_scores(spark, sf_dir), _samples(spark, sf_dir), 2, 1)
    return found.select("place", "sample.source", F.col("sample.`pca-1`").alias("lot"), _r("x", 4), _r("y", 4))


@query(f"""WITH {_NAMED} SELECT place, source AS file, CAST("pca-1" AS VARCHAR) AS lot, CASE WHEN s_acctbal IS NULL THEN '' ELSE CAST(CAST(round(s_acctbal) AS BIGINT) AS VARCHAR) END AS balance FROM n JOIN supplier ON s_name = source""")
def point_listing(spark, sf_dir):
    """Cell texts; balances are whole numbers here, as SQL has no format of six digits."""
    more = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("source"), F.round("s_acctbal").cast("long").alias("balance"))
    return explore.point_table(_samples(spark, sf_dir).join(more, "source"), {"file": "source", "lot": "`pca-1`", "balance": "balance"})


@query(f"""WITH {SPECTRA}, f AS (SELECT source, CAST(count(DISTINCT row_index) AS BIGINT) AS n_rows FROM spectra GROUP BY source), {_NAMED}
SELECT place, n.file || '-' || n.source AS stem, CASE WHEN n_rows IS NULL THEN '' ELSE '/data/' || f.source END AS path, n_rows FROM n LEFT JOIN f ON f.source = n.file AND n."pca-1" = 1""")
def shown_listing(spark, sf_dir):
    """Suppliers as files that are shown, in their order; two thirds are not in the catalog."""
    shown = _samples(spark, sf_dir).select("place", F.concat("file", F.lit("-"), "source").alias("stem"))
    counts = spectra(spark, sf_dir).groupBy("source").agg(F.count_distinct("row_index").alias("n_rows"))
    known = _samples(spark, sf_dir).filter("`pca-1` = 1").select(F.concat("file", F.lit("-"), "source").alias("stem"), "file")
    files = known.join(counts, known["file"] == counts["source"]).select("stem", F.concat(F.lit("/data/"), counts["source"]).alias("path"), "n_rows")
    return explore.shown_files(shown, files)


# -- catalog --------------------------------------------------------------------------------------------
@query(f"""WITH {TIMED} SELECT source, "Step", "Sequence", count(*) AS n_rows, max("StepTime") AS step_time_max FROM (SELECT DISTINCT source, row_index, "Step", "Sequence", "StepTime" FROM timed) GROUP BY ALL""")
def segments_summary(spark, sf_dir):
    from prismflow.operators.catalog import segment_summary

    return segment_summary(pp.step_times(spectra(spark, sf_dir)))


_FILES = """f AS (SELECT source, CAST(count(DISTINCT wavelength) AS BIGINT) AS n_wavelengths, min(wavelength) AS wavelength_min, max(wavelength) AS wavelength_max, min("Time") AS time_min, max("Time") AS time_max, count(DISTINCT row_index) AS n_rows FROM spectra GROUP BY source)"""


@query(f"""WITH {SPECTRA}, {_FILES} SELECT * FROM f""")
def file_summary(spark, sf_dir):
    from prismflow.operators.catalog import file_summary as summary

    return summary(spectra(spark, sf_dir))


@query(f"""WITH {SPECTRA}, {_FILES}, s AS (SELECT source, count(DISTINCT "Step") AS n_steps, count(DISTINCT ("Step", "Sequence")) AS n_segments FROM spectra GROUP BY source),
    m AS (SELECT 's' || CAST(s_suppkey % 10 AS VARCHAR) AS source, max(s_name) AS name FROM supplier WHERE s_suppkey % 10 <> 3 GROUP BY 1)
SELECT source, n_rows, n_wavelengths, n_steps, n_segments, name FROM f LEFT JOIN s USING (source) LEFT JOIN m USING (source)""")
def catalog_list(spark, sf_dir):
    from prismflow.operators.catalog import catalog_list as listed
    from prismflow.operators.catalog import file_summary as summary
    from prismflow.operators.catalog import segment_summary

    frame = spectra(spark, sf_dir)
    segments = segment_summary(pp.step_times(frame))
    meta = table(spark, sf_dir, "supplier").filter("s_suppkey % 10 <> 3").groupBy(F.concat(F.lit("s"), (F.col("s_suppkey") % 10).cast("string")).alias("source")).agg(F.max("s_name").alias("name"))
    return listed(summary(frame), segments, meta).select("source", "n_rows", "n_wavelengths", "n_steps", "n_segments", "name")


@query(f"""WITH {SPECTRA} SELECT min(wavelength) AS wavelength_min, max(wavelength) AS wavelength_max, min("Time") AS time_min, max("Time") AS time_max, array_to_string(list_sort(list(DISTINCT "Step")), ',') AS steps FROM spectra""")
def selection_ranges(spark, sf_dir):
    from prismflow.operators.catalog import selection_ranges as ranges

    return ranges(spectra(spark, sf_dir)).withColumn("steps", F.array_join("steps", ","))


@query("""SELECT doc_id, 'left_only' AS side FROM documents ANTI JOIN labels USING (doc_id) UNION ALL SELECT doc_id, 'right_only' FROM labels ANTI JOIN documents USING (doc_id)""")
def metadata_anti_join(spark, sf_dir):
    return tables.unmatched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT coalesce(c_nationkey, s_nationkey) AS nationkey, customers, suppliers, CASE WHEN c_nationkey IS NULL THEN 'right_only' WHEN s_nationkey IS NULL THEN 'left_only' ELSE 'both' END AS _merge
FROM (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY 1) FULL JOIN (SELECT s_nationkey + 4 AS s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey""")
def merge_indicator(spark, sf_dir):
    """Customers and, under shifted nations, suppliers."""
    left = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    right = table(spark, sf_dir, "supplier").groupBy((F.col("s_nationkey") + 4).alias("nationkey")).agg(F.count(F.lit(1)).alias("suppliers"))
    return tables.merge(left, right, ["nationkey"], "full", indicator=True)


# -- table layer ------------------------------------------------------------------------------------------
@query("""SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE contains(lower(o_orderpriority), 'urgent') AND o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 50000 AND 300000""")
def table_filter(spark, sf_dir):
    state = tables.TableState(text={"o_orderpriority": "URGENT"}, values={"o_orderstatus": ["F", "O"]}, lower={"o_totalprice": 50000}, upper={"o_totalprice": 300000})
    return tables.filter_table(table(spark, sf_dir, "orders"), state).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("""SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(c_name || '|' || c_mktsegment), '7') AND (contains(lower(c_name), 'auto') OR contains(lower(c_mktsegment), 'auto'))""")
def table_search(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return tables.filter_table(rows, tables.TableState(search="7 AUTO"))


@query("""SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal >= 0 ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 20 OFFSET 40""")
def table_page(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return tables.page_of(rows, tables.TableState(lower={"c_acctbal": 0}, sort="c_acctbal", descending=True, page=3, page_size=20), "c_custkey")[0]


@query("""SELECT CAST(row_number() OVER (ORDER BY k, o) AS BIGINT) AS place, source FROM (SELECT DISTINCT source, CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) AS k, source AS o FROM documents)""")
def natural_sort(spark, sf_dir):
    from pyspark.sql import Window

    names = table(spark, sf_dir, "documents").select("source").distinct()
    return names.select(F.row_number().over(Window.orderBy(natural_key(F.col("source")), "source")).cast("long").alias("place"), "source")


@query("""SELECT CAST(c_mktsegment AS VARCHAR) AS value, count(*) AS count FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1""")
def value_counts(spark, sf_dir):
    return tables.value_counts(table(spark, sf_dir, "customer"), "c_mktsegment")


@query("""WITH c AS (SELECT CAST(source AS VARCHAR) AS value, count(*) AS count FROM documents WHERE source IS NOT NULL GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY count DESC, value) AS k FROM c)
SELECT CASE WHEN k <= 5 THEN value ELSE 'Others' END AS value, CAST(sum(count) AS BIGINT) AS count FROM r GROUP BY 1""")
def top_values(spark, sf_dir):
    return tables.top_values(table(spark, sf_dir, "documents"), "source")


@query("""WITH e AS (SELECT min(p_size) AS lo, greatest(1, CAST(ceil((max(p_size) - min(p_size) + 1) / 20.0) AS INTEGER)) AS w FROM part)
SELECT CAST((p_size - lo) // w AS BIGINT) AS bin, CAST(lo + (p_size - lo) // w * w AS DOUBLE) AS lower, CAST(lo + (p_size - lo) // w * w + w AS DOUBLE) AS upper, count(*) AS count FROM part, e GROUP BY ALL""")
def histogram_int(spark, sf_dir):
    return tables.histogram(table(spark, sf_dir, "part"), "p_size")


@query("""WITH e AS (SELECT min(c_acctbal) AS lo, (max(c_acctbal) - min(c_acctbal)) / 20 AS w FROM customer), b AS (SELECT CAST(least(floor((c_acctbal - lo) / w), 19) AS BIGINT) AS bin, lo, w FROM customer, e)
SELECT bin, round(lo + bin * w, 6) AS lower, round(lo + (bin + 1) * w, 6) AS upper, count(*) AS count FROM b GROUP BY ALL""")
def histogram_float(spark, sf_dir):
    return tables.histogram(table(spark, sf_dir, "customer"), "c_acctbal").select("bin", _r("lower"), _r("upper"), "count")


@query("""SELECT 'value' AS "column", count(*) FILTER (value IS NULL) AS nulls, count(*) FILTER (isnan(value)) AS nans FROM events UNION ALL SELECT 'event_type', count(*) FILTER (event_type IS NULL), CAST(0 AS BIGINT) FROM events""")
def missing_counts(spark, sf_dir):
    return tables.missing_counts(table(spark, sf_dir, "events"), ["value", "event_type"])


@query(f"""WITH {SPECTRA}, b AS (SELECT *, CAST(least(floor("Time" / 2.8), 9) AS BIGINT) AS bin FROM spectra) SELECT source, wavelength, bin, round(avg("Time"), 6) AS "mean_Time", round(avg(value), 6) AS mean_value FROM b GROUP BY ALL""")
def heatmap_bin(spark, sf_dir):
    return tables.binned_means(spectra(spark, sf_dir), "Time", "value", ["source", "wavelength"], 10, 0.0, 28.0).select("source", "wavelength", "bin", _r("mean_Time"), _r("mean_value"))


@query(f"""WITH {SPECTRA}, r AS (SELECT source, "Time", wavelength, value, row_number() OVER (PARTITION BY source, "Time" ORDER BY abs(wavelength - 403.5), wavelength) AS k FROM spectra) SELECT source, "Time", wavelength, value FROM r WHERE k = 1""")
def nearest_trend(spark, sf_dir):
    return tables.nearest_row(spectra(spark, sf_dir).select("source", "Time", "wavelength", "value"), ["source", "Time"], "wavelength", 403.5)


@query(f"""WITH {SPECTRA} SELECT source, "Time", max(value) FILTER (wavelength = 401) AS w401, max(value) FILTER (wavelength = 403) AS w403 FROM spectra GROUP BY ALL""")
def pivot_first(spark, sf_dir):
    return tables.pivot_first(spectra(spark, sf_dir), ["source", "Time"], "wavelength", "value", [401.0, 403.0]).toDF("source", "Time", "w401", "w403")


@query("""SELECT DISTINCT event_type AS value FROM events WHERE event_type IS NOT NULL""")
def category_options(spark, sf_dir):
    return tables.options(table(spark, sf_dir, "events"), "event_type")


_DAY = "epoch_us(o_orderdate)"


@query(f"""WITH e AS (SELECT min({_DAY}) AS lo, CAST(ceil((max({_DAY}) - min({_DAY}) + 1) / 20.0) AS BIGINT) AS w FROM orders)
SELECT ({_DAY} - lo) // w AS bin, CAST(lo + ({_DAY} - lo) // w * w AS DOUBLE) AS lower, CAST(lo + ({_DAY} - lo) // w * w + w AS DOUBLE) AS upper, count(*) AS count FROM orders, e GROUP BY ALL""")
def histogram_time(spark, sf_dir):
    return tables.time_histogram(table(spark, sf_dir, "orders"), "o_orderdate")


@query("""SELECT CAST(row_number() OVER (ORDER BY k NULLS LAST, CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER)) AS BIGINT) AS place, k2 AS doc_id FROM (SELECT source, CASE WHEN max(doc_id) % 2 = 0 THEN max(n_chars) END AS k, max(doc_id) AS k2 FROM documents GROUP BY source)""")
def control_chart_order(spark, sf_dir):
    one = table(spark, sf_dir, "documents").groupBy("source").agg(F.max("doc_id").alias("doc_id"), F.max("n_chars").alias("n"))
    chart = tables.control_chart_order(one.withColumn("k", F.when(F.col("doc_id") % 2 == 0, F.col("n"))), "k", "source")
    return chart.select("place", "doc_id")


@query(f"""WITH {TIMED} SELECT {_LONG}, "StepTime", value FROM timed WHERE "Step" = 1 AND "Sequence" = 2""")
def segment_rows(spark, sf_dir):
    from prismflow.operators.catalog import segment_rows as rows

    return rows(pp.step_times(spectra(spark, sf_dir)), 1, 2).select(*LONG, "StepTime", "value")


@query("""SELECT key, CASE WHEN c_nationkey IS NULL THEN 'new' WHEN s_nationkey IS NULL THEN 'gone' WHEN c_nationkey = s_nationkey THEN 'same' ELSE 'changed' END AS state
FROM (SELECT c_custkey AS key, c_nationkey FROM customer) FULL JOIN (SELECT s_suppkey * 2 AS key, s_nationkey FROM supplier) USING (key)""")
def catalog_diff(spark, sf_dir):
    """Customers as old entries, suppliers as new ones, known by their nation."""
    from prismflow.operators.catalog import catalog_diff as diff

    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"))
    return diff(old, table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2).alias("key"), F.col("s_nationkey").alias("nation")), "key", ["nation"])


# with two components the F quantile has a closed form, so SQL can state the limit
_T2_LIMIT = "2 * 101.0 * 99 / (100 * 98) * (98 / 2.0) * (power(0.01, -2.0 / 98) - 1)"


@query(f"""WITH {_MODEL} SELECT source, round(sum(score * score / v), 6) AS mahalanobis_sq, round({_T2_LIMIT}, 6) AS mahalanobis_ucl, sum(score * score / v) > {_T2_LIMIT} AS mahalanobis_exceeds_ucl
FROM scores JOIN lam USING (component) WHERE component <= 2 GROUP BY source""", short=True)
def monitor_t2(spark, sf_dir):
    from prismflow.config import MahalanobisConfig
    from prismflow.operators.pca import transform_pca

    config = MahalanobisConfig(2)
    out = transform_pca(_model(spark, sf_dir), embedding_facts(spark, sf_dir), mahalanobis=config)
    return out.select("source", *[_r(c) for c in config.columns[:2]], config.columns[2])


@query(f"""WITH {_MODEL}, q AS (SELECT source, sum((z - zhat) ** 2) AS q FROM z JOIN back USING (source, feature_id) GROUP BY source) SELECT source, true AS consistent FROM q""", short=True)
def q_consistency(spark, sf_dir):
    from prismflow.config import SpeConfig
    from prismflow.operators.pca import q_consistent, transform_pca

    model, facts = _model(spark, sf_dir), embedding_facts(spark, sf_dir)
    scored = transform_pca(model, facts, spe=SpeConfig(3))
    return q_consistent(q_contribution(model, prepare(model, facts), 3), scored, "spe")


@query(f"""WITH {FACTS}, m AS (SELECT CAST(f AS BIGINT) AS feature_id FROM range(3, 12) t(f)) SELECT s.source, m.feature_id, value FROM (SELECT DISTINCT source FROM facts) s CROSS JOIN m LEFT JOIN facts ON facts.source = s.source AND facts.feature_id = m.feature_id""", short=True)
def align_features(spark, sf_dir):
    facts = embedding_facts(spark, sf_dir)
    width = embedding_width(spark, sf_dir)
    model = spark.range(3, width + 4).select(F.col("id").alias("feature_id"), F.lit(None).cast("double").alias("fill"))
    return stats.fill_missing(facts, model, facts.select("source").distinct())


@query(f"""WITH {_FLAT.replace(SPECTRA, FILLED)}, named AS (SELECT *, row_number() OVER (ORDER BY feature_id DESC) AS place FROM features WHERE "Step" <> 1)
SELECT source, place AS feature_id, value FROM facts JOIN named USING (feature_id)""")
def align_to_model(spark, sf_dir):
    """Facts of files on the features of a model that lacks a step and has the others in falling order."""
    from prismflow.api import align_features as aligned

    data = preprocess_and_flatten(spark, spectral_files(spark, sf_dir), max_null_ratio=1.0)
    rows = fl.name_table(data.features).join(data.features, "feature_id").filter("Step <> 1").toPandas().sort_values("feature_id", ascending=False)
    n, lam = len(rows), np.ones(1)
    model = PcaModel(columns=list(rows["feature"]), components=np.zeros((1, n)), mean=np.zeros(n), explained_variance=lam, explained_variance_ratio=lam, singular_values=lam, n_samples=2, noise_variance=0.0)
    return aligned(data, model).facts.select(source_name(), "feature_id", "value")


@query("""SELECT s_name AS stem, 'x' || (s_suppkey % 3) AS lot, s_acctbal AS balance, s_nationkey AS nation FROM supplier""")
def file_metadata(spark, sf_dir):
    """Metadata written as CSV files with a byte-order mark and read as the columns that are asked for."""
    from prismflow.functions.lineage import scratch
    from prismflow.sources.metadata import read_metadata

    path = scratch(spark, "metadata")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("stem"), F.concat(F.lit("x"), F.col("s_suppkey") % 3).alias("lot"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    tables.export(rows, path, "csv")
    return read_metadata(spark, path, "stem", {"lot": "category", "balance": "number", "nation": "integer"})


@query("""SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.k')) AS with_k FROM events GROUP BY event_type""")
def event_props(spark, sf_dir):
    return tables.json_counts(table(spark, sf_dir, "events"), "event_type", "props", "k").withColumnRenamed("with_value", "with_k")


@query(f"""WITH {TIMED}, g AS (SELECT source, "Step", "Sequence", count(DISTINCT row_index) AS n FROM timed GROUP BY ALL), m AS (SELECT "Step", "Sequence", max(n) AS n FROM g GROUP BY ALL)
SELECT CAST(sum(ceil(n / 2)) * 4 * 10 * 80 AS BIGINT) AS bytes FROM m""")
def fit_size(spark, sf_dir):
    from prismflow.operators.catalog import segment_summary
    from prismflow.plans.runs import fit_bytes

    segments = segment_summary(pp.step_times(spectra(spark, sf_dir)))
    return spark.createDataFrame([(fit_bytes(segments, 10, 7, 2, 2),)], "bytes long")


ORACLES |= {name: _widened(sql) for name, sql in PART_ORACLES.items()}
