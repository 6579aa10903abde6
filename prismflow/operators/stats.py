"""Per-feature statistics and the stages before PCA, on facts (source, feature_id, value).

Missing is null or NaN. Fitted state is a small table keyed by feature_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismflow.functions.quantiles import missing
from prismflow.operators import ranks

#: Sources of a block and features of a run, whose dense matrix (8 bytes a cell) gram() multiplies in a task; at most about.
GRAM_SOURCES, GRAM_FEATURES = 256, 1024
#: Blocks of one side of a task of gram(), about.
GRAM_BLOCKS = 32
#: The same for covariance().
COVARIANCE_SOURCES, COVARIANCE_FEATURES = 1024, 512


def clean(facts: DataFrame) -> DataFrame:
    """NaN as null."""
    return facts.withColumn("value", F.when(~missing("value"), F.col("value")))


def exact_sums(facts: DataFrame) -> DataFrame:
    """feature_id, n and sum of the exact values of facts that have them; a sum beyond 38 digits is an error."""
    known = facts.filter("exact is not null")
    return known.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n"), F.sum("exact").alias("sum"))


def fit_scaling(facts: DataFrame, strategy: str) -> DataFrame:
    """feature_id, center, scale. A null center is 0; a null or zero scale is 1."""
    x = F.col("value")
    ways = {
        "none": (F.lit(0.0), F.lit(1.0)),
        "z-score": (F.avg(x), F.stddev_samp(x)),
        "pareto": (F.avg(x), F.sqrt(F.stddev_samp(x))),
        "minmax": (F.min(x), F.max(x) - F.min(x)),
    }
    if strategy == "robust":
        fitted = _robust(facts)
    elif strategy in ways:
        center, scale = ways[strategy]
        fitted = clean(facts).groupBy("feature_id").agg(center.alias("center"), scale.alias("scale"))
    else:
        raise ValueError(f"unknown scaling strategy: {strategy}")
    sound = F.when((F.col("scale") != 0) & ~F.isnan("scale"), F.col("scale"))
    return fitted.select("feature_id", F.coalesce("center", F.lit(0.0)).alias("center"), F.coalesce(sound, F.lit(1.0)).alias("scale"))


def _robust(facts: DataFrame) -> DataFrame:
    """Median and distance of the quartiles of every feature, null where it has no value."""
    places = {"below": F.floor((F.col("n") - 1) / 2), "above": F.floor(F.col("n") / 2), "q1": ranks.nearest_place(0.25), "q3": ranks.nearest_place(0.75)}
    found = _of_features(facts, ranks.quantiles(facts, places))
    return found.select("feature_id", (F.col("below") / 2 + F.col("above") / 2).alias("center"), (F.col("q3") - F.col("q1")).alias("scale"))


def _of_features(facts: DataFrame, found: DataFrame) -> DataFrame:
    """A row for every feature of the facts, also those without any value."""
    return facts.select("feature_id").distinct().join(found, "feature_id", "left")


def apply_scaling(facts: DataFrame, scaling: DataFrame) -> DataFrame:
    return facts.join(scaling, "feature_id").select("source", "feature_id", ((F.col("value") - F.col("center")) / F.col("scale")).alias("value"))


def fit_outliers(facts: DataFrame, multiplier: float = 1.5) -> DataFrame:
    """feature_id, lower and upper fence (quartiles -/+ multiplier * range), p1 and p99."""
    q = _of_features(facts, ranks.nearest_quantiles(facts, {"q1": 0.25, "q3": 0.75, "p1": 0.01, "p99": 0.99}))
    spread = F.col("q3") - F.col("q1")
    return q.select("feature_id", (F.col("q1") - multiplier * spread).alias("lower"), (F.col("q3") + multiplier * spread).alias("upper"), "p1", "p99")


def outlier_sources(facts: DataFrame, bounds: DataFrame) -> DataFrame:
    """Sources with any feature outside its fence."""
    beyond = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    return facts.join(bounds, "feature_id").filter(beyond).select("source").distinct()


def drop_outliers(facts: DataFrame, bounds: DataFrame) -> DataFrame:
    """Facts of sources without outliers."""
    return facts.join(outlier_sources(facts, bounds), "source", "left_anti")


def winsorize(facts: DataFrame, bounds: DataFrame) -> DataFrame:
    """All features of sources with outliers clipped to [p1, p99]; other sources as they are."""
    flagged = outlier_sources(facts, bounds).withColumn("flag", F.lit(True))
    joined = facts.join(bounds, "feature_id").join(flagged, "source", "left")
    clipped = F.when(F.col("value").isNotNull(), F.greatest(F.least("value", "p99"), F.col("p1")))
    return joined.select("source", "feature_id", F.when(F.col("flag"), clipped).otherwise(F.col("value")).alias("value"))


def complete_sources(facts: DataFrame, features: int) -> DataFrame:
    """Sources that have a value for each of so many features."""
    return clean(facts).groupBy("source").agg(F.count("value").alias("n")).filter(F.col("n") == features).select("source")


def drop_missing(facts: DataFrame, features: int) -> DataFrame:
    """Facts of complete sources."""
    return facts.join(complete_sources(facts, features), "source", "left_semi")


def fit_medians(facts: DataFrame, features: DataFrame) -> DataFrame:
    """feature_id and its median; 0 where a feature has no value."""
    return features.select("feature_id").join(ranks.medians(facts), "feature_id", "left").select("feature_id", F.coalesce("median", F.lit(0.0)).alias("fill"))


def fill_missing(facts: DataFrame, fills: DataFrame, sources: DataFrame) -> DataFrame:
    """A value for every (source, feature): its own, or the feature's fill."""
    grid = sources.select("source").join(fills, F.lit(True))  # every source has every feature in the result
    return grid.join(clean(facts), ["source", "feature_id"], "left").select("source", "feature_id", F.coalesce("value", "fill").alias("value"))


def fill_from_centroids(facts: DataFrame, centroids: DataFrame, sources: DataFrame) -> DataFrame:
    """Missing values from the nearest centroid (cluster, feature_id, center) over a source's present features; first on ties."""
    present = clean(facts).filter("value is not null")
    gap = F.col("value") - F.col("center")
    distance = present.join(centroids, "feature_id").groupBy("source", "cluster").agg(F.sum(gap * gap).alias("d"))
    nearest = distance.groupBy("source").agg(F.min_by("cluster", F.struct("d", "cluster")).alias("cluster"))
    first = centroids.agg(F.min("cluster").alias("first"))
    chosen = sources.select("source").join(nearest, "source", "left").join(F.broadcast(first), F.lit(True)).select("source", F.coalesce("cluster", "first").alias("cluster"))
    grid = chosen.join(centroids, "cluster")
    return grid.join(present, ["source", "feature_id"], "left").select("source", "feature_id", F.coalesce("value", "center").alias("value"))


def covariance(facts: DataFrame) -> DataFrame:
    """Upper triangle (a <= b) of the sample covariance matrix of complete facts.

    Blocks of sources are dense matrices over runs of features; tasks multiply run by run and add up what they
    have of a pair of runs before it is shuffled.
    """
    means = facts.groupBy("feature_id").agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("n"))
    centered = facts.join(means, "feature_id").select("source", "feature_id", (F.col("value") - F.col("m")).alias("c"))
    sizes = facts.agg(F.approx_count_distinct("source").alias("sources"), F.max("feature_id").alias("last")).first()
    runs, blocks = (sizes["last"] or 0) // COVARIANCE_FEATURES + 1, max(1, -(-sizes["sources"] // COVARIANCE_SOURCES))
    cells = centered.withColumn("block", F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int")).withColumn("run", F.floor(F.col("feature_id") / COVARIANCE_FEATURES).cast("long"))
    kind = facts.schema["source"].dataType.simpleString()
    packed = cells.groupBy("block", "run").applyInArrow(lambda t: _dense_block(t, COVARIANCE_FEATURES), f"block int, run long, sources array<{kind}>, matrix binary")
    right = packed.select("block", F.col("run").alias("j"), F.col("sources").alias("b"), F.col("matrix").alias("y"))
    left = packed.select("block", F.col("run").alias("i"), F.col("sources").alias("a"), F.col("matrix").alias("x"))
    if runs > 1:
        partner = F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("j")
        pairs = left.select("*", partner).filter("j >= i").join(right, ["block", "j"])
    else:
        pairs = left.select("block", "i", F.col("i").alias("j"), "a", "x", F.col("a").alias("b"), F.col("x").alias("y"))
    sums = pairs.mapInArrow(_feature_products, "a long, b long, s double").groupBy("a", "b").agg(F.sum("s").alias("s"))
    sums = sums.join(means.select(F.col("feature_id").alias("b")), "b")
    return sums.join(means.select(F.col("feature_id").alias("a"), "n"), "a").select("a", "b", (F.col("s") / (F.col("n") - 1)).alias("covariance"))


def _feature_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products of features of two runs over the sources of all blocks that a task meets."""
    held: dict[tuple[int, int], np.ndarray] = {}

    def rows(i: int, j: int) -> pa.RecordBatch:
        sums = held[i, j]
        a, b = np.indices(sums.shape).reshape(2, -1)
        a, b = a + i * COVARIANCE_FEATURES, b + j * COVARIANCE_FEATURES
        on = (a <= b) & (a > 0) & ~np.isnan(sums.reshape(-1))
        return pa.RecordBatch.from_arrays([pa.array(a[on]), pa.array(b[on]), pa.array(sums.reshape(-1)[on])], names=["a", "b", "s"])

    for batch in batches:
        for k in range(batch.num_rows):
            i, j = (batch.column(c)[k].as_py() for c in ("i", "j"))
            names = [batch.column(c)[k].values for c in ("a", "b")]
            x, y = (np.frombuffer(batch.column(c)[k].as_buffer()).reshape(len(n), -1) for c, n in zip(("x", "y"), names))
            if not names[0].equals(names[1]):  # the same sources, which each run may have met in another order
                at = {s: r for r, s in enumerate(names[1].to_pylist())}
                take = [at.get(s, -1) for s in names[0].to_pylist()]
                y = np.vstack([y, np.zeros((1, y.shape[1]))])[take]
            product = x.T @ y
            if (i, j) in held:
                old = held[i, j]
                if old.shape != product.shape:
                    shape = tuple(np.maximum(old.shape, product.shape))
                    old, product = (np.pad(m, [(0, s - n) for s, n in zip(shape, m.shape)]) for m in (old, product))
                product = old + product
            held[i, j] = product
            if len(held) > 16:  # 2 MB each
                first = next(iter(held))
                yield rows(*first)
                del held[first]
    for i, j in held:
        yield rows(i, j)


def gram(facts: DataFrame) -> DataFrame:
    """Upper triangle (a <= b) of inner products of centered sources.

    Blocks of sources are multiplied by blocks of sources, over runs of features, as dense matrices in tasks:
    a task's worker holds a batch of pairs of blocks (64 MB, by Spark's setting of Arrow's bytes a batch). Blocks of one
    run, whose features' means are broadcast so that no feature's rows meet in one key, are shuffled once, and each
    task fetches its parts of them; blocks of several runs (fits take these with few sources) are copied to each
    other block of their run.
    """
    facts = facts.filter("source is not null")
    sizes = facts.agg(F.count_distinct("source").alias("sources"), F.count_distinct(F.floor(F.col("feature_id") / GRAM_FEATURES)).alias("runs")).first()
    blocks = max(1, -(-sizes["sources"] // GRAM_SOURCES))
    means = facts.groupBy("feature_id").agg(F.avg("value").alias("m"))
    means = F.broadcast(means) if sizes["runs"] <= 1 else means  # at most GRAM_FEATURES rows: facts are not shuffled by feature
    centered = facts.join(means, "feature_id").select("source", "feature_id", (F.col("value") - F.col("m")).alias("c"))
    kind = facts.schema["source"].dataType.simpleString()
    cells = centered.withColumn("block", F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int")).withColumn("run", F.floor(F.col("feature_id") / GRAM_FEATURES).cast("long"))
    packed = cells.groupBy("block", "run").applyInArrow(lambda t: _dense_block(t, GRAM_FEATURES), f"block int, run long, sources array<{kind}>, matrix binary")
    if sizes["runs"] <= 1:
        wide = math.isqrt(4 * facts.sparkSession.sparkContext.defaultParallelism) + 1  # its square: tasks for all cores
        dealt = packed.repartition(min(blocks, max(wide, -(-blocks // GRAM_BLOCKS))))
        left = dealt.select(F.col("block").alias("i"), F.col("sources").alias("a"), F.col("matrix").alias("x"))
        right = dealt.select(F.col("block").alias("j"), F.col("sources").alias("b"), F.col("matrix").alias("y"))
        met = left.join(right.hint("shuffle_replicate_nl"), F.col("i") <= F.col("j"))  # no copies: a task for each two partitions
    else:
        partner = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
        left = packed.select("run", F.col("block").alias("i"), partner, F.col("sources").alias("a"), F.col("matrix").alias("x")).filter("other >= i").withColumnRenamed("other", "j")
        right = packed.select("run", F.col("block").alias("j"), partner, F.col("sources").alias("b"), F.col("matrix").alias("y")).filter("other <= j").withColumnRenamed("other", "i")
        met = left.join(right, ["run", "i", "j"])
    pairs = met.mapInArrow(_block_products, f"p {kind}, q {kind}, product double")
    products = pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "product")
    return products if sizes["runs"] <= 1 else products.groupBy("a", "b").agg(F.sum("product").alias("product"))


def _dense_block(cells: pa.Table, run: int) -> pa.Table:
    """One row: the block's sources in order, and their values in the run's features as a dense matrix.

    The order holds however the cells arrive, so that a block that is made twice is the same.
    """
    sources = cells.column("source").combine_chunks().dictionary_encode()
    order = pc.sort_indices(sources.dictionary).to_numpy()
    row, at = np.argsort(order)[sources.indices.to_numpy()], cells.column("feature_id").to_numpy() % run
    matrix = np.zeros((len(order), int(at.max()) + 1))
    np.add.at(matrix, (row, at), np.nan_to_num(cells.column("c").to_numpy().astype(float), nan=0.0))
    names = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), sources.dictionary.take(pa.array(order)))
    columns = {"block": cells.column("block")[:1], "run": cells.column("run")[:1], "sources": names, "matrix": pa.array([matrix.tobytes()], pa.binary())}
    return pa.table(columns)


def _block_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Inner products of each source of one block with each of the other; of a block with itself, each pair once."""
    for batch in batches:
        for k in range(batch.num_rows):
            a, b = batch.column("a")[k].values, batch.column("b")[k].values
            x, y = (np.frombuffer(batch.column(c)[k].as_py()).reshape(len(n), -1) for c, n in (("x", a), ("y", b)))
            width = min(x.shape[1], y.shape[1])  # features beyond it are 0 in one of the two
            products = x[:, :width] @ y[:, :width].T
            one = batch.column("i")[k] == batch.column("j")[k]
            row, column = np.triu_indices(len(a)) if one else np.indices(products.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([a.take(pa.array(row)), b.take(pa.array(column)), pa.array(products[row, column])], names=["p", "q", "product"])
