"""Spectral tables over the driver's star schema, for queries that an oracle can repeat."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismflow.functions.lineage import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _axes() -> list[F.Column]:
    """Source, quarter and wavelength of a line item."""
    quarter = ((F.year("l_shipdate") - 1995) * 4 + F.quarter("l_shipdate") - 1).cast("long")
    return [F.concat(F.lit("s"), (F.col("l_suppkey") % 10).cast("string")).alias("source"), quarter.alias("q"), (400.0 + F.col("l_linenumber")).alias("wavelength")]


def _points() -> list[F.Column]:
    """A quarter as a time point."""
    return [F.col("q").alias("row_index"), F.col("q").cast("double").alias("Time"), F.expr("q div 10").alias("Step"), F.expr("1 + (q div 5) % 2").alias("Sequence")]


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long spectral table: 10 sources, quarters as Time, line numbers as wavelengths, mean quantities as values."""
    cells = table(spark, sf_dir, "lineitem").select(*_axes(), "l_quantity")
    mean = cells.groupBy("source", "q", "wavelength").agg(F.avg("l_quantity").alias("value"))
    return mean.select("source", *_points(), "wavelength", "value")


#: Added to sums of order keys, so that they are whole numbers which doubles do not hold.
BEYOND = 2**53 + 1


def spectral_files(spark: SparkSession, sf_dir: str, whole_numbers: bool = False) -> list[str]:
    """The spectra written as the files that an instrument leaves: a file per source, a column per wavelength, 0 where there was no value.

    With whole numbers the values are sums of order keys beyond 2 ** 53, in columns of 64-bit integers.
    """
    root, waves = scratch(spark, "spectra"), [401.0 + k for k in range(7)]
    rows = spectra(spark, sf_dir)
    if whole_numbers:
        items = table(spark, sf_dir, "lineitem").select(*_axes(), "l_orderkey").groupBy("source", "q", "wavelength")
        rows = items.agg((F.sum("l_orderkey") + BEYOND).alias("value")).select("source", *_points(), "wavelength", "value")
    wide = rows.groupBy("source", "Time", "Step", "Sequence").pivot("wavelength", waves).agg(F.first("value"))
    zero = F.lit(0).cast("long") if whole_numbers else F.lit(0.0)
    wide = wide.select("source", "Time", "Step", "Sequence", *[F.coalesce(F.col(f"`{w}`"), zero).alias(f"{w:.1f}nm") for w in waves])
    wide.repartition("source").sortWithinPartitions("source", "Time").write.partitionBy("source").parquet(root)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*/part-*.parquet")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [re.sub("^file:/+", "/", x.getPath().toString()) for x in found]


def source_name(column: str = "source") -> F.Column:
    """The source that a file of spectral_files() was written for."""
    return F.regexp_extract(column, "source=([^/]+)/", 1).alias("source")


SPECTRA = """
    spectra AS (
        SELECT source, q AS row_index, CAST(q AS DOUBLE) AS "Time", q // 10 AS "Step", 1 + (q // 5) % 2 AS "Sequence", wavelength, avg(l_quantity) AS value
        FROM (SELECT 's' || CAST(l_suppkey % 10 AS VARCHAR) AS source, CAST((year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) - 1 AS BIGINT) AS q,
                     CAST(400 + l_linenumber AS DOUBLE) AS wavelength, l_quantity FROM lineitem)
        GROUP BY ALL)"""

#: What is in spectral_files(): a value for every wavelength of every time point.
FILLED = SPECTRA.replace("spectra AS", "given AS") + """,
    spectra AS (
        SELECT p.*, CAST(400 + w AS DOUBLE) AS wavelength, coalesce(value, 0) AS value
        FROM (SELECT DISTINCT source, row_index, "Time", "Step", "Sequence" FROM given) p CROSS JOIN range(1, 8) t(w)
        LEFT JOIN given g ON g.source = p.source AND g.row_index = p.row_index AND g.wavelength = 400 + w)"""

TIMED = (
    SPECTRA
    + """,
    points AS (SELECT DISTINCT source, row_index, "Time", "Step", "Sequence" FROM spectra),
    marked AS (
        SELECT *, CASE WHEN "Step" = lag("Step") OVER w AND "Sequence" = lag("Sequence") OVER w THEN 0 ELSE 1 END AS changed
        FROM points WINDOW w AS (PARTITION BY source ORDER BY "Time", row_index)),
    segments AS (SELECT *, sum(changed) OVER (PARTITION BY source ORDER BY "Time", row_index ROWS UNBOUNDED PRECEDING) AS seg FROM marked),
    times AS (
        SELECT source, row_index, "Time" - min("Time") OVER s AS "StepTime", max("Time") OVER s - "Time" AS "ReverseStepTime"
        FROM segments WINDOW s AS (PARTITION BY source, seg)),
    timed AS (SELECT * FROM spectra JOIN times USING (source, row_index))"""
)


def embedding_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts (source, feature_id, value) of all components of each vector, some of them made missing.

    The pattern of missing values comes again every 8 components, so that 9 of 17 vectors are complete at any length.
    """
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("source"), F.posexplode("embedding").alias("p", "x"))
    gone = (F.col("source") + F.col("p") % 8) % 17 == 0
    return rows.select("source", (F.col("p") + 1).cast("long").alias("feature_id"), F.when(~gone, F.col("x").cast("double")).alias("value"))


def embedding_width(spark: SparkSession, sf_dir: str) -> int:
    """Components of the longest vector: the number of features of embedding_facts()."""
    return table(spark, sf_dir, "embeddings").agg(F.max(F.size("embedding"))).first()[0] or 0


def facts_sql(width: int) -> str:
    """The facts of vectors of so many components."""
    return f"""
    facts AS (
        SELECT vec_id AS source, CAST(p AS BIGINT) AS feature_id, CASE WHEN (vec_id + (p - 1) % 8) % 17 <> 0 THEN CAST(embedding[p] AS DOUBLE) END AS value
        FROM embeddings, range(1, {width + 1}) t(p))"""


#: Facts of short vectors, and of those of the given tables; see queries.PART_ORACLES.
SHORT, WIDTH = 8, 64
FACTS, WHOLE_FACTS = facts_sql(SHORT), facts_sql(WIDTH)


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a long table of one wavelength: users are sources, seconds are Time, the type's length is Step."""
    step = F.length("event_type").cast("long")
    # wall-clock time: no session time zone takes part
    seconds = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', cast(ts as timestamp_ntz))") / F.lit(1_000_000.0)
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("source"), F.col("event_id").alias("row_index"), seconds.alias("Time"), step.alias("Step"), F.lit(1).cast("long").alias("Sequence"), F.lit(400.0).alias("wavelength"), "value")


EVENTS = """
    spectra AS (
        SELECT CAST(user_id AS VARCHAR) AS source, event_id AS row_index, epoch_us(ts) / 1000000.0 AS "Time", CAST(length(event_type) AS BIGINT) AS "Step",
               CAST(1 AS BIGINT) AS "Sequence", CAST(400 AS DOUBLE) AS wavelength, value
        FROM events)"""
