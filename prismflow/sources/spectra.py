"""Scan many spectral Parquet files as one long table.

A file has a row per time point (Time, Step, Sequence and a column per wavelength). Files of equal column types are
read in one scan; where types differ between files a column gets the type that holds them all. The rows keep
their values as one array; the long table has a row per (source, row_index, wavelength).
"""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismflow.config import PreprocessConfig
from prismflow.functions.names import META, wavelength_of
from prismflow.functions.quantiles import missing
from prismflow.operators.rows import Rows

LONG = ("source", "row_index", "Time", "Step", "Sequence", "wavelength", "value")


#: Footers of remote files that are read at a time.
FOOTERS = 16


def _is_remote(path: str | Path) -> bool:
    return "://" in str(path)


def resolve_paths(paths: Iterable[str | Path], stem_uniqueness: str = "skip") -> list[str | Path]:
    """Absolute local paths and URIs in text order; each local one must be a readable file, Spark opens the others."""
    if isinstance(paths, (str, bytes, Path)):
        raise ValueError("paths must be a collection of paths")
    found = sorted({p if _is_remote(p) else Path(p).resolve() for p in paths}, key=str)
    if not found:
        raise ValueError("no input paths")
    for p in found:
        if not _is_remote(p):
            if not p.exists():
                raise FileNotFoundError(str(p))
            if not p.is_file():
                raise ValueError(f"not a file: {p}")
    twice = [s for s, n in Counter(PurePosixPath(str(p)).stem for p in found).items() if n > 1]
    if twice and stem_uniqueness != "skip":
        text = f"file stems occur more than once: {', '.join(sorted(twice))}"
        if stem_uniqueness == "error":
            raise ValueError(text)
        warnings.warn(text, stacklevel=2)
    return found


def check_schema(schema: T.StructType, path: object = "input") -> list[str]:
    """Wavelength columns of a file's schema, ascending; ValueError where the schema is not a spectral one."""
    types = {f.name: f.dataType for f in schema.fields}
    lacking = [m for m in META if m not in types]
    if lacking:
        raise ValueError(f"{path}: required columns are missing: {', '.join(lacking)}")
    waves = [n for n in types if n not in META]
    if not waves:
        raise ValueError(f"{path}: there is no wavelength column")
    ordered = sorted(waves, key=wavelength_of)
    wrong = [n for n, t in types.items() if not isinstance(t, T.NumericType)]
    if wrong:
        raise ValueError(f"{path}: columns are not numeric: {', '.join(wrong)}")
    return ordered


def _readable(path: str | Path) -> str:
    """A path for Spark's reader, in which no name is a pattern."""
    return re.sub(r"([][{}*?\\])", r"\\\1", str(path) if _is_remote(path) else f"file://{path.as_posix()}")


def common_type(types: Iterable[T.DataType]) -> T.DataType:
    """The numeric type that holds the values of all: double if one is floating, long for whole numbers, else a decimal wide enough (double if there is none)."""
    kinds = set(types)
    if any(isinstance(t, T.FractionalType) and not isinstance(t, T.DecimalType) for t in kinds):
        return T.DoubleType()
    decimals = [t for t in kinds if isinstance(t, T.DecimalType)]
    if not decimals:
        return T.LongType()
    whole = max([t.precision - t.scale for t in decimals] + [19 for t in kinds if not isinstance(t, T.DecimalType)])
    scale = max(t.scale for t in decimals)
    return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.DoubleType()


def scan(spark: SparkSession, paths: list[str | Path]) -> tuple[DataFrame, list[str]]:
    """The wide rows of all files with source and row_index, and the wavelength columns that all share."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import from_arrow_schema

    signed = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0)}  # as Spark reads them

    def schema_of(path: str | Path) -> T.StructType:  # footers only
        if _is_remote(path):
            return spark.read.parquet(_readable(path)).schema
        return from_arrow_schema(pa.schema([f.with_type(signed.get(f.type, f.type)) for f in pq.read_schema(path)]))

    waves: list[str] | None = None
    alike: dict[tuple, list[str | Path]] = {}
    with ThreadPoolExecutor(FOOTERS) as pool:
        for p, schema in zip(paths, pool.map(schema_of, paths)):
            own = check_schema(schema, p)
            if waves is not None and own != waves:
                raise ValueError(f"{p}: its wavelengths differ from those of {paths[0]}")
            waves = own
            alike.setdefault(tuple(schema[c].dataType for c in (*META, *own)), []).append(p)
    columns = [*META, *(waves or [])]
    types = {c: common_type(kinds[k] for kinds in alike) for k, c in enumerate(columns)} if len(alike) > 1 else {}
    named = lambda c: F.col(f"`{c}`")
    parts = []
    for files in alike.values():
        rows = spark.read.parquet(*map(_readable, files))
        # Spark gives a URI, with some characters escaped, and one slash or three
        uri = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "file:///")
        parts.append(rows.select(*[named(c).cast(types[c]).alias(c) if c in types else named(c) for c in columns], uri.alias("uri"), F.col("_metadata.row_index").alias("row_index")))
    names = spark.createDataFrame([(str(p), str(p)) if _is_remote(p) else (f"file://{p.as_posix()}", p.as_posix()) for p in paths], "uri string, source string")
    return reduce(DataFrame.unionByName, parts).join(names, "uri").drop("uri"), waves or []


def to_long(wide: DataFrame, waves: list[str]) -> DataFrame:
    """A row per wavelength, as doubles."""
    pairs = F.array(*[F.struct(F.lit(wavelength_of(w)).alias("wavelength"), F.col(f"`{w}`").cast("double").alias("value")) for w in waves])
    return wide.select("source", "row_index", "Time", "Step", "Sequence", F.explode(pairs).alias("x")).select("source", "row_index", "Time", "Step", "Sequence", "x.wavelength", "x.value")


def in_range(waves: list[str], bounds: tuple[float, float] | None) -> list[str]:
    """Wavelength columns inside closed bounds; at least one."""
    kept = [w for w in waves if bounds is None or bounds[0] <= wavelength_of(w) <= bounds[1]]
    if not kept:
        raise ValueError("no wavelength lies in wavelength_range")
    return kept


def bad_values(wide: DataFrame, waves: list[str]) -> DataFrame:
    """source, n_rows and n_bad: rows of each file, and those of them with a null, NaN or infinite value in checked columns."""
    values = F.array(*[F.col(f"`{n}`").cast("double") for n in (*META, *waves)])
    bad = F.exists(values, lambda v: missing(v) | (F.abs(v) == float("inf")))
    return wide.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_bad"))


def check_values(wide: DataFrame, waves: list[str]) -> None:
    """ValueError naming the first file, in text order, with a null, NaN or infinite value in checked columns."""
    first = bad_values(wide, waves).filter("n_bad > 0").agg(F.min("source")).first()[0]
    if first is not None:
        raise ValueError(f"{first}: there are null, NaN or infinite values")


def repeated_keys(wide: DataFrame) -> DataFrame:
    """source, Time, Step, Sequence and n, where a file repeats these."""
    return wide.groupBy("source", *META).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def check_unique_keys(wide: DataFrame) -> None:
    """ValueError where a file repeats (Time, Step, Sequence)."""
    twice = repeated_keys(wide).agg(F.min("source")).first()[0]
    if twice is not None:
        raise ValueError(f"{twice}: (Time, Step, Sequence) repeats")


def unaligned_keys(wide: DataFrame, sources: int) -> DataFrame:
    """Time, Step, Sequence and n_sources, where not all of so many files have these."""
    return wide.select("source", *META).distinct().groupBy(*META).agg(F.count(F.lit(1)).alias("n_sources")).filter(F.col("n_sources") != sources)


def check_alignment(wide: DataFrame, sources: int) -> None:
    """ValueError where files have different sets of (Time, Step, Sequence)."""
    if unaligned_keys(wide, sources).limit(1).count():
        raise ValueError("files have different (Time, Step, Sequence) sets")


def _checked(spark: SparkSession, paths: Iterable[str | Path], config: PreprocessConfig) -> tuple[DataFrame, list[str]]:
    """Checked wide rows after the step filter, and the chosen wavelength columns."""
    files = resolve_paths(paths, config.stem_uniqueness)
    wide, waves = scan(spark, files)
    chosen = in_range(waves, config.wavelength_range)
    wide = wide.select("source", "row_index", *META, *[f"`{w}`" for w in chosen])
    check_values(wide, chosen)
    if config.validate_metadata_uniqueness:
        check_unique_keys(wide)
    if config.target_steps is not None:
        wide = wide.filter(F.col("Step").isin(list(config.target_steps)))
    if config.validate_metadata_alignment:
        check_alignment(wide, len(files))
    return wide, chosen


def load(spark: SparkSession, paths: Iterable[str | Path], config: PreprocessConfig = PreprocessConfig()) -> DataFrame:
    """Checked long table of the files, after the step filter and the choice of wavelengths."""
    return to_long(*_checked(spark, paths, config))


def to_rows(wide: DataFrame, waves: list[str]) -> Rows:
    """Rows with their values as an array; columns of whole numbers and decimals are also kept exactly."""
    kinds = [wide.schema[w].dataType for w in waves]
    kinds = [T.DoubleType() if isinstance(k, (T.FloatType, T.DoubleType)) else k if isinstance(k, T.DecimalType) else T.LongType() for k in kinds]
    column = lambda w, kind: F.col(f"`{w}`").cast(kind)
    scale = max([k.scale for k in kinds if isinstance(k, T.DecimalType)], default=0)
    columns = [F.array(*[column(w, "double") for w in waves]).alias("values")]
    if any(not isinstance(k, T.DoubleType) for k in kinds):
        wide_enough = T.DecimalType(38, scale)
        columns.append(F.array(*[F.lit(None).cast(wide_enough) if isinstance(k, T.DoubleType) else column(w, wide_enough) for w, k in zip(waves, kinds)]).alias("exact"))
    return Rows(wide.select("source", "row_index", *META, *columns), [wavelength_of(w) for w in waves], [k.simpleString() for k in kinds])


def load_rows(spark: SparkSession, paths: Iterable[str | Path], config: PreprocessConfig = PreprocessConfig()) -> Rows:
    """Checked rows of the files, after the step filter and the choice of wavelengths."""
    return to_rows(*_checked(spark, paths, config))
