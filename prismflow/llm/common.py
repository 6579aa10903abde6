"""Helpers that several corpus operators share: word rules, shared scratch tables, batch tools."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word rule, as a Java regular expression.
WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows' text taken together in one numpy step; bounds a Python worker's memory.
CHUNK_BYTES = 750_000
#: Bytes of an Arrow batch that Spark hands to a Python worker, at most; a longer row comes alone.
BATCH_BYTES = 2_000_000
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def in_batches(df: DataFrame, function: Batches, schema: str) -> DataFrame:
    """mapInArrow over batches of bounded bytes, in workers that give memory back when their task ends.

    Plans run when their result is asked for, so the bound stays set in the session; a smaller one that the
    session has already is left alone.
    """
    spark = df.sparkSession
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_SETTING))
    if most <= 0 or most > BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from function(batches)
        finally:
            _trim()

    return df.mapInArrow(run, schema)


def _trim() -> None:
    """Give freed memory back to the system, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def text_or_empty(column: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str = "text") -> Column:
    """Number of words of a text as long: words end where white space or the text ends."""
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def scratch_root(spark: SparkSession) -> str:
    """The folder, visible to all executors, that the cluster names in spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder; a cluster must set it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="prismflow-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there and any executor may go."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_names(n: int) -> list[str]:
    """Column names that no table has, for columns that stand beside a caller's."""
    return [f"prismflow_{uuid.uuid4().hex}" for _ in range(n)]


def without_rows(docs: DataFrame, keys: DataFrame, of: list[Column]) -> DataFrame:
    """The rows of docs, with its columns, that have none of the keys; `of` are the key's parts as expressions on docs.

    The keys are stored first: as their size is known then, Spark broadcasts them only where they are few.
    """
    return _by_keys(docs, keys, of, "left_anti")


def with_rows(docs: DataFrame, keys: DataFrame, of: list[Column]) -> DataFrame:
    """The rows of docs, with its columns, that have one of the keys; see without_rows()."""
    return _by_keys(docs, keys, of, "left_semi")


def _by_keys(docs: DataFrame, keys: DataFrame, of: list[Column], how: str) -> DataFrame:
    mine, theirs = new_names(len(of)), new_names(len(of))
    stored = materialize(keys.toDF(*theirs), "keys")
    tagged = docs.select("*", *[c.alias(n) for c, n in zip(of, mine)])
    condition = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(mine, theirs)]
    return tagged.join(stored, condition, how).select(*[named(c) for c in docs.columns])


def named(column: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col(f"`{column.replace('`', '``')}`")


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder; results read from it must be saved before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that the texts of each take about `most` bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(column).fill_null("").cast(pa.large_string())
        ends = np.frombuffer(sizes.buffers()[1], dtype=np.int64)[sizes.offset : sizes.offset + len(sizes) + 1]
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def merged(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches put together up to about `most` bytes; a larger one stands alone."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and sum(b.nbytes for b in held) + batch.nbytes > most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        if batch.num_rows:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A well-spread 64-bit value for each 64-bit value."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def _white() -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[0x20, *range(0x09, 0x0E)]] = True
    return out


_WHITE_BYTE = _white()
_VALUES = np.random.default_rng(20250301).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWERED = np.concatenate([_VALUES[:65], _VALUES[97:123], _VALUES[91:]])
#: A factor for each place in a text, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_SEGMENT = 1 << 17


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after another (null: none), and where each begins and the last ends."""
    texts = texts.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, dtype=np.uint8)), ends - ends[0]


def hashed_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit word hashes of all texts one after another, and the number of words of each. lower: A-Z only.

    A word's hash is a polynomial of its bytes, taken from running sums over the text, so no word becomes a
    Python object. Long input is worked through in segments that end between words.
    """
    raw, ends = _text_bytes(texts)
    begins = np.zeros(len(raw) + 1, dtype=bool)
    begins[ends] = True
    values, found, counts = _LOWERED if lower else _VALUES, [], np.zeros(len(texts), dtype=np.int64)
    lo = 0
    while lo < len(raw):
        hi = min(lo + _SEGMENT, len(raw))
        while hi < len(raw):  # not inside a word, however long
            gaps = np.flatnonzero(_WHITE_BYTE[raw[lo:hi]] | begins[lo + 1 : hi + 1])
            if len(gaps):
                hi = lo + int(gaps[-1]) + 1
                break
            hi = min(hi + _SEGMENT, len(raw))
        part = raw[lo:hi]
        word = ~_WHITE_BYTE[part]
        start = word.copy()
        start[1:] &= ~word[:-1] | begins[lo + 1 : hi]
        stop = word
        stop[:-1] &= ~word[1:] | begins[lo + 1 : hi]
        starts, stops = np.flatnonzero(start), np.flatnonzero(stop) + 1
        with np.errstate(over="ignore"):
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(values[part] * _up(len(part)), out=sums[1:])
            # the factor of a word's first byte is taken out again, so its place does not matter
            found.append(mix((sums[stops] - sums[starts]) * _down(len(part))[starts], 2))
        counts += np.diff(np.searchsorted(starts + lo, ends))
        lo = hi
    return (np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)), counts


def _table(base: int):
    kept = _powers(base, _SEGMENT)

    def of(n: int) -> np.ndarray:
        return kept[:n] if n <= len(kept) else _powers(base, n)

    return of


_up, _down = _table(_BASE), _table(pow(_BASE, -1, 2**64))


def rolled(words: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A 64-bit hash for each run of `width` words (by start), over the whole array."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    power, base, m = mix(words, seed), 0xD6E8FEB86659FD93, 1  # of runs of m words
    out, done = np.zeros(len(words), dtype=np.uint64), 0
    with np.errstate(over="ignore"):
        while True:  # a run of 2m words is two of m words: as many steps as width has bits
            if width & m:
                out = out[: len(words) - done - m + 1] * np.uint64(pow(base, m, 2**64)) + power[done : len(words) - m + 1]
                done += m
            if 2 * m > width:
                return mix(out[:n], seed + 1)
            power = power[:-m] * np.uint64(pow(base, m, 2**64)) + power[m:]
            m *= 2


#: Smallest and largest bitmaps, as powers of two of their bits: 8 kB to 32 MB.
LEAST_BITS, MOST_BITS = 16, 28


def fitting_bits(keys: int) -> int:
    """Bits, as a power of two, of a bitmap with sixteen bits or more for each key, up to a bound."""
    return min(MOST_BITS, max(LEAST_BITS, (16 * max(1, keys) - 1).bit_length()))


def bitmap_of(df: DataFrame, hashes: Column, bits: int) -> np.ndarray:
    """A bitmap of 2**bits bits that has the bit of every hash set, by the hash's top bits.

    Used to leave out early what an exact join or count later would leave out anyhow: a bit set by
    chance only lets a row pass. See hit().
    """
    slot = F.shiftrightunsigned(hashes, 64 - bits)
    rows = df.select(slot.alias("s")).groupBy(F.shiftrightunsigned("s", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("b"))
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    table = rows.toArrow()
    out[table["w"].to_numpy()] = table["b"].to_numpy()
    return out


def hit(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes have their bit set."""
    slot = hashes.view(np.uint64) >> np.uint64(64 - (64 * len(bitmap)).bit_length() + 1)
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (slot & np.uint64(63))) & np.uint64(1) == 1
