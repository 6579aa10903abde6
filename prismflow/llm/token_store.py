"""Token ids on disk, Simple-8b coded, in ascending document order.

Documents are range-partitioned by id, those of one id by a hash of their text, and sorted inside each partition; each task encodes its documents
slice by slice. A stored row is a segment: part and segment number, the ids and lengths of its documents,
ids before it in its part, and the coded ids as one self-contained run of bytes (see simple8b). Segments
lie in Parquet files, so any file system that Spark writes will do, and Spark's commit protocol makes
lost executors and repeated tasks harmless.

Defined results: null or empty text is the end id alone; null ids come last; repeated rows are documents
of their own, those of equal id ordered by a hash of their text, then by text; other columns are ignored; an
empty table gives an empty store and an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismflow.llm import simple8b
from prismflow.llm.common import in_batches, merged, scratch_path, slices
from prismflow.llm.tokens import TOKEN_BYTES, encoder

#: Text of a segment, which is encoded at once, about; a longer text stands alone.
SEGMENT_BYTES = 2 * TOKEN_BYTES
SEGMENT = "part int, segment int, before long, n_ids long, first_id long, doc_ids array<long>, lengths array<long>, coded binary"


def _segments(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = encoder(path), TaskContext.get().partitionId(), 0
        for segment, docs in enumerate(slices(merged(batches, SEGMENT_BYTES), most=SEGMENT_BYTES)):
            ids, lengths = encode(docs.column("text"), end_id)
            doc_ids = docs.column("doc_id").to_pylist()
            row = (part, segment, before, len(ids), doc_ids[0], doc_ids, lengths.tolist(), simple8b.encode(ids))
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            names = [c.split()[0] for c in SEGMENT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=names)
            before += len(ids)

    return run


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all documents and write the store to a folder."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]  # an id that many rows have is spread by its texts
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    in_batches(rows, _segments(path, end_id), SEGMENT).write.option("compression", "uncompressed").parquet(folder)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document of the segments; its ids are a cut of the segment's, which no Python object holds."""
    for batch in batches:
        for k in range(batch.num_rows):
            ids = simple8b.decode(batch.column("coded")[k].as_py()).astype("<u4")
            lengths = batch.column("lengths")[k].values.to_numpy()
            ends = np.concatenate([[0], np.cumsum(lengths)])
            data = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer((4 * ends).astype(np.int64)), pa.py_buffer(ids)])
            columns = [batch.column("doc_ids")[k].values, pa.array(ends[:-1] + batch.column("before")[k].as_py()), pa.array(lengths), data.cast(pa.binary()), pa.array(np.full(len(lengths), batch.column("part")[k].as_py(), dtype=np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids", "part"])


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """One row per stored document: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian uint32)."""
    stored = spark.read.parquet(folder)
    parts = stored.groupBy("part").agg(F.sum("n_ids").alias("n"), F.min(F.struct("segment", "first_id")).alias("first"))
    earlier = Window.orderBy(F.col("first.first_id").asc_nulls_last(), "part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    base = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    rows = in_batches(stored.select("part", "before", "doc_ids", "lengths", "coded"), _documents, "doc_id long, start long, n_tokens long, ids binary, part int")
    return rows.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids")


def store_and_read(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write the documents' ids to a new store and read them back, with a checksum of each document's ids."""
    folder = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, folder, path, end_id)
    return read_tokens(docs.sparkSession, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
