"""Substring dedup over a log-structured index of fingerprints.

Words covered by a window of `width` words whose sequence also starts elsewhere are removed. A window's
fingerprint is its anchor: the least hash among the runs of GRAM words inside it, the first of equals.
Equal windows have equal anchors at equal places, and neighbours mostly share one, so the index holds
about one hash for fourteen windows and misses none.

FingerprintIndex keeps sorted immutable runs (anchor, number of places), Parquet files bucketed and sorted
by anchor, and a manifest of those that count, in a folder, so that a later session goes on with it. A new
batch becomes a run of its own that is merge-joined with each historical run; anchors that history has too,
or that the batch itself repeats, are its hits. Compaction merges runs by an outer merge join of their
buckets and deletes what it replaces.

Hits only nominate windows: every anchor of two places or more is a hit of the batch that brought its second
place. Verification hashes the whole window to 128 bits and counts it: first among the documents of a task,
where a sequence that comes twice is settled and told to the others by one row, then over all tasks. So a
passage that a third of all documents share reaches the shuffle about twice a task, not once a document.

To leave out windows early, tasks get a bitmap of the hits, whose size follows their number up to 32 MB; bits
set by chance cost some rows, never a result, as counting decides. Hits beyond what such a bitmap tells apart are
joined instead: documents' anchors meet the hits, and each document takes its own back to its text. Documents that
lose words are told by a bitmap too; where it fills up all meet the join behind it.

For increments the index also keeps the documents of each anchor, in runs of their own. A new batch then reads
of history only the documents that hold one of its hits: by their ids where they are few, which the reader
pushes down, by a join beyond.

Defined results: null text has no words; documents shorter than a window lose nothing; rows that repeat
an id and text get a result each and count as places of their own; null ids are documents too; other
columns are ignored, whatever their names; an empty table gives an empty result. Places of a document are
32-bit. Rows of one id are told apart by a 64-bit hash of their text.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prismflow.llm import common
from prismflow.llm.common import bitmap_of, fitting_bits, hashed_words, hit, in_batches, materialize, mix, rolled, scratch_path, slices, with_rows

WIDTH, GRAM = 35, 8
#: Sequences that a task remembers to tell each about twice; a longer memory saves rows only.
SEEN = 1 << 19
#: Documents of history that an increment asks for by their ids, at most.
LISTED = 1000
_PLACE = np.uint64((1 << 28) - 1)


def anchored(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, document and anchor place of every window that lies inside a document."""
    gram = min(GRAM, width)
    grams = rolled(words, gram, 3)
    span = width - gram + 1
    if len(grams) < span:
        return (np.zeros(0, dtype=np.int64),) * 3
    least, have = mix(grams, 9) & ~_PLACE | np.arange(len(grams), dtype=np.uint64), 1
    while 2 * have <= span:
        least, have = np.minimum(least[:-have], least[have:]), 2 * have
    if have < span:
        least = np.minimum(least[: have - span], least[span - have :])
    ends = np.cumsum(counts)
    doc = np.repeat(np.arange(len(counts)), counts)[: len(least)]
    inside = np.flatnonzero(np.arange(len(least)) + width <= ends[doc])
    return inside, doc[inside], (least[inside] & _PLACE).astype(np.int64)


def _gram_values(words: np.ndarray, width: int, places: np.ndarray) -> np.ndarray:
    return rolled(words, min(GRAM, width), 3)[places]


def _anchors(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words, counts = hashed_words(part.column("text"))
            _, doc, place = anchored(words, counts, width)
            new = np.ones(len(place), dtype=bool)
            new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
            values, n = np.unique(_gram_values(words, width, place[new]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], names=["anchor", "n"])

    return run


PLACES = "anchor long, doc_id long, tag long, n long"


def _document_anchors(width: int):
    """The anchors of each document (doc_id, tag, text), with the numbers of their places in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words, counts = hashed_words(part.column("text"))
            _, doc, place = anchored(words, counts, width)
            new = np.ones(len(place), dtype=bool)
            new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
            doc, values = doc[new], _gram_values(words, width, place[new])
            order = np.lexsort((values, doc))
            doc, values = doc[order], values[order]
            first = np.ones(len(doc), dtype=bool)
            first[1:] = (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])
            at = np.flatnonzero(first)
            n, of = np.diff(at, append=len(doc)), pa.array(doc[at])
            yield pa.RecordBatch.from_arrays([pa.array(values[at].view(np.int64)), part.column("doc_id").take(of), part.column("tag").take(of), pa.array(n.astype(np.int64))], names=["anchor", "doc_id", "tag", "n"])

    return run


def _tagged(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a hash of the text that tells documents of one id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _tag())


def _tag() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag")


class FingerprintIndex:
    """Immutable runs of anchors in a folder that all executors share, and a manifest of those that count.

    There are as many buckets as shuffle partitions when the index is made, so that what a shuffle by anchor
    dealt out is a bucket each and goes to one file without another shuffle. A manifest is a file of its own
    that is put in place whole; runs that no manifest names, of a writer that failed, are never read. With
    places, the default, documents are known by their anchors too, as increments need them.
    """

    def __init__(self, spark: SparkSession, width: int = WIDTH, folder: str | None = None, buckets: int | None = None, places: bool = True):
        self.spark, self.folder = spark, folder or scratch_path(spark, "fingerprints")
        empty = {"number": 0, "width": width, "buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "runs": [], "batches": {}, "places": [] if places else None}
        self.state = self._latest() or empty
        if self.state["width"] != width:
            raise ValueError(f"the index holds windows of {self.state['width']} words, not {width}")
        self.width, self.buckets = width, self.state["buckets"]

    @property
    def runs(self) -> list[str]:
        return list(self.state["runs"])

    def _files(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _latest(self) -> dict | None:
        path, fs = self._files("manifests")
        names = sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []
        whole = [n for n in names if n.endswith(".json")]
        return json.loads(self.spark.sparkContext.wholeTextFiles(f"{self.folder}/manifests/{whole[-1]}", 1).first()[1]) if whole else None

    def _commit(self, **changes) -> None:
        state = self.state | changes | {"number": self.state["number"] + 1}
        made, fs = self._files(f"manifests/{uuid.uuid4().hex}.tmp")
        out = fs.create(made)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not fs.rename(made, self._files(f"manifests/{state['number']:09d}.json")[0]):
            raise RuntimeError("another writer has changed the index")
        self.state = state

    def _write(self, rows: DataFrame, kind: str = "run") -> str:
        run, name = f"{kind}-{uuid.uuid4().hex}", f"prismflow_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "anchor").sortBy("anchor").option("path", f"{self.folder}/{run}").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the table's entry; its files stay
        return run

    def _tables(self, runs: list[str], columns: str = "anchor BIGINT, n BIGINT") -> list[tuple[str, DataFrame]]:
        """Runs as bucketed tables: their entries in the session's catalog, to be dropped after use, and their rows."""
        out = []
        for run in runs:
            name = f"prismflow_run_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (anchor) SORTED BY (anchor) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{run}'")
            out.append((name, self.spark.table(name)))
        return out

    def _drop(self, tables: list[tuple[str, DataFrame]]) -> None:
        for name, _ in tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def add(self, batch: DataFrame, batch_id: str | None = None) -> DataFrame:
        """Add a batch (doc_id, text) as a new run. Returns its hits: anchors that history has too or the batch itself repeats.

        A batch id that was added before adds nothing, and its hits are those of then.
        """
        batch_id = batch_id or uuid.uuid4().hex
        if batch_id not in self.state["batches"]:
            places = self.state.get("places")
            if places is not None:
                found = in_batches(_tagged(batch), _document_anchors(self.width), PLACES)
                new = self._write(found.repartition(self.buckets, "anchor"), "places")
                places = [*places, new]
                found = self.spark.read.schema(PLACES).parquet(f"{self.folder}/{new}").select("anchor", "n")
            else:
                found = in_batches(batch.select("text"), _anchors(self.width), "anchor long, n long")
            run = self._write(found.groupBy("anchor").agg(F.sum("n").alias("n")))
            tables = self._tables([run, *self.runs])
            (_, rows), *history = tables
            hits = rows.filter("n > 1").select("anchor")
            for _, old in history:
                hits = hits.unionByName(rows.join(old.select("anchor").hint("merge"), "anchor").select("anchor"))
            name = f"hits-{uuid.uuid4().hex}"
            hits.write.parquet(f"{self.folder}/{name}")
            self._drop(tables)
            self._commit(runs=[*self.runs, run], batches=self.state["batches"] | {batch_id: name}, places=places)
        return self.hits([batch_id])

    def hits(self, batch_ids: list[str] | None = None) -> DataFrame:
        """Anchors of the hits of these batches, or of all: all anchors that have several places."""
        names = [n for b, n in self.state["batches"].items() if batch_ids is None or b in batch_ids]
        return self.spark.read.schema("anchor long").parquet(*[f"{self.folder}/{n}" for n in names]) if names else self.spark.createDataFrame([], "anchor long")

    def documents(self, hits: DataFrame) -> DataFrame | None:
        """doc_id and tag of all documents that hold one of these anchors; None where the index does not keep them."""
        places = self.state.get("places")
        if places is None:
            return None
        rows = [self.spark.read.schema(PLACES).parquet(f"{self.folder}/{p}") for p in places]
        held = reduce(DataFrame.unionByName, rows) if rows else self.spark.createDataFrame([], PLACES)
        return held.join(hits.select("anchor"), "anchor", "left_semi").select("doc_id", "tag").distinct()

    def compact(self) -> None:
        """Merge all runs to one, two at a time, bucket by bucket, and delete the files of those replaced."""
        places = self.state.get("places") or []
        if len(places) > 1:
            rows = [self.spark.read.schema(PLACES).parquet(f"{self.folder}/{p}") for p in places]
            merged = self._write(reduce(DataFrame.unionByName, rows).repartition(self.buckets, "anchor"), "places")
            self._commit(places=[merged])
            for gone in places:
                path, fs = self._files(gone)
                fs.delete(path, True)
        while len(self.runs) > 1:
            *rest, a, b = self.runs
            tables = self._tables([a, b])
            (_, old), (_, new) = tables
            both = old.hint("merge").join(new.withColumnRenamed("n", "m"), "anchor", "full_outer")
            merged = self._write(both.select("anchor", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n")))
            self._drop(tables)
            self._commit(runs=[*rest, merged])
            for gone in (a, b):
                path, fs = self._files(gone)
                fs.delete(path, True)

    def repeated(self) -> DataFrame:
        """Anchors that have several places, after compaction; the same as all hits."""
        self.compact()
        return self.spark.read.schema("anchor long, n long").parquet(f"{self.folder}/{self.runs[0]}").filter("n > 1").select("anchor") if self.runs else self.spark.createDataFrame([], "anchor long")

    def drop(self) -> None:
        """Delete the index."""
        path, fs = self._files("")
        fs.delete(path, True)


class _Seen:
    """Sequences (two hashes) that a task has met, and whether it has told that they repeat."""

    def __init__(self):
        self._none()

    def _none(self) -> None:
        self.h1, self.h2, self.told = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)

    def __call__(self, h1: np.ndarray, h2: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of ascending h1 with their h2: which repeat, as `several` says or as they came before; and which of these are news."""
        at = np.searchsorted(self.h1, h1)
        same = np.zeros(len(h1), dtype=bool)
        inner = at < len(self.h1)
        same[inner] = (self.h1[at[inner]] == h1[inner]) & (self.h2[at[inner]] == h2[inner])
        repeats, news = several | same, several | same
        news[same] = ~self.told[at[same]]
        self.told[at[same]] = True
        if len(self.h1) > SEEN:
            self._none()
            at = np.zeros(len(h1), dtype=np.int64)
        fresh = ~same
        self.h1, self.h2, self.told = (np.insert(x, at[fresh], v[fresh]) for x, v in ((self.h1, h1), (self.h2, h2), (self.told, repeats)))
        return repeats, news


WINDOWS = "h1 long, h2 long, doc_id long, tag long, at int, length int, n int"


def _windows(width: int, bitmap):
    """Rows of nominated windows: doubtful ones, news of sequences that repeat (at < 0), and settled spans (each alone under its hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for part in slices(batches):
            words, counts = hashed_words(part.column("text"))
            start, doc, place = anchored(words, counts, width)
            anchors = _gram_values(words, width, place).view(np.int64)
            # hits that were joined are of the slice's documents, and a hit of one is a hit of all
            on = hit(bitmap.value, anchors) if bitmap is not None else np.isin(anchors, part.column("hits").flatten().to_numpy())
            start, doc = start[on], doc[on]
            if not len(start):
                continue
            h1, h2 = rolled(words, width, 4)[start], rolled(words, width, 6)[start]
            own, first, same = np.unique(h1, return_index=True, return_inverse=True)
            whole = h2 == h2[first[same]]  # of the whole hash that came first
            repeats, news = seen(own, h2[first], np.bincount(same, whole, len(own)) > 1)
            settled = whole & repeats[same]
            row = _Rows(part, counts)
            rows = np.flatnonzero(~settled)
            yield row(h1[rows], h2[rows], doc[rows], start[rows], width, 1)
            told = first[news]
            if len(told):
                yield row(h1[told], h2[told], doc[told], None, width, 2)
            spans = np.flatnonzero(settled)
            if len(spans):
                begins = np.ones(len(spans), dtype=bool)
                begins[1:] = (doc[spans[1:]] != doc[spans[:-1]]) | (start[spans[1:]] > start[spans[:-1]] + width)
                b = np.flatnonzero(begins)
                e = np.append(b[1:], len(spans)) - 1
                yield row(None, None, doc[spans[b]], start[spans[b]], start[spans[e]] - start[spans[b]] + width, 2)

    return run


class _Rows:
    """Makes rows of WINDOWS for the documents of a slice."""

    def __init__(self, part: pa.RecordBatch, counts: np.ndarray):
        self.ids, self.tags, self.before = part.column("doc_id"), part.column("tag"), np.cumsum(counts) - counts

    def __call__(self, h1, h2, doc: np.ndarray, start: np.ndarray | None, length, n: int) -> pa.RecordBatch:
        size, taken = len(doc), pa.array(doc)
        at = np.full(size, -1, dtype=np.int32) if start is None else (start - self.before[doc]).astype(np.int32)
        tags = self.tags.take(taken)
        if h1 is None:  # a key that no other row has
            h1, h2 = mix(tags.to_numpy().view(np.uint64), 1) ^ mix(at.astype(np.uint64), 2), np.full(size, 2**64 - 1, dtype=np.uint64)
        full = lambda x: pa.array(np.broadcast_to(np.asarray(x, dtype=np.int32), size))
        return pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), self.ids.take(taken), tags, pa.array(at), full(length), full(n)], names=[c.split()[0] for c in WINDOWS.split(", ")])


RESULT = "doc_id long, n_words long, n_removed long, kept string"


def _without(text: str | None, spans: list[int] | None) -> tuple[int, int, str]:
    """Number of words, of words in the spans (length << 32 | place), and the other words joined by one space."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    total = len(words)
    if spans:
        edge = np.zeros(total + 1, dtype=np.int64)
        for s in spans:
            place, length = s & 0xFFFFFFFF, s >> 32
            edge[place] += 1
            edge[place + length] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
    return total, total - len(words), b" ".join(words).decode("utf-8", "surrogatepass")


def _kept_words(bitmap=None):
    """Texts without the words of their spans; with a bitmap, of those documents that surely have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            if bitmap is not None:
                part = part.filter(pa.array(~hit(bitmap.value, part.column("h").to_numpy())))
            spans = part.column("spans").to_pylist() if bitmap is None else [None] * part.num_rows
            rows = [_without(t.as_py(), s) for t, s in zip(part.column("text"), spans)]
            n, removed, kept = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[c.split()[0] for c in RESULT.split(", ")])

    return run


def _chosen(bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.drop_columns(["h"]).filter(pa.array(hit(bitmap.value, batch.column("h").to_numpy())))

    return run


def _shared(df: DataFrame, hashes) -> object:
    """The bitmap of a column of hashes as a broadcast variable; its size follows the number of rows up to a bound."""
    return df.sparkSession.sparkContext.broadcast(bitmap_of(df, hashes, fitting_bits(df.count())))


def _with_hits(docs: DataFrame, nominated: DataFrame, width: int) -> DataFrame:
    """Documents (doc_id, tag, text) that hold a nominated anchor, and their hits."""
    anchors = in_batches(docs, _document_anchors(width), PLACES).select("anchor", "doc_id", "tag")
    mine = anchors.join(materialize(nominated.select("anchor").distinct(), "hits"), "anchor", "left_semi")
    own = materialize(mine.groupBy(F.col("doc_id").alias("of"), F.col("tag").alias("of_tag")).agg(F.collect_set("anchor").alias("hits")), "own-hits")
    both = docs.join(own, docs["doc_id"].eqNullSafe(own["of"]) & (docs["tag"] == own["of_tag"]))
    return both.select("doc_id", "text", "tag", "hits")


def repeated_spans(docs: DataFrame, nominated: DataFrame, width: int = WIDTH) -> DataFrame:
    """Verified repeats of documents (doc_id, tag, text) whose windows have nominated anchors: doc_id, tag, spans (length << 32 | place)."""
    n = nominated.count()
    if 16 * n <= 1 << common.MOST_BITS:
        windows = in_batches(docs, _windows(width, _shared(nominated, F.col("anchor"))), WINDOWS)
    else:  # a bitmap of that size would hold most bits set
        windows = in_batches(_with_hits(docs, nominated, width), _windows(width, None), WINDOWS)
    places = F.sum("n").over(Window.partitionBy("h1", "h2"))
    twice = windows.withColumn("places", places).filter("at >= 0 and places > 1")
    span = F.shiftleft(F.col("length").cast("long"), 32).bitwiseOR(F.col("at").cast("long"))
    return twice.select("doc_id", "tag", span.alias("span")).groupBy("doc_id", "tag").agg(F.collect_set("span").alias("spans"))


def remove_repeats(docs: DataFrame, nominated: DataFrame, width: int = WIDTH, only: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text): each document (doc_id, text) without its repeated windows.

    only: the documents to give results for; repeats count over all of docs.
    """
    spans = materialize(repeated_spans(_tagged(docs), nominated, width), "spans")
    bitmap = _shared(spans, F.col("tag"))
    wanted = _tagged(docs if only is None else only).withColumn("h", F.col("tag"))
    whole = in_batches(wanted, _kept_words(bitmap), RESULT)
    cut = in_batches(wanted, _chosen(bitmap), "doc_id long, text string, tag long")
    s = spans.select(F.col("doc_id").alias("of"), F.col("tag").alias("of_tag"), "spans")
    cut = cut.join(s, cut["doc_id"].eqNullSafe(s["of"]) & (cut["tag"] == s["of_tag"]), "left").select("doc_id", "text", "spans")
    return whole.unionByName(in_batches(cut, _kept_words(), RESULT))


def dedup_increment(index: FingerprintIndex, batch: DataFrame, history: DataFrame | None, batch_id: str | None = None) -> DataFrame:
    """Results for the documents (doc_id, text) of a new batch, judged against themselves and all of history.

    history holds the documents of the earlier batches, as they came; of it only those are read that hold a hit
    of this batch. Only windows that carry a hit are verified, in the batch and in history.
    """
    nominated = index.add(batch, batch_id)
    known = batch if history is None else _of_history(index, nominated, history).unionByName(batch.select("doc_id", "text"))
    out = remove_repeats(known, nominated, index.width, only=batch)
    index.compact()
    return out


def _of_history(index: FingerprintIndex, nominated: DataFrame, history: DataFrame) -> DataFrame:
    """The documents (doc_id, text) of history that hold a nominated anchor."""
    history, held = history.select("doc_id", "text"), index.documents(nominated)
    if held is None:
        return history
    held = materialize(held, "held")
    few = held.select("doc_id").distinct().limit(LISTED + 1).collect()
    if len(few) <= LISTED:  # pushed down to the reader of history
        ids = [r["doc_id"] for r in few if r["doc_id"] is not None]
        asked = F.col("doc_id").isin(ids) if ids else F.lit(False)
        history = history.filter(asked | F.col("doc_id").isNull() if len(ids) < len(few) else asked)
    return with_rows(history, held, [F.col("doc_id").cast("long"), _tag()])


def substring_dedup(docs: DataFrame, width: int = WIDTH, batches: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (its other words, joined by one space).

    The documents enter the index in batches, as increments would. Each batch is merge-joined with the runs
    of those before it; the hits of all batches nominate the windows that are verified in all documents.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    index = FingerprintIndex(docs.sparkSession, width=width, places=False)
    for k in range(batches):
        index.add(rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k), f"{k}")
    out = remove_repeats(rows, index.hits(), width)
    index.compact()
    return out


def with_digest(kept: DataFrame) -> DataFrame:
    """The result with kept_sha256 in place of the kept text."""
    return kept.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
