"""Token counts as delta-maintained rollups.

A batch inserts, revises or deletes documents. Commit looks up what the ledger holds of them, writes the
batch's new ledger rows and then its signed deltas by (source, lang, tokenizer version). Totals are the
plain sum of all deltas, so no batch reads earlier text. A batch counts once a manifest names its runs; one
that is committed again under the same id does nothing, one that failed midway is written again.

The ledger lies in buckets of documents, and a commit reads those that its batch touches. When runs are many,
they are merged to one that holds each document's latest rows, and deltas to one sum.

A document is known by its id, one without id by its text. Rows of one batch that are known by the same name
all count, and together replace what earlier batches gave under that name.

Defined results: null text counts 0 tokens; null source or language form groups of their own; deleting what
is unknown changes nothing; what one batch both gives and deletes stays; deletes without id need a text; batch
ids and versions may be any text; other columns are ignored, whatever their names; an empty batch changes
nothing, and its id is taken like any other. Groups whose documents all went disappear from the totals.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismflow.llm.common import in_batches, scratch_path, slices
from prismflow.llm.manifest import Manifest
from prismflow.llm.tokens import TOKEN_BYTES, encoder

LEDGER = "doc_id long, digest binary, version string, source string, lang string, n_docs long, n_tokens long, batch long, bucket int"
KEY = ["doc_id", "digest", "version"]
DELTAS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"
#: Buckets of a new ledger; runs that are merged when there are more.
BUCKETS, MOST_RUNS = 64, 8


def _digest() -> Column:
    """Stands for a document without id; null where there is one."""
    return F.when(F.col("doc_id").isNull(), F.unhex(F.md5(F.coalesce("text", F.lit("")))))


def counted(docs: DataFrame, path: str, version: str) -> DataFrame:
    """doc_id, digest, source, lang, version, n_tokens of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for part in slices(batches, most=TOKEN_BYTES):
            _, counts = encode(part.column("text"))
            names = ["doc_id", "digest", "source", "lang"]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(counts.astype(np.int64))], names=[*names, "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), "text").withColumn("digest", _digest())
    return in_batches(rows, run, "doc_id long, digest binary, source string, lang string, n_tokens long").withColumn("version", F.lit(version))


class TokenRollup:
    """Ledger and deltas as Parquet runs in a folder that all executors share, and a manifest of those that count."""

    def __init__(self, spark: SparkSession, counter: Callable[[DataFrame], DataFrame], version: str, folder: str | None = None, buckets: int = BUCKETS):
        self.spark, self.counter, self.version = spark, counter, version
        self.folder = folder or scratch_path(spark, "token-rollup")
        self.manifest = Manifest(spark, self.folder, {"batches": {}, "ledger": [], "deltas": [], "buckets": buckets})

    def _read(self, runs: list[str], schema: str) -> DataFrame:
        """The rows of all runs; at most MOST_RUNS + 1 of them."""
        frames = [self.spark.read.schema(schema).parquet(f"{self.folder}/{r}") for r in runs]
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], schema)

    def _write(self, kind: str, rows: DataFrame) -> str:
        run = f"{kind}/{uuid.uuid4().hex}"
        if kind == "ledger":
            rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{run}")
        else:
            rows.write.parquet(f"{self.folder}/{run}")
        return run

    def _latest(self, rows: DataFrame) -> DataFrame:
        """Of ledger rows those of each document's latest batch."""
        last = rows.groupBy(*KEY, "bucket", "batch").agg(F.collect_list(F.struct("source", "lang", "n_docs", "n_tokens")).alias("rows"))  # sources and languages of one document
        last = last.groupBy(*KEY, "bucket").agg(F.max(F.struct("batch", "rows")).alias("x"))
        return last.select(*KEY, "bucket", F.col("x.batch").alias("batch"), F.explode("x.rows").alias("r")).select(*KEY, "r.*", "batch", "bucket")

    def _before(self, state: dict, fresh: DataFrame) -> DataFrame:
        """What the ledger holds of a batch's documents, from the buckets that the batch touches."""
        touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most one for each bucket
        keys = fresh.select(*KEY).distinct().toDF(*[f"of_{c}" for c in KEY])
        of = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in KEY]
        mine = self._read(state["ledger"], LEDGER).filter(F.col("bucket").isin(touched)).join(keys, of, "left_semi")
        return self._latest(mine)

    def commit(self, batch_id: str, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> bool:
        """Apply a batch: upserts (doc_id, text, source, lang) and deletes (doc_id, text where it has no id). False if it was applied before."""
        state = self.manifest.read()
        if batch_id in state["batches"]:
            return False
        place, new = 1 + len(state["batches"]), []
        if upserts is not None:
            new.append(self.counter(upserts).groupBy(*KEY, "source", "lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens")))
        if deletes is not None:
            text = F.col("text") if "text" in deletes.columns else F.lit(None).cast("string")
            gone = deletes.select(F.col("doc_id").cast("long"), text.alias("text")).filter("doc_id is not null or text is not null").select("doc_id", _digest().alias("digest")).distinct()
            nothing = [F.lit(None).cast("string").alias(c) for c in ("source", "lang")] + [F.lit(0).cast("long").alias(c) for c in ("n_docs", "n_tokens")]
            new.append(gone.select("doc_id", "digest", F.lit(self.version).alias("version"), *nothing))
        ledger, deltas = list(state["ledger"]), list(state["deltas"])
        if new:
            bucket = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(state["buckets"])).cast("int")
            rows = reduce(DataFrame.unionByName, new).withColumn("batch", F.lit(place).cast("long")).withColumn("bucket", bucket)
            run = self._write("ledger", rows.select(*[c.split()[0] for c in LEDGER.split(", ")]))
            fresh = self._read([run], LEDGER)
            signed = fresh.selectExpr("source", "lang", "version", "n_docs d", "n_tokens t")
            if ledger:
                signed = signed.unionByName(self._before(state, fresh).selectExpr("source", "lang", "version", "-n_docs d", "-n_tokens t"))
            ledger.append(run)
            deltas.append(self._write("deltas", self._sums(signed.selectExpr("source", "lang", "version tokenizer_version", "d n_docs", "t n_tokens"))))
        state = self.manifest.commit(state, batches=state["batches"] | {batch_id: place}, ledger=ledger, deltas=deltas)
        if len(ledger) > MOST_RUNS:
            self._compact(state)
        return True

    def _compact(self, state: dict) -> None:
        """One run of each kind in place of all; documents that went leave the ledger, groups that went the deltas."""
        ledger = self._write("ledger", self._latest(self._read(state["ledger"], LEDGER)).filter("n_docs != 0").select(*[c.split()[0] for c in LEDGER.split(", ")]))
        deltas = self._write("deltas", self.totals())
        self.manifest.commit(state, ledger=[ledger], deltas=[deltas])
        self.manifest.delete([*state["ledger"], *state["deltas"]])

    @staticmethod
    def _sums(deltas: DataFrame) -> DataFrame:
        return deltas.groupBy("source", "lang", "tokenizer_version").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def totals(self) -> DataFrame:
        """n_docs and n_tokens by source, lang and tokenizer version."""
        return self._sums(self._read(self.manifest.read()["deltas"], DELTAS)).filter("n_docs != 0")


def corpus_token_counts(docs: DataFrame, path: str, version: str) -> DataFrame:
    """Totals of a corpus that came in batches, the first of them delivered twice.

    Some documents came as drafts without text and were revised, some drafts under a provisional id and were
    deleted when the document came; so the totals are those of the documents as they are.
    """
    rollup = TokenRollup(docs.sparkSession, lambda d: counted(d, path, version), version)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang")
    part = F.when(F.col("doc_id").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(16)))
    first, second, drafts = docs.filter(part < 8), docs.filter((part >= 8) & (part < 14)), docs.filter(part >= 14)
    provisional = F.when(part == 15, -1 - F.col("doc_id")).otherwise(F.col("doc_id"))
    untexted = drafts.select(provisional.alias("doc_id"), F.lit(None).cast("string").alias("text"), "source", "lang")
    rollup.commit("a", first)
    rollup.commit("b", second.unionByName(untexted))
    rollup.commit("a", first)
    rollup.commit("c", drafts, untexted.filter("doc_id < 0").select("doc_id"))
    return rollup.totals()
