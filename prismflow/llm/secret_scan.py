"""Secret scans over an incremental ledger of blobs, in DataFrame functions only.

Every version of every path is content-addressed by the SHA-256 of its bytes. The ledger holds one row
for each (blob, rule version) that has been scanned; a commit scans only pairs that it lacks and appends
them as one more Parquet run, then findings are joined back to every path that carries the blob. A manifest
names the runs that count; when they are many, they are merged to one.

Positions come from the gaps between matches: split() gives what lies before each match. Matches leave their
text as rows of lengths (in code points), whose running sums are starts and ends, so that work and memory grow
with the number of matches, however many a text has.

Defined results: null text counts as the empty blob; null ids and repeated rows give rows like any other;
other columns are ignored, whatever their names; an empty table gives an empty result; commit ids and rule
versions may be any text; findings before anything was scanned under the rule version are a ValueError, and
paths whose blob was not scanned have no row.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismflow.llm.common import materialize, scratch_path, text_or_empty
from prismflow.llm.manifest import Manifest


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and what a match must have to stay (group and least length)."""

    kind: str
    pattern: str
    group: int
    least: int


#: The base rules, in the order in which kinds are listed.
BASE_RULES = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18),  # a longest run that is too short holds no other match
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Rules beyond the base ones; their spans are added after the base kinds.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 1),
)
RULE_VERSION = "2"
#: Runs that are merged when there are more.
MOST_RUNS = 8
_MATCH = "array<struct<kind:int,g:int,m:int,t:int>>"


def _matches(text: str, rule: Rule, order: int) -> Column:
    """A rule's matches as structs: kind, and the lengths of the gap before it, of the match, and of what must be long enough."""
    whole = F.regexp_extract_all(F.col(text), F.lit(rule.pattern), F.lit(0))
    gaps = F.split(F.col(text), rule.pattern, -1)
    tested = whole if rule.group == 0 else F.regexp_extract_all(F.col(text), F.lit(rule.pattern), F.lit(rule.group))
    lengths = F.zip_with(gaps, tested, lambda g, t: F.struct(F.length(g).alias("g"), F.length(t).alias("t")))
    parts = F.zip_with(whole, lengths, lambda m, x: F.struct(F.lit(order).alias("kind"), x.g.alias("g"), F.length(m).alias("m"), x.t.alias("t")))
    # a text without a match keeps the cheap way out
    return F.when(F.size(whole) == 0, F.array().cast(_MATCH)).otherwise(F.filter(parts, lambda x: x.m.isNotNull()).cast(_MATCH))


def _listed(spans: Column, kinds: list[str]) -> Column:
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.stop.cast("string"))), ",")


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """Findings of each blob (blob, content) that has any: blob and spans, an array of (start, kind, stop) in their order."""
    parts = F.concat(*[_matches("content", r, k) for k, r in enumerate(rules)])
    each = blobs.select("blob", parts.alias("parts")).select("blob", F.posexplode("parts").alias("place", "x")).select("blob", "place", "x.*")
    line = Window.partitionBy("blob", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    least = F.array(*[F.lit(r.least) for r in rules])
    spans = each.withColumn("stop", F.sum(F.col("g") + F.col("m")).over(line).cast("int")).filter(F.col("t") >= F.get(least, F.col("kind")))
    span = F.struct((F.col("stop") - F.col("m")).alias("start"), "kind", "stop")
    return spans.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def _is(kind: int):
    return lambda span: span.kind == kind


def reported(spans: Column, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> list[Column]:
    """Columns of an array of spans (null: none): a count per base kind, base_sha256 and spans as text."""
    base, kinds = len(BASE_RULES), [r.kind for r in rules]
    spans = F.coalesce(spans, F.array().cast("array<struct<start:int,kind:int,stop:int>>"))
    counts = [F.size(F.filter(spans, _is(k))).cast("long").alias(f"n_{kinds[k]}") for k in range(min(base, len(kinds)))]
    return [*counts, F.sha2(_listed(F.filter(spans, lambda s: s.kind < base), kinds), 256).alias("base_sha256"), _listed(spans, kinds).alias("spans")]


class BlobLedger:
    """Findings by (blob, rule version) as Parquet runs in a folder that all executors share; a commit adds one run."""

    def __init__(self, spark: SparkSession, folder: str | None = None, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, rule_version: str = RULE_VERSION):
        self.spark, self.folder = spark, folder or scratch_path(spark, "blob-ledger")
        self.rules, self.rule_version = rules, rule_version
        self.manifest = Manifest(spark, self.folder, {"commits": [], "runs": []})

    def runs(self) -> list[str]:
        return list(self.manifest.read()["runs"])

    def entries(self) -> DataFrame | None:
        """All scanned (blob, rule_version) pairs with their spans; None before the first commit."""
        frames = [self.spark.read.parquet(f"{self.folder}/{r}") for r in self.runs()]
        return reduce(DataFrame.unionByName, frames) if frames else None

    def _scanned(self) -> DataFrame | None:
        """Entries of the ledger's rule version, or None if nothing was scanned under it."""
        if not any(version == self.rule_version for version, _ in self.manifest.read()["commits"]):
            return None
        return self.entries().filter(F.col("rule_version") == self.rule_version).drop("rule_version")

    def _write(self, rows: DataFrame) -> str:
        run = f"run-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{run}")
        return run

    def commit(self, versions: DataFrame, commit_id: str, text_col: str = "text") -> bool:
        """Scan blobs of these versions that the ledger lacks for its rule version. False for a commit seen before under these rules."""
        state = self.manifest.read()
        if [self.rule_version, commit_id] in state["commits"]:
            return False
        content = versions.select(text_or_empty(text_col).alias("content"))
        keyed = content.select(F.unhex(F.sha2("content", 256)).alias("blob"), "content")
        unseen, known = keyed.select("blob").distinct(), self._scanned()
        if known is not None:
            unseen = unseen.join(known.select("blob"), "blob", "left_anti")
        # found by digests alone, and stored: where unseen blobs are few, texts meet them without a shuffle
        unseen = materialize(unseen, "unseen")
        if known is not None:
            keyed = keyed.join(unseen, "blob", "left_semi")
        blobs = keyed.groupBy("blob", "content").agg(F.count(F.lit(1)).alias("n"))
        found = unseen.join(scan_blobs(blobs, self.rules), "blob", "left").withColumn("rule_version", F.lit(self.rule_version))
        runs = [*state["runs"], self._write(found.select("blob", "spans", "rule_version"))]
        state = self.manifest.commit(state, runs=runs, commits=[*state["commits"], [self.rule_version, commit_id]])
        if len(runs) > MOST_RUNS:
            self.manifest.commit(state, runs=[self._write(self.entries())])
            self.manifest.delete(runs)
        return True

    def findings(self, versions: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
        """Findings of the ledger's rule version joined to every path and version that carries the blob."""
        found = self._scanned()
        if found is None:
            raise ValueError(f"nothing was scanned with rule version {self.rule_version!r}")
        found = found.toDF("_blob_", "_spans_")
        paths = versions.select(*id_cols, F.unhex(F.sha2(text_or_empty(text_col), 256)).alias("_path_blob_"))
        return paths.join(found, F.col("_path_blob_") == F.col("_blob_")).select(*id_cols, *reported(F.col("_spans_"), self.rules))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    The documents come as a history: a part was scanned under the base rules alone, then again under all rules,
    then all documents were delivered, of which only blobs unseen under these rules are scanned, and that twice.
    """
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    part = F.pmod(F.xxhash64(text_or_empty()), F.lit(16))
    older = BlobLedger(docs.sparkSession, rules=BASE_RULES, rule_version="1")
    older.commit(known.filter(part == 0), "first")
    ledger = BlobLedger(docs.sparkSession, older.folder)
    ledger.commit(known.filter(part < 4), "first")
    ledger.commit(known, "second")
    ledger.commit(known, "second")
    return ledger.findings(known, ["doc_id"])
