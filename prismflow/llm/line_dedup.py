"""Line dedup in DataFrame functions only: explode normalised lines, hash, count documents, drop, reassemble.

A text's lines are what lies between line feeds. A line's key is the line without white space at either end
and with A-Z lower-cased. Keys of at least `least` code points that `documents` documents or more hold lose
their lines everywhere but in the smallest doc_id that holds them; shorter keys are left alone.

Lines leave a document as (SHA-256 of the key, document, position). Documents are counted for each key by
grouping (key, document) pairs before keys, so that a line which a third of all documents hold is spread over
all tasks and then arrives as one row a task. Positions of lines to drop meet the whole text once, and the
lines that stay are taken in the order of their positions.

Defined results: null text counts as one empty line. A document is known by its id and text, so rows that
repeat both are one document for the count and each gives a row with the same result; rows that repeat an id
with another text are documents of their own, of which the one of smaller text digest counts as the smaller;
null ids come after all others. Other columns of the input are ignored, or kept by drop_common_lines(),
whatever their names; an empty table gives an empty result. One document's lines are held together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismflow.llm.common import materialize, named, new_names, text_or_empty

#: The white space that a key loses at its ends, and the letters that it has in lower case.
ENDS = "\x20\t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _lines(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """doc_id, digest, position and line (its key's hash) of all lines whose key is long enough."""
    text = text_or_empty(text_col)
    keys = F.split(F.translate(text, UPPER, LOWER), "\n", -1)
    each = docs.select(F.col(id_col).alias("doc_id"), _sha(text).alias("digest"), F.posexplode(keys).alias("position", "raw"))
    trimmed = each.select("doc_id", "digest", "position", F.btrim("raw", F.lit(ENDS)).alias("key"))
    return trimmed.filter(F.char_length("key") >= least).select("doc_id", "digest", "position", _sha(F.col("key")).alias("line"))


def common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, documents: int = 2) -> DataFrame:
    """One row for each key that enough documents hold: line (hash), n_documents, first (the document that keeps it)."""
    return _common(_lines(docs, id_col, text_col, least), documents)


def _common(lines: DataFrame, documents: int) -> DataFrame:
    held = lines.select("line", "doc_id", "digest").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "digest")).alias("first")
    return held.groupBy("line").agg(F.count(F.lit(1)).alias("n_documents"), first).filter(F.col("n_documents") >= documents)


def _dropped(docs: DataFrame, id_col: str, text_col: str, least: int, documents: int) -> DataFrame:
    """doc_id, digest, positions: what each document that loses lines loses."""
    lines = materialize(_lines(docs, id_col, text_col, least), "lines")  # read twice; hashes, not texts
    common = materialize(_common(lines, documents), "common-lines")
    keeper = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))
    lost = lines.join(common.select("line", "first"), "line").filter(~keeper)
    return materialize(lost.groupBy("doc_id", "digest").agg(F.collect_set("position").alias("positions")), "dropped-lines")


def _assembled(docs: DataFrame, id_col: str, text_col: str, least: int, documents: int) -> tuple[DataFrame, list[str]]:
    """The input's rows and columns with three more, of the names returned: kept text, lines before, lines dropped."""
    kept, before, gone, key, digest, gone_id, gone_digest, positions = new_names(8)
    lost = _dropped(docs, id_col, text_col, least, documents).toDF(gone_id, gone_digest, positions)
    keyed = docs.select("*", F.col(id_col).alias(key), _sha(text_or_empty(text_col)).alias(digest))
    both = keyed.join(lost, F.col(key).eqNullSafe(F.col(gone_id)) & (F.col(digest) == F.col(gone_digest)), "left")
    lines = F.split(text_or_empty(text_col), "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(positions))
    text = F.when(F.col(positions).isNull(), text_or_empty(text_col)).otherwise(F.array_join(F.transform(stay, lambda k: F.get(lines, k)), "\n"))
    counts = [F.size(lines).cast("long").alias(before), F.coalesce(F.size(positions), F.lit(0)).cast("long").alias(gone)]
    return both.select(*[named(c) for c in docs.columns], text.alias(kept), *counts), [kept, before, gone]


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, documents: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, n_lines (before), n_dropped, text (the lines that stay, joined by line feeds)."""
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows, (kept, before, gone) = _assembled(known, "doc_id", "text", least, documents)
    return rows.select("doc_id", F.col(before).alias("n_lines"), F.col(gone).alias("n_dropped"), F.col(kept).alias("text"))


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, documents: int = 2) -> DataFrame:
    """The input's rows and columns, the text without the lines that go."""
    rows, (kept, _, _) = _assembled(docs, id_col, text_col, least, documents)
    return rows.select(*[F.col(kept).alias(c) if c == text_col else named(c) for c in docs.columns])


def with_line_digest(found: DataFrame) -> DataFrame:
    """The text's digest in its place: doc_id, n_lines, n_dropped, kept_sha256."""
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
