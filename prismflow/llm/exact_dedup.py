"""Exact dedup by skew-safe combining, in DataFrame functions only.

Texts are equal when identical after each run of white space became one space. Copies are first
combined inside each input partition, then by (digest, salt, whole text), then by (digest, whole
text): both groupings hold the full content among their keys, so equal digests never stand in for
equal texts. A group of copies of any size reaches the last stage as one row a salt at most.

Defined results: null text counts as empty, empty texts are copies of each other; rows that repeat
both id and text are one document (counted in group_size); null ids come after all others, and a group without
any other keeps one of its rows; other columns of the input are ignored, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismflow.llm.common import WHITE, materialize, new_names, text_or_empty, with_rows, without_rows


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = docs.select(F.col(id_col).alias("doc_id"), F.regexp_replace(text_or_empty(text_col), WHITE, " ").alias("content"))
    return text.select("doc_id", "content", F.unhex(F.sha2("content", 256)).alias("digest"), F.xxhash64("content").alias("check"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """One row per group of equal texts: digest, check, keep_id (smallest id), group_size."""
    keyed = _keyed(docs, id_col, text_col).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    some = keyed.groupBy("digest", "salt", "check", "content").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    whole = some.groupBy("digest", "check", "content").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    return materialize(whole.select("digest", "check", "keep_id", "group_size"), "exact-groups")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    groups = exact_groups(docs, id_col, text_col, salts)
    members = _keyed(docs, id_col, text_col).select("doc_id", "digest", "check").distinct()
    return members.join(groups, ["digest", "check"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """The input's rows and columns, one row left of each group of equal texts.

    Keys (id, digest) of rows that go, and of rows that repeat the one that stays, are found first; so whole
    rows are met by keys once, and only repeats, if there are any, are told apart as rows.
    """
    of = [F.col(id_col), F.unhex(F.sha2(F.regexp_replace(text_or_empty(text_col), WHITE, " "), 256))]
    several = exact_groups(docs, id_col, text_col, salts).filter("group_size > 1")
    keys = docs.select(of[0].alias("doc_id"), of[1].alias("digest")).groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    members = keys.join(several.select("digest", "keep_id"), "digest")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    leave = materialize(members.filter(~stays | (F.col("n") > 1)).select("doc_id", "digest", stays.alias("repeats")), "leave")
    left = without_rows(docs, leave.select("doc_id", "digest"), of)
    repeats = leave.filter("repeats").select("doc_id", "digest")
    if not repeats.limit(1).count():
        return left
    place = new_names(2)
    again = with_rows(docs, repeats, of).select("*", *[c.alias(n) for c, n in zip(of, place)]).dropDuplicates(place).drop(*place)
    return left.unionByName(again)
