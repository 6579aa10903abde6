"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prismflow.llm.common import scratch_path
from prismflow.llm.exact_dedup import drop_exact_duplicates
from prismflow.llm.language_id import keep_identified
from prismflow.llm.mixing import mix_sources, mixed_documents
from prismflow.llm.near_dedup import drop_near_duplicates
from prismflow.llm.packing import pack_documents, with_crc
from prismflow.llm.tokens import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the fused evidence settles."""
    return keep_identified(docs)


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_duplicates(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words a shingle, similarity 0.8 or more."""
    return drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight takes them."""
    return mixed_documents(docs, mix_sources(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in training sequences."""
    return with_crc(pack_documents(docs, tokenizer_path()))


STAGES = [("language ID", identify_language), ("exact dedup", dedup_exact), ("near dedup", dedup_near), ("mixing", mix), ("packing", pack)]

#: SQL can express neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
