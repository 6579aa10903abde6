"""Language identification: held-out accuracy and odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from prismflow.llm.language_id import evidence, identify, keep_identified, train_text_model

DATA = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DATA)
    model = train_text_model(docs.filter("doc_id % 2 = 0"), per_language=50)
    other = docs.filter("doc_id % 2 = 1")
    rows = evidence(other, "d", F.col("doc_id"), F.col("text"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    found = identify(rows, model).join(other.select(F.col("doc_id").alias("id"), "lang"), "id")
    assert found.filter("text_language = lang").count() >= 0.98 * other.count()
    assert found.filter("language = lang and kept").count() >= 0.98 * other.count()


def test_evidence_settles_what_text_does_not(spark):
    words = {"en": "the water that they thought this", "fr": "les eaux que nous pensions cela"}
    known = [(k, f"{words[g]} {words[g]}", g, f"http://www.{g}.example.com/{k}") for k in range(40) for g in ("en", "fr")]
    rows = [*known, (100, "", "fr", "http://www.fr.example.com/x"), (101, "12 34", None, None)]
    df = spark.createDataFrame(rows, "id long, text string, lang string, url string")
    model = train_text_model(df, id_col="id")
    found = {r["id"]: r for r in identify(evidence(df, "p", F.col("id"), F.col("text"), F.col("lang"), F.col("url")), model).collect()}
    assert found[100]["language"] == "fr" and found[100]["kept"]
    assert found[3]["kept"]


def test_odd_rows(spark, docs, none):
    left = keep_identified(docs)
    assert left.columns == docs.columns and 0 < left.count() <= docs.count()
    assert keep_identified(none).count() == 0
    assert keep_identified(docs.withColumn("lang", F.lit(None).cast("string"))).count() == 0


@pytest.mark.parametrize("url,host,domain,suffix", [("https://u:p@a.b.example.org:80/x?q#f", "a.b.example.org", "example.org", "org"), ("src0", "src0", "src0", "none"), (None, "", "", "none"), ("HTTP://X.MUSEUM", "x.museum", "x.museum", "museum")])
def test_addresses(spark, url, host, domain, suffix):
    row = evidence(spark.createDataFrame([(1, url)], "id long, url string"), "p", F.col("id"), F.lit(""), F.lit("EN-us"), F.col("url")).first()
    assert (row["host"], row["domain"], row["suffix"], row["declared"]) == (host, domain, suffix, "en")


def test_a_rejected_text_takes_no_other_of_its_id(spark):
    words = {"en": "the water that they thought this", "fr": "les eaux que nous pensions cela"}
    rows = [(k, f"{words[g]} {words[g]}", g, "s") for k, g in enumerate(["en", "fr"] * 40)]
    r = random.Random(1)
    junk = "".join(r.choice("qxzjkvwbpg") for _ in range(4000))  # no language
    odd = [(None, f"{words['en']} again", "en", "s"), (None, junk, None, None), (7, junk, None, None), (None, f"{words['fr']} again", "fr", "s")]
    docs = spark.createDataFrame([*rows, *odd], "doc_id long, text string, lang string, source string")
    model = train_text_model(docs)
    verdicts = identify(evidence(docs, "d", F.col("doc_id"), F.col("text"), F.col("lang"), F.col("source")), model)
    kept = keep_identified(docs).collect()
    assert verdicts.filter("not kept").count() == 2
    assert sorted(map(str, kept)) == sorted(map(str, docs.filter(F.length("text") < 4000).collect()))
