"""Substring dedup where a bitmap of hits would be full, and increments that read only what they must of history."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prismflow.llm import common
from prismflow.llm import substring_dedup as sd
from prismflow.llm.common import merged
from prismflow.llm.substring_dedup import FingerprintIndex, dedup_increment, substring_dedup, with_digest


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("width", [5, 35])
def test_full_bitmaps_are_joined(spark, monkeypatch, docs, rows, width):
    monkeypatch.setattr(common, "MOST_BITS", 4)
    monkeypatch.setattr(common, "LEAST_BITS", 4)
    joined, with_hits = [], sd._with_hits
    monkeypatch.setattr(sd, "_with_hits", lambda *a: joined.append(1) or with_hits(*a))
    monkeypatch.setattr(sd, "fitting_bits", lambda n: 6)
    got = with_digest(substring_dedup(docs, width=width)).collect()
    assert joined and {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == brute.op2(rows, width)


def corpus(seed=3):
    r = random.Random(seed)
    say = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    passage = say(40)
    history = [(k, say(60)) for k in range(200)] + [(500, f"{say(20)} {passage}"), (501, f"{passage} {say(5)}"), (None, f"x {passage}"), (None, say(50)), (502, None)]
    batch = [(900, f"{passage} {say(10)}"), (901, say(60)), (902, "")]
    return history, batch


def test_increment_reads_documents_with_hits(spark, tmp_path, capsys, monkeypatch):
    history, batch = corpus()
    frame(spark, history).repartitionByRange(8, "doc_id").write.parquet(str(tmp_path / "history"))
    past = spark.read.parquet(str(tmp_path / "history"))
    index = FingerprintIndex(spark, 12)
    first = {r["doc_id"]: r["n_removed"] for r in dedup_increment(index, past, None, "one").collect() if r["doc_id"] is not None}
    assert first[500] == first[501] == 40 and sum(first.values()) == 80
    hits = index.add(frame(spark, batch), "two")
    mine = sd._of_history(index, hits, past)
    assert sorted((r["doc_id"] for r in mine.collect()), key=str) == [500, 501, None]
    mine.explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [Or(In(doc_id" in plan or "PushedFilters: [Or(EqualTo(doc_id" in plan or "In(doc_id" in plan
    monkeypatch.setattr(sd, "LISTED", 1)
    by_join = sd._of_history(index, hits, past)
    assert sorted((r["doc_id"] for r in by_join.collect()), key=str) == [500, 501, None]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in dedup_increment(index, frame(spark, batch), past, "two").collect()}
    want = brute.op2([{"doc_id": k, "text": t} for k, (_, t) in enumerate(history + batch)], 12)
    assert got == {d: want[len(history) + k][:2] for k, (d, _) in enumerate(batch)} and got[900][1] == 40


def test_places_survive_compaction_and_sessions(spark, tmp_path):
    history, batch = corpus(5)
    index = FingerprintIndex(spark, 12, str(tmp_path / "i"))
    index.add(frame(spark, history[:100]), "a")
    index.add(frame(spark, history[100:]), "b")
    before = index.documents(index.hits(["b"])).collect()
    index.compact()
    later = FingerprintIndex(spark, 12, str(tmp_path / "i"))
    assert len(later.state["places"]) == 1 and sorted(map(str, later.documents(later.hits(["b"])).collect())) == sorted(map(str, before))
    bare = FingerprintIndex(spark, 12, str(tmp_path / "n"), places=False)
    bare.add(frame(spark, history), "a")
    assert bare.documents(bare.hits()) is None and not FingerprintIndex(spark, 12, str(tmp_path / "n")).state.get("places")
    out = dedup_increment(bare, frame(spark, batch), frame(spark, history), "b")
    assert {r["doc_id"]: r["n_removed"] for r in out.collect()}[900] == 40


def test_merged_batches_keep_their_rows():
    table = pa.table({"k": np.arange(1000), "text": [None if k % 7 == 0 else "x" * (k % 50) for k in range(1000)]})
    for most in (1, 3000, 10**9):
        out = list(merged(iter([*table.to_batches(max_chunksize=13), table.slice(0, 0).to_batches(max_chunksize=1)[0] if table.slice(0, 0).to_batches() else table.to_batches()[0].slice(0, 0)]), most))
        assert pa.Table.from_batches(out).equals(table.combine_chunks()) or pa.Table.from_batches(out).to_pylist() == table.to_pylist()
        assert len(out) == (77 if most == 1 else len(out)) and all(b.nbytes <= max(most, 2000) for b in out)
    assert list(merged(iter([]), 5)) == []


def test_long_texts_in_the_index(spark):
    """A text of several hundred thousand words, and one word of a megabyte."""
    r = random.Random(1)
    long = " ".join(f"v{r.randrange(10**6)}" for _ in range(200_000))
    rows = [(1, long), (2, " ".join(long.split()[150_000:150_050])), (3, "z" * 1_000_000), (4, None)]
    got = {x["doc_id"]: (x["n_words"], x["n_removed"]) for x in substring_dedup(frame(spark, rows)).collect()}
    assert got == {1: (200_000, 50), 2: (50, 50), 3: (1, 0), 4: (0, 0)}
    index = FingerprintIndex(spark)
    index.add(frame(spark, rows[:1]), "a")
    assert index.documents(index.add(frame(spark, rows[1:]), "b")).filter(F.col("doc_id") == 1).count() == 1
