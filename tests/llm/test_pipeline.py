"""The corpus pipeline: each stage on what its predecessor kept, against plain Python."""

import brute
import corpus_pipeline
import pytest

from prismflow.llm.tokens import tokenizer_path


def collected(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def stages(spark, docs, tmp_path_factory):
    """What each stage returned, written and read again."""
    root, now, out = tmp_path_factory.mktemp("stages"), docs, [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, "").write.parquet(str(root / name))
        now = spark.read.parquet(str(root / name))
        out.append(now)
    return out


def test_columns(stages, docs):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "near dedup", "mixing", "packing"]
    assert all(s.columns == docs.columns for s in stages[:-1])


def test_exact_and_near(stages):
    a, b, c = (collected(s) for s in stages[1:4])
    assert {r["doc_id"] for r in b} == {k for k, v in brute.op1(a).items() if v[2]} and len(b) == len({r["doc_id"] for r in b})
    assert {r["doc_id"] for r in c} == {k for k, v in brute.op6(b, width=5).items() if v[2]}


def test_mixing_and_packing(stages):
    before, mixed, pieces = (collected(s) for s in stages[3:6])
    size, target = brute.op7_targets(before)
    words = lambda r: len(brute.WORD.findall(r["text"] or ""))
    for s in size:
        assert abs(sum(words(r) for r in mixed if r["source"] == s) - target[s]) <= 1
    ids = brute.token_ids([{"doc_id": k, "text": r["text"]} for k, r in enumerate(mixed)], tokenizer_path(), 0)
    assert sum(p["length"] for p in pieces) == sum(map(len, ids.values()))
    used = {}
    for p in pieces:
        used.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for spans in used.values():
        at = 0
        for begin, n in sorted(spans):
            assert begin == at
            at += n
        assert at <= 1024 and at & (at - 1) == 0


def test_clean_documents_stay(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert kept.count() >= 0.99 * docs.count()


def test_empty_and_run(spark, none):
    now = none
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "")
    assert now.count() == 0
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_mixing_of_repeated_and_missing_ids(spark):
    """Rows of one id or none take what is theirs, equal ones included: never n counts for each of n rows."""
    rows = [(None, f"{'w ' * (k % 5 + 1)}n{k}", f"s{k % 2}") for k in range(40)]
    rows += [(7, f"r{k} x y", "s0") for k in range(10)] + [(None, "the same text", "s1")] * 12 + [(8, "a b c d", None)] * 9 + [(9, None, "s0"), (9, "", "s0")]
    rows += [(100 + k, f"t{k} u v w", f"s{k % 2}") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    size, target = brute.op7_targets(collected(docs))
    out = collected(corpus_pipeline.mix(spark, docs, ""))
    words = lambda r: len(brute.WORD.findall(r["text"] or ""))
    for s in size:
        assert abs(sum(words(r) for r in out if r["source"] == s) - target[s]) <= 1
    first = lambda text: " ".join((text or "").split())
    for row in set(rows):
        whole = sum(first(r["text"]) == first(row[1]) and r["doc_id"] == row[0] for r in out)
        assert whole <= 3 * rows.count(row)
