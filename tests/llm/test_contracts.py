"""The contracts of the operators against plain Python, on a small table with odd rows."""

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from prismflow.llm.exact_dedup import drop_exact_duplicates, exact_dedup
from prismflow.llm.mixing import mix_sources, mixed_documents
from prismflow.llm.near_dedup import drop_near_duplicates, near_groups
from prismflow.llm.packing import pack_documents, with_crc
from prismflow.llm.secret_scan import BASE_RULES, MORE_RULES, BlobLedger, secret_scan
from prismflow.llm.substring_dedup import FingerprintIndex, substring_dedup, with_digest
from prismflow.llm.token_counts import TokenRollup, counted
from prismflow.llm.token_store import read_tokens, store_and_read, write_tokens
from prismflow.llm.tokens import tokenizer_path
from prismflow.llm.topk import exact_top_k


def as_dict(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_exact_dedup(docs, rows, none):
    assert as_dict(exact_dedup(docs), "keep_id", "group_size", "kept", "text_sha256") == brute.op1(rows)
    left = drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(k for k, v in brute.op1(rows).items() if v[2])
    assert exact_dedup(none).count() == 0


def test_exact_dedup_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, "a  b"), (2, "a\tb")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["keep_id"], r["group_size"]) for r in exact_dedup(df).collect()) == [("1", 1, 1), ("1", 1, 4), ("2", 1, 4), ("None", 1, 4)]
    assert sorted(r["text"] for r in drop_exact_duplicates(df).collect()) == ["a b", "c"]


def test_substring_dedup(docs, rows, none):
    assert as_dict(with_digest(substring_dedup(docs)), "n_words", "n_removed", "kept_sha256") == brute.op2(rows)
    assert substring_dedup(none).count() == 0


@pytest.mark.parametrize("width", [3, 8, 50])
def test_substring_widths(docs, rows, width):
    assert as_dict(with_digest(substring_dedup(docs, width=width, batches=3)), "n_words", "n_removed", "kept_sha256") == brute.op2(rows, width)


def test_index_increments(spark):
    a = [f"w{k}" for k in range(80)]
    index = FingerprintIndex(spark, 10)
    first = spark.createDataFrame([(1, " ".join(a))], "doc_id long, text string")
    assert index.add(first).count() == 0
    fresh = spark.createDataFrame([(2, " ".join(f"v{k}" for k in range(50)))], "doc_id long, text string")
    assert index.add(fresh).count() == 0
    assert index.add(spark.createDataFrame([(3, "q " + " ".join(a[20:50]))], "doc_id long, text string")).count() > 0
    assert len(index.runs) == 3 and index.repeated().count() > 0 and len(index.runs) == 1
    index.drop()


def test_near_groups(docs, rows, none):
    assert as_dict(near_groups(docs, width=4), "n_shingles", "component_id", "kept") == brute.op6(rows)
    assert as_dict(near_groups(docs), "n_shingles", "component_id", "kept") == brute.op6(rows, width=5)
    left = drop_near_duplicates(docs)
    assert left.columns == docs.columns and left.count() == sum(v[2] for v in brute.op6(rows, 5).values())
    assert near_groups(none).count() == 0


def test_near_groups_many_copies(spark):
    """A chain-like group: members differ from one text by different shares, so pairs lie on both sides of the bound."""
    r = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(400):
        w = list(base)
        for at in r.choice(120, r.integers(0, 9), replace=False):
            w[at] = f"x{k}_{at}"
        rows.append({"doc_id": 5000 - k, "text": " ".join(w)})
    found = near_groups(spark.createDataFrame(rows, "doc_id long, text string"), width=4)
    assert as_dict(found, "n_shingles", "component_id", "kept") == brute.op6(rows)


def test_top_k(spark):
    r = np.random.default_rng(4)
    vectors = [(k, [float(x) for x in r.normal(size=8)]) for k in range(900)]
    vectors += [(k, vectors[5][1]) for k in range(900, 960)]  # ties
    vectors += [(960, None), (961, []), (962, [1.0, None] * 4), (963, [float("nan")] * 8), (964, [float("inf")] * 8), (1000, [0.5] * 3), (None, [1.0] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in exact_top_k(df, F.col("vec_id") % 50 == 0).collect()}
    whole = {k: np.array([int(np.floor(1024 * x)) for x in v] + [0] * (8 - len(v))) for k, v in vectors if k is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = {}
    for q in (k for k in whole if k % 50 == 0):
        scored = sorted(((-int(whole[q] @ v), k) for k, v in whole.items() if k != q))[:10]
        want |= {(q, i + 1): (k, -s) for i, (s, k) in enumerate(scored)}
    assert got == want
    few = exact_top_k(df.filter("vec_id < 4"), F.col("vec_id") % 2 == 0)
    assert few.count() == 6
    assert exact_top_k(df.limit(0), F.col("vec_id") % 2 == 0).count() == 0


def test_packing(docs, rows, none):
    pieces = with_crc(pack_documents(docs, tokenizer_path()))
    bad, padding = brute.check_op5(rows, [r.asDict() for r in pieces.collect()], tokenizer_path())
    assert bad == [] and padding == 0
    assert pack_documents(none, tokenizer_path()).count() == 0


def test_mixing(docs, rows, none):
    mixed = mix_sources(docs)
    size, target = brute.op7_targets(rows)
    got, source = {r["doc_id"]: r for r in mixed.collect()}, {r["doc_id"]: r["source"] for r in rows}
    assert len(got) == len(rows)
    assert all(r["source_size"] == size[source[k]] and abs(r["target"] - target[source[k]]) < 1e-6 and r["taken"] <= 3 * r["size"] for k, r in got.items())
    for s in size:
        assert abs(sum(r["taken"] for k, r in got.items() if source[k] == s) - target[s]) <= 1
    assert sorted(map(str, mix_sources(docs).collect())) == sorted(map(str, mixed.collect()))
    out = mixed_documents(docs, mixed)
    assert out.columns == docs.columns
    assert sum(len(brute.WORD.findall(r["text"] or "")) for r in out.collect()) == sum(r["taken"] for r in got.values())
    assert mix_sources(none).count() == 0 and mixed_documents(none, mix_sources(none)).count() == 0


def test_secrets(docs, rows, none):
    want = brute.op9(rows)
    found = as_dict(secret_scan(docs), "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    assert set(found) == set(want)
    for k, v in want.items():
        assert found[k][:4] == v[:4] and set(v[4]) <= set(filter(None, found[k][4].split(","))) | set(v[4][:0])
    assert secret_scan(none).count() == 0


def test_ledger_scans_only_unseen_pairs(spark):
    a = spark.createDataFrame([("p1", "secret=abcdefghijkl"), ("p2", "nothing"), ("p3", "secret=abcdefghijkl")], "path string, text string")
    b = spark.createDataFrame([("p1", "nothing"), ("p4", "token: 0123456789abcdef")], "path string, text string")
    ledger = BlobLedger(spark)
    ledger.commit(a, "c1")
    ledger.commit(b, "c2")
    ledger.commit(b, "c2")
    assert ledger.entries().count() == 3 and len(ledger.runs()) == 2
    assert {r["path"]: r["spans"] for r in ledger.findings(a.unionByName(b), ["path"]).collect() if r["spans"]} == {"p1": "assign:0:19", "p3": "assign:0:19", "p4": "assign:0:23,hex:7:23"}
    newer = BlobLedger(spark, ledger.folder, BASE_RULES + MORE_RULES, "next")
    newer.commit(a, "c3")
    assert newer.entries().count() == 5


def test_token_store(spark, docs, rows, none, tmp_path):
    assert as_dict(store_and_read(docs, tokenizer_path()), "start", "n_tokens", "ids_crc32") == brute.op10(rows, tokenizer_path())
    write_tokens(none, str(tmp_path / "t"), tokenizer_path())
    assert read_tokens(spark, str(tmp_path / "t")).count() == 0


def test_token_rollup(spark):
    rows = [(1, "a b c", "s", "en"), (2, "d", "s", "de"), (3, None, None, None)]
    df = lambda r: spark.createDataFrame(r, "doc_id long, text string, source string, lang string")
    rollup = TokenRollup(spark, lambda d: counted(d, tokenizer_path(), "v1"), "v1")
    totals = lambda: {(r[0], r[1], r[2]): (r[3], r[4]) for r in rollup.totals().collect()}
    assert rollup.commit("b1", df(rows)) and not rollup.commit("b1", df(rows))
    assert totals() == {("s", "en", "v1"): (1, 3), ("s", "de", "v1"): (1, 1), (None, None, "v1"): (1, 0)}
    assert rollup.commit("b2", df([(1, "a b", "t", "en"), (4, "x", "s", "de")]), df([(2, "", "", ""), (99, "", "", "")]))
    assert totals() == {("t", "en", "v1"): (1, 2), ("s", "de", "v1"): (1, 1), (None, None, "v1"): (1, 0)}
    assert rollup.commit("b3", None, df([(1, "", "", "")])) and rollup.commit("b4", df([]))
    assert totals() == {("s", "de", "v1"): (1, 1), (None, None, "v1"): (1, 0)}
