"""Line dedup, source divergence and hard negatives against plain Python, on small and odd tables."""

import random
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prismflow.llm import divergence, hard_negatives
from prismflow.llm.divergence import distinct_terms, source_divergence, term_slices, xx64
from prismflow.llm.hard_negatives import hard_negatives as mine
from prismflow.llm.hard_negatives import share
from prismflow.llm.line_dedup import common_lines, drop_common_lines, line_dedup, with_line_digest

ODD = "doc_id long, text string, lang string, source string, line string, `first` long, positions int, `a.b` string, key string, n long, whole long, part string, `position` int"


@pytest.fixture(scope="module")
def odd():
    """Null and repeated ids, repeated rows, empty and long texts, lines with odd ends, columns with names that operators use."""
    r = random.Random(6)
    words = ["Ab", "über", "ça", "tail", "x", "Straße", "日本", "don't", "zebra", "é", "UPPER", "w1w", "again"]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared, line = [say(5) + " shared" for _ in range(12)], lambda: r.choice(shared) if r.random() < 0.5 else say(r.randint(0, 9))
    texts = [None, "", "\n", "short", "short", "\n\n  A Shared Line  \r\nshort", "a shared line", " \t a SHARED line\x0b", "a shared line\x85", "ten chars!\nten chars!", "ten chars!"]
    texts += ["\n".join(line() for _ in range(r.randint(1, 12))) for _ in range(30)] + ["\n".join(line() for _ in range(4000)), "long" * 50_000, "\n" * 3000]
    texts += [f"common line {k % 2} of a third\n{say(3)}" for k in range(20)]
    ids = [None, 5, 5, None, 9, 9, 40, 3, 3, 7, 1, *range(100, 140)]
    rows = [(ids[k] if k < len(ids) else 200 + k, t, ("en", "fr", None)[k % 3], ("s1", "s0", None, "été")[k % 4]) for k, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, texts[5], "", ""), (None, texts[5], "", ""), (77, None, "xx", "only"), (78, "one two", "yy", "a"), (79, "", "yy", "b")]
    return [(*x, "l", 1, 2, "dotted", "k", 3, 4, "p", 6) for x in rows]


@pytest.fixture(scope="module")
def frame(spark, odd):
    return spark.createDataFrame(odd, ODD).repartition(5).cache()


def plain(rows):
    return [dict(zip(("doc_id", "text", "lang", "source"), r)) for r in rows]


def test_line_dedup(frame, odd):
    want = brute.op11(plain(odd))
    got = line_dedup(frame).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got) == Counter(want)
    assert sum(r["n_dropped"] > 0 for r in got) > 20
    digests = with_line_digest(line_dedup(frame)).collect()
    assert Counter((r["doc_id"], r["kept_sha256"]) for r in digests) == Counter((w[0], brute.sha(w[3])) for w in want)


@pytest.mark.parametrize("least,documents", [(1, 2), (10, 3), (0, 5)])
def test_line_dedup_bounds(frame, odd, least, documents):
    got = line_dedup(frame, least=least, documents=documents).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got) == Counter(brute.op11(plain(odd), least, documents))


def test_line_dedup_keeps_rows_and_columns(spark, frame, odd):
    out = drop_common_lines(frame)
    assert out.columns == frame.columns
    want = Counter((r[0], t, r[2], r[3], "dotted") for r, (_, _, _, t) in zip(odd, brute.op11(plain(odd))))
    assert Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["a.b"]) for r in out.collect()) == want
    assert line_dedup(frame.limit(0)).count() == 0 and drop_common_lines(frame.limit(0)).count() == 0
    other = spark.createDataFrame([("b", "the same line"), ("a", "the same line")], "name string, body string")
    assert {r["name"]: r["body"] for r in drop_common_lines(other, "name", "body").collect()} == {"a": "the same line", "b": ""}
    assert common_lines(other, "name", "body").first()["n_documents"] == 2


def test_line_dedup_is_native(frame):
    plan = line_dedup(frame)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def found(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_divergence(frame, odd, docs, rows):
    assert found(source_divergence(frame)) == Counter(brute.op12(plain(odd)))
    assert found(source_divergence(docs)) == Counter(brute.op12(rows))
    assert found(source_divergence(frame, least_docs=1, top=3)) == Counter(brute.op12(plain(odd), 1, 3))
    assert source_divergence(frame.limit(0)).count() == 0


def test_divergence_of_many_blocks_and_tiles(monkeypatch, docs, rows):
    monkeypatch.setattr(divergence, "LEAST_ENTRIES", 5)
    assert found(source_divergence(docs, most_entries=40, tile=2)) == Counter(brute.op12(rows))


def test_held_counts_are_handed_on(monkeypatch, docs, rows):
    monkeypatch.setattr(divergence, "HELD", 10)
    part = pa.RecordBatch.from_pylist([{"lang": r["lang"] or "", "source": r["source"] or "", "text": r["text"]} for r in rows])
    held, out = divergence._Counts(), Counter()
    for k in range(0, part.num_rows, 7):
        held.add(part.slice(k, 7))
        if held.many():
            for b in held.batches():
                for x in b.to_pylist():
                    out[x["lang"], x["source"], x["term"]] += x["n"]
            assert not held.terms and not held.parts
    for b in held.batches():
        for x in b.to_pylist():
            out[x["lang"], x["source"], x["term"]] += x["n"]
    want = Counter()
    for r in rows:
        want.update((r["lang"] or "", r["source"] or "", t.translate(brute.UPPER)) for t in brute.TERM.findall(r["text"] or ""))
    assert {k: n for k, n in out.items() if k[2] is not None} == dict(want)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("abAZz 09_-.éß日\U0001f600@[`{\x7f\x80\n"), max_size=60)), max_size=8))
def test_terms_are_those_of_the_pattern(texts):
    data, starts, stops, text = term_slices(pa.array(texts, pa.string()))
    terms, which = distinct_terms(data, starts, stops)
    got = [[] for _ in texts]
    for k, t in zip(which.tolist(), text.tolist()):
        got[t].append(terms[k].decode())
    assert got == [[m.translate(brute.UPPER) for m in brute.TERM.findall(t or "")] for t in texts]
    assert len(set(terms)) == len(terms)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 31), st.binary(min_size=93, max_size=93))
def test_hash_is_xxhash(width, data):
    rows = np.frombuffer(data, dtype=np.uint8)[: 3 * width].reshape(3, width)
    assert xx64(rows).tolist() == [xxhash.xxh64_intdigest(r.tobytes()) for r in rows]


def test_equal_hashes_do_not_join_terms(monkeypatch):
    monkeypatch.setattr(divergence, "xx64", lambda rows: np.zeros(len(rows), dtype=np.uint64))
    monkeypatch.setattr(divergence.xxhash, "xxh64_intdigest", lambda term: 1)
    words = ["ab", "cd", "ab", "x" * 40, "y" * 40, "x" * 40, "abc"]
    data, starts, stops, _ = term_slices(pa.array([" ".join(words)]))
    terms, which = distinct_terms(data, starts, stops)
    assert [terms[k].decode() for k in which] == words and len(terms) == 5


def test_weights_are_exact():
    r = random.Random(8)
    for _ in range(300):
        whole = r.randint(1, 9 * 10**15)
        n = r.randint(0, whole - 1)
        assert divergence.weights(np.array([n]), np.array([whole]))[0] == 1 + 10**9 * (n + 1) // whole


VECTORS = "vec_id long, label int, embedding array<double>, row long, v int, copy string, pivot int, item int"


def vectors(n, width=6, seed=9, labels=4, spread=0.2):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(7, width))
    rows = [(k, int(r.integers(labels)), (centres[k % 7] + spread * r.normal(size=width)).tolist()) for k in range(n)]
    rows += [(n + k, k % 3, rows[5][2]) for k in range(80)]  # one vector of a tenth of the rows, under several labels
    rows += [(None, 1, [1.0] * width), (n + 90, None, [1.0] * width), (n + 91, 1, None), (n + 92, 1, []), (n + 93, 1, [float("nan")] * width), (n + 94, 1, [float("inf")] * width)]
    rows += [(n + 95, 1, [None] * width), (n + 96, 0, [0.5]), (200, 1, rows[5][2]), (200, 1, rows[5][2]), (300, 2, [0.0] * width), (400, 99, [1.0] * width)]
    return [(*x, 1, 2, "c", 3, 4) for x in rows]


def result(df):
    return Counter((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


@pytest.mark.parametrize("sample", [4096, 64])
def test_hard_negatives(spark, monkeypatch, sample):
    monkeypatch.setattr(hard_negatives, "SAMPLE", sample)
    rows = vectors(700)
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    want = brute.op13([r[:3] for r in rows])
    assert result(mine(df, F.col("vec_id") % 100 == 0, F.col("label"))) == want and len(want) > 100


def test_hard_negatives_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 3)
    monkeypatch.setattr(hard_negatives, "HELD", 5)
    monkeypatch.setattr(hard_negatives, "RUN", 16)
    rows = vectors(700, seed=3)
    df = spark.createDataFrame(rows, VECTORS)
    assert result(mine(df, F.col("vec_id") % 100 == 0, F.col("label"))) == brute.op13([r[:3] for r in rows])
    assert mine(df.limit(0), F.col("vec_id") % 100 == 0, F.col("label")).count() == 0
    assert mine(df, F.lit(False), F.col("label")).count() == 0
    assert mine(df.filter("label = 1"), F.col("vec_id") % 100 == 0, F.col("label")).count() == 0


def test_text_labels(spark):
    rows = [(k, f"l{x[1]}", x[2]) for k, x in enumerate(vectors(300)) if x[0] is not None]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    assert result(mine(df, F.col("vec_id") % 100 == 0, F.col("label"))) == brute.op13(rows)


def test_key_intervals_leave_pairs_out(spark, monkeypatch):
    """Of well separated groups most rows lie outside every shell's key intervals."""
    monkeypatch.setattr(hard_negatives, "RUN", 64)
    monkeypatch.setattr(hard_negatives, "SAMPLE", 512)
    r = np.random.default_rng(1)
    centres = 4 * np.eye(24)
    rows = [(k, int(r.integers(3)), (centres[k % 24] + 0.02 * r.normal(size=24)).tolist()) for k in range(9600)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(4)
    pairs = spark.sparkContext.accumulator(0)
    got = mine(df, F.col("vec_id") % 100 == 0, F.col("label"), least_percent=50, most_percent=100, pairs=pairs)
    want = brute.op13(rows, low=50, high=100)
    assert result(got) == want and len(want) == 96 * 50
    assert pairs.value < 0.35 * 2 * 96 * 9600  # two searches


def test_shares_round_outwards():
    for s in [*range(-250, 250), 2**62 + 7, -(2**62) - 7]:
        for percent in (30, 90, 100, 7):
            assert share(np.array([s]), percent, True)[0] == -(-percent * s // 100) and share(np.array([s]), percent, False)[0] == percent * s // 100
