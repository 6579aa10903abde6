"""Missing and repeated ids, clashing column names, increments, many languages: against plain Python."""

import math
import random
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prismflow.llm.common import hashed_words
from prismflow.llm.exact_dedup import drop_exact_duplicates
from prismflow.llm.language_id import _slot_bits, evidence, identify, keep_identified, page_text, train_text_model, trigram_slots
from prismflow.llm.mixing import mix_sources, mixed_documents
from prismflow.llm.near_dedup import drop_near_duplicates, near_groups
from prismflow.llm.packing import pack_documents, with_crc
from prismflow.llm.substring_dedup import FingerprintIndex, dedup_increment, substring_dedup, with_digest
from prismflow.llm.token_counts import TokenRollup, corpus_token_counts, counted
from prismflow.llm.token_store import store_and_read
from prismflow.llm.tokens import Encoder, tokenizer_path
from prismflow.llm.topk import exact_top_k

SCHEMA = "doc_id long, text string, lang string, source string, `__digest` string, `__gone` long, `__k` int, `__id` long, `a.b` string, tag string, h long, node string"


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, one id with several texts, rows that repeat id and text, columns with names that operators might take."""
    r = random.Random(11)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7))) for _ in range(200)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = say(100)
    near = [" ".join(w if k not in (3 * j, 3 * j + 1) else "changed" for k, w in enumerate(base.split())) for j in range(6)]
    rows = [(None, base), (None, near[0]), (None, near[0]), (4, near[1]), (4, near[2]), (4, near[2]), (2, near[3]), (9, base), (None, None), (None, ""), (5, None), (5, " "), (6, "one"), (6, "two")]
    rows += [(20 + k % 5, say(r.randint(1, 60))) for k in range(20)] + [(None, say(r.randint(1, 60))) for _ in range(8)] + [(7, "same words here")] * 6 + [(None, "same words there")] * 5
    return [(i, t, ("en", "de", None)[k % 3], f"s{k % 2}", "x", k, 5, k, "dotted", None, k, "n") for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def frame(spark, odd):
    return spark.createDataFrame(odd, SCHEMA).repartition(3).cache()


def keyed(rows):
    """Rows as documents of their own ids."""
    return [{"doc_id": k, "text": r[1], "source": r[3]} for k, r in enumerate(rows)]


def test_exact_dedup_rows(frame, odd):
    left = drop_exact_duplicates(frame)
    assert left.columns == frame.columns
    best = {}
    for r in odd:
        key = brute.WS.sub(" ", r[1] or "")
        best[key] = min(best.get(key, (True, 0)), (r[0] is None, r[0] or 0))
    got = {brute.WS.sub(" ", r["text"] or ""): (r["doc_id"] is None, r["doc_id"] or 0) for r in left.collect()}
    assert got == best and left.count() == len(best)
    assert {(r["__digest"], r["__k"], r["a.b"]) for r in left.collect()} == {("x", 5, "dotted")}


def test_near_groups_rows(frame, odd):
    """Components over rows, each named by the smallest id in it."""
    parts = brute.op6(keyed(odd), width=4)
    ids = defaultdict(list)
    for k, (_, component, _) in parts.items():
        ids[component].append(odd[k][0])
    want = Counter((odd[k][0], parts[k][0], min((i for i in ids[parts[k][1]] if i is not None), default=None)) for k in parts)
    got = near_groups(frame, width=4).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    left = drop_near_duplicates(drop_exact_duplicates(frame), width=4)
    assert left.columns == frame.columns
    texts = {brute.WS.sub(" ", r[1] or "") for r in odd}
    groups = brute.op6([{"doc_id": k, "text": t} for k, t in enumerate(sorted(texts))], width=4)
    assert left.count() == sum(v[2] for v in groups.values())


def test_substring_rows(frame, odd):
    want = brute.op2(keyed(odd), width=8)
    got = with_digest(substring_dedup(frame, width=8)).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == Counter((odd[k][0], *v) for k, v in want.items())


def test_mixing_rows(spark, frame, odd):
    out = mixed_documents(frame, mix_sources(frame))
    assert out.columns == frame.columns
    size, target = brute.op7_targets(keyed(odd))
    rows = out.collect()
    for s in size:
        assert abs(sum(len(brute.WORD.findall(r["text"] or "")) for r in rows if r["source"] == s) - target[s]) <= 1
    assert {(r["__digest"], r["__k"]) for r in rows} == {("x", 5)}


def test_packing_and_store_rows(frame, odd):
    pieces = with_crc(pack_documents(frame, tokenizer_path())).collect()
    ids = brute.token_ids(keyed(odd), tokenizer_path(), 0)
    assert sum(p["length"] for p in pieces) == sum(map(len, ids.values()))
    stored = store_and_read(frame, tokenizer_path()).collect()
    assert sorted(r["n_tokens"] for r in stored) == sorted(map(len, ids.values()))
    at = 0
    for r in sorted(stored, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]


def test_language_rows(frame):
    kept = keep_identified(frame)
    assert kept.columns == frame.columns and kept.count() <= frame.count()


def test_top_k_of_repeated_ids(spark):
    vectors = [(100, [1.0, 0.0]), (100, [0.5, 0.5]), (3, [1.0, 1.0]), (3, [1.0, 1.0]), (7, [0.0, 2.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = Counter((r["query_id"], r["vec_id"], r["score"]) for r in exact_top_k(df, F.col("vec_id") % 100 == 0).collect())
    whole, want = [(k, [int(1024 * x) for x in v]) for k, v in vectors], Counter()
    for i, (q, a) in enumerate(whole):
        for j, (c, b) in enumerate(whole):
            if q % 100 == 0 and i != j:
                want[q, c, sum(x * y for x, y in zip(a, b))] += 1
    assert got == want


def test_token_counts_against_brute_force(spark, frame, docs, rows, odd):
    tables = [(docs, [(r["doc_id"], r["text"], r["source"], r["lang"]) for r in rows]), (frame, [(r[0], r[1], r[3], r[2]) for r in odd])]
    for table, plain in tables:
        ids = brute.token_ids([{"doc_id": k, "text": r[1]} for k, r in enumerate(plain)], tokenizer_path(), 0)
        want = defaultdict(lambda: [0, 0])
        for k, r in enumerate(plain):
            want[r[2], r[3]][0] += 1
            want[r[2], r[3]][1] += len(ids[k]) - 1
        got = {(r["source"], r["lang"]): [r["n_docs"], r["n_tokens"]] for r in corpus_token_counts(table, tokenizer_path(), "v").collect()}
        assert got == dict(want)
    assert corpus_token_counts(docs.limit(0), tokenizer_path(), "v").count() == 0


def test_rollup_of_documents_without_id(spark):
    df = lambda r: spark.createDataFrame(r, "doc_id long, text string, source string, lang string")
    rollup = TokenRollup(spark, lambda d: counted(d, tokenizer_path(), "v1"), "v1")
    totals = lambda: {(r[0], r[1]): (r[3], r[4]) for r in rollup.totals().collect()}
    rollup.commit("b1", df([(None, "a b", "s", "en"), (None, "a b", "s", "en"), (None, "c", "t", "en"), (1, "d e", "s", "de"), (1, "f", "t", "de")]))
    assert totals() == {("s", "en"): (2, 4), ("t", "en"): (1, 1), ("s", "de"): (1, 2), ("t", "de"): (1, 1)}
    rollup.commit("b2", df([(None, "c", "t", "en"), (1, "g", "s", "de")]), df([(None, "a b", "", "")]))
    assert totals() == {("t", "en"): (1, 1), ("s", "de"): (1, 1)}


def test_increments_over_sessions(spark, tmp_path):
    """A later session goes on with the index; its hits alone decide what is verified."""
    r = random.Random(3)
    say = lambda n: " ".join(f"w{r.randrange(400)}" for _ in range(n))
    passage, other = say(40), say(40)
    first = [(1, f"{say(20)} {passage}"), (2, say(50)), (3, None)]
    second = [(4, f"{passage} {say(10)}"), (5, say(30)), (6, f"{other} x {other}")]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    folder = str(tmp_path / "index")
    index = FingerprintIndex(spark, 12, folder)
    one = {x["doc_id"]: x["n_removed"] for x in dedup_increment(index, frame(first), None, "one").collect()}
    assert one == {1: 0, 2: 0, 3: 0}
    later = FingerprintIndex(spark.newSession(), 12, folder)
    assert len(later.runs) == 1 and later.hits().count() == 0
    got = {x["doc_id"]: (x["n_words"], x["n_removed"]) for x in dedup_increment(later, frame(second), frame(first), "two").collect()}
    whole = brute.op2([{"doc_id": k, "text": t} for k, t in first + second], 12)
    assert got == {k: whole[k][:2] for k in (4, 5, 6)} and got[4][1] >= 40
    assert len(later.runs) == 1 and later.repeated().count() == later.hits().distinct().count() > 0
    hits = later.hits(["two"]).count()
    assert later.add(frame(second), "two").count() == hits and len(later.runs) == 1  # the batch is known
    with pytest.raises(ValueError):
        FingerprintIndex(spark, 13, folder)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("prismflow_run_")]


def test_hits_decide_what_is_verified(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "a b c d e f g h i j")], "doc_id long, text string")
    assert {r["n_removed"] for r in substring_dedup(docs, width=5).collect()} == {10}
    monkeypatch.setattr(FingerprintIndex, "hits", lambda self, batch_ids=None: self.spark.createDataFrame([], "anchor long"))
    assert {r["n_removed"] for r in substring_dedup(docs, width=5).collect()} == {0}


def test_many_languages(spark):
    r = random.Random(2)
    rows = []
    for k in range(100):
        letters = r.sample("abcdefghijklmnopqrstuvwxyz", 6)
        rows += [(100 * k + j, " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(60)), f"l{k}", f"h{k}") for j in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = train_text_model(docs)
    assert len(model.languages) == 100 and model.logs.nbytes <= 33 << 20
    found = identify(evidence(docs, "d", F.col("doc_id"), F.col("text"), F.col("lang"), F.col("source")), model).collect()
    lang = {r[0]: r[2] for r in rows}
    assert sum(x["language"] == lang[x["id"]] for x in found) >= 0.97 * len(rows)
    assert [_slot_bits(n) for n in (1, 255, 1000, 100_000)] == [15, 15, 13, 10]


def test_posteriors_by_hand(spark):
    """Every posterior, recomputed in plain Python from the model's own text scores."""
    words = {"en": "the water that they thought this", "fr": "les eaux que nous pensions cela"}
    r = random.Random(4)
    rows = [(k, " ".join(r.choice(words[g].split()) for _ in range(r.choice([0, 1, 2, 8]))), (g, None)[k % 7 == 0], f"www.{g if k % 5 else 'en'}{k % 3}.example.com") for k, g in enumerate(["en", "fr"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = train_text_model(docs)
    got = {x["id"]: x for x in identify(evidence(docs, "d", F.col("doc_id"), F.col("text"), F.col("lang"), F.col("source")), model).collect()}
    names, logs, votes = [*model.languages, "und"], {}, {}
    for k, text, _, _ in rows:
        slots, _ = trigram_slots(pa.array([text]))
        logs[k] = model.logs[:, slots].sum(axis=1, dtype=float) / 3
        logs[k] -= logs[k].max()
        p = np.exp(logs[k]) / np.exp(logs[k]).sum()
        votes[k] = int(p.argmax()) if p.max() >= 0.95 else None
    n = len(names)
    tally = lambda keep: np.array([float(sum(votes[r[0]] == j and keep(r) for r in rows)) for j in range(n)])
    sums = tally(lambda r: True) + 1
    value = {"declared": lambda r: r[2] or "none", "suffix": lambda r: "com"}
    for row in rows:
        k, total = row[0], logs[row[0]].copy()
        own = np.array([float(votes[k] == j) for j in range(n)])
        smooth = lambda v, prior: (v + 10.0 * prior) / (v.sum() + 10.0)
        prior = smooth(tally(lambda x: x[3] == row[3]) - own, smooth(tally(lambda x: True) - own, sums / sums.sum()))
        total += np.log(prior)
        for name, of in value.items():
            counts = {v: tally(lambda x, v=v: of(x) == v) for v in {of(x) for x in rows}}
            rare = [c for c in counts.values() if 0 < c.sum() < 20]
            mine = counts[of(row)] if counts[of(row)].sum() >= 20 else (sum(rare) / len(rare) if rare else np.zeros(n))
            total += np.log((mine + 0.5) / (sums + 20.0))
        p = np.exp(total - total.max())
        p /= p.sum()
        assert math.isclose(p.max(), got[k]["posterior"], abs_tol=2e-6) and (names[int(p.argmax())] == got[k]["language"] or sorted(p)[-1] - sorted(p)[-2] < 1e-9)


def test_pages_keep_their_characters(spark):
    html = "<p>caf&eacute; &amp; th&#233;&acirc;tre</p><script>var x</script>"
    page = spark.createDataFrame([(1, html)], "id long, html string")
    assert page.select(page_text(F.col("html")).alias("t")).first()["t"].strip() == "caf&eacute; &amp; th&#233;&acirc;tre"
    from prismflow.llm.language_id import _decoded

    part = pa.RecordBatch.from_arrays([pa.array(["page", "document"]), pa.array(["caf&eacute; &amp;", "a &amp; b"])], names=["kind", "text"])
    assert _decoded(part).to_pylist() == ["café &", "a &amp; b"]


def test_word_hashes():
    r = random.Random(1)
    texts = [None, "", "x" * 300_000, "y z " * 50_000, *("".join(r.choice("ab \t\né\x0b\x1c\x85") for _ in range(40)) for _ in range(50))]
    hashes, counts = hashed_words(pa.array(texts))
    words = [w for t in texts for w in (t or "").encode().split()]
    by = defaultdict(set)
    for w, h in zip(words, hashes.tolist()):
        by[w].add(h)
    assert counts.tolist() == [len((t or "").encode().split()) for t in texts]
    assert all(len(h) == 1 for h in by.values()) and len(set().union(*by.values())) == len(by)
    assert (hashed_words(pa.array(["Ab ÄB"]), True)[0] == hashed_words(pa.array(["aB ÄB"]), True)[0]).all()


def test_other_tokenizers_are_used_as_they_are(tmp_path):
    import json

    from tokenizers import Tokenizer

    parts = json.loads(open(tokenizer_path()).read())
    parts["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "t.json"
    path.write_text(json.dumps(parts))
    texts = ["a b", "word", "", " x"]
    want = [e.ids for e in Tokenizer.from_file(str(path)).encode_batch(texts, add_special_tokens=False)]
    assert Encoder(str(path))(pa.array(texts), 9)[0].tolist() == [i for w in want for i in [*w, 9]]
