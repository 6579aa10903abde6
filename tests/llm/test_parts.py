"""Parts of the operators that run inside tasks."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from prismflow.llm import simple8b
from prismflow.llm.common import rolled
from prismflow.llm.components import components
from prismflow.llm.near_dedup import PERMS, fewest, linked
from prismflow.llm.packing import pack, step_groups
from prismflow.llm.tokens import encoder, tokenizer_path


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=3000))
def test_simple8b_round_trip(values):
    ids = np.array(values, dtype=np.uint64)
    data = simple8b.encode(ids)
    assert (simple8b.decode(data) == ids).all()
    for k in range(0, -(-len(ids) // simple8b.BLOCK)):
        assert (simple8b.decode_block(data, k) == ids[k * simple8b.BLOCK :][: simple8b.BLOCK]).all()


def test_simple8b_rejects_other_data():
    with pytest.raises(ValueError):
        simple8b.decode(b"\0" * 64)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab .,'\n\t   é😀st<|endoftext|>"), max_size=40), max_size=20))
def test_encoder_equals_library(texts):
    want = [i for e in Tokenizer.from_file(tokenizer_path()).encode_batch(texts, add_special_tokens=False) for i in [*e.ids, 7]]
    ids, counts = encoder(tokenizer_path())(pa.array(texts, pa.string()), 7)
    assert ids.tolist() == want and counts.sum() == len(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5000), min_size=1, max_size=60))
def test_packing_covers_all(lengths):
    lengths = np.array(lengths)
    seen = [np.zeros(n, dtype=int) for n in lengths]
    windows = pack(lengths)
    for size, pieces in windows:
        assert sum(p[2] for p in pieces) == size <= 1024 and size & (size - 1) == 0
        for d, s, n in pieces:
            seen[d][s : s + n] += 1
    assert all((x == 1).all() for x in seen)
    assert len(step_groups(windows)) == len(windows)


def test_step_groups_are_balanced():
    windows = pack(np.random.default_rng(0).integers(1, 3000, 2000))
    groups, cost = step_groups(windows, 1 << 16), {}
    for g, (size, pieces) in zip(groups, windows):
        if size == 1024:
            cost.setdefault(g, []).append(sum(p[2] ** 2 for p in pieces))
    sizes, sums = [len(c) for c in cost.values()], [sum(c) for c in cost.values()]
    assert max(sizes) - min(sizes) <= 1 and max(sums) < 1.2 * min(sums)


def test_rolled_tells_runs_apart():
    w = np.random.default_rng(1).integers(0, 3, 500).astype(np.uint64)
    for width in (1, 4, 5, 8, 35):
        by = {}
        for k, h in enumerate(rolled(w, width, 3).tolist()):
            by.setdefault(tuple(w[k : k + width]), set()).add(h)
        assert all(len(h) == 1 for h in by.values()) and len(set().union(*by.values())) == len(by)


def test_bounds_keep_true_pairs():
    r = np.random.default_rng(2)
    least = fewest(0.8)
    equal = (r.random((20_000, PERMS)) < 0.8).reshape(20_000, len(least), -1).sum(axis=2).cumsum(axis=1)
    assert (equal >= np.array(least)).all()
    assert least[-1] > 0.5 * PERMS


def test_linked():
    a = np.arange(10, dtype=np.uint64)
    assert linked(a, a[:8], 80) and not linked(a, a[:7], 80)


def test_components(spark):
    edges = [(k, k + 1) for k in range(100, 200)] + [(5, 5), (7, 3), (3, 7), (9, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 201)} | {3: 3, 7: 3, 9: 3}


def test_hashes_of_strings():
    import random

    import xxhash

    from prismflow.llm.xx import string_hashes

    r = random.Random(1)
    words = ["".join(r.choice("abcé日x") for _ in range(r.choice([0, 1, 3, 7, 8, 9, 12, 15, 16, 31, 32, 33, 50]))) for _ in range(3000)]
    some = pa.array(words, pa.large_string()).slice(3, 2500)
    assert string_hashes(some).tolist() == [xxhash.xxh64_intdigest(w.encode()) for w in words[3:2503]]
    assert string_hashes(pa.array([], pa.large_string())).tolist() == []


@pytest.mark.parametrize("collide", [False, True])
def test_encoder_keeps_and_drops_words(monkeypatch, collide):
    """Small stores, and hashes that say nothing: the ids are those of the library."""
    import random

    from prismflow.llm import tokens
    from prismflow.llm.tokens import Encoder

    if collide:
        monkeypatch.setattr(tokens, "string_hashes", lambda words: np.arange(len(words), dtype=np.uint64) % np.uint64(3))
    r = random.Random(2)
    encode, library = Encoder(tokenizer_path(), most=50), Tokenizer.from_file(tokenizer_path())
    for _ in range(25):
        texts = [" ".join("".join(r.choice("abcdeé日 \x1c\x85.,") for _ in range(r.randint(1, 4))) for _ in range(r.randint(0, 60))) for _ in range(5)] + [None, "", " lead", "\ttab a"]
        want = [i for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False) for i in [*e.ids, 9]]
        assert encode(pa.array(texts), 9)[0].tolist() == want
    assert encode.n <= 400 and len(encode.hashes) == len(encode.code_of) == encode.n == len(encode.words)
