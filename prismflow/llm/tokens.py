"""Token ids of whole texts by the tokenizers library, and packing, counting and storing them."""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from prismflow.llm.common import _text_bytes
from prismflow.llm.xx import string_hashes

#: A space that a pre-token of the byte-level pattern does not begin with: white space or the end follows.
_ODD_SPACE = r" ([\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|$)"


_NOTHING, _SPACE = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
#: Text encoded at once; more at once means fewer distinct pieces to look up.
TOKEN_BYTES = 3_000_000


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The file of a public tokenizer; pass another path where it lies elsewhere."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _splits_at_spaces(path: str) -> bool:
    """Whether a tokenizer file is a byte-level BPE whose pattern puts a space before the word that follows it."""
    import json

    with open(path) as f:
        parts = json.load(f)
    first = parts.get("pre_tokenizer") or {}
    plain = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space")
    return bool(plain and parts["model"]["type"] == "BPE" and not parts["model"].get("dropout") and not parts.get("normalizer"))


_BLANK = np.array([chr(k).isspace() for k in range(128)] + [False] * 128)


def _visible(words: pa.LargeStringArray) -> np.ndarray:
    """Which words are not empty and do not begin with white space."""
    raw, ends = _text_bytes(words)
    out = np.diff(ends) > 0
    first = raw[ends[:-1][out]]
    out[out] = ~_BLANK[first]
    for k in np.flatnonzero(out)[first[~_BLANK[first]] > 127].tolist():
        out[k] = not words[k].as_py()[0].isspace()
    return out


class Encoder:
    """Ids of many texts at once by a byte-level BPE of the tokenizers library.

    In such a tokenizer a single space before a visible character always begins a pre-token, so the ids
    of a text are those of its pieces cut there. Each distinct piece is encoded once by the library and
    kept; at a fixed size half of the store is dropped. Texts where a space is followed by white space or by the
    end are encoded whole, and so are all texts where the file's tokenizer is not such a one.
    """

    def __init__(self, path: str, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.by_piece = _splits_at_spaces(path)
        if self.by_piece:
            self.tokenizer.model._resize_cache(0)  # pieces are kept here
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size()
        self.begins = np.zeros(size, dtype=bool)  # tokens that begin with a space
        self.begins[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True
        self.words = pa.array([], pa.large_string())  # by code
        self.hashes, self.code_of = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)  # by hash
        self.flat, self.used = np.zeros(1 << 16, dtype=np.uint32), 0
        self.starts, self.sizes = np.zeros(1 << 14, dtype=np.int32), np.zeros(1 << 14, dtype=np.int32)
        self.n = 0

    def _append(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Give the next codes to pieces of these ids."""
        total, n = len(ids), len(sizes)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + n > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.flat[self.used : self.used + total] = ids
        self.starts[self.n : self.n + n] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.n : self.n + n] = sizes
        self.used, self.n = self.used + total, self.n + n

    def _known(self, words: pa.LargeStringArray, hashes: np.ndarray) -> np.ndarray:
        """Codes of words, found by hash and confirmed by their bytes; -1 for those that are not kept."""
        out = np.full(len(words), -1, dtype=np.int32)
        at = np.searchsorted(self.hashes, hashes)
        found = np.flatnonzero(at < len(self.hashes))
        found = found[self.hashes[at[found]] == hashes[found]]
        codes = self.code_of[at[found]]
        same = pc.equal(words.take(pa.array(found)), self.words.take(pa.array(codes))).to_numpy(zero_copy_only=False)
        out[found[same]] = codes[same]
        return out

    def _keep(self, words: pa.LargeStringArray, hashes: np.ndarray, first: int) -> None:
        """Keep words under the codes from `first` on, which are the next."""
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes = np.insert(self.hashes, at, hashes[order])
        self.code_of = np.insert(self.code_of, at, (first + order).astype(np.int32))
        self.words = pa.concat_arrays([self.words, words])

    def _words(self, words: list[str]) -> None:
        """Encode words that follow a space, many in one text: each begins at a token that begins with a space."""
        for k in range(0, len(words), 500):
            text = " " + " ".join(words[k : k + 500])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
            firsts = np.flatnonzero(self.begins[ids])
            self._append(ids, np.diff(firsts, append=len(ids)))

    def _whole(self, texts: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        self._append(np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=int(sizes.sum())), sizes)

    def _library(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        end = [] if end_id is None else [end_id]
        found = [e.ids + end for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=int(sizes.sum())), sizes

    def _shrink(self) -> None:
        """Keep the half of the pieces that came first: common ones come early."""
        n = self.n // 2
        stay = self.code_of < n
        self.hashes, self.code_of, self.words = self.hashes[stay], self.code_of[stay], self.words.slice(0, n)
        self.n, self.used = n, int(self.starts[n])

    def __call__(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (null: empty), each with end_id after it; and their numbers."""
        if self.n > self.most:
            self._shrink()
        texts = texts.fill_null("").cast(pa.large_string())
        if not self.by_piece:
            return self._library(texts, end_id)
        odd = pc.match_substring_regex(texts, _ODD_SPACE)
        for token in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        # one more piece after each text stands for its end; it and the first piece get codes of their own
        pieces = pc.split_pattern(pc.binary_join_element_wise(pc.if_else(odd, "", texts), _NOTHING, _SPACE), " ")
        offsets = pieces.offsets.to_numpy()
        last = offsets[1:] - offsets[0] - 1
        firsts = np.concatenate([[0], last[:-1] + 1]).astype(np.int64) if len(last) else last
        values = pieces.flatten()
        words = values.dictionary_encode()
        hashes = string_hashes(words.dictionary)
        known = self._known(words.dictionary, hashes)
        # first pieces may begin with white space; they are encoded below, not as words
        new = np.flatnonzero(known < 0)
        new = new[_visible(words.dictionary.take(pa.array(new)))]
        fresh, first_new = words.dictionary.take(pa.array(new)), self.n
        self._words(fresh.to_pylist())
        known[new] = np.arange(first_new, self.n)
        self._keep(fresh, hashes[new], first_new)
        kept, kept_used = self.n, self.used
        self._whole(pc.if_else(odd, texts, values.take(pa.array(firsts))).to_pylist())
        end = 0 if end_id is None else 1
        self._append(np.full(end, end_id or 0, dtype=np.uint32), np.array([end]))
        codes = known[words.indices.to_numpy()]
        codes[firsts], codes[last] = kept + np.arange(len(last)), self.n - 1
        sizes = self.sizes[codes]
        running = np.cumsum(sizes, dtype=np.int32)
        source = np.repeat(self.starts[codes] - (running - sizes), sizes)
        source += np.arange(len(source), dtype=np.int32)
        self.n, self.used = kept, kept_used  # heads and the end are not kept
        return self.flat[source], np.diff(running[last], prepend=0).astype(np.int64)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer file; a reused Python worker keeps what it has encoded."""
    return Encoder(path)
