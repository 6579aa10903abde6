"""Source divergence audit: how the terms of each source of a language differ from other sources' and from the language's.

Terms are runs of ASCII letters and of anything beyond ASCII, A-Z lower-cased. A language keeps the terms of
at least `least_docs` of its documents: V terms. A group (language, source) and a language as a whole give a
kept term of count c the weight p = 1 + floor(UNIT * (c + 1) / (N + V)), N being the sum of their counts; the
divergence of p from q at a term is floor((p - q)^2 / q). All of it is integer arithmetic.

Tokenizer, inside tasks: the UTF-8 buffers of a batch's texts are one byte array, a table of 256 flags marks the
bytes of terms, and where flags change terms begin and end. The slices of one length are hashed by xxHash64
over 8-byte lanes, grouped by hash, and every slice is compared byte by byte with its group's first; only if
that fails are they grouped by their bytes. Tasks add up counts and document counts by (language, source, term)
and hand on bounded tables of them.

Divergences, inside tasks: the counts of a language are cut by a hash of the term into blocks of a bounded number
of entries, each a compressed sparse matrix of sources by terms. For each source as q, the entries of all
sources are compared with a dense row of q, summed by row with reduceat, and terms that a row lacks are added
from its one weight of absent terms; so work grows with entries times sources, not with sources squared times
terms. Sources, as q, come in tiles of a bounded number. A group's leading terms are cut to the rank asked for in
each block before they are ranked over blocks.

Defined results: null text, language and source count as empty strings. Rows are documents whatever their ids, so
repeated rows count as often as they come. A group without kept terms, and a language without any, have their
rows in part `pair` and none in part `term`; the only source of a language has no `pair`. Equal values are
ranked by the item's UTF-8 bytes. Other columns are ignored, whatever their names; an empty table gives an empty
result. Counts of a group may reach 9e15 and kept terms of a language 2e9. Memory of a task: a few times its
longest text, or one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismflow.llm.common import _text_bytes, in_batches, materialize, slices
from prismflow.llm.xx import xx64

#: What the weights of a group add up to, apart from one for each term.
UNIT_THOUSANDS = 3
#: Entries of a block at least and at most; sources of a tile; term counts that a task holds before it hands them on.
LEAST_ENTRIES, MOST_ENTRIES, TILE, HELD = 20_000, 500_000, 256, 400_000

_IN_TERM = np.zeros(256, dtype=bool)
_IN_TERM[65:91] = _IN_TERM[97:123] = _IN_TERM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def term_slices(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes of all texts, and of each term its begin, its end and its text's number."""
    raw, ends = _text_bytes(texts)
    inside = _IN_TERM[raw]
    if not len(raw):
        return raw, *[np.zeros(0, dtype=np.int64)] * 3
    cut = np.zeros(len(raw) + 1, dtype=bool)
    cut[ends] = True  # a term does not reach into the next text
    start, stop = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:-1]
    stop[:-1] &= ~inside[1:] | cut[1:-1]
    starts = np.flatnonzero(start)
    return _LOWER[raw], starts, np.flatnonzero(stop) + 1, np.searchsorted(ends, starts, side="right") - 1


def _same_bytes(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First member and group number of rows that are equal, found by hash and confirmed by bytes."""
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    if (rows == rows[first[group]]).all():
        return first, group
    _, first, group = np.unique(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}")[:, 0], return_index=True, return_inverse=True)
    return first, group


def distinct_terms(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Different terms, and for each slice the number of its term."""
    sizes, which, terms = stops - starts, np.zeros(len(starts), dtype=np.int64), []
    order = np.argsort(sizes, kind="stable")
    bounds = np.flatnonzero(np.diff(sizes[order], prepend=-1))
    for lo, hi in zip(bounds, [*bounds[1:], len(order)]):
        at, width = order[lo:hi], int(sizes[order[lo]])
        if width < 32:
            rows = data[starts[at][:, None] + np.arange(width)]
            first, group = _same_bytes(rows, xx64(rows))
            which[at] = group + len(terms)
            terms += [rows[k].tobytes() for k in first]
            continue
        known: dict[int, list[int]] = {}
        for k in at.tolist():
            term = data[starts[k] : stops[k]].tobytes()
            same = known.setdefault(xxhash.xxh64_intdigest(term), [])
            number = next((t for t in same if terms[t] == term), None)
            if number is None:
                number = len(terms)
                same.append(number)
                terms.append(term)
            which[k] = number
    return terms, which


def _summed(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Different keys in order, and the sum of each value over each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.diff(keys, prepend=-1))
    return [keys[at], *(np.add.reduceat(v[order], at) if len(at) else v for v in values)]


class _Counts:
    """Counts of terms by group that a task has read, added up until they are many."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.terms: dict[bytes, int] = {}
        self.parts: list[list[np.ndarray]] = []

    def add(self, part: pa.RecordBatch) -> None:
        pairs = zip(part.column("lang").to_pylist(), part.column("source").to_pylist())
        group = np.array([self.groups.setdefault(p, len(self.groups)) for p in pairs], dtype=np.int64)
        data, starts, stops, text = term_slices(part.column("text"))
        terms, which = distinct_terms(data, starts, stops)
        number = np.array([self.terms.setdefault(t, len(self.terms)) for t in terms], dtype=np.int64)
        in_text, n = np.unique(text * max(1, len(terms)) + which, return_counts=True)  # a term of one document
        key = (group[in_text // max(1, len(terms))] << 32) | number[in_text % max(1, len(terms))] if len(in_text) else in_text
        self.parts.append(_summed(key, n, np.ones(len(n), dtype=np.int64)))

    def many(self) -> bool:
        if sum(len(p[0]) for p in self.parts) > HELD:
            self.parts = [_summed(*(np.concatenate(x) for x in zip(*self.parts)))]
        return len(self.terms) > HELD // 2 or sum(len(p[0]) for p in self.parts) > HELD // 2

    def batches(self) -> Iterator[pa.RecordBatch]:
        """What was counted, and each group once with a null term; nothing is held afterwards."""
        key, n, docs = _summed(*(np.concatenate(x) for x in zip(*self.parts))) if self.parts else [np.zeros(0, dtype=np.int64)] * 3
        langs, sources = (pa.array([g[k] for g in self.groups], pa.string()) for k in (0, 1))
        terms, zero = pa.array([t.decode() for t in self.terms], pa.string()), pa.array(np.zeros(len(langs), dtype=np.int64))
        self.__init__()
        yield pa.RecordBatch.from_arrays([langs, sources, pa.nulls(len(langs), pa.string()), zero, zero], names=["lang", "source", "term", "n", "docs"])
        for lo in range(0, len(key), 65_536):
            part = slice(lo, lo + 65_536)
            group = pa.array(key[part] >> 32)
            yield pa.RecordBatch.from_arrays([langs.take(group), sources.take(group), terms.take(pa.array(key[part] & 0xFFFFFFFF)), pa.array(n[part]), pa.array(docs[part])], names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it); each group also once with a null term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Counts()
        for part in slices(batches):
            held.add(part)
            if held.many():
                yield from held.batches()
        if held.groups:
            yield from held.batches()

    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    found = in_batches(rows, run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def weights(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / whole), by long division in thousands, so that nothing overflows."""
    out, rest = np.divmod(counts + 1, whole)
    for _ in range(UNIT_THOUSANDS):
        digit, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digit
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums over the rows of a compressed sparse matrix, 0 for empty rows."""
    out = np.zeros(len(bounds) - 1, dtype=np.int64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.add.reduceat(values, bounds[full])
    return out


PARTS = "lang string, source string, part string, item string, value long"


def _compared(top: int, tile_size: int):
    """Of one block and tile: summed divergences of all pairs (source, source of the tile), and in the first tile leading terms."""

    def run(key: tuple, entries: pa.Table, groups: pa.Table) -> pa.Table:
        groups = groups.sort_by("source")
        sources, whole = groups["source"].combine_chunks(), np.maximum(1, groups["whole"].to_numpy())  # 0 where nothing is compared
        lang, tile = groups["lang"][0].as_py(), key[2].as_py()
        coded = entries["term"].combine_chunks().dictionary_encode()
        terms, col = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = pc.index_in(entries["source"].combine_chunks(), sources).to_numpy(zero_copy_only=False).astype(np.int64)
        n = entries["n"].to_numpy()
        order = np.lexsort((col, row))
        row, col, n = row[order], col[order], n[order]
        bounds = np.searchsorted(row, np.arange(len(sources) + 1))
        p, absent = weights(n, whole[row]), weights(np.zeros(len(sources), dtype=np.int64), whole)
        out = []
        for t in range(tile * tile_size, min(len(sources), (tile + 1) * tile_size)):
            mine = slice(bounds[t], bounds[t + 1])
            q = np.full(len(terms), absent[t])
            q[col[mine]] = p[mine]
            value = _row_sums(divergence(p, q[col]) - divergence(absent[row], q[col]), bounds)
            value += (len(terms) - (mine.stop - mine.start)) * divergence(absent, absent[t])
            for lo in range(mine.start, mine.stop, 4096):
                value += divergence(absent[:, None], p[lo : min(lo + 4096, mine.stop)]).sum(axis=1)
            other = np.flatnonzero(np.arange(len(sources)) != t)
            out.append(_part(lang, sources.take(pa.array(other)), "pair", pa.array([sources[t].as_py()] * len(other), pa.string()), value[other]))
        if tile == 0 and len(terms):
            total = np.zeros(len(terms), dtype=np.int64)
            np.add.at(total, col, n)
            q = weights(total, groups["lang_whole"].to_numpy()[0])[col]
            place = np.empty(len(terms), dtype=np.int64)
            place[pc.array_sort_indices(terms.cast(pa.binary())).to_numpy()] = np.arange(len(terms))
            lead = np.flatnonzero(p > q)
            value = divergence(p[lead], q[lead])
            ranked = np.lexsort((place[col[lead]], -value, row[lead]))
            lead, value = lead[ranked], value[ranked]
            first = np.searchsorted(row[lead], row[lead])
            kept = np.arange(len(lead)) - first < top
            lead, value = lead[kept], value[kept]
            out.append(_part(lang, sources.take(pa.array(row[lead])), "term", terms.take(pa.array(col[lead])), value))
        return pa.concat_tables(out) if out else _part(lang, pa.array([], pa.string()), "pair", pa.array([], pa.string()), np.zeros(0, dtype=np.int64))

    return run


def _part(lang: str, sources: pa.Array, part: str, items: pa.Array, values: np.ndarray) -> pa.Table:
    n = len(sources)
    return pa.table([pa.array([lang] * n, pa.string()), sources, pa.array([part] * n, pa.string()), items, pa.array(values)], names=["lang", "source", "part", "item", "value"])


def source_divergence(docs: DataFrame, least_docs: int = 3, top: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", most_entries: int = MOST_ENTRIES, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part `pair`: each other source of the language, by the summed divergence from it. Part `term`: kept terms that
    the group has more often than its language, by divergence from the language, to rank `top`.
    """
    counts = materialize(term_counts(docs, text_col, lang_col, source_col), "term-counts")
    named = counts.filter("term is not null")
    frequent = named.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).select("lang", "term")
    kept = materialize(named.join(frequent, ["lang", "term"]).select("lang", "source", "term", "n"), "kept-terms")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("entries"))
    groups = counts.filter("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").fillna(0, ["total", "entries"])
    of_lang = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("entries").alias("entries"), F.count(F.lit(1)).alias("sources"))
    vocabulary = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    size = F.least(F.lit(most_entries), F.greatest(F.lit(LEAST_ENTRIES), 4 * F.col("sources") * F.least(F.col("sources"), F.lit(tile))))
    of_lang = of_lang.join(vocabulary, "lang", "left").fillna(0, ["terms"]).select(
        "lang", "terms", F.greatest(F.lit(1), F.ceil(F.col("entries") / size)).cast("int").alias("blocks"), F.ceil(F.col("sources") / tile).cast("int").alias("tiles"), (F.col("lang_total") + F.col("terms")).alias("lang_whole")
    )
    of_lang = materialize(of_lang, "languages")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    groups = groups.join(of_lang, "lang").select("lang", "source", (F.col("total") + F.col("terms")).alias("whole"), "lang_whole", "tiles", upto("blocks").alias("block"))
    groups = groups.select("*", upto("tiles").alias("tile")).drop("tiles")
    entries = kept.join(of_lang.select("lang", "blocks", "tiles"), "lang").select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), upto("tiles").alias("tile"))
    key = ["lang", "block", "tile"]
    found = materialize(entries.groupBy(*key).cogroup(groups.groupBy(*key)).applyInArrow(_compared(top, tile), PARTS), "divergences")
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    terms = found.filter("part = 'term'").withColumn("rank", rank).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
