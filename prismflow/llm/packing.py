"""Hierarchical multi-length packing of token ids into training sequences.

Each partition is packed by itself, in pools of a bounded number of ids, so nothing is shuffled and no
group is gathered. In a pool every document first yields its full windows of the context size; the rest
is routed to the smallest tier (context, context/2, ...) that holds it. Tiers are packed from the longest
down: a rest opens a window of its tier, and the gap is filled from shorter tiers, whole rests first (the
longest that fits), then a cut one. What still lacks a full window is strung together and cut into
windows of falling powers of two, which take no padding. Sequences of a tier are dealt to step groups so
that groups have equal numbers of ids and nearly equal attention cost (sum of squared piece lengths).

Defined results: null or empty text is the end id alone; repeated rows are documents of their own; other
columns are ignored; an empty table gives an empty result. A very long text is packed like any other.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismflow.llm.common import in_batches, slices
from prismflow.llm.tokens import encoder

CONTEXT = 1024
TIERS = (1024, 512, 256, 128)
#: Text encoded at once; less than elsewhere, as packing holds a pool of ids beside it.
PACK_BYTES = 1_000_000
#: Ids packed together (8 MB), and ids of a step group.
POOL = 1 << 21
STEP = 1 << 16

Piece = tuple[int, int, int]  # document, start, length


def pack(lengths: np.ndarray, tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[Piece]]]:
    """Windows (size, pieces) that hold every id of documents of these lengths once, all of them full.

    Sizes are those of the tiers, but for at most one window each of the smaller powers of two.
    """
    top = tiers[0]
    windows: list[tuple[int, list[Piece]]] = [(top, [(d, s, top)]) for d in np.flatnonzero(lengths >= top).tolist() for s in range(0, int(lengths[d]) - top + 1, top)]
    rests: dict[int, list[Piece]] = {t: [] for t in tiers}
    for d in np.flatnonzero(lengths % top).tolist():
        n = int(lengths[d])
        rest = n % top
        rests[min(t for t in tiers if t >= rest)].append((d, n - rest, rest))
    size_of = lambda p: p[2]
    for t in tiers:
        rests[t].sort(key=size_of)
    open_ends: list[Piece] = []
    for level, tier in enumerate(tiers):
        while rests[tier]:
            window, gap = [rests[tier].pop()], 0
            gap = tier - window[0][2]
            for shorter in tiers[level + 1 :]:
                pool = rests[shorter]
                while gap and pool and (k := bisect_right(pool, gap, key=size_of)):
                    piece = pool.pop(k - 1)
                    window.append(piece)
                    gap -= piece[2]
            for shorter in reversed(tiers[level + 1 :]):
                while gap and rests[shorter]:
                    d, s, n = rests[shorter].pop(0)
                    part = min(gap, n)
                    window.append((d, s, part))
                    gap -= part
                    if part < n:
                        rests[shorter].insert(0, (d, s + part, n - part))
            if gap:
                open_ends += window
            else:
                windows.append((tier, window))
    left, size = sum(p[2] for p in open_ends), top
    queue = open_ends[::-1]
    while left:
        while size > left:
            size //= 2
        window, gap = [], size
        while gap:
            d, s, n = queue.pop()
            part = min(gap, n)
            window.append((d, s, part))
            gap -= part
            if part < n:
                queue.append((d, s + part, n - part))
        windows.append((size, window))
        left -= size
    return windows


def step_groups(windows: list[tuple[int, list[Piece]]], step: int = STEP) -> list[int]:
    """A step group for each window: of one size each, dealt back and forth by attention cost."""
    groups, base = [0] * len(windows), 0
    for size in sorted({w for w, _ in windows}, reverse=True):
        mine = [k for k, (w, _) in enumerate(windows) if w == size]
        mine.sort(key=lambda k: -sum(p[2] ** 2 for p in windows[k][1]))
        n = max(1, -(-len(mine) * size // step))
        for place, k in enumerate(mine):
            turn, at = divmod(place, n)
            groups[k] = base + (at if turn % 2 == 0 else n - 1 - at)
        base += n
    return groups


SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, tier int, step_group long, ids binary"


def _packed(path: str, end_id: int, tiers: tuple[int, ...], pool: int, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        sequence = group = TaskContext.get().partitionId() << 40
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, group
            doc_ids = [d for docs, _, _ in held for d in docs]
            ids, lengths = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            held.clear()
            begins = np.cumsum(lengths) - lengths
            windows = pack(lengths, tiers)
            steps = step_groups(windows, step)
            for lo in range(0, len(windows), 2000):
                rows = []
                for k in range(lo, min(lo + 2000, len(windows))):
                    offset, (size, pieces) = 0, windows[k]
                    for d, s, n in pieces:
                        at = int(begins[d]) + s
                        rows.append((doc_ids[d], s, n, int(lengths[d]), sequence + k, offset, size, group + steps[k], ids[at : at + n].astype("<u4").tobytes()))
                        offset += n
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names=NAMES)
            sequence, group = sequence + len(windows), group + max(steps) + 1

        total = 0
        for part in slices(batches, most=PACK_BYTES):
            ids, lengths = encode(part.column("text"), end_id)
            held.append((part.column("doc_id").to_pylist(), ids, lengths))
            total += len(ids)
            if total >= pool:
                yield from flush()
                total = 0
        if held:
            yield from flush()

    return run


TYPES = [pa.int64()] * 6 + [pa.int32(), pa.int64(), pa.binary()]
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def pack_documents(docs: DataFrame, path: str, end_id: int = 0, tiers: tuple[int, ...] = TIERS, pool: int = POOL, step: int = STEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document in a sequence, with its ids (little-endian unsigned 32-bit).

    doc_id, start (the document's ids before it), length, doc_tokens, sequence_id, offset (in the sequence),
    tier (the sequence's size), step_group, ids.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return in_batches(rows, _packed(path, end_id, tiers, pool, step), SCHEMA)


def with_crc(pieces: DataFrame) -> DataFrame:
    """The pieces with ids_crc32 in place of ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
