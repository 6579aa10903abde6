"""Simple-8b: unsigned integers in 64-bit words, a selector and as many equal-width values as fit.

ids are cut into blocks of BLOCK; every block begins at a word of its own, so that it can be decoded alone.
Values of more than 60 bits are escaped: the word holds 0 and a list has their places and values.
Layout, little-endian: magic, ids, words, blocks, escapes (uint64 each); word offset of each block and the
end (uint32); escapes' places, then values (uint64); the words.
"""

from __future__ import annotations

import numpy as np

MAGIC = int.from_bytes(b"PFS8B\x00\x00\x01", "little")
BLOCK = 1024
#: Fixed values of the code: values in a word, and bits of each, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each value needs; the high half of a value counts where it has one."""
    high = ids >> np.uint64(32)
    need = np.frexp((ids & np.uint64(0xFFFFFFFF)).astype(np.float64))[1].astype(np.uint8)
    return np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 32, need).astype(np.uint8) if high.any() else need


def encode(ids: np.ndarray) -> bytes:
    """The ids as one self-contained run of bytes."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    escaped = np.flatnonzero(ids >> np.uint64(60))
    values = ids[escaped]
    if len(escaped):
        ids = ids.copy()
        ids[escaped] = 0
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    need = np.full((blocks, BLOCK), 255, dtype=np.uint8)  # 255: beyond the end, fits nowhere
    need.reshape(-1)[:n] = _widths(ids)
    # a run that fits is longer than any other that fits: how many selectors fit gives the best one
    fits = np.zeros((blocks, BLOCK), dtype=np.uint8)
    most, width = need, 1
    for selector in range(14, -1, -1):
        count = int(COUNTS[selector])
        most = np.maximum(most[:, : BLOCK - count + 1], most[:, count - width : BLOCK - width + 1])
        ok = most <= BITS[selector]
        if not ok.any():
            break
        fits[:, : BLOCK - count + 1] += ok
        width = count
    best = 15 - fits
    sizes = np.minimum(BLOCK, n - BLOCK * np.arange(blocks))
    at, steps = np.zeros(blocks, dtype=np.int64), []
    rows = np.arange(blocks)
    while (going := at < sizes).any():  # all blocks go on by one word at once
        chosen = best[rows, np.minimum(at, BLOCK - 1)]
        steps.append((np.where(going, at, -1), chosen))
        at = np.where(going, at + COUNTS[chosen], at)
    if steps:
        starts, selectors = np.stack([s for s, _ in steps], axis=1), np.stack([c for _, c in steps], axis=1)
        used = starts >= 0
        offsets = np.concatenate([[0], np.cumsum(used.sum(axis=1))])
        first, selector = (starts + BLOCK * rows[:, None])[used], selectors[used]
    else:
        offsets, first, selector = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    words = selector.astype(np.uint64) << np.uint64(60)
    for s in range(2, 16):
        mine = np.flatnonzero(selector == s)
        if len(mine):
            k = np.arange(COUNTS[s])
            words[mine] |= np.bitwise_or.reduce(ids[first[mine][:, None] + k] << (k * BITS[s]).astype(np.uint64), axis=1)
    head = np.array([MAGIC, n, len(words), blocks, len(escaped)], dtype="<u8")
    return b"".join(x.tobytes() for x in (head, offsets.astype("<u4"), escaped.astype("<u8"), values.astype("<u8"), words.astype("<u8")))


def _parts(data: bytes):
    magic, n, n_words, blocks, n_escaped = (int(x) for x in np.frombuffer(data, "<u8", 5))
    if magic != MAGIC:
        raise ValueError("not Simple-8b data of this layout")
    offsets = np.frombuffer(data, "<u4", blocks + 1, 40).astype(np.int64)
    at = 40 + 4 * (blocks + 1)
    places, values = np.frombuffer(data, "<u8", n_escaped, at).astype(np.int64), np.frombuffer(data, "<u8", n_escaped, at + 8 * n_escaped)
    return n, offsets, places, values, np.frombuffer(data, "<u8", n_words, at + 16 * n_escaped)


def _unpacked(words: np.ndarray) -> np.ndarray:
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
    for s in range(2, 16):
        mine = np.flatnonzero(selector == s)
        if len(mine):
            k = np.arange(COUNTS[s])
            mask = np.uint64((1 << int(BITS[s])) - 1)
            out[(ends - counts)[mine][:, None] + k] = (words[mine][:, None] >> (k * BITS[s]).astype(np.uint64)) & mask
    return out


def decode(data: bytes) -> np.ndarray:
    """All ids, as uint64."""
    n, _, places, values, words = _parts(data)
    out = _unpacked(words)
    if len(out) != n:
        raise ValueError("damaged Simple-8b data")
    out[places] = values
    return out


def decode_block(data: bytes, block: int) -> np.ndarray:
    """The ids of one block, by its offset alone."""
    _, offsets, places, values, words = _parts(data)
    out = _unpacked(words[offsets[block] : offsets[block + 1]])
    here = (places >= BLOCK * block) & (places < BLOCK * (block + 1))
    out[places[here] - BLOCK * block] = values[here]
    return out
