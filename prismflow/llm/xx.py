"""xxHash64 of many short strings at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: The primes of the xxHash64 function.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xx64(rows: np.ndarray) -> np.ndarray:
    """xxHash64 (seed 0) of each row of a byte matrix with fewer than 32 columns."""
    n, width = rows.shape
    h = np.full(n, _P5 + np.uint64(width), dtype=np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while width - at >= 8:
            lane = np.ascontiguousarray(rows[:, at : at + 8]).view("<u8")[:, 0]
            h = _turned(h ^ (_turned(lane * _P2, 31) * _P1), 27) * _P1 + _P4
            at += 8
        if width - at >= 4:
            lane = np.ascontiguousarray(rows[:, at : at + 4]).view("<u4")[:, 0].astype(np.uint64)
            h = _turned(h ^ (lane * _P1), 23) * _P2 + _P3
            at += 4
        for k in range(at, width):
            h = _turned(h ^ (rows[:, k].astype(np.uint64) * _P5), 11) * _P1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


def string_hashes(strings: pa.LargeStringArray) -> np.ndarray:
    """xxHash64 of each string's bytes, length by length; those of 32 bytes or more one by one."""
    ends = np.frombuffer(strings.buffers()[1], dtype=np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    sizes, out = np.diff(ends), np.zeros(len(strings), dtype=np.uint64)
    order = np.argsort(np.minimum(sizes, 32).astype(np.uint8), kind="stable")  # by counting, as lengths are few
    bounds = np.searchsorted(sizes[order], np.arange(33)) if len(order) else np.zeros(33, dtype=np.int64)
    bounds[32] = np.searchsorted(np.minimum(sizes[order], 32), 32) if len(order) else 0
    for width in range(32):
        at = order[bounds[width] : bounds[width + 1]]
        if len(at):
            out[at] = xx64(raw[ends[at][:, None] + np.arange(width)])
    for k in order[bounds[32] :].tolist():
        out[k] = xxhash.xxh64_intdigest(raw[ends[k] : ends[k + 1]].tobytes())
    return out
