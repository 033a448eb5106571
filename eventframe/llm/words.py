"""Words of many texts at once: their keys (XXH64, seed 0) and the last bytes, from the texts' own buffers.

What counts as a word, and its key, is what ``brown_lm.tokens`` and ``brown_lm.key`` give for one text and one word; here
all words of a batch are found and hashed together, the words of one length at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Words of more bytes are hashed one by one.
_SHORT = 31
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _hashed(whole: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """XXH64 (seed 0) of the ``size`` bytes, below 32, from each start; ``whole`` has 8 more bytes at its end."""
    def read(kind: str, at: np.ndarray) -> np.ndarray:
        return np.ndarray(len(whole) - 8, kind, whole.data, strides=(1,))[at].astype(np.uint64)

    h, done = np.full(len(start), _P5 + np.uint64(size)), 0
    while size - done >= 8:
        h = _turned(h ^ _turned(read("<u8", start + done) * _P2, 31) * _P1, 27) * _P1 + _P4
        done += 8
    if size - done >= 4:
        h = _turned(h ^ read("<u4", start + done) * _P1, 23) * _P2 + _P3
        done += 4
    for i in range(done, size):
        h = _turned(h ^ whole[start + i].astype(np.uint64) * _P5, 11) * _P1
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    return h ^ h >> np.uint64(32)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys as signed numbers, last two bytes, words of each text), A-Z lowered; the last but one byte is the low one, and
    a word of one byte has ``65536 +`` that byte."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    if ends[-1] == ends[0]:
        return np.empty(0, np.int64), np.empty(0, np.int32), np.zeros(len(texts), np.int64)
    data = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    whole = np.zeros(len(data) + 8, np.uint8)
    np.take(_LOWER, data, out=whole[:-8])
    space = _SPACE[data]
    first, last = ~space, ~space
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    cut = ends[1:-1]  # words end with their text
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut], last[cut - 1] = ~space[cut], ~space[cut - 1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    many = np.diff(np.searchsorted(start, ends))
    size = stop - start
    kept = np.minimum(size, _SHORT + 1).astype(np.uint8)
    order = np.argsort(kept, kind="stable")
    bounds = np.searchsorted(kept[order], np.arange(_SHORT + 3))
    key = np.empty(len(start), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, _SHORT + 1):
            if bounds[n] < bounds[n + 1]:
                at = order[bounds[n]:bounds[n + 1]]
                key[at] = _hashed(whole, start[at], n)
    for i in order[bounds[_SHORT + 1]:].tolist():
        key[i] = xxhash.xxh64_intdigest(whole[start[i]:stop[i]].data)
    end = whole[stop - 1].astype(np.int32)
    return key.view(np.int64), np.where(size > 1, whole[np.maximum(stop - 2, 0)] + (end << 8), 65536 + end).astype(np.int32), many
