"""Word shingles of Arrow batches as 64-bit hashes, computed on whole batches with numpy inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
CHUNK = 1 << 18
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_MIX = [np.uint64((0xBF58476D1CE4E5B9 * (2 * k + 1)) & _MASK | 1) for k in range(WORDS)]
_power = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    global _power, _inverse
    if len(_power) < n:
        for name, base in (("_power", _BASE), ("_inverse", pow(_BASE, -1, 1 << 64))):
            p = np.full(n, np.uint64(base))
            p[0] = 1
            globals()[name] = np.multiply.accumulate(p)
    return _power, _inverse


def mix64(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and where each begins and ends; null counts as empty."""
    a = column.cast(pa.large_binary())
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    if a.null_count:
        a = a.fill_null(b"")
    _, offsets, data = a.buffers()
    offsets = np.frombuffer(offsets, np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _chunk(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    filled = offsets[1:] > offsets[:-1]
    space = _SPACE[data]
    before = np.r_[True, space[:-1]] if len(data) else space
    after = np.r_[space[1:], True] if len(data) else space
    before[offsets[:-1][filled]] = True
    after[offsets[1:][filled] - 1] = True
    start, end = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    power, inverse = _powers(len(data) + 1)
    prefix = np.r_[np.uint64(0), np.cumsum(_VALUE[data] * power[: len(data)])]
    word = mix64((prefix[end] - prefix[start]) * inverse[start])
    counts = np.bincount(np.searchsorted(offsets, start, side="right") - 1, minlength=len(offsets) - 1)
    n = max(0, len(word) - WORDS + 1)
    joined = np.zeros(n, np.uint64)
    for k in range(WORDS):
        joined += word[k : k + n] * _MIX[k]
    joined = mix64(joined)
    at = 0
    for c in counts:
        if c >= WORDS:
            yield joined[at : at + c - WORDS + 1]
        elif c:
            few = np.uint64(c)
            for k in range(c):
                few = few + word[at + k] * _MIX[k]
            yield mix64(np.array([few], np.uint64))
        else:
            yield joined[:0]
        at += c


def shingles(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text the hashes of its windows of five words, repeats included; a shorter text with words is one shingle."""
    data, offsets = text_bytes(column)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(offsets) - 1:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
            yield from _chunk(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            at = to
