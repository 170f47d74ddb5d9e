"""Vectorised word shingles of whole texts: words are runs of anything but ASCII white space, A-Z lower-cased.

Texts are read from Arrow buffers, so that no Python object is made for a word. A shingle is a 64-bit hash of
its words' 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(x + np.uint64(seed & 0xFFFFFFFFFFFFFFFF) * _BASE)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array end to end, and each text's bounds in them; nulls are empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, "<i8", len(texts) + 1, 8 * texts.offset)
    first = int(at[0]) if len(at) else 0
    flat = np.frombuffer(data, np.uint8, int(at[-1]) - first, first) if data and len(texts) else np.zeros(0, np.uint8)
    return flat, at - first


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def words(flat: np.ndarray, at: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text index of every word; ``gaps`` tells of each byte whether it lies between words."""
    if not flat.size:
        return (np.zeros(0, np.int64),) * 3
    space = gaps[flat]
    inner = ~space
    begins = inner.copy()
    begins[1:] &= space[:-1]
    edges = at[1:-1][at[1:-1] < flat.size]
    begins[edges] |= inner[edges]
    last = inner.copy()
    last[:-1] &= space[1:]
    before = edges[edges > 0] - 1
    last[before] |= inner[before]
    start, end = np.flatnonzero(begins), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def hashes(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice of bytes, by its polynomial and its length.

    Each slice is read as a few 64-bit numbers, through a view of the buffer at every byte.
    """
    n = end - start
    out = np.zeros(len(start), np.uint64)
    if not len(start):
        return out
    padded = np.concatenate([flat, np.zeros(8, np.uint8)])
    view = np.ndarray((flat.size + 1,), "<u8", padded.data, strides=(1,))
    masks = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
    with np.errstate(over="ignore"):
        out = mix((view[start] & masks[np.minimum(n, 8)]) + np.uint64(1))
        pending, step = np.flatnonzero(n > 8), 1
        while len(pending):
            word = view[start[pending] + 8 * step] & masks[np.minimum(n[pending] - 8 * step, 8)]
            out[pending] = mix(out[pending] * _STEP + word + np.uint64(step + 1))
            step += 1
            pending = pending[n[pending] > 8 * step]
        return out ^ (n.astype(np.uint64) * _BASE)


def shingles(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, end to end, and each text's bounds in them.

    A text with fewer words than ``width`` has one shingle, its whole sequence of words; one without words none.
    """
    flat, at = bytes_of(texts)
    flat = _LOWER[flat]
    start, end, doc = words(flat, at)
    h = hashes(flat, start, end)
    count = np.bincount(doc, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
    first = np.cumsum(count) - count
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(h), np.uint64)
        for i in range(width):
            rolled[: len(h) - i] += h[i:] * np.uint64(pow(int(_STEP), i + 1, 1 << 64))
        place = np.arange(len(h)) - first[doc] if len(h) else np.zeros(0, np.int64)
        whole = place + width <= count[doc] if len(h) else np.zeros(0, bool)
        keys, owner = mix(rolled[whole]), doc[whole]
        short = np.flatnonzero((count > 0) & (count < width))
        if len(short):
            extra = []
            for d in short:
                mine = h[first[d] : first[d] + count[d]]
                total = np.uint64(len(mine)) * _BASE
                for i, x in enumerate(mine):
                    total += x * np.uint64(pow(int(_STEP), i + 1, 1 << 64))
                extra.append(mix(np.array([total ^ np.uint64(0x5BD1E995)]))[0])
            at = np.searchsorted(owner, short)
            keys, owner = np.insert(keys, at, np.array(extra, np.uint64)), np.insert(owner, at, short)
    sets = [np.unique(x) for x in np.split(keys, np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1])] if len(texts) else []
    sizes = np.array([len(x) for x in sets], np.int64)
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
