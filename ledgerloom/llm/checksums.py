"""CRC-32 of many slices of bytes at once, and of what slices make when they are joined.

A CRC is linear over the two-element field: that of A and B is that of A, moved on by B's length, plus that of B. So a
run of words is checked from its words' values, and no byte is read twice.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np

#: Slices up to this length are read in steps over all of them, longer ones by themselves; moves up to it have a table each.
SHORT = 64


@lru_cache(1)
def tables() -> np.ndarray:
    """(SHORT + 1, 4, 256): what a move by so many bytes makes of each byte of a value."""
    each = np.array([zlib.crc32(bytes([i ^ 0xFF])) ^ 0xFF000000 for i in range(256)], np.uint32)  # without the start and end of a CRC
    out = np.zeros((SHORT + 1, 4, 256), np.uint32)
    for i in range(4):
        out[0, i] = np.arange(256, dtype=np.uint32) << np.uint32(8 * i)
    for n in range(SHORT):
        out[n + 1] = each[out[n] & np.uint32(255)] ^ (out[n] >> np.uint32(8))
    return out


def moved(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Values as they count in front of so many bytes more."""
    t, out, left = tables(), crc, by
    while True:
        n = np.minimum(left, SHORT)
        out = t[n, 0, out & np.uint32(255)] ^ t[n, 1, (out >> np.uint32(8)) & np.uint32(255)] ^ t[n, 2, (out >> np.uint32(16)) & np.uint32(255)] ^ t[n, 3, out >> np.uint32(24)]
        left = left - n
        some = np.flatnonzero(left)
        if not len(some):
            return out
        if len(some) < len(out):
            out[some] = moved(out[some], left[some])
            return out


def joined(a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Values of slices followed by others of these lengths."""
    return moved(a, length) ^ b


def of_slices(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each slice of bytes."""
    n = end - start
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    each = tables()[1, 0]
    at = np.flatnonzero((n > 0) & (n <= SHORT))
    for i in range(SHORT):
        if not len(at):
            break
        now = crc[at]
        crc[at] = each[(now ^ flat[start[at] + i]) & np.uint32(255)] ^ (now >> np.uint32(8))
        at = at[n[at] > i + 1]
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(n > SHORT):
        crc[i] = zlib.crc32(flat[start[i] : end[i]])
    return crc
