"""Anchors of long byte strings: places that any two copies of a string choose alike.

Every string of ``length`` bytes has one anchor, the leftmost of its substrings
of ``core`` bytes with the least hash. The strings with one anchor follow one
another, so a text falls into units: an anchor, and the first and last start of
the strings that it stands for. Two equal strings have anchors with equal cores
at the same distance, so only units with equal cores need be compared.
"""

from __future__ import annotations

import numpy as np

from triadic.llm.textnum import _BASE, _LETTER, mix, powers

_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
MOST = 1 << 22  # bytes in a buffer, so that a place fits 22 bits
_UP, _DOWN = powers(MOST + 1), powers(MOST + 1, _INVERSE)


class Rolling:
    """Hashes of any stretch of a buffer in constant time."""

    def __init__(self, raw: np.ndarray):
        self.sum = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_LETTER[raw] * _UP[: len(raw)], dtype=np.uint64, out=self.sum[1:])

    def of(self, start, size):
        start = np.asarray(start)
        return mix((self.sum[start + size] - self.sum[start]) * _DOWN[start] + np.asarray(size).astype(np.uint64))


def units(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int, core: int):
    """(doc, anchor, first, last, core hash, hash of the unit) of the texts raw[begin:end].

    first and last: first and last start of a string whose anchor it is. The hash
    of the unit covers all bytes of its strings and the anchor's place in them.
    """
    empty = np.empty(0, np.int64)
    if len(raw) < length:
        return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    roll = Rolling(raw)
    n = len(raw) - core + 1
    place = np.arange(n, dtype=np.uint64)
    v = (roll.of(np.arange(n), core) & ~np.uint64(MOST - 1)) | place
    width, step = length - core + 1, 1
    while 2 * step <= width:
        v = np.minimum(v[: len(v) - step], v[step:])
        step *= 2
    v = np.minimum(v[: len(v) - (width - step)], v[width - step :])
    anchor = (v & np.uint64(MOST - 1)).astype(np.int64)  # of the string from each start
    ok = np.zeros(len(anchor) + 1, np.int8)
    long = end - begin >= length
    np.add.at(ok, begin[long], 1)
    np.add.at(ok, end[long] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(ok[:-1], dtype=np.int8))
    if not len(start):
        return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    a = anchor[start]
    cut = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (start[1:] != start[:-1] + 1)))
    first, last, a = start[cut], start[np.append(cut[1:], len(start)) - 1], a[cut]
    doc = np.searchsorted(end, first, "right")
    whole = roll.of(first, last - first + length)
    return doc, a, first, last, roll.of(a, core), mix(whole * _BASE + (a - first).astype(np.uint64))
