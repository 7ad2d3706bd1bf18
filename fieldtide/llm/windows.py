"""Anchored runs of fixed-length byte windows, computed for a whole Arrow batch at once.

Every window of ``length`` bytes has one anchor: the smallest hash of the ``GRAM``-byte strings inside it. Equal windows
have equal anchors at equal distances from their starts, so windows need be compared only under one anchor, aligned at it.
Neighbouring windows mostly share their anchor and travel together as one run.
"""

from __future__ import annotations

import numpy as np

GRAM = 48
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.Generator(np.random.PCG64(20260101)).integers(1, 1 << 63, 256, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    """Spreads a 64-bit hash over all of its bits."""
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def gram_hashes(data: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """For each length n, the polynomial hash of the n bytes that start at every position."""
    powers: dict[int, np.ndarray] = {1: _BYTES[data]}
    size = 1
    while size * 2 <= max(lengths):
        h = powers[size]
        powers[size * 2] = h[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + h[size:] if h.size > size else h[:0]
        size *= 2
    out = {}
    for n in lengths:
        count = max(0, data.size - n + 1)
        total, at, bit = np.zeros(count, np.uint64), 0, size
        while bit and count:
            if n & bit:
                total *= np.uint64(pow(_BASE, bit, 1 << 64))
                total += powers[bit][at : at + count]
                at += bit
            bit >>= 1
        out[n] = total
    return out


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    size, low = 1, h
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = width - size
    return np.minimum(low[: low.size - rest], low[rest:]) if rest else low


def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor in each document of ``data``; document d is ``data[offsets[d]:offsets[d + 1]]``.

    The anchor of a window is the leftmost of its smallest grams, so a run ends where that gram leaves the window even if
    the same gram follows. Returns per run: doc, start (in the document), at (in ``data``), n (windows), anchor.
    """
    count = data.size - length + 1
    if count <= 0:
        return {name: np.zeros(0, np.int64) for name in ("doc", "start", "at", "n", "anchor")}
    grams = _mix(gram_hashes(data, [GRAM])[GRAM])
    anchor = sliding_min(grams, length - GRAM + 1)
    # Windows that reach past their document are cut out, document by document.
    ends = np.maximum(offsets[1:] - length + 1, offsets[:-1])
    marks = np.zeros(data.size + 1, np.int8)
    np.add.at(marks, offsets[:-1], 1)
    np.add.at(marks, ends, -1)
    valid = np.cumsum(marks[:count]).astype(bool)
    breaks = np.ones(count, bool)
    breaks[1:] = (anchor[1:] != anchor[:-1]) | (grams[: count - 1] == anchor[:-1])
    breaks[offsets[:-1][offsets[:-1] < count]] = True
    breaks[ends[ends < count]] = True
    first = np.flatnonzero(breaks)
    size = np.diff(np.append(first, count))
    keep = valid[first]
    first, size = first[keep], size[keep]
    owner = np.searchsorted(offsets, first, "right") - 1
    return {"doc": owner, "start": first - offsets[owner], "at": first, "n": size, "anchor": anchor[first].view(np.int64)}


def anchor_offsets(strings: list[bytes], length: int, block: int = 256) -> np.ndarray:
    """Distance of the anchor from the start of each run: it lies in the run's first window. Blocks of strings stay in cache."""
    width, found = length - GRAM + 1, [np.zeros(0, np.int64)]
    for k in range(0, len(strings), block):
        first = b"".join([s[:length] for s in strings[k : k + block]])
        grams = np.zeros(len(first), np.uint64)
        grams[: len(first) - GRAM + 1] = _mix(gram_hashes(np.frombuffer(first, np.uint8), [GRAM])[GRAM])
        found.append(np.argmin(grams.reshape(-1, length)[:, :width], axis=1))
    return np.concatenate(found)


def stretch_hashes(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The polynomial hash of the ``size`` bytes from each of the places ``at``."""
    powers = np.array([pow(_BASE, size - 1 - i, 1 << 64) for i in range(size)], np.uint64)
    out = np.zeros(at.size, np.uint64)
    for k in range(0, at.size, 512):
        out[k : k + 512] = (_BYTES[data[at[k : k + 512, None] + np.arange(size)]] * powers).sum(axis=1)
    return out
