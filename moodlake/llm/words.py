"""Words of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes that separate words: space and \t \n \v \f \r. All are ASCII, so UTF-8 can be cut at them.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_SEGMENT = 2 << 20


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A well-spread 64-bit permutation of 64-bit values."""
    h = h ^ np.uint64(salt)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def piece_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each piece ``data[starts[i]:stops[i]]`` (ascending, not overlapping, not empty),
    in segments of bounded size."""
    out = np.zeros(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(stops, starts[lo] + _SEGMENT, side="right")))
        length = stops[lo:hi] - starts[lo:hi]
        total = np.cumsum(length)
        offset = np.arange(total[-1]) - np.repeat(total - length, length)
        power = np.full(int(length.max()), _BASE, np.uint64)
        power[0] = 1
        np.cumprod(power, out=power)
        values = data[np.repeat(starts[lo:hi], length) + offset].astype(np.uint64)
        values += np.uint64(1)
        values *= power[offset]
        out[lo:hi] = np.add.reduceat(values, total - length) + length.astype(np.uint64)
        lo = hi
    return mix(out)


@dataclass
class Words:
    """Words of the texts of a buffer: byte bounds, hash, text number; and each text's first word and count."""
    starts: np.ndarray
    stops: np.ndarray
    hashes: np.ndarray
    text: np.ndarray
    first: np.ndarray
    counts: np.ndarray


def words_of(data: np.ndarray, ends: np.ndarray) -> Words:
    """Maximal runs of bytes other than spaces, not across texts."""
    solid = ~SPACE[data]
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    inner = ends[(ends > 0) & (ends < len(data))]
    begin[inner] |= solid[inner]
    end[inner - 1] |= solid[inner - 1]
    starts, stops = np.flatnonzero(begin), np.flatnonzero(end) + 1
    text = np.searchsorted(ends, starts, side="right")
    counts = np.bincount(text, minlength=len(ends)).astype(np.int64)
    return Words(starts, stops, piece_hashes(data, starts, stops), text, np.cumsum(counts) - counts, counts)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every run of ``size`` words; a text of fewer words has one run of them all."""
    n = len(w.hashes)
    short = (w.counts > 0) & (w.counts < size)
    h = np.zeros(n, np.uint64)
    inside = np.ones(n, bool)
    for k in range(size):
        other = np.minimum(np.arange(n) + k, max(n - 1, 0))
        same = (np.arange(n) + k < n) & (w.text[other] == w.text) if n else inside
        inside &= same
        h = mix(h + np.where(same, w.hashes[other], np.uint64(0)), 0x51ED270B * (k + 1)) if n else h
    keep = inside
    keep[w.first[short]] = True
    return w.text[keep], h[keep]


def per_text(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[ends] - total[np.concatenate(([0], ends[:-1]))] if len(ends) else np.zeros(0, np.int64)
