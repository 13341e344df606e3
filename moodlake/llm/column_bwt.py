"""Column-wise construction of the Burrows-Wheeler transform and the common
prefixes of a collection of strings, and the anchors that deal a corpus into
such collections. Plain numpy kernels that run inside Spark tasks.

The construction adds one symbol of every string per round, from the strings'
ends to their starts. After round j the two columns hold, in suffix order, for
every suffix of at most j symbols the symbol before it (the transform) and the
length of the prefix it shares with its predecessor. Both columns live in
task-private external files that a round reads front to back and writes anew.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Bits of a packed anchor key that hold the position inside a batch buffer.
_POS_BITS = 26
#: Largest buffer that one call of ``anchor_runs`` may be given.
MAX_BUFFER = (1 << _POS_BITS) - 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)


class _ColumnFile:
    """One column kept in an unnamed file of the task; each round reads it
    sequentially and writes its successor. It vanishes with the task."""

    def __init__(self):
        self.file = tempfile.TemporaryFile(buffering=0)

    def write(self, values: np.ndarray) -> None:
        self.file.seek(0)
        view, at = memoryview(values).cast("B"), 0
        while at < len(view):
            at += self.file.write(view[at:])

    def read(self, into: np.ndarray) -> np.ndarray:
        self.file.seek(0)
        view, at = memoryview(into).cast("B"), 0
        while at < len(view):
            got = self.file.readinto(view[at:])
            if not got:
                raise EOFError("a column ended early")
            at += got
        return into

    def close(self) -> None:
        self.file.close()


def column_bwt(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """(transform, common prefixes, tails) of the strings
    ``buffer[starts[i]:starts[i]+lengths[i]]``; ``tails[i]`` is the place of
    the ``len(starts) + i``-th suffix without its first symbol.

    Equal suffixes of different strings follow the order of the strings; the
    end markers are distinct and never count as common symbols."""
    m, width = len(starts), int(lengths.max(initial=0))
    used = np.zeros(256, bool)
    columns = np.zeros((width, m), np.uint8)
    rows = np.repeat(np.arange(m), lengths)
    offset = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    symbols = buffer[np.repeat(starts, lengths) + offset]
    used[symbols] = True
    codes = np.zeros(256, np.uint8)
    codes[used] = np.arange(1, used.sum() + 1)      # UTF-8 uses fewer than 255 byte values
    # row j-1 holds the j-th symbol from each string's end
    columns[np.repeat(lengths, lengths) - 1 - offset, rows] = codes[symbols]

    shift, low_half = np.int64(32), np.int64((1 << 32) - 1)
    most = m + len(rows)                            # the working arrays are made once
    bwt_a, bwt_b = np.zeros(most, np.uint8), np.zeros(most, np.uint8)
    lcp_a, lcp_b = np.zeros(most + 1, np.uint16), np.zeros(most + 1, np.uint16)
    # first symbol and tail of every suffix but the end markers; ascending,
    # which is the suffix order
    links_a, links_b = np.zeros(most, np.int64), np.zeros(most, np.int64)
    tail_a, moved_a, old_a = np.zeros(most, np.int64), np.arange(most), np.zeros(most, bool)
    bwt_file, lcp_file = _ColumnFile(), _ColumnFile()
    try:
        n = 0                                       # suffixes so far, without the end markers
        bwt_file.write(bwt_a[:m])
        lcp_file.write(lcp_a[:m + 1])
        at, strings = np.arange(m), np.arange(m)    # place of each string's longest suffix so far
        for j in range(width):
            bwt, lcp = bwt_file.read(bwt_a[:m + n]), lcp_file.read(lcp_a[:m + n + 1])
            symbol = columns[j, strings]
            bwt[at] = symbol                        # 0: the string has been used up
            live = symbol > 0
            at, strings, symbol = at[live], strings[live], symbol[live].astype(np.int64)
            if not len(at):
                bwt_file.write(bwt)
                break
            links, size = links_a[:n], n + len(at)
            new_links = (symbol << shift) | at
            by_link = np.argsort(new_links)
            new_links, strings, here = new_links[by_link], strings[by_link], at[by_link]
            place = np.searchsorted(links, new_links) + np.arange(len(new_links))
            old, merged = old_a[:size], links_b[:size]
            old[:] = True
            old[place] = False
            merged[old], merged[place] = links, new_links

            before, after = merged[place - 1], merged[np.minimum(place + 1, size - 1)]
            has_before = (before >> shift == new_links >> shift) & (place > 0)
            has_after = (after >> shift == new_links >> shift) & (place + 1 < size)
            low = np.where(has_before, (before & low_half) + 1, here)
            high = np.where(has_after, (after & low_half) + 1, here + 1)
            by_here = np.argsort(here)
            bounds = np.column_stack((low, here + 1, np.minimum(here + 1, len(bwt)), high))
            least = np.minimum.reduceat(lcp, bounds[by_here].ravel()).reshape(-1, 4)
            shared = np.empty((len(here), 2), np.uint16)
            shared[by_here] = least[:, ::2] + np.uint16(1)

            at = m + place
            new_bwt, new_lcp = bwt_b[:m + size], lcp_b[:m + size + 1]
            new_bwt[:m], new_lcp[:m] = bwt[:m], lcp[:m]
            new_bwt[m:][old], new_lcp[m:-1][old] = bwt[m:], lcp[m:-1]
            new_bwt[at], new_lcp[-1] = 0, 0
            new_lcp[at] = np.where(has_before, shared[:, 0], 0)
            new_lcp[at[has_after] + 1] = shared[has_after, 1]
            bwt_file.write(new_bwt)
            lcp_file.write(new_lcp)

            moved, tail, links = moved_a[:m + n], tail_a[:size], links_a[:size]
            np.add(np.flatnonzero(old), m, out=moved[m:])
            np.bitwise_and(merged, low_half, out=tail)
            np.subtract(merged, tail, out=merged)
            np.take(moved, tail, out=links, mode="clip")
            np.add(links, merged, out=links)
            n = size
        else:
            bwt = bwt_file.read(bwt_a[:m + n])
            bwt[at] = 0
            bwt_file.write(bwt)
        return (bwt_file.read(bwt_a[:m + n]), lcp_file.read(lcp_a[:m + n + 1]), links_a[:n] & low_half)
    finally:
        bwt_file.close()
        lcp_file.close()


def repeated_starts(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray,
                    length: int) -> np.ndarray:
    """For every symbol of the strings (in order): whether the ``length``-symbol
    substring starting there also starts elsewhere in the collection."""
    m = len(starts)
    base = np.cumsum(lengths) - lengths
    flags = np.zeros(int(lengths.sum()), bool)
    if m == 0 or not len(flags):
        return flags
    _, lcp, tails = column_bwt(buffer, starts, lengths)
    shared = (lcp[:-1] >= length) | (lcp[1:] >= length)
    # from the end markers towards the starts, to tell which suffix is whose
    longer = np.zeros(len(shared), np.int64)
    longer[tails] = m + np.arange(len(tails))
    at, strings = np.arange(m), np.arange(m)
    for j in range(1, int(lengths.max()) + 1):
        live = lengths[strings] >= j
        at, strings = longer[at[live]], strings[live]
        flags[base[strings] + lengths[strings] - j] = shared[at]
    return flags


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, kept between calls."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            table = np.full(max(n, 1 << 20), base)
            table[0] = 1
            _powers[i] = np.cumprod(table, out=table)
    return _powers[0][:n], _powers[1][:n]


def window_hashes(buffer: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes that start at each position."""
    n = len(buffer)
    if n < k:
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(n)
    total = np.zeros(n + 1, np.uint64)
    np.add(buffer, np.uint64(1), out=total[1:], casting="unsafe")
    total[1:] *= power
    np.cumsum(total, out=total)
    h = total[k:] - total[:-k]
    h *= inverse[:n - k + 1]
    spread = h >> np.uint64(32)
    h ^= spread
    h *= _MIX
    np.right_shift(h, np.uint64(32), out=spread)
    h ^= spread
    return h


def _sliding_min(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w keys, by doubling the width of what is known."""
    out, width = keys, 1
    while width < w:
        step = min(width, w - width)
        out = np.minimum(out[:-step], out[step:])
        width += step
    return out


def anchor_runs(buffer: np.ndarray, ends: np.ndarray, length: int, k: int):
    """Deals every ``length``-byte window to the anchor it holds: the k bytes
    of the smallest hash (the leftmost such). Equal windows hold equal anchors.

    ``ends`` are the documents' ends in the buffer. Returns, for each run of
    windows with one anchor: document, anchor hash, start in the buffer, and
    the number of windows."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if len(buffer) > MAX_BUFFER:
        raise ValueError("buffer too large for one call")
    if len(buffer) < length:
        return none
    h = window_hashes(buffer, k)
    low = np.uint64((1 << _POS_BITS) - 1)
    keys = h & ~low
    keys |= np.arange(len(h), dtype=np.uint64)
    least = _sliding_min(keys, length - k + 1)
    begins = np.concatenate(([0], ends[:-1]))
    # runs end where the anchor changes, where a document begins, and behind its last whole window
    cuts = np.zeros(len(least) + 1, bool)
    cuts[0] = True
    np.not_equal(least[1:], least[:-1], out=cuts[1:-1])
    cuts[begins[begins < len(least)]] = True
    behind = ends - length + 1
    cuts[behind[(behind > 0) & (behind < len(least))]] = True
    cuts[-1] = True
    bounds = np.flatnonzero(cuts)
    start, count = bounds[:-1], np.diff(bounds)
    doc = np.searchsorted(ends, start, side="right")
    whole = start + length <= ends[doc]
    start, count, doc = start[whole], count[whole], doc[whole]
    return doc, h[(least[start] & low).astype(np.int64)], start, count
