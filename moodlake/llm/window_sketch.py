"""Removal of word windows that occur more than once, with a count-min sketch as a prefilter.

Documents are stored once, in chunks of about ``CHUNK_BYTES`` of text, bucketed by chunk; their texts are never
shuffled afterwards. A chunk counts its windows into a partial sketch and sends what it touched (each counter once, with
the mark "twice or more") to the sketch's shards. A shard merges the partial sketches of all chunks and answers each
chunk with a bit for every counter that it sent: was it reached twice? Counters are shared by windows, so counts are
overestimated, never under: a window with a counter below two occurs once for certain. The others go through a second
pass of the same form, which sends and counts their exact keys. So a chunk receives bits, a shard holds a bounded range
of counters or keys, and a window that a third of all documents hold reaches its shard once per chunk.

The sketch grows with the corpus: ``DEPTH`` rows of four to eight counters a window, cut into shards. Window keys of 96 bits stand for word sequences.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodlake.llm.common import bucketed, materialized, prepare, text_buffer
from moodlake.llm.words import SPACE, Words, mix, words_of

#: Words of a window.
SIZE = 35
#: Text bytes of a chunk (a longer text is a chunk of its own).
CHUNK_BYTES = 8 << 20
#: Counters of a shard, as powers of two: the least, the most, and how many shards there may be before they grow (a chunk
#: then still sends some thousand counters to each).
SHARD_BITS, MOST_SHARD_BITS, SHARDS_BITS = 22, 26, 10
DEPTH = 2

_SENT = {"part": pa.int64(), "chunk": pa.int64(), "n": pa.int32(), "keys": pa.binary(), "twice": pa.binary()}
_REPLY = {"chunk": pa.int64(), "part": pa.int64(), "bits": pa.binary()}
_SENT_DDL = "part long, chunk long, n int, keys binary, twice binary"
_REPLY_DDL = "chunk long, part long, bits binary"
_NEW = ["n_words", "n_removed", "kept", "kept_sha256"]


def _pack(flags: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(flags).tobytes(), 1)


def _unpack(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(data), np.uint8), count=n).astype(bool)


def _pack_ascending(values: np.ndarray) -> bytes:
    """Differences of 32 bits, stored byte by byte of significance: the high bytes are mostly zeros."""
    steps = np.diff(values, prepend=0).astype("<u4")
    return zlib.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack_ascending(data: bytes, n: int) -> np.ndarray:
    steps = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, n).T
    return np.cumsum(np.ascontiguousarray(steps).view("<u4").ravel(), dtype=np.int64)


def _as_table(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(types)
    return pa.Table.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, types.values())],
                                schema=pa.schema(list(types.items())))


def _window_starts(w: Words, size: int) -> np.ndarray:
    """Words that begin a window."""
    last = max(len(w.text) - size + 1, 0)
    return np.flatnonzero(w.text[:last] == w.text[size - 1:]) if last else np.zeros(0, np.int64)


def _window_hashes(w: Words, starts: np.ndarray, size: int, salt: int) -> np.ndarray:
    """A 64-bit hash of each window, put together from hashes of runs of 1, 2, 4, ... words."""
    run, length, at = mix(w.hashes, salt), 1, starts
    out = np.full(len(starts), salt, np.uint64)
    left = size
    while left:
        if left & 1:
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + run[at], salt + length)
            at = at + length
        left >>= 1
        if left:
            run = mix(run[:-length] * np.uint64(0xD6E8FEB86659FD93) + run[length:], salt + length) if len(run) > length else run[:0]
            length *= 2
    return out


def _counters(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(h, 0x5BF03635 * (row + 1)) >> np.uint64(64 - bits)


def _by_shard(values: np.ndarray, shards: int, shift: int) -> Iterator[tuple[int, int, int]]:
    """(shard, first, behind) of ascending values, without empty shards."""
    bounds = np.searchsorted(values, np.arange(1, shards, dtype=np.uint64) << np.uint64(shift)).tolist()
    for k, (lo, hi) in enumerate(zip([0, *bounds], [*bounds, len(values)])):
        if hi > lo:
            yield k, lo, hi


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their chunk and number of words (estimated by the spaces)."""
    chunk, size = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        data, ends = text_buffer(batch.column("text"))
        lengths = np.diff(ends, prepend=0)
        spaces = np.concatenate(([0], np.cumsum(SPACE[data], dtype=np.int64)))
        own = np.empty(len(ends), np.int64)
        for i, n in enumerate(lengths.tolist()):
            if size and size + n > CHUNK_BYTES:
                chunk, size = chunk + 1, 0
            own[i] = chunk
            size += n
        words = spaces[ends] - spaces[ends - lengths] + 1
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), pa.array(own), pa.array(words)],
                                         names=["row", "text", "chunk", "words"])


class _Plan:
    """What the passes agree on."""

    def __init__(self, size: int, windows: int):
        self.size = size
        self.bits = max(8, (4 * windows).bit_length())
        self.shard_bits = min(max(SHARD_BITS, min(self.bits - SHARDS_BITS, MOST_SHARD_BITS)), self.bits)
        self.shards = 1 << (self.bits - self.shard_bits)

    def key_shift(self) -> int:
        return 64 - (self.bits - self.shard_bits)

    def hashes(self, texts: pa.Table) -> tuple[Words, np.ndarray, np.ndarray]:
        w = words_of(*text_buffer(texts.column("text")))
        starts = _window_starts(w, self.size)
        return w, starts, _window_hashes(w, starts, self.size, 1)


def _first(plan: _Plan):
    """A chunk's partial sketch."""
    def run(texts: pa.Table) -> pa.Table:
        _, _, h = plan.hashes(texts)
        chunk, rows = texts.column("chunk")[0].as_py(), []
        for row in range(DEPTH if len(h) else 0):
            own, times = np.unique(_counters(h, row, plan.bits), return_counts=True)
            for k, lo, hi in _by_shard(own, plan.shards, plan.shard_bits):
                low = (own[lo:hi] & np.uint64((1 << plan.shard_bits) - 1)).astype(np.int64)
                rows.append((row * plan.shards + k, chunk, hi - lo, _pack_ascending(low), _pack(times[lo:hi] > 1)))
        return _as_table(rows, _SENT)
    return run


def _merge(plan: _Plan):
    """A shard of the merged sketch -> for each chunk, which of its counters reached two."""
    def run(sent: pa.Table) -> pa.Table:
        counts = np.zeros(1 << plan.shard_bits, np.uint8)       # they stop at two
        touched = []
        for n, keys, twice in zip(*(sent.column(c).to_pylist() for c in ("n", "keys", "twice"))):
            at = _unpack_ascending(keys, n).astype(np.uint32)
            counts[at] = np.minimum(counts[at] + np.uint8(1) + _unpack(twice, n), 2)
            touched.append(at)
        return _as_table([(c, p, _pack(counts[at] > 1)) for c, p, at in
                          zip(sent.column("chunk").to_pylist(), sent.column("part").to_pylist(), touched)], _REPLY)
    return run


def _bits(replies: list[tuple[int, bytes]], parts: list[tuple[int, int]]) -> np.ndarray:
    """The replies' bits in the order of ``parts``: (part, number of bits)."""
    by_part = dict(replies)
    return np.concatenate([_unpack(by_part[p], n) for p, n in parts]) if parts else np.zeros(0, bool)


def _replies(t: pa.Table) -> list[tuple[int, bytes]]:
    return list(zip(t.column("part").to_pylist(), t.column("bits").to_pylist()))


def _keys(w: Words, starts: np.ndarray, h: np.ndarray, open_: np.ndarray, size: int):
    """(order, first of each run of equal keys, h, k) of the open windows' keys, ascending."""
    own = h[open_]
    more = (_window_hashes(w, starts[open_], size, 2) >> np.uint64(32)).astype(np.uint32)
    order = np.lexsort((more, own))
    own, more = own[order], more[order]
    fresh = np.ones(len(own), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (more[1:] != more[:-1])
    return order, fresh, own, more


def _second(plan: _Plan):
    """A chunk with the sketch's replies -> the exact keys of the windows whose counters all reached two. Which those are
    goes along under the part -1 - chunk, for the last pass."""
    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        if not replies.num_rows:
            return _as_table([], _SENT)
        chunk, said, rows = texts.column("chunk")[0].as_py(), _replies(replies), []
        w, starts, h = plan.hashes(texts)
        open_ = np.ones(len(h), bool)
        for row in range(DEPTH):
            own, back = np.unique(_counters(h, row, plan.bits), return_inverse=True)
            parts = [(row * plan.shards + k, hi - lo) for k, lo, hi in _by_shard(own, plan.shards, plan.shard_bits)]
            open_ &= _bits(said, parts)[back]
        if not open_.any():
            return _as_table([], _SENT)
        _, fresh, own, more = _keys(w, starts, h, open_, plan.size)
        first = np.flatnonzero(fresh)
        times, own, more = np.diff(np.append(first, len(own))), own[first], more[first]
        for k, lo, hi in _by_shard(own, plan.shards, plan.key_shift()):
            rows.append((k, chunk, hi - lo, own[lo:hi].tobytes() + more[lo:hi].tobytes(), _pack(times[lo:hi] > 1)))
        rows.append((-1 - chunk, chunk, len(h), None, _pack(open_)))
        return _as_table(rows, _SENT)
    return run


def _count(sent: pa.Table) -> pa.Table:
    """A range of exact keys -> for each chunk, which of its keys occur twice or more in all."""
    parts, chunks, numbers, keys, twice = (sent.column(c).to_pylist() for c in _SENT)
    if parts[0] < 0:
        return _as_table([(chunks[0], parts[0], twice[0])], _REPLY)
    own = np.concatenate([np.frombuffer(k, np.uint64, n) for k, n in zip(keys, numbers)])
    more = np.concatenate([np.frombuffer(k, np.uint32, n, 8 * n) for k, n in zip(keys, numbers)])
    several = np.concatenate([_unpack(t, n) for t, n in zip(twice, numbers)])
    order = np.lexsort((more, own))
    own, more = own[order], more[order]
    same = (own[1:] == own[:-1]) & (more[1:] == more[:-1])
    several[order[1:]] |= same
    several[order[:-1]] |= same
    stops = np.cumsum(numbers)
    return _as_table([(c, p, _pack(several[b - n:b])) for c, p, n, b in zip(chunks, parts, numbers, stops.tolist())], _REPLY)


def _last(plan: _Plan, kept: list[str]):
    """A chunk with the replies to its keys -> its rows with what is left of each text."""
    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        w, starts, h = plan.hashes(texts)
        said = _replies(replies)
        covered = np.zeros(len(w.text) + 1, np.int32)
        if said:
            chunk = texts.column("chunk")[0].as_py()
            open_ = _unpack(dict(said)[-1 - chunk], len(h))
            order, fresh, own, _ = _keys(w, starts, h, open_, plan.size)
            parts = [(k, hi - lo) for k, lo, hi in _by_shard(own[fresh], plan.shards, plan.key_shift())]
            repeated = np.empty(len(own), bool)
            repeated[order] = _bits(said, parts)[np.cumsum(fresh) - 1]
            begin = starts[open_][repeated]
            covered[begin] += 1
            covered[begin + plan.size] -= 1
        stay = np.cumsum(covered[:-1]) == 0
        data, _ = text_buffer(texts.column("text"))
        text, ends = _joined(data, w, stay)
        raw = memoryview(text)
        begins = np.concatenate(([0], ends[:-1]))
        digests = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(begins.tolist(), ends.tolist())]
        gone = w.counts - np.bincount(w.text[stay], minlength=len(w.counts))
        left = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [
            None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int64).tobytes()), pa.py_buffer(text)]).cast(pa.large_string()).cast(pa.string())
        columns = [texts.column("row"), *([texts.column("text")] if "text" in kept else []), pa.array(w.counts), pa.array(gone), left, pa.array(digests)]
        return pa.Table.from_arrays(columns, names=["row", *["text"] * ("text" in kept), *_NEW])
    return run


def _joined(data: np.ndarray, w: Words, stay: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words that stay, joined by one space in each text: all bytes, and the texts' ends in them."""
    starts, stops, text = w.starts[stay], w.stops[stay], w.text[stay]
    more = np.zeros(len(text), np.int64)                        # a space follows within the text
    more[:-1] = text[1:] == text[:-1]
    copied = data.copy()
    copied[stops[more > 0]] = 0x20
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[stops + more] -= 1
    sizes = np.bincount(text, weights=stops - starts + more, minlength=len(w.counts)).astype(np.int64)
    return copied[np.cumsum(inside[:-1], dtype=np.int8) > 0].tobytes(), np.cumsum(sizes)


def remove_windows(docs: DataFrame, size: int = SIZE, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_words, n_removed, kept (the words that stay, joined by one space) and kept_sha256.

    Words are maximal runs of characters other than space, \\t, \\n, \\v, \\f and \\r. Each word covered by a window of
    ``size`` words that also starts anywhere else in the texts, the same text included, is removed; windows never cross
    texts, compare words as they are, and are judged on the input. A null, empty or blank text has no words; texts of
    fewer words stay whole; of equal longer texts every word goes, repeated rows included. An empty table gives no
    rows. ``keep``: the columns to keep (default all); columns with the new names are replaced."""
    spark = docs.sparkSession
    prepare(spark)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in _NEW]
    rows = docs.select(F.struct(F.lit(True).alias("_"), *[c for c in kept if c != "text"]).alias("row"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    chunks = bucketed(rows.mapInArrow(_chunks, f"row {kind}, text string, chunk long, words long"), ["chunk"], "chunks")
    plan = _Plan(size, chunks.agg(F.sum("words")).first()[0] or 0)
    texts = chunks.select("chunk", "text")

    sent = texts.groupBy("chunk").applyInArrow(_first(plan), _SENT_DDL)
    replies = materialized(sent.groupBy("part").applyInArrow(_merge(plan), _REPLY_DDL), "sketch")
    sent = texts.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_second(plan), _SENT_DDL)
    replies = materialized(sent.groupBy("part").applyInArrow(_count, _REPLY_DDL), "counts")
    carried = "text string, " * ("text" in kept)
    made = (chunks.drop("words").groupBy("chunk").cogroup(replies.groupBy("chunk"))
            .applyInArrow(_last(plan, kept), f"row {kind}, {carried}n_words long, n_removed long, kept string, kept_sha256 string"))
    return made.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in kept], *_NEW)
