"""Removal of byte strings that occur more than once in a corpus, found with a
column-wise multi-document suffix construction (``column_bwt``).

Every ``length``-byte window belongs to the anchor it holds (the k bytes of the
smallest hash), so equal windows have equal anchors, and all windows of one
anchor form a short string around it. Strings are dealt by anchor into
collections of bounded size; in each, the Burrows-Wheeler transform and the
common prefixes are built column by column, and a window is repeated when its
suffix shares ``length`` symbols with a neighbour.

What keeps the work small and even:

- equal texts are one text with a count (combined before the shuffle);
- only anchors that occur twice or more are cut out of the texts;
- equal strings are one string with a count; a string with a count of two or
  more is repeated as a whole, and a single string whose anchor has no other
  distinct string is settled without a construction;
- an anchor with more than ``HOT_STRINGS`` distinct strings (a passage that many
  documents share, each with its own surroundings) is split: its strings are cut
  into ranges of window offsets and dealt by the bytes that all windows of a
  range have in common, first in ranges, at last window by window. No group
  reaches a task whole, whatever its size, and no window is skipped.

The result is exact; hashes only deal the work (128 bits stand for a string).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodlake.llm.column_bwt import anchor_runs, repeated_starts, window_hashes
from moodlake.llm.common import (as_batch, byte_chunks, distinct_texts, materialized, prepare,
                                 shuffle_partitions, text_buffer, text_key)

#: Bytes of a removable string.
LENGTH = 200
#: Bytes of an anchor.
ANCHOR = 64
#: Distinct strings of one anchor that a task takes at once.
HOT_STRINGS = 4096
#: Symbols of one collection (whole anchors; at least one).
COLLECTION_BYTES = 600_000
#: Bytes of a text that are scanned for anchors at once.
PIECE_BYTES = 16 << 20
#: Ranges of window offsets that a string is cut into before the construction.
SETTLE_RANGES = 4

#: ``more`` holds what a text repeats, packed as 32-bit integers: further (start, n) of an anchor, or starts of a string.
_RUNS = {"h": pa.int64(), "c1": pa.int64(), "c2": pa.int64(), "start": pa.int32(), "n": pa.int32(), "more": pa.binary()}
_STRING = {"h": pa.int64(), "f1": pa.int64(), "f2": pa.int64(), "c1": pa.int64(), "c2": pa.int64(),
           "start": pa.int32(), "n": pa.int32(), "copies": pa.int64()}
_CUT = _STRING | {"more": pa.binary()}
_SPANS = {"c1": pa.int64(), "c2": pa.int64(), "start": pa.int32(), "stop": pa.int32()}
_STRINGS = _STRING | {"bytes": pa.binary()}


def _ddl(types: dict[str, pa.DataType]) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{k} {names[t]}" for k, t in types.items())


def _digest(data: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _anchors(data: np.ndarray, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """``anchor_runs`` of texts; a text longer than ``PIECE_BYTES`` goes in pieces that overlap by ``length - 1`` bytes, so
    each window lies in one of them (an anchor depends on its window alone)."""
    if len(data) <= PIECE_BYTES or len(ends) > 1:
        return anchor_runs(data, ends, length, k)
    found = []
    for lo in range(0, len(data), PIECE_BYTES):
        piece = data[lo:lo + PIECE_BYTES + length - 1]
        doc, h, start, n = anchor_runs(piece, np.array([len(piece)]), length, k)
        found.append((doc, h, start + lo, n))
    return tuple(map(np.concatenate, zip(*found)))


def _runs(length: int, k: int):
    """Texts -> one row per text and anchor with its runs of windows (a text that repeats itself holds an anchor
    many times, and is one row of it all the same)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = text_buffer(batch.column("text"))
            keys = [batch.column(c).to_numpy() for c in ("c1", "c2")]
            for lo, hi in byte_chunks(ends):
                begin = ends[lo - 1] if lo else 0
                own = ends[lo:hi] - begin
                doc, h, start, n = _anchors(data[begin:ends[hi - 1]], own, length, k)
                begins = np.concatenate(([0], own[:-1]))
                order = np.lexsort((start, h, doc))
                doc, h, start, n = doc[order], h[order], (start - begins[doc])[order], n[order]
                fresh = np.ones(len(doc), bool)
                fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(fresh)
                after = np.append(first[1:], len(doc))
                more: list[bytes | None] = [None] * len(first)
                pairs = np.stack((start, n), axis=1).astype("<i4")
                for i in np.flatnonzero(after - first > 1).tolist():
                    more[i] = pairs[first[i] + 1:after[i]].tobytes()
                yield as_batch({"h": h[first].view(np.int64), "c1": keys[0][lo:hi][doc[first]],
                                "c2": keys[1][lo:hi][doc[first]], "start": start[first].astype(np.int32),
                                "n": n[first].astype(np.int32), "more": more}, _RUNS)
    return run


def _cut(length: int, with_bytes: bool):
    """Texts with their runs -> the runs' strings: one row per text and distinct string as hashes and starts, or the
    one run that is asked for with its bytes."""
    types = _STRINGS if with_bytes else _CUT

    def rows(batch: pa.RecordBatch, lo: int, hi: int) -> Iterator[tuple]:
        c1, c2, copies, runs = (batch.column(c).slice(lo, hi - lo).to_pylist() for c in ("c1", "c2", "copies", "runs"))
        data, ends = text_buffer(batch.column("text").slice(lo, hi - lo))
        raw = data.tobytes()
        for i, own in enumerate(runs):
            begin = int(ends[i - 1]) if i else 0
            for r in own:
                if with_bytes:
                    piece = raw[begin + r["start"]:begin + r["start"] + r["n"] + length - 1]
                    yield r["h"], r["f1"], r["f2"], c1[i], c2[i], r["start"], r["n"], r["copies"], piece
                    continue
                found: dict[bytes, list[int]] = {}
                found.setdefault(raw[begin + r["start"]:begin + r["start"] + r["n"] + length - 1], []).append(r["start"])
                if r["more"]:
                    for start, n in np.frombuffer(r["more"], "<i4").reshape(-1, 2).tolist():
                        found.setdefault(raw[begin + start:begin + start + n + length - 1], []).append(start)
                for piece, starts in found.items():
                    yield (r["h"], *_digest(piece), c1[i], c2[i], starts[0], len(piece) - length + 1,
                           copies[i] * len(starts), np.array(starts[1:], "<i4").tobytes() if starts[1:] else None)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, ends = text_buffer(batch.column("text"))
            for lo, hi in byte_chunks(ends):
                out = list(zip(*rows(batch, lo, hi)))
                if out:
                    yield as_batch(dict(zip(types, map(list, out))), types)
    return cut


def _ranges(lead: int, n: int, length: int, width: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Cuts a string's n windows into ranges of the anchor's offset in the window: (range, first and
    last window, bounds of the bytes that all windows of the range hold). ``lead``: the anchor's
    offset in the string. Equal windows fall into equal ranges with equal common bytes."""
    for at in range((lead - (n - 1)) // width, lead // width + 1):
        low, high = at * width, at * width + width - 1
        yield at, max(lead - high, 0), min(lead - low, n - 1), lead - low, lead - high + length


def _leads(data: np.ndarray, ends: np.ndarray, h: np.ndarray, k: int) -> np.ndarray:
    """The anchor's offset in each string: its first k bytes with hash h."""
    lengths = np.diff(ends, prepend=0)
    begins = ends - lengths
    hashes = window_hashes(data, k)
    owner = np.repeat(np.arange(len(ends)), lengths)[:len(hashes)]
    at = np.flatnonzero((hashes == h.view(np.uint64)[owner]) & (np.arange(len(hashes)) + k <= ends[owner]))
    own, first = np.unique(owner[at], return_index=True)
    return at[first] - begins[own]


def _settle(length: int, k: int):
    """Strings sorted by anchor -> spans of repeated windows of the strings held by one text only.

    A collection's strings are first cut into ranges of window offsets. Equal pieces are settled by
    their count; the pieces that share a range's common bytes and differ go through the column-wise
    construction."""
    width = -(-(length - k + 1) // SETTLE_RANGES)

    def one(group: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(group)
        data, ends = text_buffer(t.column("bytes"))
        raw, h = data.tobytes(), t.column("h").to_numpy()
        begins = np.concatenate(([0], ends[:-1])).tolist()
        copies, counts = t.column("copies").to_numpy().tolist(), t.column("n").to_numpy().tolist()
        found: dict[tuple, dict[bytes, list]] = {}
        leads = t.column("lead").to_numpy() if "lead" in t.column_names else _leads(data, ends, h, k)
        for i, (lead, key) in enumerate(zip(leads.tolist(), h.tolist())):
            b = begins[i]
            for at, first, last, low, high in _ranges(lead, counts[i], length, width):
                own = found.setdefault((key, at, raw[b + low:b + high]), {})
                own.setdefault(raw[b + first:b + last + length], []).append((i, first, last))
        spans, pieces, owners = [], [], []
        for own in found.values():
            for piece, held in own.items():
                several = len(held) > 1 or copies[held[0][0]] > 1
                if several:
                    spans += [x for x in held if copies[x[0]] == 1]
                if len(own) > 1:
                    pieces.append(piece)
                    owners.append((-1, 0) if several else held[0][:2])
        if pieces:
            lengths = np.array([len(x) for x in pieces])
            starts = np.cumsum(lengths) - lengths
            flags = repeated_starts(np.frombuffer(b"".join(pieces), np.uint8), starts, lengths, length)
            whose = np.repeat(np.arange(len(pieces)), lengths)
            flags &= np.array([x[0] >= 0 for x in owners])[whose]
            at = np.flatnonzero(flags)
            fresh = np.ones(len(at), bool)
            fresh[1:] = (at[1:] != at[:-1] + 1) | (whose[at[1:]] != whose[at[:-1]])
            last = at[np.append(np.flatnonzero(fresh)[1:] - 1, len(at) - 1)] if len(at) else at
            for q, x, y in zip(whose[at[fresh]].tolist(), at[fresh].tolist(), last.tolist()):
                i, first = owners[q]
                spans.append((i, first + x - int(starts[q]), first + y - int(starts[q])))
        own, first, last = (np.array(x, np.int64) for x in (zip(*spans) if spans else ([], [], [])))
        start = t.column("start").to_numpy()[own]
        return as_batch({"c1": t.column("c1").to_numpy()[own], "c2": t.column("c2").to_numpy()[own],
                         "start": (start + first).astype(np.int32),
                         "stop": (start + last + length).astype(np.int32)}, _SPANS)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            h = batch.column("h").to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))).tolist()
            ends = text_buffer(batch.column("bytes"))[1]
            for lo, hi in zip(starts, [*starts[1:], len(h)]):
                if size >= COLLECTION_BYTES and h[lo] != last:
                    yield one(group)
                    group, size = [], 0
                group.append(batch.slice(lo, hi - lo))
                size += int(ends[hi - 1] - (ends[lo - 1] if lo else 0))
                last = h[lo]
        if group:
            yield one(group)
    return settle


def _split(length: int, k: int, width: int):
    """Strings of hot anchors -> their parts, one per range of ``width`` window offsets, keyed by
    the bytes that all windows of the range hold. ``lead`` is the anchor's offset in the string."""
    types = _STRINGS | {"lead": pa.int32()}

    def parts(r: dict) -> Iterator[tuple]:
        data, lead = r["bytes"], r["lead"]
        for at, first, last, low, high in _ranges(lead, r["n"], length, width):
            key = at.to_bytes(4, "little") + (r["h"] & (1 << 64) - 1).to_bytes(8, "little")
            piece = data[first:last + length]
            yield (_digest(data[low:high] + key)[0], *_digest(piece), r["c1"], r["c2"], r["start"] + first,
                   last - first + 1, r["copies"], piece, lead - first)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out = list(zip(*(x for r in batch.slice(lo, 256).to_pylist() for x in parts(r))))
                if out:
                    yield as_batch(dict(zip(types, map(list, out))), types)
    return split


def _erase(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their spans -> what is left of each."""
    types = {"c1": pa.int64(), "c2": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(),
             "n_spans": pa.int64(), "kept": pa.binary(), "kept_sha256": pa.string()}
    for batch in batches:
        data, ends = text_buffer(batch.column("text"))
        for lo, hi in byte_chunks(ends):
            out = []
            for i, spans in zip(range(lo, hi), batch.column("spans").slice(lo, hi - lo).to_pylist()):
                text = data[ends[i - 1] if i else 0:ends[i]].tobytes()
                kept, merged, at = [], 0, 0
                stop = -1
                bounds = [(s["start"], s["stop"]) for s in spans or ()]
                for s in spans or ():
                    if s["more"]:
                        bounds += [(x, x + s["stop"] - s["start"]) for x in np.frombuffer(s["more"], "<i4").tolist()]
                for s in sorted(bounds):
                    if s[0] > stop:
                        kept.append(text[at:s[0]])
                        merged += 1
                    stop = max(stop, s[1])
                    at = stop
                kept.append(text[at:])
                left = b"".join(kept)
                out.append((len(text), len(text) - len(left), merged, left, hashlib.sha256(left).hexdigest()))
            n, removed, spans, left, sha = map(list, zip(*out))
            yield as_batch({"c1": batch.column("c1").slice(lo, hi - lo), "c2": batch.column("c2").slice(lo, hi - lo),
                            "n_bytes": n, "n_removed": removed, "n_spans": spans, "kept": left,
                            "kept_sha256": sha}, types)


def repeated_spans(texts: DataFrame, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """Byte ranges [start, stop) of each distinct text (c1, c2) whose ``length``-byte windows also
    start elsewhere; ``more`` holds further starts of ranges as long. ``texts`` comes from ``distinct_texts``. Ranges may
    overlap or touch."""
    spark = texts.sparkSession
    parts = shuffle_partitions(spark)
    # scanned twice: anchors take more room than a scan takes time
    runs = texts.mapInArrow(_runs(length, k), _ddl(_RUNS))
    # unique keys as a table of their own: the joins then shuffle both sides, and a hot key's rows can be split
    twice = materialized(texts.mapInArrow(_runs(length, k), _ddl(_RUNS)).groupBy("h").agg(F.sum(F.lit(1) + F.coalesce(F.octet_length("more"), F.lit(0))).alias("seen"))
                         .filter("seen > 1").select("h"), "twice")
    by_text = (runs.join(twice, "h").groupBy("c1", "c2")
               .agg(F.collect_list(F.struct("h", "start", "n", "more")).alias("runs")))
    cut = materialized(texts.join(by_text, ["c1", "c2"]).mapInArrow(_cut(length, False), _ddl(_CUT)), "runs")

    groups = materialized(cut.groupBy("h", "f1", "f2").agg(F.sum("copies").alias("copies"),
                                                          F.min(F.struct("c1", "c2", "start", "n")).alias("one")), "groups")
    whole = groups.filter("copies > 1").select("h", "f1", "f2")
    spans = cut.join(whole, ["h", "f1", "f2"]).select(
        "c1", "c2", "start", (F.col("start") + F.col("n") + F.lit(length - 1)).cast("int").alias("stop"), "more")

    sizes = materialized(groups.groupBy("h").agg(F.count(F.lit(1)).alias("strings")).filter("strings > 1"), "sizes")
    open_ = groups.join(sizes, "h")
    wanted = (open_.select("h", "f1", "f2", "copies", "strings", "one.*").groupBy("c1", "c2")
              .agg(F.collect_list(F.struct("h", "f1", "f2", "start", "n", "copies")).alias("runs")))
    strings = texts.drop("copies").join(wanted, ["c1", "c2"]).withColumn("copies", F.lit(1).cast("long")) \
        .mapInArrow(_cut(length, True), _ddl(_STRINGS))

    hot = sizes.filter(F.col("strings") > HOT_STRINGS).select("h")
    if not hot.isEmpty():
        strings = materialized(strings, "strings")
        hot = materialized(hot, "hot")
        spans = spans.unionByName(_hot_spans(strings.join(hot, "h"), length, k), allowMissingColumns=True)
        strings = strings.join(hot, "h", "left_anti")
    settled = (strings.repartition(parts, "h").sortWithinPartitions("h", "f1", "f2")
               .mapInArrow(_settle(length, k), _ddl(_SPANS)))
    return spans.unionByName(settled, allowMissingColumns=True)


def _hot_spans(strings: DataFrame, length: int, k: int) -> DataFrame:
    """Spans of the strings whose anchor has too many distinct strings for one task."""
    strings = strings.mapInArrow(_with_lead(length, k), _ddl(_STRINGS | {"lead": pa.int32()}))
    found = None
    width = max(2, round((length - k + 1) ** 0.5))
    for width in (width, 1):
        pieces = materialized(strings.mapInArrow(_split(length, k, width), _ddl(_STRINGS | {"lead": pa.int32()})),
                              "parts")
        groups = pieces.groupBy("h", "f1", "f2").agg(
            F.sum("copies").alias("total"),
            F.min(F.struct("c1", "c2", "start", "n", "copies", "bytes", "lead")).alias("one"))
        own = pieces.filter("copies = 1").join(groups.filter("total > 1").select("h", "f1", "f2"), ["h", "f1", "f2"])
        spans = own.select("c1", "c2", "start",
                           (F.col("start") + F.col("n") + F.lit(length - 1)).cast("int").alias("stop"))
        found = spans if found is None else found.unionByName(spans)
        if width == 1:
            return found                               # equal keys are equal windows: all settled
        sizes = groups.groupBy("h").agg(F.count(F.lit(1)).alias("strings")).filter("strings > 1")
        rest = groups.join(sizes, "h").select("h", "f1", "f2", "one.c1", "one.c2", "one.start", "one.n",
                                              F.col("total").alias("copies"), "one.bytes", "one.lead", "strings")
        cold = rest.filter(F.col("strings") <= HOT_STRINGS).drop("strings")
        found = found.unionByName(
            cold.repartition(shuffle_partitions(strings.sparkSession), "h").sortWithinPartitions("h", "f1", "f2")
            .mapInArrow(_settle(length, k), _ddl(_SPANS)))
        strings = rest.filter(F.col("strings") > HOT_STRINGS).drop("strings")
    return found


def _with_lead(length: int, k: int):
    """Adds the anchor's offset to each string."""
    types = _STRINGS | {"lead": pa.int32()}

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leads = _leads(*text_buffer(batch.column("bytes")), batch.column("h").to_numpy(), k)
            yield as_batch({c: batch.column(c) for c in _STRINGS} | {"lead": leads}, types)
    return lead


def whole_characters(kept: Column) -> Column:
    """What is left of a text as a string, without the bytes of characters that were cut in two."""
    @F.pandas_udf("string")
    def decoded(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else bytes(x).decode("utf-8", "ignore"))
    return decoded(kept)


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """``docs`` with the columns n_bytes, n_removed, n_spans, kept (binary) and kept_sha256.

    Each byte covered by a ``length``-byte string that also starts anywhere else in the texts, the
    same text included, is removed; matches never cross texts and are judged on the input. A null
    text counts as empty; texts shorter than ``length`` bytes stay whole; of equal longer texts
    every byte goes. All rows and columns of ``docs`` are kept; existing columns of those names
    are replaced."""
    prepare(docs.sparkSession)
    texts = distinct_texts(docs)
    spans = (repeated_spans(texts, length, k).groupBy("c1", "c2")
             .agg(F.collect_list(F.struct("start", "stop", "more")).alias("spans")))
    whole = F.when((F.col("copies") > 1) & (F.octet_length("text") >= length),
                   F.array(F.struct(F.lit(0).alias("start"), F.octet_length("text").alias("stop"),
                                    F.lit(None).cast("binary").alias("more"))))
    judged = (texts.join(spans, ["c1", "c2"], "left").withColumn("spans", F.coalesce(whole, "spans")).drop("copies")
              .mapInArrow(_erase, "c1 long, c2 long, n_bytes long, n_removed long, n_spans long, kept binary, "
                                  "kept_sha256 string"))
    new = ["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
    left = docs.drop(*new).select(F.struct("*").alias("row"),
                                  *text_key(F.coalesce("text", F.lit(""))))
    return left.join(judged, ["c1", "c2"]).select("row.*", *new)
