"""Best-fit packing of documents into sequences of fixed capacity, under conflicts.

A sequence (bin) holds at most one item of a source and one of a duplicate cluster; each bin carries both
sets as bitmaps. Documents are dealt by hash to shards of about ``SHARD_ITEMS``; a shard takes its items from
long to short, keeps its bins ordered by what room they have left, and searches from the first bin with room
enough upwards until the bitmaps allow one: the tightest compatible bin. Without one it opens a bin.

A document longer than the capacity fills bins of its own with whole pieces; its last piece is packed.
Shards are independent, so a source or cluster with a third of all rows is spread over all of them.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodlake.llm.common import as_batch, prepare, shuffle_partitions

#: Words of a sequence.
CAPACITY = 2048
#: Documents that a shard holds on average.
SHARD_ITEMS = 8192
_BIN = (1 << 32) - 1


class Bins:
    """Open bins ordered by residual capacity."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.order: list[int] = []                  # residual * 2**32 + bin, ascending
        self.masks: list[int] = []
        self.used: list[int] = []

    def full(self, mask: int) -> int:
        """A bin that one piece fills."""
        self.masks.append(mask)
        self.used.append(self.capacity)
        return len(self.used) - 1

    def place(self, length: int, mask: int) -> tuple[int, int]:
        """(bin, offset in it) of the tightest bin with room that shares no bit with ``mask``."""
        order, masks = self.order, self.masks
        for i in range(bisect_left(order, length << 32), len(order)):
            b = order[i] & _BIN
            if not masks[b] & mask:
                del order[i]
                break
        else:
            b = len(masks)
            masks.append(0)
            self.used.append(0)
        at = self.used[b]
        self.used[b] += length
        masks[b] |= mask
        if self.used[b] < self.capacity:
            insort(order, (self.capacity - self.used[b] << 32) | b)
        return b, at


def pack_shard(items: list[tuple[int, object, object]], capacity: int) -> list[list[tuple[int, int, int, int]]]:
    """Items (length, source, cluster), longest first -> per item its pieces (piece, length, bin, offset).
    Null sources and clusters conflict with nothing."""
    bits: dict[tuple, int] = {}
    held: dict[tuple, int] = {}
    for _, source, cluster in items:
        for key in ((0, source), (1, cluster)):
            held[key] = held.get(key, 0) + 1
    for key, n in held.items():
        if n > 1 and key[1] is not None:            # a bit only where a conflict can arise
            bits[key] = 1 << len(bits)
    bins, out = Bins(capacity), []
    for length, source, cluster in items:
        mask = bits.get((0, source), 0) | bits.get((1, cluster), 0)
        whole, rest = divmod(length, capacity)
        pieces = [(k, capacity, bins.full(mask), 0) for k in range(whole)]
        if rest:
            pieces.append((whole, rest, *bins.place(rest, mask)))
        out.append(pieces)
    return out


def _pack(capacity: int, key_type: pa.DataType):
    types = {"shard": pa.int32(), "item": key_type, "piece": pa.int32(), "length": pa.int64(), "bin": pa.int64(),
             "offset": pa.int64()}

    def shard_rows(shard: int, rows: list[tuple]) -> pa.RecordBatch:
        done = pack_shard([r[1:] for r in rows], capacity)
        out = [(shard, r[0], *piece) for r, pieces in zip(rows, done) for piece in (pieces or [(0, 0, None, None)])]
        return as_batch(dict(zip(types, map(list, zip(*out)))), types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        last = None
        for batch in batches:
            for shard, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "item", "length", "source", "cluster"))):
                if rows and shard != last:
                    yield shard_rows(last, rows)
                    rows = []
                last = shard
                rows.append(tuple(row))
        if rows:
            yield shard_rows(last, rows)
    return run


def pack(docs: DataFrame, item: Column, length: Column, source: Column, cluster: Column, n_docs: int,
         capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: shard, item, piece, length, bin (long, unique with its shard) and offset in the bin.

    Items of no length (or a null one) have one row with length 0 and no bin. ``item`` is carried through and need
    not be unique or set; rows that agree in all four columns go to one shard. ``n_docs`` sets the number of shards."""
    spark = docs.sparkSession
    prepare(spark)
    shards = max(1, -(-n_docs // SHARD_ITEMS))
    rows = docs.select(item.alias("item"), F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0)).alias("length"),
                       source.alias("source"), cluster.alias("cluster"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("item", "length", "source", "cluster"), F.lit(shards)).cast("int"))
    kind = rows.schema["item"].dataType
    key_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]
    return (rows.repartition(shuffle_partitions(spark), "shard")
            .sortWithinPartitions("shard", F.desc("length"), "source", "cluster", "item")
            .mapInArrow(_pack(capacity, key_type), f"shard int, item {kind.simpleString()}, piece int, length long, "
                                                   "bin long, offset long"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Packs documents by words (runs of characters other than ASCII spaces; a null text has none). Duplicate
    cluster: the same words in the same order, case apart. Columns: doc_id, piece, n_words, shard, bin, offset."""
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    same = F.xxhash64(F.trim(F.lower(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))))
    packed = pack(docs, F.col("doc_id"), words, F.col("source"), same, docs.count(), capacity)
    return packed.select(F.col("item").alias("doc_id"), "piece", F.col("length").alias("n_words"), "shard", "bin", "offset")
