"""Jaccard self-join on word n-grams with MinHash bands, and the classes it links.

1. Equal texts become one node with a count (combined before the shuffle).
2. Each text's n-gram set gets MinHash values, cut into bands; bands and rows follow from the target
   recall at the threshold. Band hashes that only one text has are dropped.
3. In each bucket, texts whose whole signatures agree in at least ``LOOSE`` of the places are tied by a
   spanning forest, never by all pairs; its components are the groups that may hold links.
4. Every pair within a group is verified on the full n-gram sets, in matrices inside a task; only link
   counts and a spanning forest of the links leave it. The forest's components are the classes.

Buckets and groups of more than ``BLOCK`` members are cut into blocks by hash, and each pair of blocks is a
task's work of its own: nothing is capped, and no group comes to one task whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodlake.llm.common import (as_batch, bucketed, byte_chunks, materialized, prepare, shuffle_partitions, text_buffer)
from moodlake.llm.components import components
from moodlake.llm.words import mix, shingles, words_of

SIZE, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Hash functions that a signature may have.
MOST_HASHES = 80
#: Share of agreeing signature places from which two texts of a bucket are grouped.
LOOSE = 0.5
#: Members of a bucket or group that a task takes at once.
BLOCK = 1024
BLOCK_BYTES = 8 << 20
#: Bytes of texts that a verifying task gathers before it works.
GATHER_BYTES = 4 << 20


def choose_bands(threshold: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows) of the most selective signature of at most ``most`` hashes that puts a pair at the
    threshold into a common bucket with probability ``recall``."""
    for rows in range(int(math.log(0.01) / math.log(threshold)) + 1, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no signature of that many hashes reaches the recall")


def _signatures(size: int, bands: int, rows: int):
    """Texts -> nodes with their band hashes and 16 bits of every MinHash value. Texts without words: none."""
    types = {"node": pa.binary(), "bands": pa.list_(pa.int64()), "signature": pa.binary()}
    seeds = mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64))
    adds, factors = seeds[::2], seeds[1::2] | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = text_buffer(batch.column("text"))
            nodes = batch.column("node")
            for lo, hi in byte_chunks(ends):
                begin = ends[lo - 1] if lo else 0
                text, h = shingles(words_of(data[begin:ends[hi - 1]], ends[lo:hi] - begin), size)
                if not len(h):
                    continue
                own, first = np.unique(text, return_index=True)
                low = np.empty((len(own), bands * rows), np.uint32)
                for i in range(bands * rows):
                    low[:, i] = np.minimum.reduceat(((h ^ adds[i]) * factors[i]) >> np.uint64(32), first)
                key = np.zeros((len(own), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
                for r in range(rows):
                    key = mix(key) + low[:, r::rows].astype(np.uint64)
                short = np.ascontiguousarray(low.astype(np.uint16))
                yield as_batch({"node": nodes.slice(lo, hi - lo).take(pa.array(own)),
                                "bands": pa.ListArray.from_arrays(np.arange(0, key.size + 1, bands, dtype=np.int32),
                                                                  mix(key).view(np.int64).ravel()),
                                "signature": [x.tobytes() for x in short]}, types)
    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], full) -> Iterator[pa.Table]:
    """Runs of rows with equal keys in a sorted stream, several at once until ``full(size)`` bytes."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() if not pa.types.is_binary(batch.schema.field(k).type)
                   else np.array(batch.column(k).to_pylist(), object) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is None or any(c[0] != x for c, x in zip(columns, last))
        cuts = np.flatnonzero(change).tolist()
        last = [c[-1] for c in columns]
        begin = 0
        for cut in cuts:
            if cut > begin:
                held.append(batch.slice(begin, cut - begin))
            if held and full(held):
                yield pa.Table.from_batches(held)
                held = []
            begin = cut
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def _runs(t: pa.Table, keys: list[str]) -> Iterator[pa.Table]:
    """The groups inside a table sorted by its keys."""
    columns = [np.array(t.column(k).to_pylist(), object) for k in keys]
    change = np.ones(t.num_rows, bool)
    for i in range(1, t.num_rows):
        change[i] = any(c[i] != c[i - 1] for c in columns)
    cuts = [*np.flatnonzero(change).tolist(), t.num_rows]
    for lo, hi in zip(cuts, cuts[1:]):
        yield t.slice(lo, hi - lo)


def _blocked(df: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """Rows with the pair of blocks (p <= q) they are compared in and their own block; a key of at
    most BLOCK members (and BLOCK_BYTES bytes) has the one pair (0, 0). ``sizes``: key, members, bytes."""
    n = F.ceil(F.greatest(F.col("members") / F.lit(float(BLOCK)), F.col("bytes") / F.lit(float(BLOCK_BYTES)))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    return (df.join(sizes, key).withColumn("n", n).withColumn("block", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
            .withColumn("other", other).withColumn("p", F.least("block", "other")).withColumn("q", F.greatest("block", "other"))
            .drop("members", "bytes", "n", "other"))


def _forest(close, n: int) -> list[tuple[int, int]]:
    """Spanning forest of the relation: ``close(i, rest)`` tells which of ``rest`` i is tied to."""
    rest, out = np.arange(n), []
    while len(rest):
        root, rest = rest[0], rest[1:]
        queue = [root]
        while queue and len(rest):
            i = queue.pop()
            tied = close(i, rest)
            near, rest = rest[tied], rest[~tied]
            out += [(int(root), int(x)) for x in near]
            queue += near.tolist()
    return out


def _tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets -> forest edges between texts whose signatures agree loosely."""
    types = {"a": pa.binary(), "b": pa.binary()}
    keys = ["key", "p", "q"]
    for t in _groups(batches, keys, lambda held: sum(x.num_rows for x in held) >= 4096):
        edges = set()
        node = t.column("node").to_pylist()
        places = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint16).reshape(len(node), -1)
        columns = [t.column(k).to_numpy() for k in keys]
        change = np.ones(len(node), bool)
        change[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        cuts = [*np.flatnonzero(change).tolist(), len(node)]
        enough = LOOSE * places.shape[1]
        for lo, hi in zip(cuts, cuts[1:]):
            own = places[lo:hi]
            for x, y in _forest(lambda i, rest: (own[rest] == own[i]).sum(1) >= enough, hi - lo):
                edges.add((node[lo + x], node[lo + y]) if node[lo + x] < node[lo + y] else (node[lo + y], node[lo + x]))
        if edges:
            a, b = map(list, zip(*edges))
            yield as_batch({"a": a, "b": b}, types)


def _verify(size: int, threshold: float):
    """Groups -> (a, a, documents linked to a) and forest edges (a, b, 0) of the links."""
    types = {"a": pa.binary(), "b": pa.binary(), "links": pa.int64()}
    keys = ["root", "p", "q"]

    def links(t: pa.Table) -> tuple[list, list, list]:
        data, ends = text_buffer(t.column("text"))
        text, h = shingles(words_of(data, ends), size)
        node, copies = t.column("node").to_pylist(), t.column("copies").to_numpy()
        block = t.column("block").to_numpy()
        cross = t.column("p")[0].as_py() != t.column("q")[0].as_py()
        n = len(node)
        both = np.unique(np.stack((h, text.astype(np.uint64)), axis=1), axis=0)     # each n-gram once per text
        h, text = both[:, 0], both[:, 1].astype(np.int64)
        sizes = np.bincount(text, minlength=n)
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        # n-grams that the same texts hold weigh as one
        held = np.add.reduceat(mix(text.astype(np.uint64) + np.uint64(1)), first) if len(h) else h
        count = np.diff(np.append(first, len(h)))
        _, one, weight = np.unique(held, return_index=True, return_counts=True)
        shared = count[one] > 1
        one, weight = one[shared], weight[shared]
        common = np.zeros((n, n), np.float32)
        for lo in range(0, len(one), 2048):
            some = one[lo:lo + 2048]
            rows = np.repeat(np.arange(len(some)), count[some])
            at = np.arange(len(rows)) - np.repeat(np.cumsum(count[some]) - count[some], count[some])
            has = np.zeros((len(some), n), np.float32)
            has[rows, text[first[some][rows] + at]] = 1
            common += (has * weight[lo:lo + 2048, None].astype(np.float32)).T @ has
        # exact ties count: float32 holds the counts, but not their products with the threshold
        near = common.astype(np.float64) * (1 + threshold) >= threshold * (sizes[:, None] + sizes[None, :]) - 1e-4
        near &= common > 0
        np.fill_diagonal(near, False)
        if cross:
            near &= block[:, None] != block[None, :]
        total = near @ copies
        edges = _forest(lambda i, rest: near[i, rest], n)
        some = np.flatnonzero(total).tolist()
        return ([node[i] for i in some] + [node[x] for x, _ in edges],
                [node[i] for i in some] + [node[y] for _, y in edges],
                [int(total[i]) for i in some] + [0] * len(edges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, keys, lambda held: sum(x.nbytes for x in held) >= GATHER_BYTES):
            out: tuple[list, list, list] = ([], [], [])
            for group in _runs(t, keys):
                if group.num_rows > 1:
                    for x, y in zip(out, links(group.combine_chunks())):
                        x += y
            if out[0]:
                yield as_batch(dict(zip(types, out)), types)
    return run


def near_duplicates(docs: DataFrame, size: int = SIZE, threshold: float = THRESHOLD,
                    recall: float = RECALL) -> DataFrame:
    """``docs`` with class_id, n_links, class_size and class_key.

    Two documents are linked when the Jaccard similarity of their sets of ``size``-word runs is at
    least ``threshold`` (words: runs of characters other than ASCII spaces; a text of fewer words has
    one run of them all). n_links: the other documents linked to this one, copies included. class_id:
    the smallest doc_id that links lead to; class_size: its documents. Texts without words and null
    texts link to nothing and are classes of their own (rows that share a doc_id share such a class;
    null ids stay null). class_key: a key that all rows of a class share, ids or not; null for texts without words. All rows and columns stay; columns of the new names are replaced."""
    spark = docs.sparkSession
    prepare(spark)
    parts = shuffle_partitions(spark)
    bands, rows = choose_bands(threshold, recall)
    node = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    texts = bucketed(docs.select(F.coalesce("text", F.lit("")).alias("text")).select(node.alias("node"), "text")
                     .groupBy("node").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")), ["node"], "texts")

    signed = materialized(texts.mapInArrow(_signatures(size, bands, rows),
                                           "node binary, bands array<long>, signature binary"), "signatures")
    banded = signed.select(F.explode("bands").alias("key"), "node")
    # unique keys as tables of their own: the joins then shuffle both sides, and a hot key's rows can be split
    sizes = materialized(banded.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.lit(0).alias("bytes"))
                         .filter("members > 1"), "buckets")
    members = _blocked(banded, "key", sizes).join(signed.select("node", "signature"), "node")
    tied = (members.repartition(parts, "key", "p", "q").sortWithinPartitions("key", "p", "q")
            .select("key", "p", "q", "node", "signature").mapInArrow(_tie, "a binary, b binary"))
    groups = materialized(components(tied), "groups")

    held = texts.join(groups, "node")
    group_sizes = materialized(held.groupBy("root").agg(F.count(F.lit(1)).alias("members"),
                                                        F.sum(F.octet_length("text")).alias("bytes")), "group-sizes")
    verified = materialized(
        _blocked(held, "root", group_sizes).repartition(parts, "root", "p", "q").sortWithinPartitions("root", "p", "q")
        .select("root", "p", "q", "block", "node", "copies", "text")
        .mapInArrow(_verify(size, threshold), "a binary, b binary, links long"), "links")
    links = verified.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(verified.filter("a <> b").select("a", "b"))

    new = ["class_id", "n_links", "class_size", "class_key"]
    # a text without words ties no rows but those of one id
    wordless = F.coalesce("text", F.lit("")).rlike(r"^[\x20\x09-\x0D]*$")
    left = docs.drop(*new).select(F.struct("*").alias("row"), F.col("doc_id").alias("d"),
                                  F.when(~wordless, node).alias("node"))
    some = left.filter("node IS NOT NULL")
    per_text = some.groupBy("node").agg(F.min("d").alias("d"), F.count(F.lit(1)).alias("copies"))
    known = (per_text.join(roots, "node", "left").join(links, "node", "left")
             .withColumn("root", F.coalesce("root", "node")))
    classes = materialized(known.groupBy("root").agg(F.min("d").alias("class_id"), F.sum("copies").alias("class_size")),
                           "classes")
    found = known.join(classes, "root").select(
        "node", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "class_size",
        F.col("root").alias("class_key"))
    alone = left.filter("node IS NULL").select("row.*", F.col("d").alias("class_id"), F.lit(0).cast("long").alias("n_links"),
                                               F.lit(1).cast("long").alias("class_size"), F.lit(None).cast("binary").alias("class_key"))
    return some.join(found, "node").select("row.*", *new).unionByName(alone)
