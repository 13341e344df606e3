"""Exact top-k inner-product search with a ball tree per shard.

Vectors become integers and are dealt by ball: to the nearest of some centres, a large ball to several shards of about
``SHARD_VECTORS``. Each shard's tree (points, centres, radii) is one row of an index table in the shared folder. A query
walks a tree best first: nodes wait in a heap ordered by their upper bound q.centre + |q| radius, and the walk ends at the
first bound below the current kth score. Each query first searches the ball of the largest bound; the kth score found there
is shared with the others: a ball whose bound is below it is not visited, and the walks in the rest start from it. Queries
travel in blocks, and each pair of block and shard is joined on the shard, so neither the queries nor the index ever sit
whole in one place.
"""

from __future__ import annotations

import decimal
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodlake.llm.common import as_batch, materialized, prepare, shuffle_partitions

SCALE = 1024
SHARD_VECTORS = 16_384
LEAF = 64
QUERY_BLOCK = 256
#: Most balls, vectors of a sample for each of them, and numbers of the whole sample.
MOST_BALLS = 2048
BALL_SAMPLE = 32
SAMPLE_NUMBERS = 1 << 23


def build_tree(points: np.ndarray) -> dict[str, np.ndarray]:
    """A ball tree: the points' order, and per node its centre, radius, range in that order and children
    (-1 for a leaf). A node is split at the median along the line between two far points."""
    n = len(points)
    order = np.arange(n)
    centre, radius, begin, end, left, right = [], [], [], [], [], []

    def node(lo: int, hi: int) -> int:
        own = points[order[lo:hi]]
        c = own.mean(0)
        centre.append(c)
        radius.append(float(np.sqrt(((own - c) ** 2).sum(1).max())))
        begin.append(lo)
        end.append(hi)
        left.append(-1)
        right.append(-1)
        return len(centre) - 1

    todo = [node(0, n)] if n else []
    while todo:
        k = todo.pop()
        lo, hi = begin[k], end[k]
        if hi - lo <= LEAF or radius[k] == 0:
            continue
        own = points[order[lo:hi]]
        a = own[((own - centre[k]) ** 2).sum(1).argmax()]
        b = own[((own - a) ** 2).sum(1).argmax()]
        mid = (hi - lo) // 2
        order[lo:hi] = order[lo:hi][np.argpartition(own @ (b - a), mid)]
        left[k], right[k] = node(lo, lo + mid), node(lo + mid, hi)
        todo += [left[k], right[k]]
    return {"order": order, "centre": np.array(centre).reshape(len(centre), points.shape[1]), "radius": np.array(radius),
            "begin": np.array(begin, np.int32), "end": np.array(end, np.int32), "left": np.array(left, np.int32),
            "right": np.array(right, np.int32)}


class Tree:
    """A shard's points in tree order, with its nodes as plain lists for the walk."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, centre, radius, begin, end, left, right):
        self.ids, self.points, self.centre, self.radius = ids, points.astype(np.float64), centre, radius
        self.exact, self.most = points, float(np.abs(self.points).max(initial=0))
        self.begin, self.end, self.left, self.right = begin.tolist(), end.tolist(), left.tolist(), right.tolist()

    def scores(self, q: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Inner products as exact integers: in float64 while nothing can leave 53 bits, else as Python integers."""
        if self.most * float(np.abs(q.astype(np.float64)).sum()) < 2.0 ** 53:
            return (self.points[lo:hi] @ q.astype(np.float64)).astype(np.int64)
        return self.exact[lo:hi].astype(object) @ q.astype(object)

    def search(self, q: np.ndarray, bounds: list[float], own_id: int, k: int, floor: float) -> list[tuple[int, int]]:
        """The k best (score, id) of at least ``floor``, ties to the smaller id, without ``own_id``."""
        best: list[tuple[int, int]] = []            # a heap of (score, -id)
        heap = [(-bounds[0], 0)] if bounds else []
        while heap:
            bound, node = heapq.heappop(heap)
            least = max(floor, best[0][0]) if len(best) == k else floor
            if -bound < least:
                break
            if self.left[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    heapq.heappush(heap, (max(-bounds[child], bound), child))
                continue
            lo, hi = self.begin[node], self.end[node]
            scores = self.scores(q, lo, hi)
            some = np.flatnonzero(scores >= least)
            for s, i in zip(scores[some].tolist(), self.ids[lo:hi][some].tolist()):
                if i == own_id:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
        return [(int(s), -i) for s, i in best]


_INDEX = {"shard": pa.int32(), "width": pa.int32(), "ids": pa.binary(), "points": pa.binary(), "centre": pa.binary(),
          "radius": pa.binary(), "begin": pa.binary(), "end": pa.binary(), "left": pa.binary(), "right": pa.binary()}
_INDEX_DDL = "shard int, width int, " + ", ".join(f"`{k}` binary" for k in list(_INDEX)[2:])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors sorted by shard and width -> one row per shard and width with its tree."""
    def one(key: tuple, ids: list, rows: list) -> pa.RecordBatch:
        points = np.array(rows, np.int64).reshape(len(rows), key[1])
        tree = build_tree(points.astype(np.float64))
        order = tree.pop("order")
        blobs = {"ids": np.array(ids, np.int64)[order], "points": points[order]} | tree
        return as_batch({"shard": [key[0]], "width": [key[1]]} | {k: [v.tobytes()] for k, v in blobs.items()}, _INDEX)

    key, ids, rows = None, [], []
    for batch in batches:
        for shard, width, i, v in zip(*(batch.column(c).to_pylist() for c in ("shard", "width", "vec_id", "vector"))):
            if key is not None and key != (shard, width):
                yield one(key, ids, rows)
                ids, rows = [], []
            key = (shard, width)
            ids.append(i)
            rows.append(v)
    if key is not None:
        yield one(key, ids, rows)


def _search(k: int):
    """Index rows joined with query blocks -> the best candidates of each query in the shard."""
    types = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.decimal128(38)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tree = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in batch.schema.names}
                key = (row["shard"].as_py(), row["width"].as_py())
                if key != held:
                    blob = {c: np.frombuffer(row[c].as_py(), t) for c, t in
                            (("ids", np.int64), ("points", np.int64), ("centre", np.float64), ("radius", np.float64),
                             ("begin", np.int32), ("end", np.int32), ("left", np.int32), ("right", np.int32))}
                    n, width = len(blob["ids"]), key[1]
                    blob["points"] = blob["points"].reshape(n, width)
                    blob["centre"] = blob["centre"].reshape(len(blob["radius"]), width)
                    held, tree = key, Tree(**blob)
                out = []
                for q in row["queries"].as_py():
                    v = np.array(q["vector"], np.int64)
                    x = v.astype(np.float64)
                    norm = float(np.sqrt(x @ x))
                    upper = tree.centre @ x + norm * tree.radius
                    upper += 1e-9 * (norm * tree.most * len(x) + 1)     # rounding never hides a candidate
                    floor = -math.inf if q["floor"] is None else int(q["floor"])
                    out += [(q["query_id"], i, decimal.Decimal(s)) for s, i in
                            tree.search(v, upper.tolist(), q["query_id"], k, floor)]
                if out:
                    yield as_batch(dict(zip(types, map(list, zip(*out)))), types)
    return run


def _integers(embedding: Column) -> Column:
    return F.transform(embedding, lambda x: F.floor(F.lit(SCALE) * x.cast("double")).cast("long"))


def _usable(embedding: Column) -> Column:
    """Components that are set, finite and, when scaled, under 2**62 (so they are longs, and scores fit 38 digits)."""
    bound = F.lit(2.0 ** 62 / SCALE)
    return embedding.isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < bound))


@dataclass(frozen=True)
class Balls:
    """Where vectors are: centre, radius and shards [first, first + count) of each ball; ``others`` shards (-1, -2, ...)
    hold the vectors of other lengths than ``width``."""
    width: int
    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    count: np.ndarray
    others: int

    @property
    def shards(self) -> int:
        return int(self.count.sum()) + self.others


def _centres(sample: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """A few rounds of k-means over a sample."""
    centre = sample[:n].copy()
    for _ in range(rounds):
        near = ((centre * centre).sum(1)[None] - 2 * sample @ centre.T).argmin(1)
        size = np.bincount(near, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, near, sample)
        centre[size > 0] = total[size > 0] / size[size > 0][:, None]
    return centre


def _deal(vectors: DataFrame) -> tuple[DataFrame, Balls]:
    """The vectors with their shard, stored once. Those of the commonest length go to the nearest of at most
    ``MOST_BALLS`` centres (fitted to a sample of ``BALL_SAMPLE`` vectors each, at most ``SAMPLE_NUMBERS`` numbers), a large ball to several shards by a hash of
    the id; which centres only decides what can be skipped, never a result."""
    spark = vectors.sparkSession
    sizes = {r["width"]: r["n"] for r in vectors.groupBy("width").agg(F.count(F.lit(1)).alias("n"))
             .orderBy(F.desc("n"), "width").limit(2).collect()}
    total = vectors.count()
    width = max(sizes, key=lambda w: (sizes[w], -w), default=0)
    n = min(MOST_BALLS, max(1, -(-sizes.get(width, 0) // SHARD_VECTORS)))
    others = -(-(total - sizes.get(width, 0)) // SHARD_VECTORS)
    sample = (vectors.filter(F.col("width") == width).orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(n * BALL_SAMPLE, SAMPLE_NUMBERS // max(width, 1) + 1))
              .select("vector").toPandas()["vector"])            # at most SAMPLE_NUMBERS numbers
    centre = _centres(np.stack(sample).astype(np.float64), n) if len(sample) else np.zeros((0, width))
    sent = spark.sparkContext.broadcast(centre)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            fits = batch.column("width").to_numpy() == own.shape[1]
            ball, far = np.full(len(fits), -1, np.int32), np.zeros(len(fits))
            if fits.any() and len(own):
                m = batch.column("vector").filter(pa.array(fits)).flatten().to_numpy().astype(np.float64).reshape(-1, own.shape[1])
                near = ((own * own).sum(1)[None] - 2 * m @ own.T).argmin(1)
                ball[fits], far[fits] = near, np.sqrt(((m - own[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ball), pa.array(far)],
                                             names=[*batch.schema.names, "ball", "far"])

    dealt = materialized(vectors.mapInArrow(assign, "vec_id long, vector array<long>, asked boolean, width int, ball int, far double"), "dealt")
    facts = {r["ball"]: r for r in dealt.filter("ball >= 0").groupBy("ball").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect()}
    some = sorted(facts)
    count = np.array([-(-facts[b]["n"] // SHARD_VECTORS) for b in some], np.int64)
    first = np.cumsum(count) - count
    balls = Balls(width, centre[some] if some else centre[:0], np.array([facts[b]["far"] for b in some]), first, count, others)
    where = spark.createDataFrame(list(zip(some, first.tolist(), count.tolist())), "ball int, first long, count long")   # at most MOST_BALLS rows
    hashed = F.xxhash64("vec_id")
    shard = F.when(F.col("ball") < 0, -1 - F.pmod(hashed, F.lit(max(others, 1)))).otherwise(F.col("first") + F.pmod(hashed, F.col("count")))
    return (dealt.join(F.broadcast(where), "ball", "left")
            .select("vec_id", "vector", "asked", "width", shard.cast("int").alias("shard")), balls)


_VISITS_DDL = "query_id long, vector array<long>, width int, floor decimal(38,0), shard int"


def _visits(balls: Balls, first: bool):
    """Queries -> a row for each shard to be searched: those of the ball with the largest bound first (for other lengths all
    of theirs), then those of the balls whose bound q.centre + |q| radius reaches the query's kth score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, shards = [], []
            for i, (v, floor) in enumerate(zip(batch.column("vector").to_pylist(), batch.column("floor").to_pylist())):
                if len(v) != balls.width:
                    some = range(-balls.others, 0) if first else ()
                else:
                    q = np.array(v, np.float64)
                    norm = np.sqrt(q @ q)
                    bound = balls.centre @ q + norm * balls.radius
                    bound += 1e-9 * (norm * (np.sqrt((balls.centre ** 2).sum(1)) + balls.radius) + 1)   # rounding hides nothing
                    best = int(bound.argmax())
                    keep = np.arange(len(bound)) == best
                    if not first:
                        keep = ~keep & (bound >= (-np.inf if floor is None else float(floor)))
                    some = [x for b in np.flatnonzero(keep) for x in range(balls.first[b], balls.first[b] + balls.count[b])]
                at += [i] * len(some)
                shards += some
            if at:
                rows = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(shards, pa.int32())], names=[*rows.schema.names, "shard"])
    return run


def top_k(embeddings: DataFrame, queries: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: for every row that ``queries`` selects, the k largest inner products with all
    rows of another vec_id, of vectors scaled to integers by floor(1024 x); ties go to the smaller vec_id. Scores are
    exact at any size and ranked so; one beyond a long (2**63 - 1) is returned as null.

    Rows with a null vec_id or vector, or a null or non-finite component (or one of 2**62 and more when scaled), take no
    part; only vectors of one length
    are compared. Fewer than k candidates give as many rows; a repeated vec_id is a candidate each time, and a
    repeated query row is answered once."""
    spark = embeddings.sparkSession
    prepare(spark)
    parts = shuffle_partitions(spark)
    vectors = (embeddings.filter(F.col("vec_id").isNotNull() & _usable(F.col("embedding")))
               .select(F.col("vec_id").cast("long").alias("vec_id"), _integers(F.col("embedding")).alias("vector"),
                       queries.alias("asked"))
               .withColumn("width", F.size("vector")))
    dealt, balls = _deal(vectors)
    index = materialized(dealt.drop("asked").repartition(max(parts, min(balls.shards, 10 * parts)), "shard", "width")
                         .sortWithinPartitions("shard", "width").mapInArrow(_index, _INDEX_DDL), "index")

    asked = (dealt.filter("asked").dropDuplicates(["vec_id", "width"]).withColumnRenamed("vec_id", "query_id")
             .select("query_id", "vector", "width", F.lit(None).cast("decimal(38,0)").alias("floor")))
    found = materialized(_matched(index, asked.mapInArrow(_visits(balls, True), _VISITS_DDL), k), "home")
    if balls.shards > 1:
        kth = (found.groupBy("query_id").agg(F.get(F.array_sort(F.collect_list("score")), F.count("score").cast("int") - k).alias("floor")))
        away = asked.drop("floor").join(kth, "query_id", "left").select("query_id", "vector", "width", "floor")
        found = found.unionByName(_matched(index, away.mapInArrow(_visits(balls, False), _VISITS_DDL), k))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").try_cast("long").alias("score")))


def _matched(index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Candidates of the queries in the shards they name; queries of a shard go in blocks of about QUERY_BLOCK."""
    sizes = asked.groupBy("shard", "width").agg(F.count(F.lit(1)).alias("n"))
    blocks = (asked.join(sizes, ["shard", "width"])
              .withColumn("block", F.pmod(F.xxhash64("query_id"), F.ceil(F.col("n") / F.lit(float(QUERY_BLOCK)))))
              .groupBy("shard", "width", "block")
              .agg(F.collect_list(F.struct("query_id", "vector", "floor")).alias("queries")))
    return index.join(blocks, ["shard", "width"]).mapInArrow(_search(k), "query_id long, vec_id long, score decimal(38,0)")
