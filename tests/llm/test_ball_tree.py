import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from moodlake.llm import ball_tree


def brute(rows, k):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in {(i, tuple(v)) for i, v in ok if i % 10 == 0}:
        found = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in ok if j != i and len(c) == len(q))
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard", [40, 16_384])
def test_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(ball_tree, "SHARD_VECTORS", shard)
    monkeypatch.setattr(ball_tree, "LEAF", 4)
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 360)]                     # ties
    rows += [(400, None), (410, [1.0, None, 2.0, 0.0, 0.0, 1.0]), (420, [float("nan")] * 6), (430, [float("inf")] * 6), (None, rows[1][1]),
             (440, [0.5, 0.25]), (441, [1.0, 1.0]), (450, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).repartition(3)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ball_tree.top_k(df, F.col("vec_id") % 10 == 0, 7).collect())
    assert got == brute(rows, 7)


def test_large_components_are_scored_exactly(spark, monkeypatch):
    """Products beyond 53 and 64 bits: ranked exactly; a score that is no long is null."""
    monkeypatch.setattr(ball_tree, "SHARD_VECTORS", 20)
    rng = np.random.default_rng(3)
    for size in (2.0 ** 14, 2.0 ** 17, 1e6, 2.0 ** 40):
        rows = [(i, [float(np.float32(x)) for x in rng.normal(size=64) * size]) for i in range(60)] + [(70, [2.0 ** 60] * 64)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(2)
        got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ball_tree.top_k(df, F.col("vec_id") % 10 == 0, 5).collect())
        assert got == [(q, n, v, s if abs(s) < 2 ** 63 else None) for q, n, v, s in brute(rows[:60], 5)]
        assert size < 1e6 or any(x[3] is None for x in got)


def test_balls_out_of_reach_are_not_visited(spark, monkeypatch):
    """Clustered vectors: a query is sent to few shards, and the result is exact; a ball of several shards is searched whole."""
    monkeypatch.setattr(ball_tree, "SHARD_VECTORS", 50)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8)) * 4
    rows = [(i, [float(np.float32(x)) for x in centres[0 if i % 3 == 0 else i % 12] + rng.normal(size=8) * 0.1]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    sent, plain = [], ball_tree._matched

    def watched(index, asked, k):
        sent.append((asked.count(), index.count()))
        return plain(index, asked, k)
    monkeypatch.setattr(ball_tree, "_matched", watched)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ball_tree.top_k(df, F.col("vec_id") % 10 == 0, 5).collect())
    assert got == brute(rows, 5)
    assert len(sent) == 2 and sum(n for n, _ in sent) < 0.7 * 90 * sent[0][1]


def test_tree_holds_every_point_in_its_balls():
    points = np.random.default_rng(2).normal(size=(1000, 8))
    t = ball_tree.build_tree(points)
    assert sorted(t["order"].tolist()) == list(range(1000))
    for c, r, lo, hi in zip(t["centre"], t["radius"], t["begin"], t["end"]):
        assert (np.sqrt(((points[t["order"][lo:hi]] - c) ** 2).sum(1)) <= r + 1e-9).all()


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, -1.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ball_tree.top_k(df, F.col("vec_id") == 0).collect()] == \
        [(0, 1, 1, 1024 * 3072 - 2048 * 1024)]
    assert ball_tree.top_k(df.filter("vec_id < 0"), F.col("vec_id") == 0).count() == 0
    assert ball_tree.top_k(df, F.col("vec_id") == 7).count() == 0
