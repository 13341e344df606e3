"""Exact distributed quantiles equal a brute-force percentile_cont, ties and
skew included, and never need the window in one place."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moodlake.operators.quantiles import exact_quantile, value_at_rank
from moodlake.plans import serving


def percentile_cont(values, q):
    xs = sorted(values)
    pos = q * (len(xs) - 1)
    r = int(pos)
    lo = xs[r]
    hi = xs[min(r + 1, len(xs) - 1)]
    return lo + (hi - lo) * (pos - r)


def _data(kind, n, seed=3):
    rnd = random.Random(seed)
    if kind == "uniform":
        return [rnd.random() * 100 for _ in range(n)]
    if kind == "hot":  # a third of all rows share one value
        return [7.5 if i % 3 == 0 else rnd.randint(0, 5000) / 100 for i in range(n)]
    if kind == "exponential":  # spans many orders of magnitude
        return [math.exp(rnd.uniform(-30, 30)) for _ in range(n)]
    if kind == "few":
        return [float(rnd.randint(0, 3)) for _ in range(n)]
    raise ValueError(kind)


@pytest.mark.parametrize("kind", ["uniform", "hot", "exponential", "few"])
@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 0.999, 1.0])
def test_exact_quantile_matches_brute_force(spark, kind, q):
    vals = _data(kind, 3000)
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(6)
    # max_collect far below n forces the sketch-bracket narrowing passes
    got = exact_quantile(df, "x", q, accuracy=100, max_collect=40)
    assert got == pytest.approx(percentile_cont(vals, q), rel=1e-12, abs=1e-12)


def test_every_rank_of_a_skewed_column(spark):
    vals = _data("hot", 600, seed=9)
    df = spark.createDataFrame([(v,) for v in vals], "v double").repartition(4)
    xs = sorted(vals)
    for r in (0, 1, 199, 200, 201, 300, 598, 599):
        assert value_at_rank(df, r, len(xs), accuracy=50, max_collect=10) == xs[r]


def test_nulls_ignored_and_empty(spark):
    df = spark.createDataFrame([(None,), (2.0,), (None,), (4.0,)], "x double")
    assert exact_quantile(df, "x", 0.5) == 3.0
    assert exact_quantile(df.where(F.col("x") > 10), "x", 0.95) is None


def test_equals_spark_percentile_on_latencies(spark):
    """The served p95 equals Spark's (single-task) exact percentile on the fixture."""
    from moodlake.plans import overlays as O
    from tests.conftest import SF01

    posts = O.posts_meta(O.load(spark, SF01, "events"))
    as_of = "2024-01-20 00:00:00"
    got = serving.latency_p95_value(posts, 60 * 24 * 3, as_of)  # a 3-day window: many rows
    cond = serving._latency_window(as_of, 60 * 24 * 3)
    lat = F.timestamp_diff("MICROSECOND", F.col("ingested_at"), F.col("classified_at")) / F.lit(1e6)
    ref = posts.where(cond).agg(F.percentile(lat, F.lit(0.95))).first()[0]
    assert got == pytest.approx(ref, abs=1e-9)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.sampled_from([-3.5, 0.0, 0.25, 1.0, 2.0, 1e6]) | st.floats(-1e3, 1e3, allow_nan=False),
                min_size=1, max_size=400),
       st.floats(0.0, 1.0))
def test_exact_quantile_property(spark, vals, q):
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(3)
    got = exact_quantile(df, "x", q, accuracy=20, max_collect=8)
    assert got == pytest.approx(percentile_cont(vals, q), rel=1e-9, abs=1e-9)
