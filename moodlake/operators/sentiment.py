"""Engagement-weighted sentiment per (time bucket, symbol).

One hash aggregation with partial (map-side) and final phases: a hot symbol
is reduced inside every map task before the shuffle, and the bucket is part
of the key, so no group can grow past one bucket's worth of partial rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodlake.functions.timefns import as_of_col, time_bucket


def engagement_weight(score="score", comments="comments") -> Column:
    """1 + ln(1 + max(score, 0) + comments); NULLs count as 0; negative comments
    are not clamped. Arithmetic in LONG, so 1 + score + comments cannot overflow.
    A non-positive argument gives NULL (the row then leaves both sums)."""
    s = F.greatest(F.coalesce(F.col(score).cast("long"), F.lit(0)), F.lit(0))
    c = F.coalesce(F.col(comments).cast("long"), F.lit(0))
    arg = (F.lit(1) + s + c).cast("double")
    return F.lit(1.0) + F.when(arg > 0, F.ln(arg))


def stance_sign(stance="stance") -> Column:
    st = F.col(stance)
    return F.when(st == 1, 1).when(st == -1, -1).otherwise(0)


#: The state of a bucket, from which rows, longer buckets and late batches are made by addition.
STATE = ("n_posts", "sw", "w", "pos_ct", "neu_ct", "neg_ct")


def state_aggregates() -> list[Column]:
    """The aggregates of ``STATE`` over scored fan-out rows: counts, the weights' sum, and their sum by sign."""
    w = engagement_weight()
    return [F.count(F.lit(1)).alias("n_posts"), F.sum(stance_sign() * w).alias("sw"), F.sum(w).alias("w"),
            F.sum((F.col("stance") == 1).cast("long")).alias("pos_ct"),
            F.sum((F.col("stance") == 0).cast("long")).alias("neu_ct"),
            F.sum((F.col("stance") == -1).cast("long")).alias("neg_ct")]


def sentiment_state(ticker_posts: DataFrame, width: str = "10 seconds", time_col: str = "created_at") -> DataFrame:
    """bucket, ticker and the bucket's state over scored rows. States of disjoint rows add up (``merge_state``)."""
    scored = ticker_posts.where(F.col("stance").isNotNull())
    return (scored.groupBy(time_bucket(time_col, width).alias("bucket"), F.col("ticker")).agg(*state_aggregates()))


def merge_state(states: DataFrame, width: str | None = None) -> DataFrame:
    """States added up: per bucket as they are, or per longer bucket of ``width`` (a multiple of theirs)."""
    bucket = F.col("bucket") if width is None else time_bucket("bucket", width)
    return states.groupBy(bucket.alias("bucket"), F.col("ticker")).agg(*[F.sum(c).alias(c) for c in STATE])


def finish_state(states: DataFrame) -> DataFrame:
    """bucket, ticker, n_posts, vw_sentiment, pos_ct, neu_ct, neg_ct from states."""
    return states.select("bucket", "ticker", "n_posts", (F.col("sw") / F.nullif(F.col("w"), F.lit(0.0))).alias("vw_sentiment"),
                         "pos_ct", "neu_ct", "neg_ct")


def sentiment_buckets(ticker_posts: DataFrame, width: str = "10 seconds",
                      time_col: str = "created_at") -> DataFrame:
    """bucket, ticker, n_posts, vw_sentiment, pos_ct, neu_ct, neg_ct over scored rows.
    Only buckets holding a scored row appear (no gap filling)."""
    return finish_state(sentiment_state(ticker_posts, width, time_col))


def closed_buckets(view: DataFrame, width_seconds: int = 10, end_offset_seconds: int = 10,
                   start_offset_hours: int | None = None, as_of=None) -> DataFrame:
    """Materialized-only view: buckets whose end lies at least ``end_offset`` before
    as_of (and, with a start offset, not older than as_of - start_offset)."""
    end = F.col("bucket") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(width_seconds))
    limit = as_of_col(as_of) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(end_offset_seconds))
    cond = end <= limit
    if start_offset_hours is not None:
        cond = cond & (F.col("bucket") >= as_of_col(as_of) - F.make_dt_interval(F.lit(0), F.lit(start_offset_hours)))
    return view.where(cond)


def latest_per_ticker(view: DataFrame) -> DataFrame:
    """Newest bucket row of every symbol in one aggregation (max_by), instead of a
    per-symbol sort: partial aggregation keeps one row per symbol per map task."""
    cols = [c for c in view.columns if c != "ticker"]
    return (view.groupBy("ticker")
            .agg(F.max_by(F.struct(*cols), F.col("bucket")).alias("r"))
            .select("ticker", *[F.col(f"r.{c}").alias(c) for c in cols]))
