"""User-facing read queries over the sentiment view and the posts table.

Each is a DataFrame function with an explicit ``as_of``; filters on grouping
columns (ticker, bucket) are pushed by Catalyst below the aggregate and into
the Parquet scan, and every LIMIT is planned as a per-partition top-k
(TakeOrderedAndProject), never a full sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodlake.functions.dictionaries import BATCH_SIZE
from moodlake.functions.timefns import as_of_col, hours_before, minutes_before, seconds_between
from moodlake.operators.quantiles import exact_quantile

SERIES_COLS = ("bucket", "vw_sentiment", "n_posts", "pos_ct", "neu_ct", "neg_ct")


def sentiment_series(view: DataFrame, ticker: str, from_hours: int = 1, as_of=None) -> DataFrame:
    """Buckets of one symbol newer than as_of - from_hours (strict), newest first."""
    return (view.where((F.col("ticker") == F.lit(ticker)) & (F.col("bucket") > hours_before(as_of, from_hours)))
            .select(*SERIES_COLS)
            .orderBy(F.col("bucket").desc()))


def sentiment_series_from_facts(ticker_posts: DataFrame, ticker: str, from_hours: int = 1, as_of=None,
                                 width: str = "10 seconds", time_col: str = "created_at") -> DataFrame:
    """``sentiment_series`` computed from the fan-out facts instead of a stored view.

    A bucket newer than the bound holds only rows newer than the bound, so the
    facts are pre-filtered on the raw event time (exact): the predicate reaches
    the Parquet scan (row-group skipping, partition pruning on a stored table)
    together with the symbol, and only the look-back window is aggregated."""
    from moodlake.operators.sentiment import sentiment_buckets

    lo = hours_before(as_of, from_hours)
    facts = ticker_posts.where((F.col("ticker") == F.lit(ticker)) & (F.col(time_col) > lo))
    return sentiment_series(sentiment_buckets(facts, width, time_col), ticker, from_hours, as_of)


def sentiment_latest(view: DataFrame, ticker: str) -> DataFrame:
    """The newest bucket of one symbol: one row, or none."""
    return (view.where(F.col("ticker") == F.lit(ticker))
            .select(*SERIES_COLS)
            .orderBy(F.col("bucket").desc())
            .limit(1))


def sentiment_latest_from_facts(ticker_posts: DataFrame, ticker: str, width: str = "10 seconds",
                                time_col: str = "created_at") -> DataFrame:
    """``sentiment_latest`` from the facts: the symbol's newest scored time is found first (a max that Parquet statistics
    and the symbol's filter keep small), then only that bucket is aggregated."""
    from moodlake.functions.timefns import BUCKET_ORIGIN_SECONDS, width_seconds
    from moodlake.operators.sentiment import sentiment_buckets

    facts = ticker_posts.where((F.col("ticker") == F.lit(ticker)) & F.col("stance").isNotNull())
    newest = facts.agg(F.unix_seconds(F.max(time_col).cast("timestamp"))).first()[0]
    if newest is None:
        return sentiment_latest(sentiment_buckets(facts, width, time_col), ticker)
    w = width_seconds(width)
    start = BUCKET_ORIGIN_SECONDS + (newest - BUCKET_ORIGIN_SECONDS) // w * w
    lo = F.timestamp_seconds(F.lit(start)).cast(ticker_posts.schema[time_col].dataType)
    return sentiment_latest(sentiment_buckets(facts.where(F.col(time_col) >= lo), width, time_col), ticker)


def chart_feed(view: DataFrame, ticker: str, from_hours: int = 24, as_of=None,
               time_format: str = "HH:mm:ss") -> DataFrame:
    """Dashboard series: oldest first, bucket formatted as time of day."""
    s = sentiment_series(view, ticker, from_hours, as_of)
    return chart_rows(s, time_format)


def chart_rows(series: DataFrame, time_format: str = "HH:mm:ss") -> DataFrame:
    """Series rows reversed to ascending time, renamed for the chart."""
    return (series.orderBy(F.col("bucket").asc())
            .select(F.date_format("bucket", time_format).alias("time"),
                    F.col("vw_sentiment").alias("sentiment"),
                    F.col("n_posts").alias("posts")))


def unscored(posts: DataFrame, as_of=None, horizon_hours: int = 24) -> DataFrame:
    """Posts the scorer may pick: unscored, created within the horizon, not backfill."""
    cond = (F.col("stance").isNull()
            & (F.col("created_at") > hours_before(as_of, horizon_hours))
            & ~F.coalesce(F.col("is_backfill"), F.lit(False)))
    return posts.where(cond)


def unscored_queue(posts: DataFrame, as_of=None, batch_size: int = BATCH_SIZE,
                   horizon_hours: int = 24) -> DataFrame:
    """Newest-first work queue: unscored, created within the horizon, not backfill.
    Ties on ingested_at are broken by id so the queue is deterministic."""
    return (unscored(posts, as_of, horizon_hours)
            .orderBy(F.col("ingested_at").desc(), F.col("id").asc()).limit(batch_size))


def pipeline_count(posts: DataFrame, minutes: int = 5, as_of=None) -> DataFrame:
    """Rows ingested in the last `minutes` (strict lower bound)."""
    return (posts.where(F.col("ingested_at") > minutes_before(as_of, minutes))
            .agg(F.count(F.lit(1)).alias("last_5m_count")))


def _latency_window(as_of, minutes: int) -> Column:
    lo = minutes_before(as_of, minutes)
    return (F.col("classified_at").isNotNull() & (F.col("classified_at") > lo)
            & (F.col("ingested_at") > lo) & ~F.coalesce(F.col("is_backfill"), F.lit(False)))


def _rounded_seconds(p) -> Column:
    """NULL -> 0, half-even to 2 places (on the decimal value, not the binary double)."""
    p = F.lit(p).cast("double") if not isinstance(p, Column) else p
    return (F.coalesce(F.bround(p.cast("decimal(38,9)"), 2), F.lit(0).cast("decimal(38,9)"))
            .cast("double").alias("p95_latency_sec"))


def latency_p95_value(posts: DataFrame, minutes: int = 10, as_of=None):
    """Exact p95 (seconds, unrounded; None if no row) of classified_at - ingested_at
    over the window. Distributed rank selection (operators/quantiles.py): no
    task or driver ever holds the window's values."""
    lat = seconds_between("ingested_at", "classified_at")
    return exact_quantile(posts.where(_latency_window(as_of, minutes)), lat, 0.95)


def pipeline_latency_p95(posts: DataFrame, minutes: int = 10, as_of=None, exact: bool = True) -> DataFrame:
    """p95 of classified_at - ingested_at in seconds over the last `minutes`
    (both stamps), backfill excluded; NULL -> 0, rounded half-even to 2 places.
    The exact value is found by distributed rank selection when the function is
    called; ``exact=False`` stays lazy and uses a percentile_approx sketch."""
    spark = posts.sparkSession
    if exact:
        return spark.range(1).select(_rounded_seconds(latency_p95_value(posts, minutes, as_of)))
    lat = seconds_between("ingested_at", "classified_at")
    p = F.percentile_approx(lat, F.lit(0.95), F.lit(10000))
    return posts.where(_latency_window(as_of, minutes)).agg(p.alias("p")).select(_rounded_seconds(F.col("p")))


def latency_sketches(posts: DataFrame, k: int = 800) -> DataFrame:
    """A quantile sketch (KLL) of the latencies of each minute, stored beside the view: minute, n, sketch. A post belongs to
    the minute that the earlier of its two stamps ends in, as windows have a strict lower bound. ``k`` sets the sketches'
    size; ranks from merged ones are within about 2.3 / k ** 0.9 of the truth (a rank error of 0.6 % at 800)."""
    first = F.least("ingested_at", "classified_at")
    # the minute's end: (m - 1 min, m]
    minute = F.timestamp_seconds(F.ceil(F.unix_micros(first.cast("timestamp")) / F.lit(60_000_000)) * 60)
    rows = posts.where(F.col("classified_at").isNotNull() & F.col("ingested_at").isNotNull() & ~F.coalesce(F.col("is_backfill"), F.lit(False)))
    lat = seconds_between("ingested_at", "classified_at")
    return (rows.groupBy(minute.alias("minute"))
            .agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(lat.cast("double"), F.lit(k)).alias("sketch")))


def latency_from_sketches(sketches: DataFrame, p: float = 0.95, minutes: int | None = 10, as_of=None) -> DataFrame:
    """One row: n and p95_latency_sec (the item of that rank; null without rows) of the stored minutes after
    ``as_of - minutes`` (its minute begun counts as a whole; None: of all minutes). No post is read."""
    own = sketches
    if minutes is not None:
        own = own.where(F.col("minute") > F.date_trunc("minute", minutes_before(as_of, minutes)))
    merged = own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.kll_merge_agg_double("sketch").alias("s"))
    return merged.select("n", F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("s", F.lit(p))).alias("p95_latency_sec"))


def pipeline_metrics(posts: DataFrame, as_of=None, batch_size: int = BATCH_SIZE,
                     count_minutes: int = 5, latency_minutes: int = 10) -> DataFrame:
    """One row: p95_latency_sec, last_5m_count, batched_avg_size.

    The count is one pruned scan with a partial/final count; the p95 is the
    exact distributed rank selection of ``latency_p95_value`` (a global exact
    percentile aggregate would merge the whole window in one task)."""
    p95 = latency_p95_value(posts, latency_minutes, as_of)
    cnt = posts.where(F.col("ingested_at") > minutes_before(as_of, count_minutes)).agg(
        F.count(F.lit(1)).alias("last_5m_count"))
    return cnt.select(_rounded_seconds(p95), F.col("last_5m_count").cast("long").alias("last_5m_count"),
                      F.lit(batch_size).alias("batched_avg_size"))


def recent_sample(posts: DataFrame, as_of=None, days: int = 1, n: int = 10000) -> DataFrame:
    """Bounded sample of recent post texts for cost measurement (ordered by id)."""
    from moodlake.functions.text import post_text
    return (posts.where(F.col("created_at") > as_of_col(as_of) - F.make_dt_interval(F.lit(days)))
            .orderBy("id").limit(n)
            .select("id", post_text().alias("text")))


def symbol_prefix(tickers: DataFrame, q: str, n: int = 20) -> DataFrame:
    """Symbols starting with q (case-sensitive; % and _ in q act as wildcards)."""
    return tickers.where(F.col("symbol").like(q + "%")).select("symbol").orderBy("symbol").limit(n)


def symbol_list(tickers: DataFrame, n: int = 100) -> DataFrame:
    return tickers.select("symbol").orderBy("symbol").limit(n)


def symbol_search(tickers: DataFrame, q: str = "") -> DataFrame:
    """The symbol lookup as one call: up to 20 prefix hits for ``q``, or the
    first 100 symbols when ``q`` is empty."""
    return symbol_prefix(tickers, q) if q else symbol_list(tickers)
