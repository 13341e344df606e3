"""The stored sentiment view: its changelog, compaction, refresh and repair.

Writers append one folder per batch (``writer=W/batch_id=N/committed_at=T``, T in microseconds); the current view is the
newest commit per (bucket, ticker): the one that counted most posts (none is ever taken away, so a writer with a slow
clock cannot win with an older count), then the latest. Compaction folds a snapshot and the commits newer than it, told
by their folders, into a new snapshot; readers take snapshot + newer commits, and ``trim`` drops the folded batch folders.
Snapshots are range-partitioned and sorted by (ticker, bucket): a series query for one symbol reads only the row groups
whose min/max cover it.

``write_state`` stores mergeable states instead of finished means: full states replace a writer's earlier one of the same
bucket, deltas are added, so a late batch is merged without reading a fact again, and longer buckets are sums of short ones.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ("bucket", "ticker")
ORDER = ("committed_at", "batch_id", "writer")


def _files(spark: SparkSession, path: str):
    """(Hadoop path, its file system)"""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _children(spark: SparkSession, path: str) -> list[str]:
    p, fs = _files(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def commit(rows: DataFrame, path: str, writer: str, batch_id: int) -> None:
    """Stores a batch of a writer under the time of its commit. A batch that is committed again replaces its earlier
    commit once it is complete. Writers have folders of their own, as their batch ids all begin at 0."""
    spark, folder = rows.sparkSession, f"{path}/writer={writer}/batch_id={batch_id}"
    before = _children(spark, folder)
    rows.write.parquet(f"{folder}/committed_at={time.time_ns() // 1000}")
    for name in before:
        p, fs = _files(spark, f"{folder}/{name}")
        fs.delete(p, True)


def write_sentiment_view(view: DataFrame, path: str, mode: str = "overwrite") -> None:
    (view.repartitionByRange("ticker", "bucket").sortWithinPartitions("ticker", "bucket")
     .write.mode(mode).parquet(path))


def _newest(rows: DataFrame) -> DataFrame:
    cols = [c for c in rows.columns if c not in set(KEY)]
    return (rows.groupBy(*KEY)
            .agg(F.max_by(F.struct(*cols), F.struct("n_posts", *ORDER)).alias("r"))
            .select(*KEY, *[F.col(f"r.{c}").alias(c) for c in cols]))


def _since(spark: SparkSession, changelog: str, snapshot: str | None) -> DataFrame:
    """The snapshot's rows (if there is one) and the changelog's later commits."""
    log = spark.read.parquet(changelog)
    if snapshot is None:
        return log
    snap = spark.read.parquet(snapshot)
    upto = snap.agg(F.max("committed_at")).scalar()
    newer = log.where(F.col("committed_at") > F.coalesce(upto, F.lit(0)))      # folders: older commits are not read
    return snap.unionByName(newer.select(*snap.columns))


def current_view(spark: SparkSession, changelog: str, snapshot: str | None = None) -> DataFrame:
    """Newest value per (bucket, ticker) over the snapshot (if any) and the
    commits newer than it."""
    return _newest(_since(spark, changelog, snapshot)).drop(*ORDER)


def compact(spark: SparkSession, changelog: str, snapshot_out: str, previous_snapshot: str | None = None) -> str:
    """Fold the previous snapshot and the commits newer than it into a new snapshot folder (written once, never
    in place, so a failed compaction leaves the previous snapshot valid)."""
    write_sentiment_view(_newest(_since(spark, changelog, previous_snapshot)), snapshot_out)
    return snapshot_out


def trim(spark: SparkSession, changelog: str, snapshot: str) -> int:
    """Delete the batch folders whose commits the snapshot holds, all but each writer's last (its ids must not
    start again); returns how many. Call it when no reader uses an older snapshot."""
    upto = spark.read.parquet(snapshot).agg(F.max("committed_at")).first()[0]
    if upto is None:
        return 0
    folded = (spark.read.parquet(changelog).groupBy("writer", "batch_id").agg(F.max("committed_at").alias("at")))
    last = folded.groupBy("writer").agg(F.max("batch_id").alias("last"))
    gone = folded.join(last, "writer").where((F.col("at") <= F.lit(upto)) & (F.col("batch_id") < F.col("last"))).collect()
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(changelog).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in gone:
        fs.delete(path(f"{changelog}/writer={r['writer']}/batch_id={r['batch_id']}"), True)
    return len(gone)


def refresh_window(ticker_posts: DataFrame, as_of, start_offset_hours: int = 24, end_offset_seconds: int = 10,
                   width_seconds: int = 10, time_col: str = "created_at") -> DataFrame:
    """The buckets one refresh of the aggregate recomputes: closed ones (end at
    least ``end_offset`` before ``as_of``) not older than ``as_of - start_offset``.

    Only facts inside [as_of - start_offset, as_of - end_offset) are read (the
    predicate reaches the scan): every row of a bucket in the window lies in
    that range, so the window's buckets are exact; partial buckets at the
    edges are dropped by the closed-bucket filter."""
    from moodlake.functions.timefns import as_of_col
    from moodlake.operators.sentiment import closed_buckets, sentiment_buckets

    t = as_of_col(as_of)
    lo = t - F.make_dt_interval(F.lit(0), F.lit(start_offset_hours))
    hi = t - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(end_offset_seconds))
    facts = ticker_posts.where((F.col(time_col) >= lo) & (F.col(time_col) < hi))
    return closed_buckets(sentiment_buckets(facts, f"{width_seconds} seconds", time_col), width_seconds,
                          end_offset_seconds, start_offset_hours, as_of)


def refresh_sentiment_view(ticker_posts: DataFrame, changelog: str, batch_id: int, as_of, **window) -> None:
    """One scheduled refresh (the aggregate's policy: every 10 s, [now - 1 day,
    now - 10 s]) as a batch job: the window's buckets are a commit of the writer ``refresh``, and a re-run replaces its own
    batch; ``current_view`` / ``compact`` read it like the streaming sink's batches."""
    commit(refresh_window(ticker_posts, as_of, **window), changelog, "refresh", batch_id)


def repair_view(spark: SparkSession, fanout: str, touched: str, changelog: str, width: str = "10 seconds",
                time_col: str = "created_at") -> int | None:
    """Recomputes the buckets that late rows touched, and only those: ``touched`` holds the (bucket, ticker) pairs of each
    insert (``batch_id=N``), ``fanout`` the facts by date. The pairs of the inserts behind the last repair semi-join the
    facts of their dates, and the buckets become a commit of the writer ``repair`` under the last insert's id, so a repair
    that died is done again. Returns that id; None when nothing was touched.

    Rows behind the watermark are counted neither by the stream nor by a refresh of the last day; this counts them."""
    from moodlake.functions.timefns import time_bucket
    from moodlake.operators.ingest import prune_values
    from moodlake.operators.sentiment import sentiment_buckets
    from moodlake.sources.posts_store import PARTITION_COL

    batch_of = lambda names: [int(n.split("=", 1)[1]) for n in names if n.startswith("batch_id=")]
    done = max(batch_of(_children(spark, f"{changelog}/writer=repair")), default=-1)
    todo = [b for b in sorted(batch_of(_children(spark, touched))) if b > done]
    if not todo:
        return None
    pairs = spark.read.parquet(*[f"{touched}/batch_id={b}" for b in todo]).select(*KEY).distinct()
    ends = F.col("bucket") + F.expr(f"interval {width}") - F.expr("interval 1 microsecond")
    dates = prune_values(pairs.select(F.explode(F.sequence(F.to_date("bucket"), F.to_date(ends))).alias(PARTITION_COL)), PARTITION_COL)
    facts = spark.read.parquet(fanout)
    if dates is not None:                               # more dates than a predicate should list: the join alone decides
        facts = facts.where(F.col(PARTITION_COL).isin(dates))
    own = facts.withColumn("bucket", time_bucket(time_col, width)).join(pairs, list(KEY), "left_semi").drop("bucket")
    commit(sentiment_buckets(own, width, time_col), changelog, "repair", todo[-1])
    return todo[-1]


def write_state(states: DataFrame, path: str, writer: str, batch_id: int, delta: bool = False) -> None:
    """A batch of states (``operators.sentiment.sentiment_state``): ``full`` ones replace what the writer said of a bucket
    before (a stream's update mode), deltas (a batch of late rows) are added. Re-running a batch replaces its own."""
    commit(states, f"{path}/kind={'delta' if delta else 'full'}", writer, batch_id)


def current_state(spark: SparkSession, path: str) -> DataFrame:
    """The state of every (bucket, ticker): each writer's newest full one and all deltas, added up."""
    from moodlake.operators.sentiment import STATE, merge_state

    log = spark.read.parquet(path)
    full = (log.where("kind = 'full'").groupBy(*KEY, "writer")
            .agg(F.max_by(F.struct(*STATE), F.struct("n_posts", "committed_at", "batch_id")).alias("r")).select(*KEY, "r.*"))
    return merge_state(full.unionByName(log.where("kind = 'delta'").select(*KEY, *STATE)))
