"""Structured Streaming jobs.

* landed files -> ``readStream`` with a declared schema;
* live ingest: insert-if-absent in two tiers, so a post is stored once however late it or a copy of it arrives: keys
  ahead of the watermark are known to keyed RocksDB state, keys behind it are looked up in the stored posts;
* engagement-weighted sentiment per (10 s window, ticker) in update mode under a 1-day watermark — a
  bucket keeps changing for a day, so append mode would hold every bucket; rows later than that skip only
  the stream's aggregate, and the buckets they touch are repaired from the stored fan-out (``views.repair_view``);
* sinks are ``foreachBatch`` writers that overwrite the directories of their own
  batch id: a batch re-run after a lost executor or driver restart replaces
  its output instead of duplicating it (exactly-once with the checkpoint).

Everything lives under the shared checkpoint root (``spark.checkpoint.dir``).
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodlake.functions.timefns import bucket_window
from moodlake.operators.ingest import (ARRIVAL, POST_KEY, first_write, prune_values, split_null_keys, stamp_classified,
                                       valid_vector, with_arrival, with_arrival_rows, with_post_defaults, with_post_id)
from moodlake.operators.sentiment import STATE, finish_state, state_aggregates
from moodlake.session import keep_state_in_rocksdb, ship_package
from moodlake.sources.posts_store import PARTITION_COL, read_dates, store_dates, with_blooms, with_partition
from moodlake.sources.views import commit, current_view

WATERMARK = "1 day"
# Rows of a micro-batch per task that writes them: a batch's files follow its rows and dates, not dates times shuffle tasks.
FILE_ROWS = 10_000
# Most row numbers of a micro-batch's new posts that are sent to every task.
MAX_ROWS_SENT = 2_000_000


def event_time(df: DataFrame, time_col: str) -> DataFrame:
    """Watermarks need TIMESTAMP; a TIMESTAMP_NTZ event time is read as UTC
    (the session time zone is pinned to UTC, so wall-clock values are unchanged)."""
    from pyspark.sql.types import TimestampNTZType
    if isinstance(df.schema[time_col].dataType, TimestampNTZType):
        return df.withColumn(time_col, F.col(time_col).cast("timestamp"))
    return df


def dedup_stream(df: DataFrame, key, time_col: str = "created_at", watermark: str = WATERMARK) -> DataFrame:
    """Drop re-delivered rows (first seen wins) with state bounded by the watermark."""
    return event_time(df, time_col).withWatermark(time_col, watermark).dropDuplicates(list(key))


def sentiment_stream(ticker_posts: DataFrame, width: str = "10 seconds", time_col: str = "created_at",
                     watermark: str = WATERMARK, with_watermark: bool = True, state: bool = False) -> DataFrame:
    """Windowed sentiment aggregate over a (watermarked) stream of fan-out rows; with ``state`` the buckets' states, which
    longer buckets and late batches are added up from (``views.write_state``)."""
    src = event_time(ticker_posts, time_col)
    src = src.withWatermark(time_col, watermark) if with_watermark else src
    states = (src.where(F.col("stance").isNotNull())
              .groupBy(bucket_window(time_col, width).alias("win"), F.col("ticker")).agg(*state_aggregates())
              .select(F.col("win.start").alias("bucket"), "ticker", *STATE))
    return states if state else finish_state(states)


def score_recent(posts: DataFrame, score_fn, horizon_hours: int | None = None,
                 time_col: str = "created_at") -> DataFrame:
    """Apply ``score_fn``; with a horizon, only posts created within
    ``horizon_hours`` of the batch time keep their scores (the reference's
    queue never picks older posts, so they stay unscored and out of the
    sentiment aggregate). The horizon is the batch's ``current_timestamp()``."""
    scored = score_fn(posts)
    if horizon_hours is None:
        return scored
    recent = F.col(time_col) > F.current_timestamp() - F.make_dt_interval(F.lit(0), F.lit(int(horizon_hours)))
    for c in ("stance", "probs", "model_ver"):
        if c in scored.columns:
            scored = scored.withColumn(c, F.when(recent, F.col(c)))
    return scored


def batch_dir_writer(path: str, fmt: str = "parquet"):
    """foreachBatch function: write each micro-batch to ``path/batch_id=N``,
    overwriting on re-execution (idempotent)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").format(fmt).save(f"{path}/batch_id={batch_id}")
    return write


def changelog_writer(path: str, writer: str = "stream"):
    """foreachBatch function of an upserted view: each micro-batch is a commit of ``writer`` (``views.commit``)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        commit(batch, path, writer, batch_id)
    return write


def read_changelog(spark: SparkSession, path: str) -> DataFrame:
    """Current value of an upserted view: newest commit per key (max_by, partial aggregation, no sort)."""
    return current_view(spark, path)


def run_available(writer, checkpoint: str, timeout_s: int = 900):
    """Process everything landed so far, then stop (availableNow trigger)."""
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
        raise TimeoutError("streaming query did not finish")
    if q.exception() is not None:
        raise q.exception()
    return q


def start_sentiment_from_fanout(spark: SparkSession, paths: dict, fanout_schema, trigger: dict | None = None,
                                width: str = "10 seconds"):
    """Second stage of the live path: new fan-out rows as a stream -> windowed sentiment (update mode) -> changelog sink.

    It reads the hand-off folder ``fan_queue``, from which Spark deletes what a committed batch has read, so its listing
    does not grow with the store (``paths`` without one: the ``batch_id`` folders of ``ticker_posts``).

    A re-executed ingest batch rewrites its hand-off under new file names, which the file source would read again;
    fan-out rows are therefore deduplicated on (post_id, ticker, created_at) under the watermark before they are
    aggregated, so a replayed batch cannot be counted twice."""
    trigger = trigger or {"processingTime": "10 seconds"}
    reader = spark.readStream.schema(fanout_schema)
    if "fan_queue" in paths:
        tp = reader.option("cleanSource", "delete").option("recursiveFileLookup", "true").parquet(paths["fan_queue"])
    else:
        tp = reader.parquet(f"{paths['ticker_posts']}/batch_id=*")
    agg = sentiment_stream(dedup_stream(tp, ("post_id", "ticker", "created_at")), width=width, with_watermark=False)
    return (agg.writeStream.outputMode("update").foreachBatch(changelog_writer(paths["sentiment"]))
            .option("checkpointLocation", paths["ckpt_agg"]).trigger(**trigger).start())


# --- live ingest: insert-if-absent in two tiers --------------------------------------------------

# a key that the stream's state saw for the first time, and the clock that the watermark may not pass
NEW_KEY, CLOCK = "__new_key", "__clock"
# a row's number in its micro-batch
ROW = "__row"


def with_new_keys(records: DataFrame, to_rows, key=POST_KEY, time_col: str = "created_at", watermark: str = WATERMARK,
                  clock=None) -> DataFrame:
    """The streamed records, and a row ``__new_key`` for every key that the state (keyed, RocksDB, expiring by event time)
    has not seen. Of rows behind the watermark the state tells nothing; those are looked up in the store.

    The watermark follows the least of the newest event time and the newest ``clock`` (default: the batch's time): a post
    dated years ahead does not move it, so it cannot make all others late."""
    keys, _ = split_null_keys(to_rows(records).select(*key), key)
    keys = (event_time(keys, time_col).withWatermark(time_col, watermark).dropDuplicates(list(key))
            .select(F.struct(*key).alias(NEW_KEY)))
    clock = F.current_timestamp() if clock is None else F.col(clock) if isinstance(clock, str) else clock
    rows = records.withColumn(CLOCK, clock.cast("timestamp")).withWatermark(CLOCK, watermark)
    return rows.unionByName(keys, allowMissingColumns=True)


class Progress:
    """A small JSON file per micro-batch: what it counted, and the newest times up to it, from which the next batch knows
    the watermark it runs under. ``batch_id`` -1 is written at the start: a store that is there already was filled by
    others, so rows up to its last date are looked up there however new they are."""

    def __init__(self, spark: SparkSession, path: str, watermark: str = WATERMARK):
        self.spark, self.path = spark, path
        delay = spark.range(1).select(F.expr(f"cast(interval {watermark} as interval day to second)").alias("d")).first()["d"]
        self.delay = delay // dt.timedelta(microseconds=1)

    def _file(self, batch_id: int):
        f = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch-{batch_id:012d}.json")
        return f, f.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def start(self, posts_dir: str) -> None:
        f, fs = self._file(-1)
        if not fs.exists(f):
            dates = store_dates(self.spark, posts_dir)
            days = (dt.date.fromisoformat(max(dates)) - dt.date(1970, 1, 1)).days + 1 if dates else None
            self.write(-1, {"floor": days * 86_400_000_000 if dates else None})

    def write(self, batch_id: int, facts: dict) -> None:
        f, fs = self._file(batch_id)
        out = fs.create(f, True)
        out.write((json.dumps({"batch_id": batch_id} | facts) + "\n").encode())
        out.close()

    def read(self, batch_id: int) -> dict | None:
        f, fs = self._file(batch_id)
        if not fs.exists(f):
            return None
        stream = fs.open(f)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def bound(self, before: dict | None) -> int | None:
        """Event times (in microseconds) under it are looked up: the watermark that the batch after ``before`` runs under (a
        millisecond more, the state's precision), or the floor. None: all rows are."""
        if before is None:
            return None
        times = [before.get("newest"), before.get("clock")]
        bounds = [] if None in times else [min(times) - self.delay + 1000]
        return max([x for x in (*bounds, before.get("floor")) if x is not None], default=-(1 << 62))


def ingest_metrics(spark: SparkSession, out_root: str) -> DataFrame:
    """What each micro-batch counted: records read, corrupt ones, rows with a NULL in the key, rows looked up in the store,
    posts that were new, repeated rows, posts stored, refused vectors and fan-out rows."""
    counts = ", ".join(f"{c} bigint" for c in ("read", "corrupt", "null_keys", "looked_up", "new", "repeated", "stored",
                                               "refused_vectors", "fanned_out"))
    return spark.read.schema(f"batch_id bigint, {counts}").json(f"{out_root}/progress").where("batch_id >= 0")


def store_insert_writer(out_root: str, link_fn, score_fn=None, key=POST_KEY, order=(ARRIVAL,),
                        score_horizon_hours: int | None = None, to_posts=None, corrupt_col: str = "_corrupt_record",
                        derived_cols=("text",), embed_fn=None, vector_size: int | None = None, progress: Progress | None = None,
                        bucket: str = "10 seconds"):
    """foreachBatch function of the live path (the reference's unique key + ON CONFLICT DO NOTHING, kept forever).

    Per micro-batch: rows with a NULL in the key go to ``quarantine_keys``; first write wins inside the batch by
    ``order``, the arrival order (an aggregation with a map-side partial, so the copies of a hot post collapse before
    any shuffle). Of landed posts rows only keys and arrivals are shuffled for that, and the numbers of those that are new
    are sent to the tasks that hold the rows (up to ``MAX_ROWS_SENT``; beyond that, and with ``to_posts``, whole rows are
    shuffled). Of the first rows, rows ahead of the watermark are new if the stream's state says so (``with_new_keys``), and no
    stored file is read for them; rows behind it are anti-joined to the posts of all EARLIER batches, whose folders are
    listed and read for the dates of those rows only. A batch without new keys (a writer of its own) looks all rows up.
    Only the new posts are linked, scored and embedded. Posts with a symbol are written to
    ``posts/created_date=D/batch_id=N`` (dynamic overwrite), those whose vector has another length than ``vector_size``
    to ``quarantine_vectors``, the fan-out to ``ticker_posts/created_date=D/batch_id=N`` and, for the next stage, to
    ``fan_queue/batch_id=N``; the (bucket, ticker) pairs that rows behind the watermark touch go to ``touched/batch_id=N``
    (``views.repair_view``). A re-executed batch excludes only earlier batches, so it recomputes and replaces exactly its
    own output.

    With ``to_posts`` the landing holds raw source records (listing JSON, say): records a PERMISSIVE reader could not
    parse (``corrupt_col`` set) go to ``quarantine/batch_id=N`` and the rest are mapped to posts rows first."""
    from moodlake.functions.timefns import time_bucket
    from moodlake.operators.symbols import fan_out, with_feed_engagement

    posts_dir, key = f"{out_root}/posts", list(key)

    def by_date(rows: DataFrame, name: str, batch_id: int) -> None:
        """``rows`` come in ranges of time, so a task has few dates and a hot date many tasks."""
        (with_blooms(with_partition(rows).withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite")).option("partitionOverwriteMode", "dynamic")
         .partitionBy(PARTITION_COL, "batch_id").parquet(f"{out_root}/{name}"))

    def by_batch(rows: DataFrame, name: str, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out_root}/{name}/batch_id={batch_id}")

    def absent(rows: DataFrame, batch_id: int) -> DataFrame:
        """Rows whose key no earlier batch has stored."""
        spark = rows.sparkSession
        dates = prune_values(rows, PARTITION_COL)
        if dates is None:  # more dates than a predicate should list: read the whole store, if there is one
            dates = store_dates(spark, posts_dir)
        stored_schema = T.StructType([rows.schema[c] for c in key] + [T.StructField(PARTITION_COL, T.DateType()),
                                                                     T.StructField("batch_id", T.LongType())])
        prior = read_dates(spark, posts_dir, dates, stored_schema) if dates else None
        if prior is None:
            return rows
        return rows.join(prior.where(F.col("batch_id") < F.lit(batch_id)).select(*key, PARTITION_COL),
                         key + [PARTITION_COL], "left_anti")

    def mapped(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(parsed records as posts rows, corrupt records)"""
        tiered, raw = NEW_KEY in batch.columns, to_posts is not None
        rows = batch.where(F.col(NEW_KEY).isNull()) if tiered else batch
        bad = rows.limit(0).select(F.lit("").alias(corrupt_col))
        if raw and corrupt_col in batch.columns:
            rows, bad = rows.where(F.col(corrupt_col).isNull()), rows.where(F.col(corrupt_col).isNotNull()).select(corrupt_col)
        rows = rows.drop(*[c for c in (NEW_KEY, CLOCK, corrupt_col if raw else None) if c])
        return (with_post_defaults(with_post_id(to_posts(rows))) if raw else rows), bad

    def newest(batch_id: int, before: dict | None, **stamps) -> dict:
        """The newest times so far, and the floor."""
        old = before or {}
        return {c: max((x for x in (v, old.get(c)) if x is not None), default=None) for c, v in stamps.items()} | {"floor": old.get("floor")}

    def write(batch: DataFrame, batch_id: int) -> None:
        before = progress.read(batch_id - 1) if progress else None
        tiered = NEW_KEY in batch.columns
        bound = progress.bound(before) if tiered and progress else None
        batch = with_arrival_rows(batch).persist()      # the corrupt-record column may only be queried on parsed, cached rows
        rows, bad = mapped(batch)
        event = F.unix_micros(F.col("created_at").cast("timestamp"))
        late = F.lit(True) if bound is None else event < F.lit(bound)
        whole, torn = split_null_keys(rows, key)
        no_key = F.lit(False)
        for c in key:
            no_key = no_key | F.col(c).isNull()
        clock = batch.agg(F.max(F.unix_micros(CLOCK)).alias("clock")) if CLOCK in batch.columns else None
        seen = rows.agg(F.count(F.lit(1)).alias("parsed"), F.count_if(no_key).alias("null_keys"),
                        F.count_if(~no_key & late).alias("looked_up"), F.max(F.when(~no_key, event)).alias("newest"))
        seen = (seen if clock is None else seen.crossJoin(clock)).crossJoin(bad.agg(F.count(F.lit(1)).alias("corrupt"))).first().asDict()
        stamps = newest(batch_id, before, newest=seen["newest"], clock=seen.get("clock"))
        facts = {"read": seen["parsed"] + seen["corrupt"], "corrupt": seen["corrupt"], "null_keys": seen["null_keys"],
                 "looked_up": seen["looked_up"], "new": 0, "repeated": 0, "stored": 0, "refused_vectors": 0, "fanned_out": 0}
        if seen["corrupt"]:
            by_batch(bad, "quarantine", batch_id)
        if seen["null_keys"]:
            by_batch(torn.drop(ARRIVAL), "quarantine_keys", batch_id)
        if seen["parsed"] > seen["null_keys"]:
            facts |= insert(batch, with_partition(whole), late, bound, seen["looked_up"], batch_id, 1 + seen["parsed"] // FILE_ROWS)
            facts["repeated"] = seen["parsed"] - seen["null_keys"] - facts["new"]
        if progress:
            progress.write(batch_id, facts | stamps)
        batch.unpersist()

    def insert(batch: DataFrame, whole: DataFrame, late, bound, looked_up: int, batch_id: int, tasks: int) -> dict:
        """Stores the rows that are new, written by so many tasks; returns what was counted."""
        def unknown(first: DataFrame) -> DataFrame:
            """Those of a batch's first rows that are neither stored nor known to the stream's state."""
            parts = [absent(first.where(late), batch_id)] if looked_up else []
            if bound is not None:
                # the columns and types of the aggregation, so its rows need no second shuffle
                fresh = batch.where(F.col(NEW_KEY).isNotNull()).select(*[F.col(f"{NEW_KEY}.{c}").cast(first.schema[c].dataType).alias(c) for c in key])
                parts.append(first.where(~late).join(with_partition(fresh), key + [PARTITION_COL], "left_semi").select(*first.columns))
            return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

        sent = None
        if to_posts is None and ARRIVAL in order:       # a row has a number: the new ones are found by key, and only they are read whole
            slim = whole.select(*dict.fromkeys([*key, "created_at", PARTITION_COL, *order]))
            sent = unknown(first_write(slim, key + [PARTITION_COL], order)).select(F.col(f"{ARRIVAL}.row").alias(ROW)).persist()
        if sent is not None and sent.count() <= MAX_ROWS_SENT:
            new = whole.withColumn(ROW, F.col(f"{ARRIVAL}.row")).join(F.broadcast(sent), ROW, "left_semi").drop(ROW, ARRIVAL)
        else:
            new = unknown(first_write(whole, key + [PARTITION_COL], order).drop(ARRIVAL))
        inserted = Observation()
        posts = link_fn(new.drop(PARTITION_COL).observe(inserted, F.count(F.lit(1)).alias("n")))
        if embed_fn is not None:  # only posts that are new get embedded
            posts = embed_fn(posts)
        staged = None
        if score_fn is not None:
            staged = score_recent(posts, score_fn, score_horizon_hours).persist()
            staged.count()  # scores exist from here on: stamp classified_at after them
            posts = stamp_classified(staged)
        fits = F.lit(True) if vector_size is None else valid_vector("embedding", vector_size)
        kept = posts.where(F.size("tickers") > 0).drop(*derived_cols).persist()     # title and body are stored
        stored = kept.agg(F.count_if(fits).alias("stored"), F.count_if(~fits).alias("refused_vectors"),
                          F.coalesce(F.sum(F.when(fits, F.size("tickers"))), F.lit(0)).cast("long").alias("fanned_out")).first().asDict()
        by_date(kept.where(fits).repartitionByRange(tasks, "created_at"), "posts", batch_id)
        facts = {"new": inserted.get["n"]} | stored
        if facts["refused_vectors"]:
            by_batch(kept.where(~fits), "quarantine_vectors", batch_id)
        # of the cached rows that are stored, not a second evaluation
        fan = fan_out(with_feed_engagement(kept.where(fits))).repartitionByRange(tasks, "created_at")
        if facts["stored"]:
            by_date(fan, "ticker_posts", batch_id)
            by_batch(fan, "fan_queue", batch_id)
            if looked_up:
                by_batch(fan.where(late).select(time_bucket("created_at", bucket).alias("bucket"), "ticker").distinct(), "touched", batch_id)
        for df in (staged, kept, sent):
            if df is not None:
                df.unpersist()
        return facts

    return write


def start_store_pipeline(spark: SparkSession, landing: str, landing_schema, out_root: str, link_fn,
                         score_fn=None, trigger: dict | None = None, landing_format: str = "json",
                         max_files_per_trigger: int | None = None, order=(ARRIVAL,), score_horizon_hours: int | None = None,
                         to_posts=None, reader_options: dict | None = None, derived_cols=("text",), embed_fn=None,
                         vector_size: int | None = None, watermark: str = WATERMARK, clock=None):
    """The live path: landed posts -> insert-if-absent -> posts and fan-out folders.

    Duplicates are caught, and new posts kept, however late they arrive: keys ahead of the watermark by the query's state,
    keys behind it by the store. ``clock`` (a column of the landing; default the batch's time) is what the watermark never
    passes; a replay of history gives the time its records were polled. ``order`` is the arrival order inside a
    micro-batch (default: file time, file, place in the file; a ``to_posts`` that builds new rows must carry ``__arrival``
    through, as the readers of this library do). ``trigger`` is passed to ``DataStreamWriter.trigger`` (default: every
    10 s, the refresh interval of the reference; ``{"availableNow": True}`` in tests). Stored posts carry ``id``,
    ``ingested_at`` (batch time) and ``classified_at``; ``derived_cols`` (the linking text) are not stored. Returns (query,
    paths); ``fan_queue`` feeds ``start_sentiment_from_fanout``, ``ingest_metrics`` reads what the batches counted."""
    ship_package(spark)
    keep_state_in_rocksdb(spark)
    trigger = trigger or {"processingTime": "10 seconds"}
    paths = {k: f"{out_root}/{k}" for k in ("posts", "ticker_posts", "fan_queue", "touched", "sentiment", "ckpt_ingest", "ckpt_agg")}
    queue = spark._jvm.org.apache.hadoop.fs.Path(paths["fan_queue"])
    queue.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(queue)
    progress = Progress(spark, f"{out_root}/progress", watermark)
    progress.start(paths["posts"])
    reader = spark.readStream.schema(landing_schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    for k, v in (reader_options or {}).items():
        reader = reader.option(k, v)
    src = with_arrival(reader.format(landing_format).load(landing))
    if to_posts is None:
        src = with_post_defaults(with_post_id(src))
    src = with_new_keys(src, to_posts or (lambda rows: rows), watermark=watermark, clock=clock)
    q = (src.writeStream.foreachBatch(store_insert_writer(
            out_root, link_fn, score_fn, order=order, score_horizon_hours=score_horizon_hours, to_posts=to_posts,
            derived_cols=derived_cols, embed_fn=embed_fn, vector_size=vector_size, progress=progress))
         .option("checkpointLocation", paths["ckpt_ingest"]).trigger(**trigger).start())
    return q, paths


#: One live path: nothing in it forgets a post.
start_live_pipeline = start_store_pipeline
