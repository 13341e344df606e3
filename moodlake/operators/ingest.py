"""Ingest operators: first-write-wins dedup, insert-if-absent, fan-out, unions.

First write wins is an aggregation (``min_by`` over the arrival order), not a
window: the partial aggregate collapses the copies of a hot key inside every
map task, so a key holding a third of all arrivals never lands whole in one
task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POST_KEY = ("source", "external_id", "created_at")


# most partition values a static predicate lists before it falls back to a range
MAX_PRUNE_VALUES = 1000
# when and where a record was landed: orders the copies of a post within a batch
ARRIVAL = "__arrival"


def with_arrival(records: DataFrame) -> DataFrame:
    """Adds ``__arrival`` to the rows of a file source: file time, file, place in the file. Call it on the source itself,
    before anything that changes the rows' order; on a stream, ``with_arrival_rows`` numbers the rows of each batch."""
    m = F.col("_metadata")
    at = F.struct(m["file_modification_time"].alias("time"), m["file_path"].alias("file"), m["file_block_start"].alias("block"))
    records = records.withColumn(ARRIVAL, at)
    return records if records.isStreaming else with_arrival_rows(records)


def with_arrival_rows(batch: DataFrame) -> DataFrame:
    """``__arrival`` (if there is one) completed by the row's place among the rows of its task, in file order."""
    if ARRIVAL not in batch.columns:
        return batch
    a = F.col(ARRIVAL)
    return batch.withColumn(ARRIVAL, F.struct(a["time"].alias("time"), a["file"].alias("file"), a["block"].alias("block"),
                                              F.monotonically_increasing_id().alias("row")))


def split_null_keys(df: DataFrame, key=POST_KEY) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is whole, rows with a NULL in it). The key columns are NOT NULL in the posts table;
    a NULL never equals anything, so such a row would be inserted again at every replay."""
    whole = F.lit(True)
    for c in key:
        whole = whole & F.col(c).isNotNull()
    return df.where(whole), df.where(~whole)


def first_write(df: DataFrame, key=POST_KEY, order=("k",)) -> DataFrame:
    """One row per key: the row with the smallest ``order``, the columns that say what arrived first (required;
    ties are broken by the remaining columns, so the result is deterministic)."""
    key, order = list(key), list(order)
    if not order:
        raise ValueError("first write wins needs the columns of the arrival order")
    rest = [c for c in df.columns if c not in key]
    rank = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order])
    return (df.groupBy(*key)
            .agg(F.min_by(F.struct(*[F.col(c) for c in rest]), rank).alias("__w"))
            .select(*key, *[F.col(f"__w.{c}").alias(c) for c in rest])
            .select(*df.columns))


def prune_values(batch: DataFrame, prune_col: str) -> list | None:
    """The batch's distinct values of ``prune_col``; None when there are more than MAX_PRUNE_VALUES."""
    found = [r[0] for r in batch.select(prune_col).where(F.col(prune_col).isNotNull()).distinct()
             .limit(MAX_PRUNE_VALUES + 1).collect()]
    return found if len(found) <= MAX_PRUNE_VALUES else None


def prune_filter(batch: DataFrame, prune_col: str):
    """Predicate on ``prune_col`` covering the batch: its distinct values (one far outlier adds one partition,
    not all between), or their range when there are too many. Spark's dynamic partition pruning never prunes the
    build side of an anti join, so a stored target is pruned statically; exact, as a matching key has the same
    partition value."""
    values = prune_values(batch, prune_col)
    if values is None:
        lo, hi = batch.agg(F.min(prune_col), F.max(prune_col)).first()
        return F.col(prune_col).between(F.lit(lo), F.lit(hi))
    return F.col(prune_col).isin(values) if values else F.lit(False)


def insert_new(target: DataFrame, batch: DataFrame, key=POST_KEY, order=("k",),
               prune_col: str | None = None) -> DataFrame:
    """Rows of ``batch`` with a whole key that is absent from ``target`` (first write wins
    inside the batch). With ``prune_col`` (the partition column of a stored
    target, and a function of the key) the anti join also matches on it, and the target is read only
    at the batch's values of that column (PartitionFilters)."""
    batch, _ = split_null_keys(batch, key)
    on = list(key) + ([prune_col] if prune_col else [])
    new = first_write(batch, on, order)     # by the columns of the join, which so needs no second shuffle
    stored = target.select(*on)
    if prune_col:
        stored = stored.where(prune_filter(batch, prune_col))
    return new.join(stored, on=on, how="left_anti")


def union_listings(*listings: DataFrame) -> DataFrame:
    """Bag union of listing polls (overlap is removed by the insert key)."""
    out = listings[0]
    for d in listings[1:]:
        out = out.unionByName(d)
    return out


def union_sources(*sources: DataFrame) -> DataFrame:
    """Union of sources with different column sets; missing columns are NULL."""
    out = sources[0]
    for d in sources[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def with_post_id(posts: DataFrame) -> DataFrame:
    """``id`` = xxhash64 of the unique key (source, external_id, created_at), so a
    replayed post gets the id it had; an existing ``id`` column is kept."""
    if "id" in posts.columns:
        return posts
    return posts.withColumn("id", F.xxhash64(*[F.col(c) for c in POST_KEY]))


def with_post_defaults(posts: DataFrame, ingested_at=None) -> DataFrame:
    """Column defaults of the posts table: empty symbol list, ingest stamp (the
    query's current time — in a micro-batch, the batch's timestamp, the same for
    every row of the batch), a NULL backfill flag, and the text hash."""
    out = posts
    if "tickers" in out.columns:
        out = out.withColumn("tickers", F.coalesce("tickers", F.array().cast("array<string>")))
    if "ingested_at" not in out.columns:
        out = out.withColumn("ingested_at", F.current_timestamp() if ingested_at is None
                             else F.lit(str(ingested_at)).cast("timestamp"))
    if "is_backfill" not in out.columns:
        out = out.withColumn("is_backfill", F.lit(None).cast("boolean"))
    if "txt_hash" not in out.columns and {"title", "body"} <= set(out.columns):
        from moodlake.functions.text import post_text, text_hash
        out = out.withColumn("txt_hash", text_hash(post_text()))
    return out


def stamp_classified(scored: DataFrame) -> DataFrame:
    """``classified_at`` = now (wall clock, read when this is called) on scored
    rows. Call it after the scores have been computed (e.g. on a persisted,
    materialised batch) so the stamp follows the scoring."""
    import datetime as dt

    now = dt.datetime.now(dt.timezone.utc)
    return scored.withColumn("classified_at", F.when(F.col("stance").isNotNull(), F.lit(now)))


def valid_vector(vec_col: str, dim: int):
    """Whether a vector may be stored: NULL (the column is nullable) or of the declared size."""
    from moodlake.functions.vectors import has_dim
    return F.col(vec_col).isNull() | has_dim(vec_col, dim)


def split_vector_size(df: DataFrame, dim: int, vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by the declared vector size — the
    store's fixed-size guard. A filter pair on one input, no shuffle; rejected
    rows go to quarantine instead of failing the batch."""
    ok = valid_vector(vec_col, dim)
    return df.where(ok), df.where(~ok)
