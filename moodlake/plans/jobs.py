"""Batch ingest jobs: one poll of posts into the store, and the replay.

``ingest_poll`` is the write path of one poll as a batch job: ids from the
unique key, column defaults, insert-if-absent into the partitioned posts store
(first write wins, stored side pruned to the poll's dates), symbol linking and
embedding of the new posts, only those with a symbol kept, and the fan-out of
exactly the rows that were inserted. ``replay`` reruns both sources and
marks the rows as backfill; the store's unique key makes it idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodlake import schemas
from moodlake.functions.text import post_text
from moodlake.operators.ingest import union_sources, valid_vector, with_post_defaults, with_post_id
from moodlake.operators.symbols import extract_symbols, fan_out, with_feed_engagement
from moodlake.sources import files as FS
from moodlake.sources.posts_store import PostsStore


def conform_posts(df: DataFrame) -> DataFrame:
    """The columns of the posts table, in order, cast to its types; absent ones NULL."""
    from pyspark.sql.types import ArrayType

    cols = []
    for f in schemas.POSTS.fields:
        dt = f.dataType
        if isinstance(dt, ArrayType):  # a cast cannot narrow element nullability
            dt = ArrayType(dt.elementType, True)
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        cols.append(c.cast(dt).alias(f.name))
    return df.select(*cols)


def posts_store(spark, path: str) -> PostsStore:
    return PostsStore(spark, path, schemas.POSTS)


def ingest_poll(store: PostsStore, posts: DataFrame, link_fn=None, backfill: bool = False,
                ingested_at=None, order=("arrival",), embed_fn=None,
                vector_size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Insert one poll's posts; returns (inserted posts, their ticker_posts rows).

    ``order``: the columns that tell what arrived first. ``link_fn`` adds ``tickers`` from a ``text`` column (default: the
    default dictionaries), ``embed_fn`` adds ``embedding`` from it; both run once, on new posts only. A vector of
    another length than ``vector_size`` is refused with its post. Feed posts fan out with score 1 and comments 0,
    listing posts with their own engagement."""
    link = link_fn or (lambda df: extract_symbols(df, "text"))
    rows = with_post_defaults(with_post_id(posts), ingested_at)
    if backfill:
        rows = rows.withColumn("is_backfill", F.lit(True))

    def prepare(new: DataFrame) -> DataFrame:
        linked = link(new.withColumn("text", post_text())).where(F.size("tickers") > 0)
        if embed_fn is not None:
            linked = embed_fn(linked)
        out = conform_posts(linked)
        if vector_size is not None:
            out = out.withColumn("__reject", ~valid_vector("embedding", vector_size))
        return out

    new = store.insert(rows, order=order, prepare=prepare)
    return new, fan_out(with_feed_engagement(new))


def replay(store: PostsStore, listing_records: DataFrame, feed_items: DataFrame, link_fn=None,
           ingested_at=None, embed_fn=None, vector_size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rerun both ingests as a backfill over everything landed: the 'new' listing of every channel and all feed items,
    rows marked ``is_backfill``. Posts already stored are skipped (insert-if-absent), so replaying twice adds nothing."""
    listings = FS.listing_posts(FS.listing_poll(listing_records, backfill=True), ingested_at)
    feeds = FS.feed_posts(FS.feed_poll(feed_items), ingested_at)
    listings = listings.withColumn("arrival", F.col("pos").cast("long")).drop("listing", "pos")
    feeds = feeds.withColumn("arrival", F.col("pos").cast("long")).drop("feed", "pos")
    return ingest_poll(store, union_sources(listings, feeds), link_fn, backfill=True, ingested_at=ingested_at,
                       embed_fn=embed_fn, vector_size=vector_size)


def score_pass(posts: DataFrame, scores_path: str, model, as_of=None, horizon_hours: int = 24) -> DataFrame:
    """One pass of the scorer as a batch job: every post it may pick (unscored, created within the horizon, not
    backfill, and without a stored score — no 32-row cap: batching is the model call's concern) is scored in one
    distributed pass; the scores (id, stance, probs, model_ver, classified_at) are appended to their own dataset
    instead of updating posts in place. Returns the scores written; passing over the same posts again writes none.
    ``current_posts`` gives the posts with their scores filled in."""
    from moodlake.operators.scoring import score_with_model
    from moodlake.plans.serving import unscored

    queue = unscored(posts, as_of, horizon_hours).select("id", "title", "body")
    try:
        queue = queue.join(posts.sparkSession.read.parquet(scores_path).select("id"), "id", "left_anti")
    except Exception as e:  # noqa: BLE001 - no scores yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    queue = queue.withColumn("text", post_text())
    scored = score_with_model(model, queue).select(
        "id", F.col("stance").cast("short").alias("stance"), "probs", "model_ver",
        (F.current_timestamp() if as_of is None else F.lit(str(as_of)).cast("timestamp")).alias("classified_at"))
    scored = scored.checkpoint(eager=True)  # one scoring run, however often the result is read
    scored.write.mode("append").parquet(scores_path)
    return scored


def content_key(text_col: str = "text"):
    """What a text's scores are stored under: the text as it is (``txt_hash`` folds case and spaces, a model may not)."""
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)


def stored_scores(spark, path: str, model_ver: str) -> DataFrame | None:
    """The content-addressed scores of a model (one per text, the earliest); None before the first pass."""
    try:
        found = spark.read.parquet(f"{path}/model_ver={model_ver}")
    except Exception as e:  # noqa: BLE001 - no scores yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return (found.groupBy("content").agg(F.min_by(F.struct("stance", "probs"), F.struct("scored_at", "stance")).alias("s"))
            .select("content", "s.*"))


def score_by_content(posts: DataFrame, path: str, score_fn, model_ver: str, text_col: str = "text") -> DataFrame:
    """``posts`` with stance and probs, every distinct text scored once per model: copies share a score, and a text that an
    earlier pass has scored is not scored again. ``score_fn`` adds stance and probs to rows with ``text``; new scores are
    appended under (model_ver, content), keyed by content, and return to the posts by it.

    Copies are combined before texts are shuffled. Two passes side by side may both score a text; one score counts."""
    spark = posts.sparkSession
    keyed = posts.drop("stance", "probs").withColumn("__content", content_key(text_col))
    texts = keyed.groupBy(F.col("__content").alias("content")).agg(F.first(F.coalesce(text_col, F.lit(""))).alias("text"))
    known = stored_scores(spark, path, model_ver)
    if known is not None:
        texts = texts.join(known.select("content"), "content", "left_anti")
    fresh = score_fn(texts).select("content", F.col("stance").cast("short").alias("stance"), "probs", F.current_timestamp().alias("scored_at"))
    fresh.write.mode("append").parquet(f"{path}/model_ver={model_ver}")
    scores = stored_scores(spark, path, model_ver)
    return keyed.join(scores, keyed["__content"] == scores["content"], "left").drop("__content", "content")


def earliest_scores(scores: DataFrame) -> DataFrame:
    """One score per post: the first one written (a pass that ran twice side by side may have left two)."""
    rest = [c for c in scores.columns if c != "id"]
    return (scores.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct("classified_at", "model_ver", "stance")).alias("__s"))
            .select("id", *[F.col(f"__s.{c}").alias(c) for c in rest]))


def current_posts(posts: DataFrame, scores: DataFrame) -> DataFrame:
    """Posts with the stored scores filled in (stance moves NULL -> value once, so
    only still-unscored posts are joined; the rest pass through). A post has one score, the earliest."""
    s = earliest_scores(scores).select("id", F.col("stance").alias("__st"), F.col("probs").alias("__pr"),
                                       F.col("model_ver").alias("__mv"), F.col("classified_at").alias("__ca"))
    done = posts.where(F.col("stance").isNotNull())
    todo = posts.where(F.col("stance").isNull()).join(s, "id", "left")
    filled = (todo.withColumn("stance", F.coalesce("stance", "__st"))
              .withColumn("probs", F.coalesce("probs", "__pr"))
              .withColumn("model_ver", F.coalesce("model_ver", "__mv"))
              .withColumn("classified_at", F.coalesce("classified_at", "__ca"))
              .select(*posts.columns))
    return done.unionByName(filled)


def export_posts(posts: DataFrame) -> DataFrame:
    """Posts as they leave the engine: ``probs`` as JSON text, the form the posts table stores."""
    return posts.withColumn("probs", F.to_json("probs"))
