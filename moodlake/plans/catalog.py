"""Registered queries: key -> (spark, sf_dir) -> DataFrame.

Every query reads the given tables (or data Spark derives from them) in
full; parameters such as the symbol, ``as_of`` and ``k`` are the features of
the query, not row caps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodlake.operators import sentiment as S
from moodlake.plans import overlays as O
from moodlake.plans import serving as V
from moodlake.plans.normalize import for_check
from moodlake.session import ship_package

# FIXED VALUES (fixture parameters shared with the oracle SQL)
SERIES_TICKER = "click"
SERIES_AS_OF = "2024-01-30 00:00:00"
CLOSED_AS_OF = "2024-01-15 00:00:00"
REFRESH_AS_OF_1 = "2024-01-14 12:00:00"
METRICS_AS_OF = "2024-01-15 12:00:00"
TEXT_AS_OF = "2024-01-01 12:00:00"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(key: str):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # every time function assumes UTC (feed dates, epochs, bucket bounds)
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            ship_package(spark)
            return for_check(fn(spark, sf_dir))

        QUERIES[key] = run
        QUERIES[key].__name__ = key
        return fn
    return deco


def _mentions(spark, sf_dir):
    return O.scored_mentions(O.load(spark, sf_dir, "events"))


def _view10s(spark, sf_dir):
    return S.sentiment_buckets(_mentions(spark, sf_dir), "10 seconds")


@register("sentiment_buckets_10s")
def q_buckets_10s(spark, sf_dir):
    return _view10s(spark, sf_dir)


@register("sentiment_buckets_1h")
def q_buckets_1h(spark, sf_dir):
    return S.sentiment_buckets(_mentions(spark, sf_dir), "1 hour")


@register("sentiment_buckets_7d")
def q_buckets_7d(spark, sf_dir):
    return S.sentiment_buckets(_mentions(spark, sf_dir), "7 days")


@register("sentiment_closed_buckets")
def q_closed(spark, sf_dir):
    from moodlake.sources.views import refresh_window
    return refresh_window(_mentions(spark, sf_dir), CLOSED_AS_OF)


@register("sentiment_series")
def q_series(spark, sf_dir):
    return V.sentiment_series_from_facts(_mentions(spark, sf_dir), SERIES_TICKER, from_hours=24, as_of=SERIES_AS_OF)


@register("sentiment_latest")
def q_latest(spark, sf_dir):
    return V.sentiment_latest_from_facts(_mentions(spark, sf_dir), SERIES_TICKER)


@register("sentiment_latest_all")
def q_latest_all(spark, sf_dir):
    return S.latest_per_ticker(_view10s(spark, sf_dir))


@register("chart_feed")
def q_chart(spark, sf_dir):
    return V.chart_rows(V.sentiment_series_from_facts(_mentions(spark, sf_dir), SERIES_TICKER, from_hours=24,
                                                      as_of=SERIES_AS_OF))


def _meta(spark, sf_dir):
    return O.posts_meta(O.load(spark, sf_dir, "events"))


@register("pipeline_count_5m")
def q_count5(spark, sf_dir):
    return V.pipeline_count(_meta(spark, sf_dir), 5, as_of=METRICS_AS_OF)


@register("pipeline_latency_p95")
def q_p95(spark, sf_dir):
    return V.pipeline_latency_p95(_meta(spark, sf_dir), 10, as_of=METRICS_AS_OF)


@register("pipeline_metrics")
def q_metrics(spark, sf_dir):
    return V.pipeline_metrics(_meta(spark, sf_dir), as_of=METRICS_AS_OF)


@register("pipeline_latency_sketch")
def q_p95_sketch(spark, sf_dir):
    """p95 from the stored minutes' sketches: of the last ten minutes, and of all, whose rank must be right to 1 %."""
    posts, path = _meta(spark, sf_dir), scratch_dir(spark, "latency_sketches")
    V.latency_sketches(posts).write.parquet(path)
    sketches = spark.read.parquet(path)
    recent = V.latency_from_sketches(sketches, minutes=10, as_of=METRICS_AS_OF)
    whole = V.latency_from_sketches(sketches, minutes=None).select(F.col("n").alias("n_all"), F.col("p95_latency_sec").alias("__p"))
    lat = V.seconds_between("ingested_at", "classified_at")
    kept = posts.where(lat.isNotNull() & ~F.coalesce(F.col("is_backfill"), F.lit(False))).crossJoin(F.broadcast(whole))
    ranks = kept.groupBy("n_all").agg((F.count_if(lat < F.col("__p")) / F.count(F.lit(1))).alias("lo"),
                                      (F.count_if(lat <= F.col("__p")) / F.count(F.lit(1))).alias("hi"))
    near = (F.col("lo") - 0.01 <= 0.95) & (F.col("hi") + 0.01 >= 0.95)
    return recent.crossJoin(ranks.select("n_all", near.alias("rank_within_1pct")))


@register("unscored_queue")
def q_queue(spark, sf_dir):
    return V.unscored_queue(_meta(spark, sf_dir), as_of=METRICS_AS_OF).select(
        "id", "source", "created_at", "ingested_at")


@register("recent_sample")
def q_sample(spark, sf_dir):
    return V.recent_sample(O.posts_text(O.load(spark, sf_dir, "documents")), as_of=TEXT_AS_OF)


# --- text, hashing and symbol linking -------------------------------------

from moodlake.functions import text as TX  # noqa: E402
from moodlake.operators import symbols as SY  # noqa: E402
from moodlake.operators import text_ops as TO  # noqa: E402


def _posts_text(spark, sf_dir):
    return O.posts_text(O.load(spark, sf_dir, "documents"))


def _o6_whitelist():
    return {k: k for k in O.O6_WHITELIST}


def _linked(spark, sf_dir):
    p = _posts_text(spark, sf_dir).withColumn("text", TX.post_text())
    return SY.extract_symbols(p, "text", _o6_whitelist(), O.O6_STOPLIST, O.O6_KEYWORDS)


@register("text_hash")
def q_text_hash(spark, sf_dir):
    return TO.with_text_hash(_posts_text(spark, sf_dir)).select("id", "txt_hash")


@register("exact_duplicate_groups")
def q_dup_groups(spark, sf_dir):
    return TO.exact_duplicate_groups(TO.with_text_hash(_posts_text(spark, sf_dir)))


@register("duplicate_groups_inserted")
def q_dup_inserted(spark, sf_dir):
    """Groups over two inserts into the bucketed index: those of the first, updated by what the second adds."""
    hashed = TO.with_text_hash(_posts_text(spark, sf_dir))
    path, second = scratch_dir(spark, "duplicate_index"), F.col("id") % 2 == 1
    index = TO.DuplicateIndex(spark, path, int(spark.conf.get("spark.sql.shuffle.partitions")))
    index.insert(hashed.where(~second))
    known, grown = index.groups(), index.groups_with(hashed.where(second))
    return known.join(grown, "txt_hash", "left_anti").unionByName(grown)


@register("per_source_cap")
def q_cap(spark, sf_dir):
    return TO.per_source_cap(_posts_text(spark, sf_dir), "source", "id", 50).select("id", "source", "rank")


@register("candidate_symbols")
def q_candidates(spark, sf_dir):
    d = O.load(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), TX.candidate_symbols("text").alias("candidates"))


@register("extract_symbols")
def q_extract(spark, sf_dir):
    return _linked(spark, sf_dir).select("id", "tickers")


@register("keyword_symbols")
def q_keywords(spark, sf_dir):
    d = O.load(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"),
                    SY.finish(SY.keyword_hits(F.lower("text"), O.O6_KEYWORDS), 5).alias("tickers"))


@register("extract_symbols_large")
def q_extract_large(spark, sf_dir):
    """Symbol linking with a whitelist far beyond the literal bound: the key map
    (size-checked) is broadcast and probed with each post's candidate tokens."""
    p = _posts_text(spark, sf_dir).withColumn("text", TX.post_text())
    dim = O.conversation_symbols(O.load(spark, sf_dir, "conversations"))
    return SY.extract_symbols(p, "text", dim, O.O6_STOPLIST, O.O6_KEYWORDS).select("id", "tickers")


@register("keyword_symbols_large")
def q_keywords_large(spark, sf_dir):
    """Keyword linking with a dictionary too large for in-row CASE tests: a join on the keywords' rarest grams."""
    d = O.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    kw = O.benchmark_keywords(O.load(spark, sf_dir, "benchmark"))
    return SY.with_keyword_symbols(d, "text", kw, "found").select("id", SY.finish(F.col("found"), 5).alias("tickers"))


@register("symbol_fanout")
def q_fanout(spark, sf_dir):
    return SY.fan_out(_linked(spark, sf_dir), feed_engagement=True)


@register("posts_with_symbol")
def q_with_symbol(spark, sf_dir):
    return SY.posts_with_symbol(_linked(spark, sf_dir), "NTI").select("id", "tickers")


@register("symbol_keys")
def q_symbol_keys(spark, sf_dir):
    return SY.symbol_keys(O.symbols_from_parts(O.load(spark, sf_dir, "part")))


# --- ingest, sources and sinks --------------------------------------------

from moodlake.functions.dictionaries import FEED_SOURCE  # noqa: E402
from moodlake.operators import ingest as IG  # noqa: E402
from moodlake.session import scratch_dir  # noqa: E402
from moodlake.sources import files as FS  # noqa: E402
from moodlake.sources.posts_store import PostsStore, write_partitioned  # noqa: E402

ARRIVAL_COLS = ("id", "source", "external_id", "created_at", "k", "copy")
RANGE_START = "2024-01-10 00:00:00"
RANGE_END = "2024-01-12 12:00:00"


def _arrivals(spark, sf_dir):
    return O.arrivals(O.load(spark, sf_dir, "documents")).select(*ARRIVAL_COLS)


@register("dedup_first_write")
def q_dedup(spark, sf_dir):
    return IG.first_write(_arrivals(spark, sf_dir), order=("k", "copy"))


@register("insert_new_posts")
def q_insert(spark, sf_dir):
    arr = _arrivals(spark, sf_dir)
    stored = arr.where(F.col("k") == 0)
    batch = arr.where(F.col("k") > 0)
    return IG.insert_new(stored, batch, order=("k", "copy"))


_ARRIVAL_SCHEMA = "id long, source string, external_id string, created_at timestamp_ntz, k int, copy string"


@register("replay_idempotent")
def q_replay(spark, sf_dir):
    from pyspark.sql.types import _parse_datatype_string
    store = PostsStore(spark, scratch_dir(spark, "replay"), _parse_datatype_string(_ARRIVAL_SCHEMA))
    arr = _arrivals(spark, sf_dir)
    store.insert(arr, order=("k", "copy"))
    again = store.insert(arr, order=("k", "copy"))  # replay: adds nothing
    assert again.limit(1).count() == 0, "replay inserted rows twice"
    return store.read().drop("created_date")


@register("union_listings")
def q_union_listings(spark, sf_dir):
    new, hot = O.listings(O.load(spark, sf_dir, "conversations"))
    return IG.union_listings(new, hot).select("channel", "id", "listing", "pos", "score")


@register("union_sources")
def q_union_sources(spark, sf_dir):
    feed = _posts_text(spark, sf_dir).select(
        F.lit(FEED_SOURCE).alias("source"), "external_id", "created_at", "title", F.lit(1).alias("score"))
    new, hot = O.listings(O.load(spark, sf_dir, "conversations"))
    listing = IG.first_write(IG.union_listings(new, hot), key=("channel", "id"), order=("listing",))
    lp = FS.listing_posts(listing).select("source", "external_id", "created_at", "title", "subreddit",
                                          "score", "comments")
    return IG.union_sources(feed, lp)


@register("time_range_scan")
def q_time_range(spark, sf_dir):
    path = scratch_dir(spark, "posts_meta")
    write_partitioned(_meta(spark, sf_dir), path)
    store = PostsStore(spark, path, _meta(spark, sf_dir).schema)
    return store.scan(RANGE_START, RANGE_END).select("id", "created_at", "stance")


@register("symbol_seed")
def q_symbol_seed(spark, sf_dir):
    path = scratch_dir(spark, "symbols_csv")
    dim = O.symbols_from_parts(O.load(spark, sf_dir, "part"))
    (dim.select("symbol", F.concat(F.lit("Name of "), "symbol").alias("name"),
                F.lower("symbol").alias("aliases"))
     .write.option("header", True).csv(path))
    return FS.read_symbols(spark, path).select("symbol")


def _symbols(spark, sf_dir):
    return O.symbols_from_parts(O.load(spark, sf_dir, "part"))


@register("symbol_prefix")
def q_symbol_prefix(spark, sf_dir):
    return V.symbol_prefix(_symbols(spark, sf_dir), "Brand#1")


@register("symbol_list")
def q_symbol_list(spark, sf_dir):
    return V.symbol_list(_symbols(spark, sf_dir))


@register("feed_items")
def q_feed_items(spark, sf_dir):
    path = scratch_dir(spark, "feed_xml")
    (O.feed_xml_items(O.load(spark, sf_dir, "documents"))
     .write.format("xml").option("rowTag", "item").option("rootTag", "channel").save(path))
    posts = FS.feed_posts(FS.read_feed_items(spark, path), ingested_at=TEXT_AS_OF)
    return posts.select("source", "external_id", F.col("created_at").cast("timestamp_ntz").alias("created_at"),
                        "title", "url", "score", "txt_hash")


@register("feed_items_atom")
def q_feed_items_atom(spark, sf_dir):
    path = scratch_dir(spark, "feed_atom")
    (O.atom_xml_entries(O.load(spark, sf_dir, "documents"))
     .write.format("xml").option("rowTag", "entry").option("rootTag", "feed").save(path))
    posts = FS.feed_posts(FS.read_atom_entries(spark, path), ingested_at=TEXT_AS_OF)
    return posts.select("source", "external_id", F.col("created_at").cast("timestamp_ntz").alias("created_at"),
                        "title", "url", "score", "txt_hash")


FEED_FILE_BYTES = 128 << 20


def _feed_files(spark, sf_dir) -> int:
    """Files that the feed is landed in: four, and more for larger tables, so that none outgrows the task that writes it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(O.table_path(sf_dir, "documents"))
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return max(4, -(-size // FEED_FILE_BYTES))


@register("stream_feed_items")
def q_stream_feed_items(spark, sf_dir):
    """Feed XML landed as several files, read as a file stream (one file per
    trigger) -> feed posts -> batch-id sink; equals the batch reader's rows."""
    path = scratch_dir(spark, "feed_xml_stream")
    (O.feed_xml_items(O.load(spark, sf_dir, "documents")).repartition(_feed_files(spark, sf_dir))
     .write.format("xml").option("rowTag", "item").option("rootTag", "channel").save(path))
    posts = FS.feed_posts(FS.stream_feed_items(spark, path, max_files_per_trigger=1), ingested_at=TEXT_AS_OF)
    sink = scratch_dir(spark, "feed_stream_sink")
    ST.run_available(posts.writeStream.foreachBatch(ST.batch_dir_writer(sink)),
                     scratch_dir(spark, "ckpt_feed_stream"))
    return spark.read.parquet(sink).select(
        "source", "external_id", F.col("created_at").cast("timestamp_ntz").alias("created_at"),
        "title", "url", "score", "txt_hash")


@register("feed_dates")
def q_feed_dates(spark, sf_dir):
    from moodlake.functions.timefns import feed_timestamp
    return O.feed_date_strings(O.load(spark, sf_dir, "documents")).select(
        "id", feed_timestamp("date").cast("timestamp_ntz").alias("created_at"))


@register("feed_quarantine")
def q_feed_quarantine(spark, sf_dir):
    """Malformed feed items are isolated one by one: quarantined, never taking
    later items of the same document with them."""
    path = scratch_dir(spark, "feed_malformed")
    O.malformed_feed_lines(O.load(spark, sf_dir, "documents")).write.text(path)
    good, bad = FS.split_quarantine(FS.read_feed_records(spark, path))
    return (good.select(F.lit(0).alias("bad"), F.lit(1).alias("ok"))
            .unionByName(bad.select(F.lit(1).alias("bad"), F.lit(0).alias("ok")))
            .agg(F.sum("bad").cast("long").alias("n_quarantined"), F.sum("ok").cast("long").alias("n_kept")))


def _landed_listings(spark, sf_dir):
    path = scratch_dir(spark, "listing_json")
    O.listing_json_lines(O.load(spark, sf_dir, "documents")).write.text(path)
    return FS.split_quarantine(FS.read_listings(spark, path))


@register("listing_posts")
def q_listing_posts(spark, sf_dir):
    good, _ = _landed_listings(spark, sf_dir)
    return FS.listing_posts(good, ingested_at=TEXT_AS_OF).select(
        "source", "external_id", "created_at", "subreddit", "score", "comments", "txt_hash")


@register("quarantine_rows")
def q_quarantine(spark, sf_dir):
    good, bad = _landed_listings(spark, sf_dir)
    return (good.select(F.lit(0).alias("bad"), F.lit(1).alias("ok"))
            .unionByName(bad.select(F.lit(1).alias("bad"), F.lit(0).alias("ok")))
            .agg(F.sum("bad").cast("long").alias("n_quarantined"), F.sum("ok").cast("long").alias("n_kept")))


# --- similarity -------------------------------------------------------------

from moodlake.operators import scoring as SCR  # noqa: E402
from moodlake.operators import similarity as SIM  # noqa: E402

QUERY_POST = 7
BATCH_K = 5
TORN_K = 10


def _vec_posts(spark, sf_dir):
    return O.load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


@register("similar_posts")
def q_similar(spark, sf_dir):
    return SIM.similar_posts(_vec_posts(spark, sf_dir), QUERY_POST, k=10).select("id", "label")


@register("similar_posts_cosine")
def q_similar_cos(spark, sf_dir):
    return SIM.similar_posts(_vec_posts(spark, sf_dir), QUERY_POST, k=10, metric="cosine").select("id", "label")


@register("similar_posts_batch")
def q_similar_batch(spark, sf_dir):
    p = _vec_posts(spark, sf_dir)
    return SIM.similar_posts_batch(p, p, k=BATCH_K)


@register("similar_posts_approx")
def q_similar_approx(spark, sf_dir):
    p = _vec_posts(spark, sf_dir)
    return SIM.similar_posts_approx(p, p, k=10)


@register("similar_posts_approx_all_cells")
def q_similar_all_cells(spark, sf_dir):
    """Probing every cell is exact."""
    p = _vec_posts(spark, sf_dir)
    return SIM.similar_posts_approx(p, p, k=BATCH_K, n_cells=8, n_probe=8)


@register("similar_posts_cells")
def q_similar_cells(spark, sf_dir):
    """Stored cells with an exact stop: every post against all others."""
    p, path = _vec_posts(spark, sf_dir), scratch_dir(spark, "cells")
    SIM.write_cells(p, path, max_iter=5)
    return SIM.similar_posts_cells(spark, path, p, k=BATCH_K)


@register("similar_posts_batch_torn")
def q_similar_batch_torn(spark, sf_dir):
    """Vectors that are missing or lost a dimension come last, in the batch form too."""
    p = O.torn_vectors(O.load(spark, sf_dir, "embeddings"))
    return SIM.similar_posts_batch(p, p, k=TORN_K)


@register("similar_posts_batch_torn_all")
def q_similar_batch_torn_all(spark, sf_dir):
    """The same over all rows, as queries and as candidates."""
    p = O.torn_vectors(O.load(spark, sf_dir, "embeddings"))
    return SIM.similar_posts_batch(p, p, k=BATCH_K)


@register("mean_pool")
def q_mean_pool(spark, sf_dir):
    return SIM.mean_pool_long(_vec_posts(spark, sf_dir), "label")


VECTOR_DIM = 64  # declared size of the fixture's vectors (the reference declares 384)


@register("vector_size_guard")
def q_vector_guard(spark, sf_dir):
    ok, bad = IG.split_vector_size(O.torn_vectors(O.load(spark, sf_dir, "embeddings")), VECTOR_DIM)
    dims = F.coalesce(F.size("embedding"), F.lit(-1)).alias("dims")
    return (ok.select("id", dims, F.lit(1).alias("accepted"))
            .unionByName(bad.select("id", dims, F.lit(0).alias("accepted"))))


# --- scoring ----------------------------------------------------------------

WRITEBACK_AS_OF = "2024-02-01 00:00:00"
EMBED_DIM = 16


def _decoded(spark, sf_dir):
    return SCR.decode_logits(O.logits(O.load(spark, sf_dir, "embeddings"))).withColumn(
        "model_ver", F.lit(SCR.MODEL_VER))


@register("stance_decode")
def q_decode(spark, sf_dir):
    return _decoded(spark, sf_dir).select("id", "probs.neg", "probs.neu", "probs.pos", "stance")


@register("stance_writeback")
def q_writeback(spark, sf_dir):
    posts = _meta(spark, sf_dir)
    out = SCR.stance_writeback(posts, _decoded(spark, sf_dir), as_of=WRITEBACK_AS_OF)
    return out.select("id", "stance", "model_ver", "classified_at")


def _doc_posts(spark, sf_dir):
    return O.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _scored(spark, sf_dir, batch_size):
    udf = SCR.batch_logits_udf(SCR.hashed_scorer(), batch_size=batch_size)
    return SCR.score_with_udf(_doc_posts(spark, sf_dir), udf).select("id", "stance", "probs.neg", "probs.neu", "probs.pos")


@register("score_posts")
def q_score(spark, sf_dir):
    """A batched fixed-weight model over every whole text."""
    return _scored(spark, sf_dir, SCR.BATCH_SIZE)


@register("score_posts_batch_1")
def q_score_1(spark, sf_dir):
    """The batch size changes the cost, never the scores."""
    return _scored(spark, sf_dir, 1)


@register("embed_posts")
def q_embed(spark, sf_dir):
    return _components(SCR.embed_hashed(_doc_posts(spark, sf_dir), EMBED_DIM, element="double"))


def _components(embedded):
    """id, dim, value. An outer explode and a filter on what it makes: from a plain one Catalyst infers a filter on the
    array's size, below which the vectors would be computed a second time."""
    return embedded.select("id", F.posexplode_outer("embedding").alias("dim", "value")).where(F.col("dim").isNotNull())


ENCODER_DIM = 8


@register("embed_encoder")
def q_embed_encoder(spark, sf_dir):
    """An external encoder's token states, pooled under its mask in batches of 32 texts of similar length."""
    udf = SCR.batch_embed_udf(SCR.hashed_encoder(ENCODER_DIM), element="double")
    return _components(_doc_posts(spark, sf_dir).select("id", udf("text").alias("embedding")))


@register("score_store")
def q_score_store(spark, sf_dir):
    """Every distinct text scored once: half of the posts in a first pass, then all of them."""
    from moodlake.plans import jobs as J

    posts, path = _doc_posts(spark, sf_dir), scratch_dir(spark, "score_store")
    udf = SCR.batch_logits_udf(SCR.hashed_scorer())
    score = lambda rows: SCR.score_with_udf(rows, udf)
    J.score_by_content(posts.where(F.col("id") % 2 == 0), path, score, SCR.MODEL_VER)
    done = J.score_by_content(posts, path, score, SCR.MODEL_VER)
    return done.select("id", "stance", "probs.neg", "probs.neu", "probs.pos")


@register("score_posts_trained")
def q_score_trained(spark, sf_dir):
    """The default scorer trained on the labelled documents, saved, loaded and applied to every document."""
    labels = SCR.three_class_label(O.load(spark, sf_dir, "labels")).withColumnRenamed("doc_id", "id")
    posts, path = _doc_posts(spark, sf_dir), scratch_dir(spark, "trained_scorer")
    SCR.save_model(SCR.train_default_scorer(posts.join(labels, "id"), max_iter=10), path)
    scored = SCR.score_with_model(SCR.load_model(path), posts.withColumn("text", F.coalesce("text", F.lit(""))))
    return scored.select("id", "stance", "probs.neg", "probs.neu", "probs.pos")


@register("fanout_writeback")
def q_fanout_writeback(spark, sf_dir):
    """Stances of the posts' scores filled into unscored fan-out rows."""
    facts = _mentions(spark, sf_dir)
    return SCR.fanout_writeback(facts, _decoded(spark, sf_dir)).select("post_id", "ticker", "created_at", "stance")


@register("probs_export")
def q_probs_export(spark, sf_dir):
    """``probs`` leaves the engine as JSON text."""
    from moodlake.plans.jobs import export_posts
    j = F.from_json("probs", "neg double, neu double, pos double")
    out = export_posts(_decoded(spark, sf_dir))
    return out.select("id", j["neg"].alias("neg"), j["neu"].alias("neu"), j["pos"].alias("pos"))


# --- streaming ----------------------------------------------------------------

from moodlake.streaming import pipeline as ST  # noqa: E402

EVENT_ORIGIN = "2024-01-01 00:00:00"
EVENT_POLL_SECONDS = 6 * 86400
TEXT_POLL_SECONDS = 8 * 3600
LIVE_BATCHES = 6  # micro-batches that what was landed goes in


def _stream_mentions(spark, sf_dir, late_rows: bool):
    """Land O1 rows as re-delivering polls (plus, optionally, a final poll of rows
    more than a day late), stream dedup + windowed sentiment into a changelog,
    and return the current view."""
    land = scratch_dir(spark, "landed_mentions")
    rows = _mentions(spark, sf_dir)
    O.land_polls(rows, land, "created_at", EVENT_POLL_SECONDS, EVENT_ORIGIN)
    if late_rows:
        late = rows.select("created_at", (F.col("post_id") + F.lit(10_000_000_000)).alias("post_id"),
                           F.concat(F.lit("late_"), "ticker").alias("ticker"), "stance", "score", "comments")
        late.where(F.col("created_at") < F.lit("2024-01-07").cast("timestamp_ntz")).write.mode("append").parquet(land)
    stream = (spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(land))
    dedup = ST.dedup_stream(stream, ("post_id", "ticker", "created_at"))
    agg = ST.sentiment_stream(dedup, with_watermark=False)
    sink = scratch_dir(spark, "sentiment_changelog")
    ST.run_available(agg.writeStream.outputMode("update").foreachBatch(ST.changelog_writer(sink)),
                     scratch_dir(spark, "ckpt_sentiment"))
    return ST.read_changelog(spark, sink).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@register("stream_sentiment")
def q_stream_sentiment(spark, sf_dir):
    return _stream_mentions(spark, sf_dir, late_rows=False).select(*_view10s(spark, sf_dir).columns)


@register("stream_late_rows")
def q_stream_late(spark, sf_dir):
    return _stream_mentions(spark, sf_dir, late_rows=True).select(*_view10s(spark, sf_dir).columns)


@register("stream_dedup")
def q_stream_dedup(spark, sf_dir):
    ev = O.load(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    land = scratch_dir(spark, "landed_events")
    O.land_polls(ev, land, "ts", EVENT_POLL_SECONDS, EVENT_ORIGIN)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 2).parquet(land)
    out = scratch_dir(spark, "events_dedup")
    ST.run_available(ST.dedup_stream(stream, ("event_id", "ts"), time_col="ts")
                     .writeStream.outputMode("append").foreachBatch(ST.batch_dir_writer(out)),
                     scratch_dir(spark, "ckpt_dedup"))
    return spark.read.parquet(out).drop("batch_id").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _live_fanout(spark, posts, poll_col="created_at"):
    """Posts landed in polls that each re-deliver the one before, through the live path (several bounded triggers);
    the stored fan-out, once every landed row has been read, however long that takes. The linking text is made of title and
    body, so it is not landed."""
    land, live = scratch_dir(spark, "landed_posts"), scratch_dir(spark, "live")
    n = O.land_all_polls(posts, land, poll_col, TEXT_POLL_SECONDS, EVENT_ORIGIN)

    def link(df):
        return SY.extract_symbols(df.withColumn("text", TX.post_text()), "text", _o6_whitelist(), O.O6_STOPLIST, O.O6_KEYWORDS)

    landed = spark._jvm.org.apache.hadoop.fs.Path(land)
    size = landed.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(landed).getLength()
    q, paths = ST.start_live_pipeline(spark, land, posts.schema, live, link, trigger={"availableNow": True},
                                      reader_options={"recursiveFileLookup": "true", "maxBytesPerTrigger": str(size // LIVE_BATCHES + 1)})
    q.awaitTermination()    # no time limit, at which a part of the rows would pass for all; a failed query raises here
    read = ST.ingest_metrics(spark, live).agg(F.sum("read")).first()[0] or 0
    if read != n:           # stopped by others
        raise RuntimeError(f"the live query ended after {read} of {n} landed rows")
    return (spark.read.parquet(paths["ticker_posts"]).drop("batch_id", "created_date")
            .withColumn("created_at", F.col("created_at").cast("timestamp_ntz")))


@register("stream_ingest")
def q_stream_ingest(spark, sf_dir):
    """Landed feed posts -> first write and insert-if-absent -> symbol linking -> posts + fan-out sinks."""
    return _live_fanout(spark, _posts_text(spark, sf_dir))


@register("stream_insert_if_absent")
def q_stream_store(spark, sf_dir):
    """Every post landed twice over, in two runs of polls: the stored fan-out equals the batch fan-out of the distinct posts."""
    posts = _posts_text(spark, sf_dir)
    return _live_fanout(spark, posts.unionByName(posts.where(F.col("id") % 3 == 0)))


@register("stream_late_posts")
def q_stream_late_posts(spark, sf_dir):
    """Posts days and weeks behind the newest, and a few dated years ahead, are all stored and fanned out."""
    return _live_fanout(spark, O.late_posts_text(O.load(spark, sf_dir, "documents")), "polled_at")


@register("replay_job")
def q_replay_job(spark, sf_dir):
    """S11 as a job: feed XML and listing JSON (torn lines quarantined) replayed
    into the posts store with the backfill caps, twice; the second run must add
    nothing. Returns the stored posts."""
    from moodlake.plans import jobs as J

    docs = O.load(spark, sf_dir, "documents")
    feed_dir, listing_dir = scratch_dir(spark, "replay_feed"), scratch_dir(spark, "replay_listings")
    # landed compressed: a file per task of the table's scan, so none is too large to be read whole
    O.feed_xml_items(docs).write.format("xml").option("rowTag", "item").option("rootTag", "channel").option("compression", "gzip").save(feed_dir)
    O.listing_json_lines(docs).write.option("compression", "gzip").text(listing_dir)
    items = FS.read_feed_items(spark, feed_dir)
    good, _ = FS.split_quarantine(FS.read_listings(spark, listing_dir))
    store = J.posts_store(spark, scratch_dir(spark, "replay_store"))

    def link(df):
        return SY.extract_symbols(df, "text", _o6_whitelist(), O.O6_STOPLIST, O.O6_KEYWORDS)

    J.replay(store, good, items, link, ingested_at=TEXT_AS_OF)
    again, _ = J.replay(store, good, items, link, ingested_at=TEXT_AS_OF)
    assert again.limit(1).count() == 0, "replay inserted rows twice"
    return store.read().select("source", "external_id", F.col("created_at").cast("timestamp_ntz").alias("created_at"),
                               "tickers", "score", "comments", "is_backfill")


@register("view_refresh")
def q_view_refresh(spark, sf_dir):
    """Two scheduled refreshes of the aggregate (12 h apart) into a changelog;
    the current view holds every closed bucket of the union of their windows."""
    from moodlake.sources import views as VW

    log = scratch_dir(spark, "refresh_changelog")
    facts = _mentions(spark, sf_dir)
    VW.refresh_sentiment_view(facts, log, 0, REFRESH_AS_OF_1)
    VW.refresh_sentiment_view(facts, log, 1, CLOSED_AS_OF)
    return ST.read_changelog(spark, log).withColumn("bucket", F.col("bucket").cast("timestamp_ntz")).select(
        *_view10s(spark, sf_dir).columns)


@register("view_repair")
def q_view_repair(spark, sf_dir):
    """Posts weeks late: the stream's view of the others, then a replay that inserts them, then the repair of the buckets
    that they touched."""
    from moodlake.functions.timefns import time_bucket
    from moodlake.sources import views as VW
    from moodlake.sources.posts_store import with_partition

    rows = _mentions(spark, sf_dir)
    late = F.col("post_id") % 10 == 3
    log, facts, touched = (scratch_dir(spark, x) for x in ("repair_changelog", "repair_facts", "repair_touched"))
    land = scratch_dir(spark, "repair_landed")
    O.land_polls(rows.where(~late), land, "created_at", EVENT_POLL_SECONDS, EVENT_ORIGIN, redeliver=False)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(land)
    ST.run_available(ST.sentiment_stream(stream).writeStream.outputMode("update").foreachBatch(ST.changelog_writer(log)),
                     scratch_dir(spark, "ckpt_repair"))
    for batch_id, own in enumerate((rows.where(~late), rows.where(late))):
        (with_partition(own).withColumn("batch_id", F.lit(batch_id)).write.mode("append")
         .partitionBy("created_date", "batch_id").parquet(facts))
    (rows.where(late).where(F.col("stance").isNotNull()).select(time_bucket("created_at", "10 seconds").alias("bucket"), "ticker")
     .distinct().write.parquet(f"{touched}/batch_id=1"))
    VW.repair_view(spark, facts, touched, log)
    return ST.read_changelog(spark, log).withColumn("bucket", F.col("bucket").cast("timestamp_ntz")).select(
        *_view10s(spark, sf_dir).columns)


@register("sentiment_rollup_1h")
def q_rollup_1h(spark, sf_dir):
    """Hours added up from the stored 10 s state, which a late batch has been added to."""
    from moodlake.sources import views as VW

    rows, late = _mentions(spark, sf_dir), F.col("post_id") % 10 == 3
    path = scratch_dir(spark, "state")
    VW.write_state(S.sentiment_state(rows.where(~late)), path, "stream", 0)
    VW.write_state(S.sentiment_state(rows.where(late)), path, "late", 0, delta=True)
    return S.finish_state(S.merge_state(VW.current_state(spark, path), "1 hour"))


@register("posts_with_symbol_indexed")
def q_with_symbol_indexed(spark, sf_dir):
    """R4 through the fan-out index: linked posts stored partitioned by date,
    their fan-out stored sorted by symbol, then one symbol looked up."""
    linked = _linked(spark, sf_dir).drop("text")
    posts_path, index_path = scratch_dir(spark, "posts_by_date"), scratch_dir(spark, "fanout_index")
    write_partitioned(linked, posts_path)
    SY.write_fanout_index(SY.fan_out(linked, feed_engagement=True), index_path)
    return SY.posts_with_symbol_indexed(spark.read.parquet(posts_path), spark.read.parquet(index_path),
                                        "NTI").select("id", "tickers")
