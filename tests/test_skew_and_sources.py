"""Skewed keys (a third of all rows on one key) and per-poll source caps."""

from pyspark.sql import functions as F

from moodlake.operators import ingest as IG
from moodlake.operators import sentiment as S
from moodlake.operators import text_ops as TO
from moodlake.sources import files as FS
from tests.conftest import SF001, SF01


def _events(spark):
    return spark.read.parquet(f"{SF01}/events.parquet")


def test_hot_ticker_sentiment_equals_plain_sum(spark):
    ev = _events(spark)
    hot = F.when(F.col("event_id") % 3 == 0, F.lit("HOT")).otherwise(F.col("event_type"))
    tp = ev.select(F.col("ts").alias("created_at"), hot.alias("ticker"), F.lit(1).cast("short").alias("stance"),
                   F.lit(0).alias("score"), F.lit(0).alias("comments"))
    out = S.sentiment_buckets(tp, "1 day")
    total = out.agg(F.sum("n_posts")).first()[0]
    assert total == ev.count()
    hot_rows = out.where(F.col("ticker") == "HOT").agg(F.sum("n_posts")).first()[0]
    assert hot_rows == ev.where(F.col("event_id") % 3 == 0).count()
    assert out.where(F.col("vw_sentiment") != 1.0).count() == 0


def test_hot_key_first_write(spark):
    ev = _events(spark)
    # a third of all arrivals are copies of one post key
    arr = ev.select(F.lit("feed").alias("source"),
                    F.when(F.col("event_id") % 3 == 0, F.lit("hot")).otherwise(F.col("event_id").cast("string"))
                    .alias("external_id"),
                    F.when(F.col("event_id") % 3 == 0, F.lit("2024-01-01").cast("timestamp_ntz"))
                    .otherwise(F.col("ts")).alias("created_at"),
                    F.col("event_id").alias("k"))
    out = IG.first_write(arr).collect()
    hot = [r for r in out if r.external_id == "hot"]
    assert len(hot) == 1 and hot[0].k == 0
    assert len(out) == ev.where(F.col("event_id") % 3 != 0).count() + 1


def test_hot_hash_duplicate_group(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    same = F.when(F.col("doc_id") % 3 == 0, F.lit("one text")).otherwise(F.col("text"))
    posts = docs.select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("title"), same.alias("body"))
    groups = TO.exact_duplicate_groups(TO.with_text_hash(posts)).orderBy(F.desc("n")).first()
    assert groups.n >= docs.where(F.col("doc_id") % 3 == 0).count() and groups.first_id == 0


def test_listing_and_feed_poll_caps(spark):
    conv = spark.read.parquet(f"{SF01}/conversations.parquet")
    rec = conv.select(F.lit("c").alias("channel"), F.col("turn").cast("int").alias("pos"), (F.col("conv_id") % 2).alias("poll"),
                      F.when(F.col("turn") % 2 == 0, "new").otherwise("hot").alias("listing"),
                      (F.lit(1704067200.0) + F.col("conv_id")).alias("created_utc"))
    assert FS.listing_poll(rec).count() == rec.count()  # everything landed unless a cap is asked for
    live = FS.listing_poll(rec, cap=100, poll=("poll",))
    per = {(r.listing, r.poll): r.n for r in live.groupBy("listing", "poll").agg(F.count("*").alias("n")).collect()}
    assert len(per) == 4 and all(v <= 100 for v in per.values())
    back = FS.listing_poll(rec, backfill=True)
    assert back.where(F.col("listing") != "new").count() == 0
    assert back.count() == rec.where(F.col("listing") == "new").count()
    assert FS.listing_poll(rec, backfill=True, cap=200).count() == 200
    items = spark.read.parquet(f"{SF01}/documents.parquet").select(
        F.col("source").alias("feed"), F.col("doc_id").cast("int").alias("pos"))
    capped = FS.feed_poll(items, cap=7)
    assert capped.groupBy("feed").count().where(F.col("count") > 7).count() == 0
    assert capped.count() == 7 * items.select("feed").distinct().count()


def test_aqe_skew_handling_is_on(spark):
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"


def test_streaming_state_in_rocksdb(spark):
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("RocksDBStateStoreProvider")
    assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled") == "true"


def test_malformed_feed_items_are_isolated_one_by_one(spark):
    from moodlake.plans import overlays as O
    from moodlake.session import scratch_dir
    from moodlake.sources import files as FS

    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    path = scratch_dir(spark, "feed_bad")
    O.malformed_feed_lines(docs).coalesce(1).write.text(path)  # one document: bad items in the middle
    good, bad = FS.split_quarantine(FS.read_feed_records(spark, path))
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    expect = {f"urn:post:{i}" for i in ids if not (i % 13 == 12 or i % 17 == 16 or i % 19 == 18)}
    assert {r.guid for r in good.select("guid").collect()} == expect
    assert bad.count() == len(ids) - len(expect) > 0


def test_store_writer_hot_post_is_a_third_of_the_batch(spark):
    from moodlake.functions.text import post_text
    from moodlake.operators import symbols as SY
    from moodlake.plans import overlays as O
    from moodlake.session import scratch_dir
    from moodlake.streaming import pipeline as ST

    posts = O.posts_text(spark.read.parquet(f"{SF01}/documents.parquet")).withColumn("text", post_text())
    n = posts.count()
    hot = posts.where(F.col("id") == 7)
    copies = hot.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n // 2)))).drop("copy")
    batch = posts.unionByName(copies)  # post 7 is a third of the rows
    root = scratch_dir(spark, "hot_store")
    ST.store_insert_writer(root, lambda df: SY.extract_symbols(df, "text", {k: k for k in O.O6_WHITELIST}, O.O6_STOPLIST,
                                                               O.O6_KEYWORDS), order=("id",))(batch, 0)
    stored = spark.read.parquet(f"{root}/posts")
    assert stored.where(F.col("id") == 7).count() == 1
    assert stored.count() == stored.select("source", "external_id", "created_at").distinct().count()
    fan = spark.read.parquet(f"{root}/ticker_posts")
    assert fan.where(F.col("post_id") == 7).count() == fan.where(F.col("post_id") == 7).select("ticker").distinct().count()
