"""Batch ingest jobs: one poll and the replay (idempotent, backfill-marked)."""

import json

from pyspark.sql import functions as F

from moodlake.functions.dictionaries import FEED_SOURCE
from moodlake.functions.text import post_text
from moodlake.operators import symbols as SY
from moodlake.plans import jobs as J
from moodlake.plans import overlays as O
from moodlake.plans import serving as V
from moodlake.session import scratch_dir
from moodlake.sources import files as FS
from tests.conftest import SF01


def _link(df):
    return SY.extract_symbols(df, "text", {k: k for k in O.O6_WHITELIST}, O.O6_STOPLIST, O.O6_KEYWORDS)


def test_replay_is_idempotent_and_marks_backfill(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    feed_dir, listing_dir = scratch_dir(spark, "jobs_feed"), scratch_dir(spark, "jobs_listings")
    O.feed_xml_items(docs).write.format("xml").option("rowTag", "item").option("rootTag", "channel").save(feed_dir)
    O.listing_json_lines(docs).write.text(listing_dir)
    items = FS.read_feed_items(spark, feed_dir)
    good, _ = FS.split_quarantine(FS.read_listings(spark, listing_dir))
    store = J.posts_store(spark, scratch_dir(spark, "jobs_store"))
    as_of = "2024-01-02 00:00:00"

    new, fan = J.replay(store, good, items, _link, ingested_at=as_of)
    n_new, n_fan = new.count(), fan.count()
    assert n_new > 0 and n_fan >= n_new
    assert new.where(~F.col("is_backfill")).count() == 0
    assert new.select("id").distinct().count() == n_new
    feed_fan = fan.join(new.where(F.col("source") == FEED_SOURCE).select(F.col("id").alias("post_id")), "post_id")
    assert feed_fan.where((F.col("score") != 1) | (F.col("comments") != 0)).count() == 0
    # no cap: every landed feed item with a symbol went in
    landed = _link(FS.feed_posts(items, as_of).withColumn("text", post_text())).where(F.size("tickers") > 0)
    assert new.where(F.col("source") == FEED_SOURCE).count() == landed.count()

    again, fan2 = J.replay(store, good, items, _link, ingested_at=as_of)
    assert again.count() == 0 and fan2.count() == 0
    assert store.read().count() == n_new


def test_symbol_search(spark):
    tickers = O.symbols_from_parts(spark.read.parquet(f"{SF01}/part.parquet"))
    assert V.symbol_search(tickers, "Brand#1").count() == V.symbol_prefix(tickers, "Brand#1").count() > 0
    assert V.symbol_search(tickers).count() == min(100, tickers.count())


def test_score_pass_scores_eligible_posts_once(spark):
    from moodlake.operators import scoring as SCR

    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    posts = J.conform_posts(O.posts_text(docs).withColumn("ingested_at", F.col("created_at"))
                            .withColumn("is_backfill", F.when(F.col("id") % 10 == 0, F.lit(True))))
    labels = SCR.three_class_label(spark.read.parquet(f"{SF01}/labels.parquet")).withColumnRenamed("doc_id", "id")
    train = O.posts_text(docs).withColumn("text", F.concat_ws(" ", "title", "body")).join(labels, "id")
    model = SCR.train_default_scorer(train, max_iter=3)
    as_of = "2024-01-01 12:00:00"  # posts are one per minute from 2024-01-01: 720 in the horizon
    eligible = V.unscored(posts, as_of)
    n_eligible = eligible.count()
    assert 0 < n_eligible < posts.count()
    scores_path = scratch_dir(spark, "scores")
    scored = J.score_pass(posts, scores_path, model, as_of=as_of)
    assert scored.count() == n_eligible and scored.where(F.col("stance").isNull()).count() == 0
    view = J.current_posts(posts, spark.read.parquet(scores_path))
    assert view.count() == posts.count()
    assert view.where(F.col("stance").isNotNull()).count() == n_eligible
    # a second pass over the current view, or over the same unscored posts, finds nothing left to score
    assert J.score_pass(view, scores_path, model, as_of=as_of).count() == 0
    assert J.score_pass(posts, scores_path, model, as_of=as_of).count() == 0
    assert J.current_posts(posts, spark.read.parquet(scores_path)).count() == posts.count()
    # scores written twice side by side do not double a post, and the export carries probs as JSON
    twice = spark.read.parquet(scores_path).unionByName(spark.read.parquet(scores_path))
    doubled = J.current_posts(posts, twice)
    assert doubled.count() == posts.count()
    row = J.export_posts(doubled.where(F.col("stance").isNotNull())).first()
    assert set(json.loads(row.probs)) == {"neg", "neu", "pos"}


def test_poll_links_each_new_post_once_and_sets_null_keys_aside(spark):
    """One NULL in the key, a re-delivery that differs, and a vector of the wrong size."""
    posts = J.conform_posts(O.posts_text(spark.read.parquet(f"{SF01}/documents.parquet"))).drop("id")
    posts = posts.withColumn("arrival", F.lit(0).cast("long"))
    later = posts.limit(50).withColumn("arrival", F.lit(1).cast("long")).withColumn("title", F.lit("A later edit THE"))
    torn = posts.limit(3).withColumn("external_id", F.lit(None).cast("string"))
    linked = spark.sparkContext.accumulator(0)

    def link(df):
        def count(_):
            linked.add(1)
            return True
        # nondeterministic: counted where the linker runs, not pushed below the insert's join
        return _link(df.where(F.udf(count, "boolean").asNondeterministic()(F.col("external_id"))))

    def embed(df):
        size = F.when(F.col("external_id").cast("int") % 7 == 0, F.lit(3)).otherwise(F.lit(4))
        return df.withColumn("embedding", F.array_repeat(F.lit(1.0).cast("float"), size))

    store = J.posts_store(spark, scratch_dir(spark, "poll_store"))
    batch = later.unionByName(posts).unionByName(torn)
    new, fan = J.ingest_poll(store, batch, link, embed_fn=embed, vector_size=4)
    assert linked.value == posts.count()
    stored = store.read()
    assert stored.where(F.col("title") == "A later edit THE").count() == 0  # first write wins by arrival
    assert stored.where("external_id IS NULL").count() == 0 and stored.where(F.size("embedding") != 4).count() == 0
    refused = _link(posts.withColumn("text", post_text())).where("size(tickers) > 0 AND cast(external_id AS int) % 7 = 0").count()
    assert refused > 0 and store.rejected().count() == refused + 3
    assert new.count() == stored.count() and fan.count() >= new.count()
    again, _ = J.ingest_poll(store, batch, _link, embed_fn=embed, vector_size=4)
    assert again.count() == 0


def test_replay_lands_compressed_and_reads_the_same(spark, monkeypatch):
    """The replay's feed and listing files are compressed; they hold the records that plain files do."""
    import os

    from moodlake.plans import catalog as C
    from moodlake.plans import overlays as O
    from tests.conftest import SF001
    landed = {}
    for name in ("read_feed_items", "read_listings"):
        def watched(spark, path, plain=getattr(C.FS, name), name=name):
            landed[name] = path
            return plain(spark, path)
        monkeypatch.setattr(C.FS, name, watched)
    C.QUERIES["replay_job"](spark, SF001)
    assert all(f.endswith(".gz") for p in landed.values() for f in os.listdir(p) if f.startswith("part-")) and len(landed) == 2
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    assert spark.read.text(landed["read_listings"]).count() == O.listing_json_lines(docs).count()
    assert C.FS.read_feed_items(spark, landed["read_feed_items"]).count() == docs.count()
