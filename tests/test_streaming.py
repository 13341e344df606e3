"""Live pipeline: two chained streaming queries equal the batch composition."""

import time

import pytest
from pyspark.sql import functions as F

from moodlake.functions.text import post_text
from moodlake.operators import scoring as SCR
from moodlake.operators import sentiment as S
from moodlake.operators import symbols as SY
from moodlake.plans import overlays as O
from moodlake.session import scratch_dir
from moodlake.streaming import pipeline as ST
from tests.conftest import SF01


def test_live_pipeline_equals_batch(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    posts = O.posts_text(docs).withColumn("text", post_text())
    land = scratch_dir(spark, "live_land")
    O.land_polls(posts, land, "created_at", 8 * 3600, "2024-01-01 00:00:00", fmt="json")

    labels = SCR.three_class_label(spark.read.parquet(f"{SF01}/labels.parquet")).withColumnRenamed("doc_id", "id")
    model = SCR.train_default_scorer(posts.join(labels, "id"), max_iter=5)

    def link(df):
        return SY.extract_symbols(df, "text", {k: k for k in O.O6_WHITELIST}, O.O6_STOPLIST, O.O6_KEYWORDS)

    def score(df):
        return SCR.score_with_model(model, df)

    out = scratch_dir(spark, "live_out")
    q1, paths = ST.start_live_pipeline(spark, land, posts.schema, out, link, score,
                                       trigger={"availableNow": True}, max_files_per_trigger=2)
    q1.awaitTermination(600)
    assert q1.exception() is None
    fan_schema = spark.read.parquet(paths["ticker_posts"]).drop("batch_id", "created_date").schema
    q2 = ST.start_sentiment_from_fanout(spark, paths, fan_schema, trigger={"availableNow": True})
    q2.awaitTermination(600)
    assert q2.exception() is None
    live = ST.read_changelog(spark, paths["sentiment"]).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))

    batch_posts = score(link(posts))
    batch = S.sentiment_buckets(SY.fan_out(batch_posts, feed_engagement=True))
    cols = ["bucket", "ticker", "n_posts", "pos_ct", "neu_ct", "neg_ct"]
    a = live.select(*cols, F.round("vw_sentiment", 9).alias("vw"))
    b = batch.select(*cols, F.round("vw_sentiment", 9).alias("vw"))
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    # every linked post stored once, although every poll re-delivered the previous one
    stored = spark.read.parquet(paths["posts"])
    n_linked = batch_posts.where(F.size("tickers") > 0).count()
    assert stored.count() == stored.select("source", "external_id", "created_at").distinct().count() == n_linked
    assert n_linked < posts.count()  # posts without a symbol are not stored
    # T8: stored posts carry the stamps the pipeline metrics read
    st = stored.select("id", "ingested_at", "classified_at", "stance")
    assert st.where(F.col("ingested_at").isNull() | F.col("classified_at").isNull()).count() == 0
    assert st.where(F.col("classified_at") < F.col("ingested_at")).count() == 0
    from moodlake.plans import serving as V
    m = V.pipeline_metrics(stored, count_minutes=60, latency_minutes=60).first()
    assert m.last_5m_count == n_linked and m.p95_latency_sec >= 0


def test_replay_inserts_nothing_new(spark):
    from moodlake.plans.catalog import QUERIES
    df = QUERIES["replay_idempotent"](spark, SF01)  # asserts internally that the replay added no rows
    assert df.count() == df.select("source", "external_id", "created_at").distinct().count()


def test_store_writer_is_idempotent_and_dedups_forever(spark):
    from moodlake.operators import symbols as SY2

    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    posts = O.posts_text(docs).withColumn("text", post_text())

    def link(df):
        return SY2.extract_symbols(df, "text", {k: k for k in O.O6_WHITELIST}, O.O6_STOPLIST, O.O6_KEYWORDS)

    root = scratch_dir(spark, "store_writer")
    write = ST.store_insert_writer(root, link, order=("id",))
    first = posts.where(F.col("id") % 2 == 0)
    hot = posts.where(F.col("id") == 4)
    for _ in range(5):  # one post re-delivered many times inside the batch
        first = first.unionByName(hot)
    write(first, 0)
    fan0 = spark.read.parquet(f"{root}/ticker_posts").count()
    write(first, 0)  # the same batch re-executed: replaces its own output
    assert spark.read.parquet(f"{root}/ticker_posts").count() == fan0
    # batch 1 re-sends every old post (days "late") plus the rest
    write(posts, 1)
    stored = spark.read.parquet(f"{root}/posts")
    keys = stored.select("source", "external_id", "created_at")
    assert stored.count() == keys.distinct().count()
    expect = link(posts).where(F.size("tickers") > 0).count()
    assert stored.count() == expect
    fan = spark.read.parquet(f"{root}/ticker_posts").drop("batch_id", "created_date")
    batch = SY2.fan_out(link(posts), feed_engagement=True)
    assert fan.count() == batch.count()


def test_score_horizon_leaves_old_posts_unscored(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    posts = O.posts_text(docs).withColumn("text", post_text())
    labels = SCR.three_class_label(spark.read.parquet(f"{SF01}/labels.parquet")).withColumnRenamed("doc_id", "id")
    model = SCR.train_default_scorer(posts.join(labels, "id"), max_iter=3)

    def score(df):
        return SCR.score_with_model(model, df)

    all_scored = ST.score_recent(posts, score)
    assert all_scored.where(F.col("stance").isNull()).count() == 0
    # the fixture posts are from 2024: a 24 h horizon leaves every one unscored
    old = ST.score_recent(posts, score, 24)
    assert old.where(F.col("stance").isNotNull() | F.col("probs").isNotNull()).count() == 0
    # a horizon reaching back past 2024 scores them all, identically
    wide = ST.score_recent(posts, score, 24 * 365 * 50)
    a = all_scored.select("id", "stance", "model_ver")
    b = wide.select("id", "stance", "model_ver")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_atom_stream_equals_batch_reader(spark):
    from moodlake.sources import files as FS

    path = scratch_dir(spark, "atom_stream")
    (O.atom_xml_entries(spark.read.parquet(f"{SF01}/documents.parquet")).repartition(3)
     .write.format("xml").option("rowTag", "entry").option("rootTag", "feed").save(path))
    sink = scratch_dir(spark, "atom_sink")
    ST.run_available(FS.stream_feed_items(spark, path, atom=True, max_files_per_trigger=1)
                     .writeStream.foreachBatch(ST.batch_dir_writer(sink)), scratch_dir(spark, "atom_ckpt"))
    streamed = spark.read.parquet(sink).drop("batch_id")
    batch = FS.read_atom_entries(spark, path)
    assert streamed.count() == batch.count() == 1000
    assert streamed.exceptAll(batch.select(*streamed.columns)).count() == 0
    assert spark.read.parquet(sink).select("batch_id").distinct().count() == 3  # one file per trigger


def test_raw_listing_stream_with_quarantine(spark):
    from pyspark.sql import types as T

    from moodlake import schemas
    from moodlake.operators import symbols as SY2
    from moodlake.sources import files as FS

    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    land = scratch_dir(spark, "raw_listings")
    O.listing_json_lines(docs).repartition(3).write.text(land)
    sch = T.StructType(list(schemas.LISTING.fields) + [T.StructField("_corrupt_record", T.StringType(), True)])

    def to_posts(raw):
        return FS.listing_posts(raw).withColumn("text", post_text())

    def link(df):
        return SY2.extract_symbols(df, "text", {k: k for k in O.O6_WHITELIST}, O.O6_STOPLIST, O.O6_KEYWORDS)

    out = scratch_dir(spark, "raw_listing_out")
    q, paths = ST.start_store_pipeline(spark, land, sch, out, link, trigger={"availableNow": True},
                                       max_files_per_trigger=1, to_posts=to_posts,
                                       reader_options={"mode": "PERMISSIVE",
                                                       "columnNameOfCorruptRecord": "_corrupt_record"})
    q.awaitTermination(600)
    assert q.exception() is None
    torn = docs.where(F.col("doc_id") % 11 == 10).count()
    assert spark.read.parquet(f"{out}/quarantine").count() == torn > 0
    good, _ = FS.split_quarantine(FS.read_listings(spark, land))
    expect = link(to_posts(good)).where(F.size("tickers") > 0)
    stored = spark.read.parquet(paths["posts"])
    assert stored.count() == expect.count() > 0
    assert stored.select("id").distinct().count() == stored.count()  # ids from the key, one per post
    fan = spark.read.parquet(paths["ticker_posts"])
    assert fan.where(F.col("comments").isNull()).count() == 0  # listing engagement carried, not feed defaults


def test_fanout_stage_ignores_rewritten_batches(spark):
    """A fan-out batch written twice (a re-executed ingest batch: same rows, new
    file names) is counted once by the sentiment stage."""
    tp = O.scored_mentions(spark.read.parquet(f"{SF01}/events.parquet")).withColumn(
        "created_at", F.col("created_at").cast("timestamp"))
    root = scratch_dir(spark, "fan_rewrite")
    paths = {"ticker_posts": f"{root}/ticker_posts", "sentiment": f"{root}/sentiment", "ckpt_agg": f"{root}/ckpt"}
    tp.write.parquet(f"{paths['ticker_posts']}/batch_id=0")
    tp.write.parquet(f"{paths['ticker_posts']}/batch_id=0b")  # the same rows again, other files
    q = ST.start_sentiment_from_fanout(spark, paths, tp.schema, trigger={"availableNow": True})
    q.awaitTermination(600)
    assert q.exception() is None
    live = ST.read_changelog(spark, paths["sentiment"]).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))
    batch = S.sentiment_buckets(O.scored_mentions(spark.read.parquet(f"{SF01}/events.parquet")))
    cols = ["bucket", "ticker", "n_posts", "pos_ct", "neu_ct", "neg_ct"]
    assert live.select(*cols).exceptAll(batch.select(*cols)).count() == 0
    assert batch.select(*cols).exceptAll(live.select(*cols)).count() == 0


def test_store_pipeline_embeds_new_posts_for_similarity(spark):
    from moodlake.operators import similarity as SIM
    from moodlake.operators import symbols as SY2

    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    posts = O.posts_text(docs).withColumn("text", post_text())
    land = scratch_dir(spark, "embed_land")
    O.land_polls(posts, land, "created_at", 8 * 3600, "2024-01-01 00:00:00", fmt="json")
    embedder = SCR.train_embedder(posts.select("text"), vector_size=16)

    def link(df):
        return SY2.extract_symbols(df, "text", {k: k for k in O.O6_WHITELIST}, O.O6_STOPLIST, O.O6_KEYWORDS)

    q, paths = ST.start_store_pipeline(spark, land, posts.schema, scratch_dir(spark, "embed_out"), link,
                                       trigger={"availableNow": True}, max_files_per_trigger=2,
                                       embed_fn=lambda df: SCR.embed_with_model(embedder, df))
    q.awaitTermination(600)
    assert q.exception() is None
    stored = spark.read.parquet(paths["posts"])
    assert "text" not in stored.columns
    assert stored.where(F.size("embedding") != 16).count() == 0
    pid = stored.select("id").first().id
    near = SIM.similar_posts(stored, pid, k=5)
    assert near.count() == 5 and near.where(F.col("id") == pid).count() == 0


def test_live_posts_carry_text_hash(spark):
    from moodlake.operators.ingest import with_post_defaults
    from moodlake.operators.text_ops import exact_duplicate_groups, with_text_hash

    posts = O.posts_text(spark.read.parquet(f"{SF01}/documents.parquet"))
    a = exact_duplicate_groups(with_post_defaults(posts))
    b = exact_duplicate_groups(with_text_hash(posts))
    assert a.count() == b.count() > 0 and a.exceptAll(b).count() == 0


def test_store_stays_flat_over_many_batches(spark, monkeypatch):
    """Closed dates are merged to one folder each; a later batch lists only the folders of its own dates, and
    still inserts nothing twice."""
    import os

    from moodlake.sources.posts_store import compact_closed_dates

    posts = O.posts_text(spark.read.parquet(f"{SF01}/documents.parquet")).withColumn("text", post_text())
    day = F.make_dt_interval((F.col("id") % 5).cast("int"))  # five dates
    posts = posts.withColumn("created_at", F.col("created_at") + day).persist()

    def link(df):
        return SY.extract_symbols(df, "text", {k: k for k in O.O6_WHITELIST}, O.O6_STOPLIST, O.O6_KEYWORDS)

    root = scratch_dir(spark, "flat_store")
    write = ST.store_insert_writer(root, link, order=("id",))
    for b in range(8):
        write(posts.where(F.col("id") % 8 <= b), b)  # every batch re-sends all earlier rows
    stored = spark.read.parquet(f"{root}/posts")
    rows = sorted(tuple(r) for r in stored.drop("batch_id").collect())
    dates = [d for d in sorted(os.listdir(f"{root}/posts".removeprefix("file:"))) if "=" in d]
    monkeypatch.setattr("moodlake.sources.posts_store.FILE_BYTES", 20_000)      # a day of several files
    merged = compact_closed_dates(spark, f"{root}/posts", dates[-1].split("=")[1])
    assert any(len([f for f in os.listdir(f"{root}/posts/{d}/{b}".removeprefix("file:")) if f.endswith(".parquet")]) > 1
               for d in dates[:-1] for b in os.listdir(f"{root}/posts/{d}".removeprefix("file:")) if "=" in b)
    assert merged == len(dates) - 1
    folders = {d: [x for x in os.listdir(f"{root}/posts/{d}".removeprefix("file:")) if "=" in x] for d in dates}
    assert all(len(folders[d]) == 1 for d in dates[:-1]) and len(folders[dates[-1]]) > 1
    columns = [c for c in stored.columns if c != "batch_id"]
    assert sorted(tuple(r) for r in spark.read.parquet(f"{root}/posts").select(columns).collect()) == rows
    assert compact_closed_dates(spark, f"{root}/posts", dates[-1].split("=")[1]) == 0
    write(posts, 8)
    assert spark.read.parquet(f"{root}/posts").count() == len(rows)
    posts.unpersist()


def _minutes(spark, lo, hi, step=1):
    """A post a minute: ids [lo, hi) from midnight of 2024-03-01, all with the symbol THE."""
    return spark.range(lo, hi, step).select(
        F.col("id"), F.lit("s").alias("source"), F.col("id").cast("string").alias("external_id"),
        (F.lit("2024-03-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))).alias("created_at"),
        F.lit("the post").alias("text"))


def _link_the(df):
    return SY.extract_symbols(df, "text", {"THE": "THE"}, (), ())


def _scored(df):
    return df.withColumn("stance", (F.col("id") % 3 - 1).cast("short")).withColumn("model_ver", F.lit("m"))


def _run_live(spark, land, out, schema, **options):
    q, paths = ST.start_live_pipeline(spark, land, schema, out, _link_the, _scored, trigger={"availableNow": True}, **options)
    q.awaitTermination(900)
    if q.exception() is not None:
        raise q.exception()
    return paths


def test_only_rows_behind_the_watermark_are_looked_up(spark, monkeypatch):
    """Many batches of one day: the state tells what is new and no stored file is read, until a row days behind comes."""
    land, out = scratch_dir(spark, "tier_land"), scratch_dir(spark, "tier_out")
    schema = _minutes(spark, 0, 1).schema
    reads = []
    plain = ST.read_dates

    def watched(spark_, path, dates, schema_):
        reads.append(sorted(map(str, dates)))
        return plain(spark_, path, dates, schema_)
    monkeypatch.setattr(ST, "read_dates", watched)
    n = 0
    for poll in range(12):                              # every poll re-sends the one before
        n = max(n, 30 * poll + 60)
        _minutes(spark, 30 * poll, 30 * poll + 60).coalesce(1).write.mode("append").json(land)
    paths = _run_live(spark, land, out, schema, max_files_per_trigger=1)
    assert reads == []
    _minutes(spark, 3 * 1440, 3 * 1440 + 60).coalesce(1).write.mode("append").json(land)     # three days on
    _run_live(spark, land, out, schema, max_files_per_trigger=1)
    assert reads == []
    late = _minutes(spark, 10, 50).unionByName(_minutes(spark, 600, 640)).unionByName(_minutes(spark, 3 * 1440 + 50, 3 * 1440 + 70))
    late.coalesce(1).write.mode("append").json(land)    # 40 stored long ago, 40 late ones, 10 known, 10 new
    _run_live(spark, land, out, schema, max_files_per_trigger=1)
    assert reads == [["2024-03-01"]]
    stored = spark.read.parquet(paths["posts"])
    assert stored.count() == stored.select("external_id").distinct().count() == n + 60 + 40 + 10
    counts = ST.ingest_metrics(spark, out).agg(*[F.sum(c).alias(c) for c in ("read", "new", "repeated", "looked_up", "stored", "fanned_out")]).first()
    assert (counts["read"], counts["new"], counts["stored"], counts["fanned_out"]) == (12 * 60 + 60 + 100, n + 110, n + 110, n + 110)
    assert counts["repeated"] == counts["read"] - counts["new"] and counts["looked_up"] == 80
    touched = spark.read.parquet(paths["touched"])
    assert touched.select("bucket").distinct().count() == 40


def test_a_date_far_ahead_makes_no_other_post_late(spark):
    land, out = scratch_dir(spark, "ahead_land"), scratch_dir(spark, "ahead_out")
    polls = [_minutes(spark, 0, 60), _minutes(spark, 5_000_000, 5_000_001), _minutes(spark, 30, 90)]
    for p in polls:
        p.withColumn("polled_at", F.lit("2024-03-01 02:00:00").cast("timestamp")).coalesce(1).write.mode("append").json(land)
    paths = _run_live(spark, land, out, polls[0].withColumn("polled_at", F.lit(None).cast("timestamp")).schema, max_files_per_trigger=1, clock="polled_at")
    assert spark.read.parquet(paths["posts"]).count() == 91
    assert ST.ingest_metrics(spark, out).agg(F.sum("looked_up")).first()[0] == 0


def test_a_store_filled_by_others_is_looked_up(spark):
    """A new query over a store that is there already does not take its posts for new."""
    land, out = scratch_dir(spark, "old_land"), scratch_dir(spark, "old_out")
    write = ST.store_insert_writer(out, _link_the, order=("id",))
    write(_minutes(spark, 0, 100), -5)
    _minutes(spark, 50, 150).coalesce(1).write.json(land)
    paths = _run_live(spark, land, out, _minutes(spark, 0, 1).schema)
    stored = spark.read.parquet(paths["posts"])
    assert stored.count() == stored.select("external_id").distinct().count() == 150


def test_repair_counts_what_stream_and_refresh_miss(spark):
    """Late posts in the served view: live ingest, sentiment stage, late posts, repair."""
    from moodlake.sources import views as VW

    land, out = scratch_dir(spark, "repair_land"), scratch_dir(spark, "repair_out")
    schema = _minutes(spark, 0, 1).schema
    for poll in (_minutes(spark, 0, 3 * 1440, 2), _minutes(spark, 5 * 1440, 5 * 1440 + 100), _minutes(spark, 1, 1440, 2)):
        poll.coalesce(1).write.mode("append").json(land)
        paths = _run_live(spark, land, out, schema, max_files_per_trigger=1)
        fan = spark.read.parquet(paths["ticker_posts"]).drop("batch_id", "created_date")
        q = ST.start_sentiment_from_fanout(spark, paths, fan.schema, trigger={"availableNow": True})
        q.awaitTermination(600)
        assert q.exception() is None
    cols = ["bucket", "ticker", "n_posts", "pos_ct", "neu_ct", "neg_ct"]
    want = S.sentiment_buckets(fan).select(*cols)
    missed = want.exceptAll(VW.current_view(spark, paths["sentiment"]).select(*cols)).count()
    assert missed == 720                                # a post in each second minute of the first day
    last = VW.repair_view(spark, paths["ticker_posts"], paths["touched"], paths["sentiment"])
    got = VW.current_view(spark, paths["sentiment"]).select(*cols)
    assert want.exceptAll(got).count() == got.exceptAll(want).count() == 0
    assert last is not None and VW.repair_view(spark, paths["ticker_posts"], paths["touched"], paths["sentiment"]) is None
    repaired = spark.read.parquet(f"{paths['sentiment']}/writer=repair")
    assert repaired.count() == 720                      # only what was touched


def test_states_add_up(spark):
    from moodlake.sources import views as VW

    rows = O.scored_mentions(spark.read.parquet(f"{SF01}/events.parquet"))
    path = scratch_dir(spark, "states")
    part = F.col("post_id") % 5
    VW.write_state(S.sentiment_state(rows.where(part == 0)), path, "stream", 0)
    VW.write_state(S.sentiment_state(rows.where(part <= 1)), path, "stream", 1)      # an update of the same buckets
    VW.write_state(S.sentiment_state(rows.where(part == 2)), path, "other", 0)
    for _ in range(2):                                  # a late batch that ran twice
        VW.write_state(S.sentiment_state(rows.where(part >= 3)), path, "late", 0, delta=True)
    state = VW.current_state(spark, path)
    for width in (None, "1 hour", "7 days"):
        got = S.finish_state(S.merge_state(state, width))
        want = S.sentiment_buckets(rows, width or "10 seconds")
        norm = lambda df: sorted((r["bucket"], r["ticker"], r["n_posts"], round(r["vw_sentiment"], 9), r["pos_ct"], r["neg_ct"]) for r in df.collect())
        assert norm(got) == norm(want)


def test_arrival_through_raw_lines(spark):
    """Raw listing lines as text: the readers carry the arrival, so the first write wins in the live path too."""
    from moodlake.sources import files as FS

    land = scratch_dir(spark, "line_land")
    line = '{"id": "%s", "title": "the %s", "selftext": "x", "url": "u", "channel": "c", "score": 1, "num_comments": 2, "created_utc": 1704067200.0, "listing": "new", "pos": %d}'
    for k in range(3):
        spark.createDataFrame([(line % (i, f"copy {k}", i),) for i in range(5)], "value string").coalesce(1).write.mode("append").text(land)
    q, paths = ST.start_store_pipeline(spark, land, "value string", scratch_dir(spark, "line_out"), _link_the, landing_format="text",
                                       trigger={"availableNow": True}, to_posts=lambda raw: FS.listing_posts(FS.listing_records(raw)).withColumn("text", post_text()))
    q.awaitTermination(600)
    assert q.exception() is None
    assert {r["title"] for r in spark.read.parquet(paths["posts"]).collect()} == {"the copy 0"}


def test_a_batch_writes_few_files_and_small_filters(spark):
    """Files of a batch follow its rows and dates, not dates times shuffle tasks, and a file of few posts has small filters."""
    import os

    root = scratch_dir(spark, "few_files")
    posts = spark.range(4000).select(
        "id", F.lit("s").alias("source"), F.col("id").cast("string").alias("external_id"), F.lit("the").alias("text"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("id").cast("int") % 960)).alias("created_at"))
    write = ST.store_insert_writer(root, lambda df: df.withColumn("tickers", F.array(F.lit("THE"))), order=("id",))
    write(posts.repartition(4), 0)
    for name, most in (("posts", 20_000), ("ticker_posts", 5_000)):
        sizes = [os.path.getsize(f"{d}/{f}") for d, _, fs in os.walk(f"{root}/{name}") for f in fs if f.endswith(".parquet")]
        assert 40 <= len(sizes) <= 41 and max(sizes) < most, (name, len(sizes), max(sizes))
    assert spark.read.parquet(f"{root}/posts").select("id").distinct().count() == 4000


def test_new_keys_need_no_second_shuffle_of_the_posts(spark, monkeypatch):
    """The posts' rows are grouped and met with the stream's new keys under one partitioning."""
    plans = []
    batch = spark.createDataFrame([(1, "s", "a", "2024-01-01 00:00:00", "the"), (2, "s", "b", "2024-01-01 00:00:00", "the")],
                                  "id long, source string, external_id string, created_at string, text string")
    batch = batch.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    key = F.struct("source", "external_id", F.col("created_at").cast("timestamp").alias("created_at"))
    records = batch.withColumn(ST.NEW_KEY, F.lit(None).cast(key_type(batch, key)))
    keys = batch.where("id = 1").select(key.alias(ST.NEW_KEY))

    class Before(ST.Progress):
        def read(self, batch_id):
            return {"newest": 0, "clock": 0, "floor": None}

    def link(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df.withColumn("tickers", F.array(F.lit("THE")))
    monkeypatch.setattr(ST, "with_arrival_rows", lambda df: df)
    root = scratch_dir(spark, "one_shuffle")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        write = ST.store_insert_writer(root, link, order=("id",), progress=Before(spark, f"{root}/progress"))
        write(records.unionByName(keys, allowMissingColumns=True), 0)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plans[0].count("Exchange hashpartitioning") == 2, plans[0]
    assert [r.id for r in spark.read.parquet(f"{root}/posts").collect()] == [1]


def key_type(df, column):
    return df.select(column.alias("k")).schema["k"].dataType


def test_feed_files_follow_the_table(spark, monkeypatch):
    """A larger table lands in more files, so none of them is read whole by one task that grows with it."""
    from moodlake.plans import catalog as C

    from tests.conftest import SF001
    few = C.QUERIES["stream_feed_items"](spark, SF001)
    assert C._feed_files(spark, SF001) == 4
    import os
    monkeypatch.setattr(C, "FEED_FILE_BYTES", os.path.getsize(f"{SF001}/documents.parquet") // 6 + 1)
    assert C._feed_files(spark, SF001) == 6
    landed = []
    plain = C.FS.stream_feed_items

    def watched(spark, path, **options):
        landed.append(len([f for f in os.listdir(path) if f.startswith("part-")]))
        return plain(spark, path, **options)
    monkeypatch.setattr(C.FS, "stream_feed_items", watched)
    many = C.QUERIES["stream_feed_items"](spark, SF001)
    assert landed == [6]
    assert few.exceptAll(many).count() == 0 and many.exceptAll(few).count() == 0


class _Watched:
    """A live query whose ``awaitTermination`` is another one."""

    def __init__(self, q, wait):
        self.q, self.wait = q, wait

    def awaitTermination(self, timeout=None):  # noqa: N802
        return self.wait(self.q, timeout)

    def __getattr__(self, name):
        return getattr(self.q, name)


def _watch(monkeypatch, wait):
    from moodlake.plans import catalog as C

    plain = ST.start_live_pipeline

    def start(*args, **options):
        q, paths = plain(*args, **options)
        return _Watched(q, wait), paths
    monkeypatch.setattr(C.ST, "start_live_pipeline", start)
    return C


def test_a_live_query_that_outlasts_a_time_limit_is_waited_for(spark, monkeypatch):
    """However long the live query takes, its result is that of every landed row, not of those read so far."""
    def wait(q, timeout):
        if timeout is not None:                         # a limit that the query does not keep
            while not q.recentProgress and q.isActive:
                time.sleep(0.05)
            return False
        return q.awaitTermination()
    C = _watch(monkeypatch, wait)
    posts = _minutes(spark, 0, 6 * 480, 20).drop("text").withColumn("title", F.lit("the post")).withColumn("body", F.lit("x"))
    got = C._live_fanout(spark, posts)
    assert sorted(r.post_id for r in got.where("ticker = 'THE'").collect()) == list(range(0, 6 * 480, 20))


def test_a_live_query_that_others_stop_gives_no_result(spark, monkeypatch):
    def wait(q, timeout):
        while not q.recentProgress and q.isActive:
            time.sleep(0.05)
        q.stop()
        return True
    C = _watch(monkeypatch, wait)
    posts = _minutes(spark, 0, 6 * 480, 20).drop("text").withColumn("title", F.lit("the post")).withColumn("body", F.lit("x"))
    with pytest.raises(RuntimeError, match="landed rows"):
        C._live_fanout(spark, posts).collect()


def test_late_posts_are_waited_for(spark, monkeypatch, tmp_path):
    """stream_late_posts over a table of its own, under a limit that the live query does not keep: every post is fanned out."""
    def wait(q, timeout):
        if timeout is not None:
            while not q.recentProgress and q.isActive:
                time.sleep(0.05)
            return False
        return q.awaitTermination()
    C = _watch(monkeypatch, wait)
    docs = spark.range(0, 6 * 480, 20).select(F.col("id").alias("doc_id"), F.lit("the post\nx").alias("text"), F.lit("en").alias("lang"),
                                              F.lit("s").alias("source"), F.lit(10).cast("long").alias("n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = C.QUERIES["stream_late_posts"](spark, str(tmp_path))
    assert sorted(r.post_id for r in got.where("ticker = 'THE'").collect()) == list(range(0, 6 * 480, 20))


def test_only_the_keys_of_a_batch_are_shuffled(spark, monkeypatch):
    """The rows that are new are found by key and arrival, the texts stay where they were read; beyond the bound whole rows
    are shuffled. Either way the first write wins, whole, also of copies that differ."""
    root, plans, stored = scratch_dir(spark, "slim_land"), [], {}
    for k in range(3):                                  # every post three times, in the order of the files
        (_minutes(spark, 0, 40).withColumn("text", F.concat(F.lit(f"the copy {k} of "), F.col("id").cast("string")))
         .withColumn("title", F.col("text")).coalesce(1).write.mode("append").json(root))

    def link(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return _link_the(df)
    for most in (2_000_000, 0):
        monkeypatch.setattr(ST, "MAX_ROWS_SENT", most)
        out = scratch_dir(spark, "slim_out")
        schema = _minutes(spark, 0, 1).withColumn("title", F.lit("")).schema
        for again in range(2):                          # a second query over the same store adds nothing
            q, paths = ST.start_live_pipeline(spark, root, schema, out, link, trigger={"availableNow": True})
            q.awaitTermination()
        stored[most] = sorted((r.id, r.title) for r in spark.read.parquet(paths["posts"]).collect())
    grouped = [any("min_by" in line and "title#" in line for line in p.splitlines()) for p in plans]
    assert grouped == [False, True] and "LeftSemi" in plans[0]
    assert stored[0] == stored[2_000_000] == [(i, f"the copy 0 of {i}") for i in range(40)]


def test_polls_are_landed_compressed_and_shuffled_once(spark, monkeypatch):
    import os

    posts = _minutes(spark, 0, 1000).withColumn("text", F.repeat(F.lit("the same words "), 20))
    shuffled = []
    plain = type(posts).repartition

    def repartition(df, *cols):
        shuffled.append(df.count())
        return plain(df, *cols)
    monkeypatch.setattr(type(posts), "repartition", repartition)
    path = scratch_dir(spark, "polls")
    assert O.land_all_polls(posts, path, "created_at", 6 * 3600, "2024-03-01 00:00:00") == 2000
    assert shuffled == [1000]                           # and sent twice from where they are
    files = [f"{d}/{f}" for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")]
    assert sum(map(os.path.getsize, files)) < 1000 * 100
    landed = spark.read.schema(posts.schema).option("recursiveFileLookup", "true").json(path)
    assert landed.exceptAll(posts.unionByName(posts)).count() == posts.unionByName(posts).exceptAll(landed).count() == 0
    folders = {d.rsplit("=")[-1]: spark.read.schema(posts.schema).json(f"{path}/{d}").count() for d in os.listdir(path) if "=" in d}
    assert folders == {"0": 360, "1": 720, "2": 640, "3": 280}
