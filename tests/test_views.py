"""Changelog compaction: snapshot + newer batches == full changelog view."""

from pyspark.sql import functions as F

from moodlake.operators import sentiment as S
from moodlake.plans import overlays as O
from moodlake.plans import serving as V
from moodlake.session import scratch_dir
from moodlake.sources import views as VW
from moodlake.streaming import pipeline as ST
from tests.conftest import SF001


def test_compaction_equals_changelog(spark):
    tp = O.scored_mentions(spark.read.parquet(f"{SF001}/events.parquet"))
    log = scratch_dir(spark, "changelog")
    # three "micro-batches": the later ones restate some buckets with new values
    write = ST.changelog_writer(log)
    for b, cond in enumerate([F.col("post_id") % 3 != 2, F.lit(True), F.col("post_id") % 2 == 0]):
        write(S.sentiment_buckets(tp.where(cond)), b)
    full = VW.current_view(spark, log)
    snap = VW.compact(spark, log, scratch_dir(spark, "snapshot"))
    write(S.sentiment_buckets(tp), 3)
    after = VW.current_view(spark, log, snap)
    expect = S.sentiment_buckets(tp)
    cols = ["bucket", "ticker", "n_posts", "pos_ct", "neu_ct", "neg_ct"]
    assert after.select(*cols).exceptAll(expect.select(*cols)).count() == 0
    assert full.count() == after.count()
    # series reads straight from the sorted snapshot
    s = V.sentiment_series(spark.read.parquet(snap).drop(*VW.ORDER), "click", 24 * 40, "2024-02-01 00:00:00")
    assert s.count() == full.where(F.col("ticker") == "click").count()


def test_stream_and_refresh_write_one_view_and_trim_keeps_it(spark):
    """The stream's and the refresh's batch ids both begin at 0; the newest commit counts, and folded batches can go."""
    tp = O.scored_mentions(spark.read.parquet(f"{SF001}/events.parquet"))
    log, cols = scratch_dir(spark, "two_writers"), ["bucket", "ticker", "n_posts", "pos_ct", "neu_ct", "neg_ct"]
    write = ST.changelog_writer(log)
    write(S.sentiment_buckets(tp.where("post_id % 2 = 0")), 0)  # the stream missed half of the rows
    VW.refresh_sentiment_view(tp, log, 0, "2024-02-15 00:00:00", start_offset_hours=24 * 60)
    expect = S.sentiment_buckets(tp).select(*cols)

    def same(df):
        return df.select(*cols).exceptAll(expect).count() == 0 and expect.exceptAll(df.select(*cols)).count() == 0

    assert same(VW.current_view(spark, log)) and same(ST.read_changelog(spark, log))
    for b in range(1, 4):
        write(S.sentiment_buckets(tp.where("post_id % 3 = 0")).limit(0).unionByName(S.sentiment_buckets(tp)), b)
    first = VW.compact(spark, log, scratch_dir(spark, "snap_a"))
    assert VW.trim(spark, log, first) == 3  # the stream's batches 0..2; each writer keeps its last
    assert same(VW.current_view(spark, log, first))
    write(S.sentiment_buckets(tp), 4)
    second = VW.compact(spark, log, scratch_dir(spark, "snap_b"), first)
    assert same(VW.current_view(spark, log, second))
