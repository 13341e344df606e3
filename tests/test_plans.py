"""Physical-plan assertions: the scale properties the design relies on."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from moodlake.operators import sentiment as S
from moodlake.plans import overlays as O
from moodlake.plans import serving as V
from moodlake.session import scratch_dir
from tests.conftest import SF001


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def full_plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("key", ["sentiment_buckets_10s", "extract_symbols", "symbol_fanout", "text_hash",
                                 "stance_decode", "pipeline_metrics", "dedup_first_write"])
def test_no_python_on_hot_path(spark, key):
    p = full_plan(E.queries()[key](spark, SF001))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


@pytest.mark.parametrize("key", ["similar_posts", "sentiment_latest", "unscored_queue", "symbol_prefix"])
def test_top_k_not_full_sort(spark, key):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = plan(E.queries()[key](spark, SF001))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "TakeOrderedAndProject" in p


def test_single_search_works_on_batches_and_moves_no_vector(spark):
    """Distances come from one Arrow kernel, not from a lambda per element; only each task's k best are merged."""
    for key in ("similar_posts", "similar_posts_cosine"):
        p = plan(E.queries()[key](spark, SF001))
        assert "lambda" not in p and p.count("ArrowEvalPython") == 1 and "BatchEvalPython" not in p and "hashpartitioning" not in p


def test_sentiment_partial_aggregation_before_shuffle(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = plan(E.queries()["sentiment_buckets_10s"](spark, SF001))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "partial_count" in p and "partial_sum" in p
    assert p.index("Exchange") < p.rindex("partial_sum")  # partial below the exchange


def test_dedup_is_aggregate_with_partial(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = plan(E.queries()["dedup_first_write"](spark, SF001))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "partial_min_by" in p and "Window" not in p


def test_per_source_cap_limits_before_shuffle(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = plan(E.queries()["per_source_cap"](spark, SF001))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert p.count("WindowGroupLimit") >= 2  # partial (map side) and final


def test_series_filter_pushed_to_stored_view(spark):
    path = scratch_dir(spark, "view")
    S.sentiment_buckets(O.scored_mentions(O.load(spark, SF001, "events"))).write.parquet(path)
    df = V.sentiment_series(spark.read.parquet(path), "click", 24, "2024-01-30 00:00:00")
    p = plan(df)
    assert "PushedFilters: [IsNotNull(ticker), IsNotNull(bucket), EqualTo(ticker,click), GreaterThan(bucket," in p
    assert "ReadSchema: struct<bucket:timestamp_ntz,ticker:string,n_posts:bigint" in p


def test_time_range_scan_prunes_partitions(spark):
    df = E.queries()["time_range_scan"](spark, SF001)
    p = plan(df)
    pf = p[p.index("PartitionFilters: ["):]
    pf = pf[:pf.index("]")]
    assert ">= 2024-01-10)" in pf and "<= 2024-01-12)" in pf  # the range, not just isnotnull


def test_scan_prunes_columns(spark):
    p = plan(E.queries()["sentiment_buckets_10s"](spark, SF001))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string,value:double,props:string>" in p
    p2 = plan(E.queries()["text_hash"](spark, SF001))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p2


def test_fanout_links_once_inside_codegen(spark):
    p = plan(E.queries()["symbol_fanout"](spark, SF001))
    assert p.count("regexp_extract_all") == 1
    assert "lambdafunction" not in p


def test_series_from_facts_pushes_symbol_and_time_to_scan(spark):
    p = plan(E.queries()["sentiment_series"](spark, SF001))
    scan = p[p.index("PushedFilters"):]
    assert "EqualTo(event_type,click)" in scan and "GreaterThan(ts," in scan


def test_insert_reads_only_the_batch_dates_of_the_store(spark):
    from moodlake.operators.ingest import insert_new
    from moodlake.sources.posts_store import PostsStore, with_partition

    arr = O.arrivals(O.load(spark, SF001, "documents")).select("id", "source", "external_id", "created_at", "k", "copy")
    store = PostsStore(spark, scratch_dir(spark, "prune_store"), arr.schema)
    store.insert(arr.where(F.col("k") == 0), order=("k", "copy"))
    day1 = F.col("created_at") < F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")
    new = insert_new(store.read(), with_partition(arr.where((F.col("k") > 0) & day1)), order=("k", "copy"),
                     prune_col="created_date")
    scans = [ln for ln in plan(new).split("\n") if "FileScan" in ln and "created_date" in ln]
    assert scans and all("(created_date" in ln[ln.index("PartitionFilters"):] for ln in scans)
    stored_day1 = store.read().where(day1).select("source", "external_id", "created_at")
    batch_day1 = arr.where((F.col("k") > 0) & day1).select("source", "external_id", "created_at").distinct()
    assert new.count() == batch_day1.exceptAll(stored_day1).count()


def test_view_refresh_reads_only_its_window(spark):
    from moodlake.sources import views as VW

    facts = O.scored_mentions(O.load(spark, SF001, "events"))
    p = plan(VW.refresh_window(facts, "2024-01-15 00:00:00"))
    scan = p[p.index("PushedFilters"):]
    scan = scan[:scan.index("]")]
    assert "GreaterThanOrEqual(ts," in scan and "LessThan(ts," in scan


def test_symbol_lookup_through_fanout_index_prunes(spark):
    p = plan(E.queries()["posts_with_symbol_indexed"](spark, SF001))
    assert "EqualTo(ticker,NTI)" in p  # symbol filter reaches the index scan
    assert "dynamicpruningexpression(created_date" in p  # posts read only on the symbol's dates


def test_queries_run_from_another_folder(tmp_path):
    """Workers find the package although neither their folder nor PYTHONPATH holds it."""
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""import sys; sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as e
print("rows", e.queries()["similar_posts_batch"](spark, {SF001!r}).count())"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 2500" in out.stdout, out.stderr[-1500:]


def test_unset_checkpoint_folder_is_an_error_on_a_cluster():
    from types import SimpleNamespace as N

    import pytest

    from moodlake.session import checkpoint_root
    sc = N(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_root(N(sparkContext=sc, conf=N(get=lambda k, d=None: d)))


def test_insert_shuffles_the_batch_once(spark):
    """First write and the anti join with the stored keys share one partitioning of the batch."""
    from moodlake.operators.ingest import insert_new
    from moodlake.sources.posts_store import with_partition
    rows = spark.range(50).select(F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.col("id").cast("string").alias("external_id"),
                                  F.timestamp_seconds(F.col("id") * 9000).cast("timestamp_ntz").alias("created_at"), F.col("id").alias("k"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = insert_new(with_partition(rows.where("k < 20")), with_partition(rows.unionByName(rows)), prune_col="created_date")
        assert plan(new).count("Exchange hashpartitioning") == 2
        assert sorted(r.k for r in new.collect()) == list(range(20, 50))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
