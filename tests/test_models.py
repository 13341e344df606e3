"""Models as Spark uses them: hashed ones, external encoders, scores by content, the trained scorer; latency sketches,
point lookups and the bucketed duplicate index."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from moodlake.operators import scoring as SCR
from moodlake.operators import text_ops as TO
from moodlake.plans import jobs as J
from moodlake.plans import overlays as O
from moodlake.plans import serving as V
from moodlake.plans.catalog import QUERIES
from moodlake.session import scratch_dir
from moodlake.sources.posts_store import write_partitioned
from tests.conftest import SF001, SF01


def plain_mean(text, dims):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower()) if isinstance(text, str) else []
    if not words:
        return np.zeros(dims)
    vec = lambda w: np.frombuffer(b"".join(hashlib.md5(f"{w}#{k}".encode()).digest() for k in range(-(-dims // 16))), np.uint8)[:dims] / 255 - 0.5
    return np.mean([vec(w) for w in words], axis=0)


@pytest.mark.parametrize("gather", [1 << 22, 64])
def test_hashed_mean_equals_word_by_word(monkeypatch, gather):
    monkeypatch.setattr(SCR, "_GATHER", gather)
    monkeypatch.setattr(SCR, "_HASHED", {})
    texts = ["", None, " \t", "One two  two", "é\x1cx\x85y z", "a " * 700, "w1 w2", "  lead", "İ ß"]
    for dims in (3, 16, 40):
        assert np.allclose(SCR.hashed_mean(texts, dims), [plain_mean(t, dims) for t in texts], atol=1e-12)
    small = SCR.HashedWords(3, most=4)                  # a full memory starts anew
    for k in range(5):
        n = small.numbers([b"x%d" % (k + j) for j in range(3)])
        assert np.allclose(small.table[n], [plain_mean(f"x{k + j}", 3) for j in range(3)])


class _Unlisted(dict):
    def keys(self):
        raise AssertionError("all known words were gone through")


def test_a_batch_costs_its_own_words(monkeypatch):
    """However many words are known, a batch looks up its own, and a batch of one text gives the scores of a large one."""
    known = SCR.HashedWords(3)
    known.numbers([b"w%d" % k for k in range(5000)])
    known.rows = _Unlisted(known.rows)
    n = known.numbers([b"w7", b"new", b"w7"])
    assert list(n) == [known.rows[b"w7"], 5000, known.rows[b"w7"]]
    assert np.allclose(known.table[n], [plain_mean(w, 3) for w in ("w7", "new", "w7")])


def test_sums_do_not_depend_on_the_words_order(monkeypatch):
    """Components that tie are equal, so the order of words and batches decides no stance."""
    rng = np.random.default_rng(3)
    words = np.array([f"w{k}" for k in range(300)])
    texts = [" ".join(rng.choice(words, 200)) for _ in range(50)]
    mixed = [" ".join(rng.permutation(t.split())) for t in texts]
    one = np.concatenate([SCR.hashed_mean([t], 3) for t in mixed])
    assert (SCR.hashed_mean(texts, 3) == one).all()
    monkeypatch.setattr(SCR, "_GATHER", 64)
    assert (SCR.hashed_mean(texts, 3) == one).all()


@pytest.mark.parametrize("size", [1, 3, 32])
def test_logits_go_back_by_the_arrow_batch(spark, size):
    """The model is given batches of its size; what it returns goes back as one column per Arrow batch."""
    import pandas as pd

    seen = []

    def make():
        def predict(texts):
            seen.append(len(texts))
            return SCR.hashed_mean(texts, 3)
        return predict
    texts = ["one two", "", "three", "four five six", None, "w", "x y"]
    out = list(SCR.batch_logits_udf(make, batch_size=size).func(iter([pd.Series(texts), pd.Series([], dtype=object), pd.Series(["z"])])))
    assert [len(s) for s in out] == [7, 0, 1]
    assert seen == [min(size, 7 - lo) for lo in range(0, 7, size)] + [1]
    assert np.allclose([*out[0], *out[2]], [plain_mean(t, 3) for t in [*texts, "z"]])
    wrong = SCR.batch_logits_udf(lambda: lambda texts: np.zeros((len(texts) + 1, 3)))
    with pytest.raises(ValueError):
        list(wrong.func(iter([pd.Series(["a"])])))


def test_embedding_is_evaluated_once(spark):
    for key in ("embed_posts", "embed_encoder"):
        plan = QUERIES[key](spark, SF001)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1, key


def test_pooling_does_not_depend_on_the_batch(spark):
    posts = spark.read.parquet(f"{SF001}/documents.parquet").select(F.col("doc_id").alias("id"), "text").unionByName(
        spark.createDataFrame([(-1, None), (-2, ""), (-3, "one")], "id long, text string"))
    out = {}
    for size in (1, 32):
        udf = SCR.batch_embed_udf(SCR.hashed_encoder(5), size, "double")
        out[size] = {r["id"]: r["v"] for r in posts.select("id", udf("text").alias("v")).collect()}
    assert out[1].keys() == out[32].keys() and all(np.allclose(out[1][k], out[32][k], atol=1e-12) for k in out[1])
    want = np.mean([plain_mean("[cls]", 5), plain_mean("[sep]", 5)], axis=0)
    assert np.allclose(out[32][-1], want) and np.allclose(out[32][-2], want)
    single = SCR.batch_embed_udf(SCR.hashed_encoder(5))
    assert posts.select(single("text").alias("v")).schema["v"].dataType.simpleString() == "array<float>"


def test_each_text_is_scored_once(spark):
    """Copies and texts of earlier passes are not given to the model again; another model scores anew."""
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    calls = spark.sparkContext.accumulator(0)
    plain = SCR.hashed_scorer()

    def counting():
        predict = plain()

        def run(texts):
            calls.add(len(texts))
            return predict(texts)
        return run
    # a model of its own for each pass: one that a worker keeps would count for its first task only
    score = lambda rows: SCR.score_with_udf(rows, SCR.batch_logits_udf(counting))
    path = scratch_dir(spark, "scores_by_content")
    distinct = lambda df: df.select("text").distinct().count()
    half = docs.where("id % 2 = 0")
    J.score_by_content(half, path, score, "m1")
    assert calls.value == distinct(half) < half.count()
    done = J.score_by_content(docs, path, score, "m1")
    assert calls.value == distinct(docs) < docs.count()
    rows = {r["id"]: (r["stance"], tuple(r["probs"])) for r in done.collect()}
    want = {r["id"]: (r["stance"], tuple(r["probs"])) for r in SCR.score_with_udf(docs, SCR.batch_logits_udf(plain)).collect()}
    assert rows == want
    J.score_by_content(docs, path, score, "m1")
    assert calls.value == distinct(docs)
    J.score_by_content(half, path, score, "m2")
    assert calls.value == distinct(docs) + distinct(half)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "A b"), (4, "a b")], "id long, text string")
    assert J.score_by_content(odd, path, score, "m3").count() == 4 and calls.value == distinct(docs) + distinct(half) + 3


def test_trained_scorer_is_better_than_the_commonest_class(spark):
    labels = SCR.three_class_label(spark.read.parquet(f"{SF01}/labels.parquet")).withColumnRenamed("doc_id", "id")
    scored = QUERIES["score_posts_trained"](spark, SF01).join(labels, "id")
    right = scored.where(F.col("stance") + 1 == F.col("label")).count()
    assert right >= max(r["count"] for r in labels.groupBy("label").count().collect()) and right > 0.8 * scored.count()


def test_sketch_ranks_are_close_and_read_no_post(spark):
    """200,000 latencies, a third of them equal: the merged sketches' p95 has a rank within 1 %."""
    base = F.lit("2024-05-01 10:00:00").cast("timestamp")
    ms = F.when(F.col("id") % 3 == 0, F.lit(5000)).otherwise(F.pmod(F.xxhash64("id"), F.lit(60_000)))
    posts = spark.range(200_000).select(
        (base + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("id") % 7200)).alias("ingested_at"), ms.alias("ms"),
        F.when(F.col("id") % 50 == 7, F.lit(True)).alias("is_backfill"))
    posts = posts.withColumn("classified_at", F.col("ingested_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("ms") / 1000))
    path = scratch_dir(spark, "sketches")
    V.latency_sketches(posts).write.parquet(path)
    sketches = spark.read.parquet(path)
    kept = posts.where(F.col("is_backfill").isNull())
    for minutes in (10, 60, None):
        as_of = "2024-05-01 12:00:00"
        own = kept if minutes is None else kept.where(F.col("ingested_at") > F.lit(as_of).cast("timestamp") - F.expr(f"interval {minutes} minutes"))
        got = V.latency_from_sketches(sketches, minutes=minutes, as_of=as_of).first()
        n, lo, hi = own.agg(F.count(F.lit(1)), F.count_if(F.col("ms") / 1000 < got["p95_latency_sec"]), F.count_if(F.col("ms") / 1000 <= got["p95_latency_sec"])).first()
        assert got["n"] == n and lo / n - 0.01 <= 0.95 <= hi / n + 0.01
    none = V.latency_from_sketches(sketches, minutes=10, as_of="2030-01-01 00:00:00").first()
    assert (none["n"], none["p95_latency_sec"]) == (0, None)


def _scanned(df) -> int:
    """Rows that the plan's scans gave out."""
    df.collect()
    todo, rows = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            p = p.executedPlan()
        if "Scan" in p.nodeName() and p.metrics().contains("numOutputRows"):
            rows += p.metrics().apply("numOutputRows").value()
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return rows


def test_a_point_lookup_reads_the_row_groups_that_may_hold_the_id(spark):
    posts = spark.range(20_000).select(F.xxhash64("id").alias("id"), F.lit("s").alias("source"), F.hex("id").alias("external_id"),
                                       F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 40).alias("created_at"))
    path = scratch_dir(spark, "bloom")
    write_partitioned(posts, path)
    stored = spark.read.parquet(path)
    files = len(stored.inputFiles())
    assert files >= 8
    wanted = posts.select("id").limit(1).first()["id"]
    hit = stored.where(F.col("id") == wanted)
    assert hit.count() == 1 and _scanned(stored.where(F.col("id") == wanted)) <= 20_000 * 3 / files
    assert _scanned(stored.where(F.col("id") == 12345)) <= 20_000 * 2 / files
    assert _scanned(stored.where((F.col("source") == "s") & (F.col("external_id") == "2A"))) <= 20_000 * 3 / files


def test_new_posts_find_their_groups_without_moving_the_stored_ones(spark):
    hashed = TO.with_text_hash(O.posts_text(spark.read.parquet(f"{SF01}/documents.parquet"))).select("id", "txt_hash")
    path = scratch_dir(spark, "duplicates")
    index = TO.DuplicateIndex(spark, path, 4)
    rows = lambda df: sorted(tuple(r) for r in df.select("txt_hash", "n", "first_id").collect())
    assert index.groups().count() == 0
    for part in range(3):
        new = hashed.where(F.col("id") % 3 == part)
        before = hashed.where(F.col("id") % 3 < part)
        want = TO.exact_duplicate_groups(before.unionByName(new)).join(new, "txt_hash", "left_semi")
        found = index.groups_with(new)
        assert rows(found) == rows(want)
        index.insert(new)
    assert rows(index.groups()) == rows(TO.exact_duplicate_groups(hashed))
    assert "Exchange" not in index.groups()._jdf.queryExecution().executedPlan().toString()
    plan = index.groups_with(hashed.limit(50))._jdf.queryExecution().sparkPlan().toString()
    joined = index.groups_with(hashed.where("id < 50"))
    joined.collect()
    text = joined._jdf.queryExecution().executedPlan().toString()
    stored_side = text[text.index("Scan parquet spark_catalog"):] if text.count("Scan parquet spark_catalog") else text
    assert "Bucketed: true" in text and plan and "Exchange" not in stored_side.split("\n")[0]
    again = TO.DuplicateIndex(spark, path, 4)          # opened by another session's entry
    assert rows(again.groups()) == rows(index.groups())
    index.close()
    again.close()
