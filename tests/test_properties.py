"""Properties: bounded sentiment, counts, idempotent inserts, scorer invariance."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moodlake.operators import ingest as IG
from moodlake.operators import scoring as SCR
from moodlake.operators import sentiment as S
from tests.conftest import SF001

row = st.tuples(st.integers(0, 59), st.sampled_from(["A", "B"]), st.sampled_from([None, -1, 0, 1, 2]),
                st.one_of(st.none(), st.integers(-50, 1000)), st.one_of(st.none(), st.integers(0, 1000)))


@settings(max_examples=15, deadline=None)
@given(st.lists(row, min_size=1, max_size=40))
def test_sentiment_bounds(spark, rows):
    df = spark.createDataFrame([(f"2024-01-01 00:00:{s:02d}", t, st_, sc, cm) for s, t, st_, sc, cm in rows],
                               "created_at string, ticker string, stance short, score int, comments int") \
        .withColumn("created_at", F.col("created_at").cast("timestamp"))
    for r in S.sentiment_buckets(df).collect():
        assert r.vw_sentiment is None or abs(r.vw_sentiment) <= 1 + 1e-12
        assert r.pos_ct + r.neu_ct + r.neg_ct <= r.n_posts


def test_insert_of_duplicates_changes_nothing(spark):
    base = spark.read.parquet(f"{SF001}/documents.parquet").select(
        F.col("source"), F.col("doc_id").cast("string").alias("external_id"),
        F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.lit(0).alias("k"))
    assert IG.insert_new(base, base.unionByName(base)).count() == 0
    once = IG.first_write(base)
    twice = IG.first_write(base.unionByName(base.withColumn("k", F.lit(1))))
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0


def test_external_scorer_batch_size_and_partition_invariance(spark):
    def _make_predict():  # nested: shipped to Python workers by value
        import numpy as np

        w = np.array([[0.3, -0.2, 0.1], [0.05, 0.1, -0.3]])

        def predict(texts):
            lens = np.array([len(t) for t in texts], dtype=float)
            feats = np.stack([np.log1p(lens), np.array([t.count("e") for t in texts], dtype=float)], axis=1)
            return feats @ w

        return predict

    docs = spark.read.parquet(f"{SF001}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    out = []
    for bs, parts in ((1, 1), (32, 4), (7, 3)):
        udf = SCR.batch_logits_udf(_make_predict, batch_size=bs)
        scored = SCR.decode_logits(docs.repartition(parts).withColumn("logits", udf("text")))
        out.append(sorted((r.id, r.stance, round(r.probs.pos, 12)) for r in scored.collect()))
    assert out[0] == out[1] == out[2]


def test_default_scorer_probabilities(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    labels = SCR.three_class_label(spark.read.parquet(f"{SF001}/labels.parquet")).withColumnRenamed("doc_id", "id")
    model = SCR.train_default_scorer(docs.join(labels, "id"), max_iter=10)
    rows = SCR.score_with_model(model, docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert abs(r.probs.neg + r.probs.neu + r.probs.pos - 1) < 1e-9
        assert r.stance in (-1, 0, 1)


def test_embedder_is_mean_of_word_vectors_over_whole_text(spark):
    import numpy as np

    from moodlake.operators import scoring

    docs = spark.read.parquet(f"{SF001}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    model = scoring.train_embedder(docs.repartition(3), vector_size=8, num_partitions=3)
    vecs = {r.word: np.array(r.vector.toArray()) for r in model.stages[-1].getVectors().collect()}
    one = scoring.embed_with_model(model, docs.repartition(1)).collect()
    many = {r.id: r.embedding for r in scoring.embed_with_model(model, docs.repartition(7)).collect()}
    tok = model.stages[0]
    toks = {r.id: r["__tok"] for r in tok.transform(docs).select("id", "__tok").collect()}
    longest = max(toks, key=lambda i: len(toks[i]))
    assert len(toks[longest]) > 1000  # whole texts, beyond any 512-token model limit
    for r in one:
        assert r.embedding == many[r.id]  # partitioning does not change a vector
        t = toks[r.id]
        expect = np.mean([vecs[w] for w in t], axis=0) if t else np.zeros(8)
        assert np.allclose(r.embedding, expect, atol=1e-5)


def test_trained_embedder_keeps_every_word(spark):
    from pyspark.ml.feature import RegexTokenizer

    from moodlake.operators import scoring

    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("text")
    toks = RegexTokenizer(inputCol="text", outputCol="__tok", pattern=r"(?U)\W+", minTokenLength=1).transform(docs)
    full = toks.select(F.explode("__tok").alias("w")).distinct().count()
    assert scoring.train_embedder(docs, vector_size=4).stages[-1].getVectors().count() == full


def test_hashed_embedding_is_the_mean_over_the_whole_text(spark):
    import numpy as np

    from moodlake.operators import scoring

    docs = spark.createDataFrame([(1, "One two  two"), (2, ""), (3, None), (4, "ÉTÉ " * 5000)], "id long, text string")
    got = {r.id: r.embedding for r in scoring.embed_hashed(docs, 20).collect()}
    one, two = scoring.hashed_mean(["one", "two"], 20)
    assert np.allclose(got[1], (one + 2 * two) / 3, atol=1e-6) and not any(got[2]) and not any(got[3])
    assert np.allclose(got[4], scoring.hashed_mean(["été"], 20)[0], atol=1e-6)


def test_trained_scorer_saved_and_loaded_scores_the_same(spark):
    from moodlake.operators import scoring
    from moodlake.session import scratch_dir

    docs = spark.read.parquet(f"{SF001}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    labels = scoring.three_class_label(spark.read.parquet(f"{SF001}/labels.parquet")).withColumnRenamed("doc_id", "id")
    model = scoring.train_default_scorer(docs.join(labels, "id"), max_iter=3)
    path = scratch_dir(spark, "scorer")
    scoring.save_model(model, path)
    a = scoring.score_with_model(model, docs).select("id", "stance").collect()
    assert sorted(a) == sorted(scoring.score_with_model(scoring.load_model(path), docs).select("id", "stance").collect())
