import math
import re

import numpy as np
from pyspark.sql import functions as F

from moodlake.llm import quality_bayes


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality_bayes.train(docs, labels.filter("doc_id % 2 = 0"))
    rows = quality_bayes.score(docs.join(labels.filter("doc_id % 2 = 1"), "doc_id"), F.col("source"), F.col("lang"), model,
                               ["doc_id", "quality"]).collect()
    good = [r["keep"] for r in rows if r["quality"] == 1]
    poor = [r["keep"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(poor) <= 0.1 * len(poor)


def test_sparse_sites_shrink_towards_their_parents(spark):
    rng = np.random.default_rng(2)
    rows = [("good.org", "a", float(p)) for p in rng.uniform(0.7, 1, 400)] + [("bad.org", "a", float(p)) for p in rng.uniform(0, 0.3, 400)]
    rows += [("bad.org", "b", 1.0), ("new.org", "a", 1.0), (None, None, 0.5)]
    got = {(r["host"], r["path"]): r for r in
           quality_bayes.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    assert len(got) == 5
    mean = sum(r[2] for r in rows) / len(rows)
    assert got["good.org", "a"]["path_p"] > 0.8 and got["bad.org", "a"]["path_p"] < 0.2
    # one document moves its path and host only part of the way from the host, and the global mean
    assert got["bad.org", "a"]["path_p"] < got["bad.org", "b"]["path_p"] < 1
    assert mean < got["new.org", "a"]["host_p"] < 1


def test_many_sites_are_joined_by_shuffling(spark, odd_docs, monkeypatch):
    model = quality_bayes.Classifier(np.r_[1.0, np.zeros(18)], np.zeros(19), np.ones(19))
    rows = {}
    for bound in (100_000, 1):
        monkeypatch.setattr(quality_bayes, "BROADCAST_SITES", bound)
        out = quality_bayes.score(odd_docs, F.col("source"), F.col("lang"), model)
        rows[bound] = sorted(map(str, out.collect()))
        assert len(rows[bound]) == odd_docs.count()
    assert rows[1] == rows[100_000]


def test_odd_rows_and_no_labels(odd_docs, no_docs, no_labels):
    model = quality_bayes.train(odd_docs, no_labels)
    out = quality_bayes.score(odd_docs, F.col("source"), F.col("lang"), model)
    rows = out.collect()
    assert len(rows) == odd_docs.count() and {r["doc_p"] for r in rows} == {0.5}
    assert set(odd_docs.columns) <= set(out.columns)
    assert quality_bayes.score(no_docs, F.col("source"), F.col("lang"), model).count() == 0


def brute_features(text):
    """The statistics of one text, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    raw = text.encode()
    letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    solid = max(sum(b not in b" \t\n\x0b\x0c\r" for b in raw), 1)
    count = lambda members: sum(b in members for b in raw)
    n = max(len(words), 1)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    rates = [count(b"#*$%&|<>~^=_{}[]\\@") / solid, count(b"!?") / solid, count(bytes(range(65, 91))) / solid,
             count(bytes(range(48, 58))) / solid, sum(a == b for a, b in zip(words, words[1:])) / n,
             sum(not any(map(letter, w.encode())) for w in words) / n, (len(lines) - len(set(lines))) / max(len(lines), 1)]
    return [1.0, *[math.log(r + 0.003) for r in rates], *rates, len(set(words)) / n, math.log1p(len(words)), math.log1p(solid / n),
            sum(map(letter, raw)) / solid]


def test_features_equal_brute_force(spark):
    texts = ["", " \n ", "One two two THREE!", "a b\n\na b\n12 %$ x1", "é é # #\nç", "same\nsame\nsame\n", "x" * 3000]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    data = "".join(texts).encode()
    ends = np.cumsum([len(t.encode()) for t in texts])
    assert np.allclose(quality_bayes.features(np.frombuffer(data, np.uint8), ends), [brute_features(t) for t in texts], atol=1e-12)


def brute_posteriors(rows):
    """host_p and path_p by site, from (host, path, p)."""
    total = sum(p for *_, p in rows) / len(rows)

    def strength(sites):
        sites = [(n, s, prior) for n, s, prior in sites if n]
        if len(sites) < 2:
            return 100.0
        n = sum(x[0] for x in sites)
        v = sum(n_ * q * (1 - q) for n_, _, q in sites) / n
        spread = sum(n_ * (s / n_ - q) ** 2 for n_, s, q in sites)
        between = (spread - len(sites) * v) / max(n - sum(x[0] ** 2 for x in sites) / n, 1e-9)
        return min(max(v / between - 1, 1), 10_000) if between > 0 else 10_000

    by = lambda key: {k: (len(x), sum(x)) for k in {key(r) for r in rows} for x in [[r[2] for r in rows if key(r) == k]]}
    hosts, paths = by(lambda r: r[0]), by(lambda r: r[:2])
    m = strength([(n, s, total) for n, s in hosts.values()])
    host_p = {k: (s + m * total) / (n + m) for k, (n, s) in hosts.items()}
    m = strength([(n, s, host_p[k[0]]) for k, (n, s) in paths.items()])
    return host_p, {k: (s + m * host_p[k[0]]) / (n + m) for k, (n, s) in paths.items()}, total


def test_scores_equal_brute_force(spark):
    """Posteriors and the final probability of many sparse sites, a hot one and null ones."""
    rng = np.random.default_rng(6)
    rows = [("hot", f"p{i % 3}", float(p)) for i, p in enumerate(rng.uniform(0.2, 0.9, 300))]
    rows += [(f"h{i % 60}", None if i % 7 == 0 else f"p{i % 4}", float(p)) for i, p in enumerate(rng.uniform(0, 1, 200))]
    rows += [(None, "x", 0.9), (None, None, 0.1)]
    host_p, path_p, total = brute_posteriors(rows)
    got = quality_bayes.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double").repartition(3)).collect()
    assert {(r["host"], r["path"]) for r in got} == path_p.keys() and len(got) == len(path_p)
    logit = lambda p: math.log(p / (1 - p))
    for r in got:
        site = (r["host"], r["path"])
        assert math.isclose(r["host_p"], host_p[r["host"]], rel_tol=1e-9) and math.isclose(r["path_p"], path_p[site], rel_tol=1e-9)
        assert math.isclose(r["shift"], logit(path_p[site]) - logit(total), rel_tol=1e-7, abs_tol=1e-9)


def test_final_scores_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("p", F.lit("clash")).withColumn("_host", F.lit("clash"))
    rng = np.random.default_rng(8)
    model = quality_bayes.Classifier(rng.normal(size=19) / 8, np.zeros(19), np.ones(19))
    rows = quality_bayes.score(docs, F.col("source"), F.col("lang"), model).collect()
    x = np.array([brute_features(r["text"] or "") for r in rows])
    p = model.probability(x)
    host_p, path_p, total = brute_posteriors([(r["source"], r["lang"], q) for r, q in zip(rows, p.tolist())])
    logit = lambda p: math.log(p / (1 - p))
    for r, q in zip(rows, p.tolist()):
        want = 1 / (1 + math.exp(-(logit(min(max(q, 1e-6), 1 - 1e-6)) + logit(path_p[r["source"], r["lang"]]) - logit(total))))
        assert math.isclose(r["doc_p"], q, rel_tol=1e-9) and math.isclose(r["quality_p"], want, rel_tol=1e-7)
        assert r["keep"] == (r["quality_p"] >= 0.5) and r["_host"] == r["p"] == "clash"
    # the same rows where texts are not kept
    slim = quality_bayes.score(docs, F.col("source"), F.col("lang"), model, ["doc_id"]).collect()
    assert sorted(map(str, slim)) == sorted(str(r) for r in quality_bayes.score(docs, F.col("source"), F.col("lang"), model).drop(
        "text", "lang", "source", "n_chars", "p", "_host").collect())


def test_repeated_ids_are_learned_once(spark):
    """Rows that share a labelled id count as one document."""
    texts = [f"word{i} goes on and on, again." for i in range(30)] + ["#$% !!! 123 " * 5] * 30
    labels = spark.createDataFrame([(i, int(i < 30), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    once = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    often = once.unionByName(once.filter("doc_id = 3").crossJoin(spark.range(500).select()))
    a, b = (quality_bayes.train(x, labels) for x in (once, often))
    assert np.allclose(a.weights, b.weights)


def test_one_label_only(spark, odd_docs):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality_bayes.train(odd_docs, labels)
    assert all(r["keep"] for r in quality_bayes.score(odd_docs, F.col("source"), F.col("lang"), model).collect())
