import collections
import hashlib
import random
import re

import pytest

from moodlake.llm import window_sketch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, size):
    own = [WORD.findall(t or "") for t in texts]
    seen = collections.Counter(tuple(w[i:i + size]) for w in own for i in range(len(w) - size + 1))
    out = []
    for w in own:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i:i + size])] > 1:
                gone[i:i + size] = [True] * size
        out.append((len(w), sum(gone), " ".join(x for x, y in zip(w, gone) if not y)))
    return out


def check(docs, size):
    rows = window_sketch.remove_windows(docs, size).collect()
    assert len(rows) == docs.count()
    for r, (n, removed, kept) in zip(rows, brute([r["text"] for r in rows], size)):
        assert (r["n_words"], r["n_removed"], r["kept"]) == (n, removed, kept)
        assert r["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
    return rows


def test_odd_rows(odd_docs):
    rows = check(odd_docs, 35)
    assert sum(r["n_removed"] > 0 for r in rows) > 5 and set(odd_docs.columns) <= set(rows[0].asDict())


@pytest.mark.parametrize(("chunk", "shard_bits", "size"), [(300, 4, 3), (16 << 20, 24, 5), (2000, 6, 8)])
def test_random_texts(spark, monkeypatch, chunk, shard_bits, size):
    """Many chunks, many shards, and counters that most windows share."""
    monkeypatch.setattr(window_sketch, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(window_sketch, "SHARD_BITS", shard_bits)
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(12)]

    def text():
        out = [rng.choice(["a", "b", "é", "c,"]) + str(rng.randrange(4)) for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.5:
            out[rng.randrange(len(out) + 1):0] = passage
        return rng.choice([" ", "\n", " \t "]).join(out)

    texts = [text() for _ in range(120)]
    texts += [texts[0]] * 40 + ["same " * 50, "same " * 9, None, "", " \n"]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), size)


def test_overestimates_lose_nothing(spark, monkeypatch):
    """A sketch of far too few counters only sends more windows to the second pass."""
    plan = window_sketch._Plan.__init__

    def small(self, size, windows):
        plan(self, size, 1)
    monkeypatch.setattr(window_sketch._Plan, "__init__", small)
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 80))) for _ in range(80)]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), 4)


def test_one_very_long_text(spark):
    rng = random.Random(9)
    part = " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(60))
    long = " ".join(f"x{rng.randrange(10 ** 7)}" for _ in range(300_000))
    docs = spark.createDataFrame([(1, long[:len(long) // 2] + " " + part + " " + long[len(long) // 2:]), (2, part), (3, long[:1000])], "doc_id long, text string")
    check(docs, 35)


def test_empty_table(no_docs):
    out = window_sketch.remove_windows(no_docs)
    assert out.count() == 0 and {"n_words", "n_removed", "kept", "kept_sha256", "c1"} <= set(out.columns)


def test_texts_are_not_shuffled(odd_docs):
    plan = window_sketch.remove_windows(odd_docs, keep=["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1           # of the replies


def test_sf001_equals_brute_force(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), 35)
