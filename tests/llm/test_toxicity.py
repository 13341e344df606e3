import itertools
import random

import numpy as np
import zlib

from moodlake.llm import toxicity
from tests.llm.conftest import words


def test_chain_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    transitions, start = rng.normal(size=(2, 2)), rng.normal(size=2)
    sizes = [1, 5, 3, 7]
    e = rng.normal(size=sum(sizes)) * 3
    first = np.zeros(len(e), bool)
    first[np.cumsum([0, *sizes[:-1]])] = True
    got, at = toxicity.chain_marginals(e, first, transitions, start), 0
    for n in sizes:
        own, total, toxic = e[at:at + n], 0.0, np.zeros(n)
        for path in itertools.product((0, 1), repeat=n):
            w = np.exp(start[path[0]] + sum(transitions[a, b] for a, b in zip(path, path[1:])) + sum(x for x, y in zip(own, path) if y))
            total += w
            toxic += w * np.array(path)
        assert np.allclose(got[at:at + n], toxic / total)
        at += n


def labelled(spark, n=400):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        w = words(rng, rng.randrange(20, 80)).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["vilething", "Nastyones", "nastyfolk", "vilely"]))
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learns_words_and_beginnings_and_tells_spans(spark):
    docs, labels = labelled(spark)
    crf = toxicity.train(docs, labels)
    rows = toxicity.score(docs, crf).collect()
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in rows) >= 0.97 * len(rows)
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        for s in r["spans"]:
            assert r["text"][s["start"]:s["stop"]].lower().startswith(("vile", "nasty"))


def test_held_out_rows_teach_nothing(spark):
    """Turning the held-out labels around changes no weight."""
    docs, labels = labelled(spark, 200)
    held = {i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2}
    turned = spark.createDataFrame([(r["doc_id"], 1, 1 - r["toxic"] if r["doc_id"] in held else r["toxic"]) for r in labels.collect()],
                                   labels.schema)
    a, b = toxicity.train(docs, labels), toxicity.train(docs, turned)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.document, b.document)
    assert {r["doc_id"] for r in docs.filter(toxicity.held_out(docs["doc_id"])).collect()} == held


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    crf = toxicity.train(docs, labels)
    rows = toxicity.score(docs.join(labels, "doc_id").filter(toxicity.held_out(docs["doc_id"])), crf, spans=False).collect()
    caught = sum(r["predicted"] and r["toxic"] for r in rows)
    assert caught / sum(r["toxic"] for r in rows) >= 0.85 and caught / sum(r["predicted"] for r in rows) >= 0.85


def test_odd_rows_and_no_labels(spark, odd_docs, no_docs, no_labels):
    docs, labels = labelled(spark, 120)
    crf = toxicity.train(docs, labels)
    rows = toxicity.score(odd_docs, crf).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if not (r["text"] or "").strip()}) == 1
    assert "kept" in toxicity.score(odd_docs, crf).columns
    blank = toxicity.train(odd_docs, no_labels)
    assert {r["predicted"] for r in toxicity.score(odd_docs, blank).collect()} == {0}
    assert toxicity.score(no_docs, blank).count() == 0
    only = toxicity.train(docs, labels.filter("toxic = 0"))
    assert {r["predicted"] for r in toxicity.score(docs, only).collect()} == {0}
