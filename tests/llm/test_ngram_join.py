import collections
import random
import re

import pytest

from moodlake.llm import ngram_join
from moodlake.llm.components import components
from tests.llm.conftest import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text, size=5):
    w = WORD.findall(text or "")
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows):
    """(class, links, class size) per row of (doc_id, text)."""
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 10 * both >= 8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    members = collections.defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(i)
    out = [None] * len(rows)
    for own in members.values():
        ids = [rows[i][0] for i in own if rows[i][0] is not None]
        for i in own:
            out[i] = (min(ids) if ids else None, links[i], len(own))
    return out


def check(docs):
    rows = ngram_join.near_duplicates(docs).collect()
    want = brute([(r["doc_id"], r["text"]) for r in rows])
    assert len(rows) == docs.count()
    for r, w in zip(rows, want):
        assert (r["class_id"], r["n_links"], r["class_size"]) == w, r["doc_id"]


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.9999), (0.8, 0.99), (0.5, 0.9)):
        bands, rows = ngram_join.choose_bands(threshold, recall)
        assert 1 - (1 - threshold ** rows) ** bands >= recall and bands * rows <= ngram_join.MOST_HASHES


def test_odd_rows(odd_docs):
    check(odd_docs)


@pytest.mark.parametrize("block", [3, 1024])
def test_families_of_near_copies(spark, monkeypatch, block):
    """With blocks of three, buckets and groups are compared in pairs of blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(7)
    rows = []
    for family in range(6):
        base = words(rng, rng.randrange(5, 160)).split()
        for _ in range(rng.randrange(1, 12)):
            own = list(base)
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(len(own))] = "new"
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + i, words(rng, 50)) for i in range(20)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))


def test_sf001(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"))


def test_empty_table(no_docs):
    assert ngram_join.near_duplicates(no_docs).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 130)] + [(200, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 130)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_long_pair_at_exactly_the_threshold(spark):
    """1,152 shared runs of 1,440: a product in float32 falls short of the threshold."""
    rng = random.Random(13)
    same, one, other = words(rng, 1156), words(rng, 144), words(rng, 144)
    texts = [same + " " + one, same + " " + other]
    a, b = map(grams, texts)
    assert (len(a & b), len(a | b)) == (1152, 1440)
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
