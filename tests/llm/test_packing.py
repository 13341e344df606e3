import collections
import random

import pytest

from moodlake.llm import packing
from tests.llm.test_ngram_join import WORD


def brute_pack(items, capacity):
    """Best fit by looking at every bin: the least residual that fits, then the lowest bin number."""
    bins, out = [], []
    for length, source, cluster in items:
        keys = {("s", source)} - {("s", None)} | {("c", cluster)} - {("c", None)}
        pieces = []
        whole, rest = divmod(length, capacity)
        for k in range(whole):
            bins.append([capacity, set(keys)])
            pieces.append((k, capacity, len(bins) - 1, 0))
        if rest:
            fit = [(capacity - used, i) for i, (used, held) in enumerate(bins) if capacity - used >= rest and not held & keys]
            if fit:
                i = min(fit)[1]
            else:
                bins.append([0, set()])
                i = len(bins) - 1
            pieces.append((whole, rest, i, bins[i][0]))
            bins[i][0] += rest
            bins[i][1] |= keys
        out.append(pieces)
    return out


def test_tightest_compatible_bin():
    rng = random.Random(6)
    for _ in range(60):
        items = sorted(((rng.randrange(0, 30), rng.choice([None, "a", "a", "b", "c"]), rng.choice([None, *range(6)]))
                        for _ in range(rng.randrange(1, 60))), key=lambda x: -x[0])
        assert packing.pack_shard(items, 12) == brute_pack(items, 12)


@pytest.mark.parametrize("shard", [4, 8192])
def test_documents(spark, odd_docs, monkeypatch, shard):
    monkeypatch.setattr(packing, "SHARD_ITEMS", shard)
    rows = packing.pack_documents(odd_docs, 100).collect()
    want, got = collections.Counter(), collections.Counter()
    for r in odd_docs.collect():
        want[r["doc_id"]] += len(WORD.findall(r["text"] or ""))
    for r in rows:
        got[r["doc_id"]] += r["n_words"]
    assert want == got
    bins = collections.defaultdict(list)
    for r in rows:
        assert (r["bin"] is None) == (r["n_words"] == 0)
        if r["n_words"]:
            bins[r["shard"], r["bin"]].append(r)
    source = {r["doc_id"]: r["source"] for r in odd_docs.filter("doc_id <> 11 and doc_id is not null").collect()}
    for own in bins.values():
        own.sort(key=lambda r: r["offset"])
        assert sum(r["n_words"] for r in own) <= 100
        assert [r["offset"] for r in own] == [sum(x["n_words"] for x in own[:i]) for i in range(len(own))]
        sources = [source[r["doc_id"]] for r in own if source.get(r["doc_id"])]
        assert len(sources) == len(set(sources))


def test_empty_table(no_docs):
    assert packing.pack_documents(no_docs).count() == 0
