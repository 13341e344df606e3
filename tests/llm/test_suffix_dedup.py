import collections
import hashlib
import random

import numpy as np
import pytest

from moodlake.llm import suffix_dedup
from moodlake.llm.column_bwt import column_bwt, repeated_starts


def brute(texts, length):
    """Per text: bytes, removed, spans, kept bytes."""
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i:i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, bytes(x for x, y in zip(b, gone) if not y)))
    return out


def test_construction_equals_sorted_suffixes():
    rng = random.Random(1)
    for _ in range(60):
        strings = [bytes(rng.randrange(97, 100) for _ in range(rng.randrange(0, 14))) for _ in range(rng.randrange(1, 7))]
        buffer = np.frombuffer(b"".join(strings), np.uint8)
        lengths = np.array([len(s) for s in strings])
        bwt, lcp, tails = column_bwt(buffer, np.cumsum(lengths) - lengths, lengths)
        # end markers sort before all symbols, in the order of the strings
        suffixes = sorted([[*s[i:], -1], q, s[i - 1] if i else 0] for q, s in enumerate(strings) for i in range(len(s) + 1))
        suffixes.sort(key=lambda x: [(c, 0) if c >= 0 else (-1, x[1]) for c in x[0]])
        used = {c: k + 1 for k, c in enumerate(sorted(set(b"".join(strings))))}
        assert bwt.tolist() == [used.get(x[2], 0) for x in suffixes]
        for i in range(1, len(suffixes)):
            a, b = suffixes[i - 1][0][:-1], suffixes[i][0][:-1]
            same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[i] == same


def test_repeated_starts_equals_counting():
    rng = random.Random(2)
    for _ in range(80):
        length = rng.choice([2, 3, 5])
        strings = [bytes(rng.randrange(3) for _ in range(rng.randrange(0, 30))) for _ in range(rng.randrange(1, 10))]
        lengths = np.array([len(s) for s in strings])
        flags = repeated_starts(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(lengths) - lengths, lengths, length)
        seen = collections.Counter(s[i:i + length] for s in strings for i in range(len(s) - length + 1))
        assert flags.tolist() == [i + length <= len(s) and seen[s[i:i + length]] > 1 for s in strings for i in range(len(s))]


def check(spark, docs, length, k):
    rows = suffix_dedup.remove_repeats(docs, length, k).collect()
    want = brute([r["text"] for r in rows], length)
    assert len(rows) == docs.count()
    for r, (n, removed, spans, kept) in zip(rows, want):
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == (n, removed, spans, kept)
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_odd_rows(spark, odd_docs):
    check(spark, odd_docs, 200, 64)


@pytest.mark.parametrize("hot", [1, 4096])
def test_random_texts_with_hot_anchors(spark, monkeypatch, hot):
    """Two letters make repeats everywhere; with HOT_STRINGS of 1, every group is split by ranges and windows."""
    monkeypatch.setattr(suffix_dedup, "HOT_STRINGS", hot)
    rng = random.Random(3)
    passage = "".join(rng.choice("ab") for _ in range(60))
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 60))) + (passage if rng.random() < 0.7 else "")
             + "".join(rng.choice("ab") for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    texts += ["ab" * 40, "a" * 90, texts[0], texts[0]]
    check(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 24, 8)


def test_anchors_of_a_text_of_any_length():
    """70 MB go in pieces: every window lies in one run, and equal windows have equal anchors, at piece edges too."""
    rng = np.random.default_rng(5)
    size, piece = 70_000_000, suffix_dedup.PIECE_BYTES
    data = rng.integers(97, 123, size).astype(np.uint8)
    passage = rng.integers(97, 123, 1500).astype(np.uint8)
    places = (1000, piece - 700, 3 * piece - 100)
    for at in places:
        data[at:at + 1500] = passage
    _, h, start, n = suffix_dedup._anchors(data, np.array([size]), 200, 64)
    order = np.argsort(start)
    h, start, n = h[order], start[order], n[order]
    assert start[0] == 0 and (start[:-1] + n[:-1] == start[1:]).all() and start[-1] + n[-1] == size - 199
    own = [h[np.searchsorted(start, np.arange(at, at + 1301), side="right") - 1].tolist() for at in places]
    assert own[0] == own[1] == own[2]


@pytest.mark.parametrize("piece", [64, 300])
def test_pieces_equal_whole_texts(spark, monkeypatch, piece):
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", piece)
    rng = random.Random(6)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 900))) for _ in range(12)]
    texts += [texts[0][:400] + texts[1], texts[2] * 2]
    check(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 24, 8)


def test_empty_table(no_docs):
    out = suffix_dedup.remove_repeats(no_docs)
    assert out.count() == 0 and {"n_removed", "kept", "kept_sha256", "c1"} <= set(out.columns)


def test_sf001_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(spark, docs, 200, 64)
