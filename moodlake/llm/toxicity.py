"""Toxic spans by a linear-chain conditional random field over words.

Document labels are turned into word labels first: over the labelled training
documents, every word and word beginning gets its document counts in toxic and
clean documents; those that are significantly tied to toxic documents mark the
toxic words of the toxic documents. A two-state field (clean, toxic) with word
and word-beginning features is trained on windows around marked words and on
windows of clean documents. Every whole text is then tagged: forward-backward
marginals give the toxic spans, and their largest and summed values give the
document score through a logistic fit on the training documents.

Bounds (parameters): ``max_docs`` labelled documents and ``max_windows`` windows
train the model, chosen by a hash of their id; ``max_cues`` marking words.
Scoring reads every document whole, and never looks at labels, language,
source or id.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodlake.llm.common import as_batch, byte_chunks, labelled, materialized, prepare, text_buffer, with_text_columns

WORD = re.compile(r"\w+")
#: Weights of the field's hashed features.
BUCKETS = 1 << 18
#: Words on either side of a marked word in a training window.
REACH = 10
#: Least log-likelihood ratio and purity of a marking word or beginning.
CUE_G2, CUE_PURITY, CUE_DOCS = 20.0, 0.9, 4
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id's text has remainder 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _beginnings(word: str) -> list[str]:
    return [f"^{word[:n]}" for n in range(3, min(6, len(word) - 1) + 1)]


def _feature_ids(word: str) -> list[int]:
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in (word, *_beginnings(word))]


@dataclass
class Field:
    """Trained weights: features of the toxic state, transitions, start; and the document fit."""
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray
    document: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def emissions(self, words: list[str]) -> np.ndarray:
        """Weight of the toxic state for each word, its features summed in one pass."""
        ids: list[int] = []
        begins = []
        for w in words:
            begins.append(len(ids))
            ids += _feature_ids(w.lower())
        return np.add.reduceat(self.weights[ids].astype(np.float64), begins) if words else np.zeros(0)


def _cue_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled texts -> partial document counts of words and beginnings."""
    types = {"cue": pa.string(), "toxic": pa.int64(), "clean": pa.int64()}
    counts: tuple[Counter, Counter] = Counter(), Counter()

    def flush():
        keys = list(counts[0].keys() | counts[1].keys())
        out = as_batch({"cue": keys, "toxic": [counts[1][k] for k in keys], "clean": [counts[0][k] for k in keys]}, types)
        counts[0].clear()
        counts[1].clear()
        return out

    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
            cues: set[str] = set()
            for w in {x.lower() for x in WORD.findall(text.as_py())}:
                cues.add(w)
                cues.update(_beginnings(w))
            counts[int(toxic)].update(cues)
            if len(counts[0]) + len(counts[1]) > 400_000:
                yield flush()
    yield flush()


def _neighbours(cues: set[str]):
    """Toxic texts -> the cues in them with a hash of the words on either side."""
    types = {"cue": pa.string(), "around": pa.int64()}

    def run(batches):
        for batch in batches:
            found = set()
            for text in batch.column("text").to_pylist():
                words = ["", *(x.lower() for x in WORD.findall(text)), ""]
                for before, w, after in zip(words, words[1:], words[2:]):
                    for cue in (w, *_beginnings(w)):
                        if cue in cues:
                            found.add((cue, zlib.crc32(f"{before} {after}".encode("utf-8", "surrogatepass"))))
            yield as_batch(dict(zip(types, map(list, zip(*found)))) if found else {"cue": [], "around": []}, types)
    return run


def _marks(word: str, cues: set[str]) -> bool:
    return word in cues or any(b in cues for b in _beginnings(word))


def _windows(cues: set[str]):
    """Labelled texts -> windows of words with their marks; one of each clean text, and of a toxic
    text one around each marked word."""
    types = {"doc_id": pa.int64(), "at": pa.int32(), "words": pa.list_(pa.string()), "marks": pa.list_(pa.int8())}

    def run(batches):
        for batch in batches:
            rows = []
            for key, text, toxic in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "toxic"))):
                words = [x.lower() for x in WORD.findall(text)]
                if not words:
                    continue
                marks = [int(bool(toxic) and _marks(w, cues)) for w in words]
                centres = [i for i, y in enumerate(marks) if y] if toxic else [zlib.crc32(str(key).encode()) % len(words)]
                for c in centres:
                    lo, hi = max(0, c - REACH), c + REACH + 1
                    rows.append((key, c, words[lo:hi], marks[lo:hi]))
            if rows:
                yield as_batch(dict(zip(types, map(list, zip(*rows)))), types)
    return run


def _train_field(windows: list[tuple[list[str], list[int]]], steps: int = 60, rate: float = 0.5,
                 decay: float = 1e-4) -> Field:
    """Maximum likelihood by adaptive full-batch gradient steps; forward-backward over all windows at once."""
    n, width = len(windows), 2 * REACH + 1
    ids, token, mask, marks = [], [], np.zeros((n, width), bool), np.zeros((n, width), np.int64)
    cache: dict[str, list[int]] = {}
    for i, (words, own) in enumerate(windows):
        mask[i, :len(words)], marks[i, :len(words)] = True, own
        for t, w in enumerate(words):
            f = cache.setdefault(w, None) or cache.__setitem__(w, _feature_ids(w)) or cache[w]
            ids += f
            token += [i * width + t] * len(f)
    ids, token = np.array(ids, np.int64), np.array(token, np.int64)
    w, a, s = np.zeros(BUCKETS), np.zeros((2, 2)), np.zeros(2)
    sums = [np.full(BUCKETS, 1e-8), np.full((2, 2), 1e-8), np.full(2, 1e-8)]
    pairs = mask[:, 1:]
    seen_a = np.array([[((marks[:, :-1] == x) & (marks[:, 1:] == y) & pairs).sum() for y in (0, 1)] for x in (0, 1)])
    seen_s = np.array([(marks[:, 0] == 0).sum(), (marks[:, 0] == 1).sum()])
    for _ in range(steps):
        e = np.bincount(token, w[ids], minlength=n * width).reshape(n, width)
        p, joint = _window_marginals(e, mask, a, s)
        grads = (np.bincount(ids, ((marks - p) * mask).ravel()[token], minlength=BUCKETS) / n - decay * w,
                 (seen_a - joint) / n - decay * a,
                 (seen_s - np.array([(1 - p[:, 0]).sum(), p[:, 0].sum()])) / n - decay * s)
        for x, g, q in zip((w, a, s), grads, sums):
            q += g * g
            x += rate * g / np.sqrt(q)
    return Field(w.astype(np.float32), a, s)


def _window_marginals(e, mask, a, s):
    """Marginals of the toxic state, and expected transitions, of padded windows."""
    n, width = e.shape
    forward, backward = np.zeros((n, width, 2)), np.ones((n, width, 2))
    emit = np.exp(np.stack((np.zeros_like(e), np.clip(e, -30, 30)), axis=2))
    step = np.exp(a)
    forward[:, 0] = np.exp(s) * emit[:, 0]
    forward[:, 0] /= forward[:, 0].sum(1, keepdims=True)
    for t in range(1, width):
        new = forward[:, t - 1] @ step * emit[:, t]
        forward[:, t] = np.where(mask[:, t, None], new / new.sum(1, keepdims=True), forward[:, t - 1])
    for t in range(width - 2, -1, -1):
        new = (backward[:, t + 1] * emit[:, t + 1]) @ step.T
        backward[:, t] = np.where(mask[:, t + 1, None], new / new.sum(1, keepdims=True), 1)
    p = forward * backward
    p /= p.sum(2, keepdims=True)
    joint = forward[:, :-1, :, None] * step * (emit * backward)[:, 1:, None, :]
    joint /= joint.sum((2, 3), keepdims=True)
    return p[:, :, 1], (joint * mask[:, 1:, None, None]).sum((0, 1))


def chain_marginals(e: np.ndarray, first: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> np.ndarray:
    """P(toxic) of every word of many texts laid end to end; ``first`` marks each text's first word.

    Exact forward-backward as a scan over blocks: each word is a 2x2 matrix (a text's first word
    resets the chain), block products give the messages at the blocks' bounds, and all blocks then
    run side by side."""
    n = len(e)
    if not n:
        return np.zeros(0)
    width = max(1, int(n ** 0.5))
    blocks = -(-n // width)
    weight = np.exp(np.clip(e, -30, 30))
    step, begin = np.exp(transitions), np.exp(start)

    def laid_out(value: np.ndarray, pad: float) -> np.ndarray:
        out = np.full(blocks * width, pad)
        out[:n] = value
        return np.ascontiguousarray(out.reshape(blocks, width).T)      # one row per step of all blocks

    # entries of each word's matrix (from state, to state); the padding is the identity
    m00 = laid_out(np.where(first, begin[0], step[0, 0]), 1.0)
    m10 = laid_out(np.where(first, begin[0], step[1, 0]), 0.0)
    m01 = laid_out(np.where(first, begin[1], step[0, 1]) * weight, 0.0)
    m11 = laid_out(np.where(first, begin[1], step[1, 1]) * weight, 1.0)

    p00, p01, p10, p11 = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
    for t in range(width):
        p00, p01 = p00 * m00[t] + p01 * m10[t], p00 * m01[t] + p01 * m11[t]
        p10, p11 = p10 * m00[t] + p11 * m10[t], p10 * m01[t] + p11 * m11[t]
        scale = 1 / (p00 + p01 + p10 + p11)
        p00, p01, p10, p11 = p00 * scale, p01 * scale, p10 * scale, p11 * scale
    ahead, behind = np.empty((2, blocks)), np.empty((2, blocks))
    x, y = 0.5, 0.5
    for b in range(blocks):
        ahead[:, b] = x, y
        x, y = x * p00[b] + y * p10[b], x * p01[b] + y * p11[b]
        x, y = x / (x + y), y / (x + y)
    x, y = 0.5, 0.5
    for b in range(blocks - 1, -1, -1):
        behind[:, b] = x, y
        x, y = p00[b] * x + p01[b] * y, p10[b] * x + p11[b] * y
        x, y = x / (x + y), y / (x + y)
    forward = np.empty((width, 2, blocks))
    x, y = ahead
    for t in range(width):
        x, y = x * m00[t] + y * m10[t], x * m01[t] + y * m11[t]
        scale = 1 / (x + y)
        x, y = x * scale, y * scale
        forward[t, 0], forward[t, 1] = x, y
    out = np.empty((width, blocks))
    x, y = behind
    for t in range(width - 1, -1, -1):
        toxic = forward[t, 1] * y
        out[t] = toxic / (forward[t, 0] * x + toxic)
        x, y = m00[t] * x + m01[t] * y, m10[t] * x + m11[t] * y
        scale = 1 / (x + y)
        x, y = x * scale, y * scale
    return out.T.ravel()[:n]


def _document_features(top: np.ndarray, total: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Largest marginal, expected number of toxic words, and their share of the text."""
    top = np.clip(top, 1e-6, 1 - 1e-6)
    return np.stack((np.ones_like(top), np.log(top / (1 - top)), np.log1p(total),
                     np.log((total + 0.1) / (words + 10.0))), axis=1)


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def _tag(model, spans: bool):
    """Texts -> top and summed marginal, score, and spans as code point offsets with their marginals."""
    types = {"row": pa.int64(), "top": pa.float64(), "total": pa.float64(), "words": pa.int64(), "score": pa.float64(),
             "spans": pa.list_(pa.struct({"start": pa.int32(), "stop": pa.int32(), "p": pa.float64()}))}

    def tag(column: pa.Array) -> Iterator[pa.RecordBatch]:
        crf: Field = model.value
        cache: dict[str, float] = {}
        _, ends = text_buffer(column)
        for lo, hi in byte_chunks(ends):
            texts = column.slice(lo, hi - lo).to_pylist()
            words = [WORD.findall(t) for t in texts]
            counts = np.array([len(w) for w in words], np.int64)
            if len(cache) > 300_000:
                cache.clear()
            new = [w for w in set().union(*words) if w not in cache]
            cache.update(zip(new, crf.emissions(new).tolist()))
            e = np.fromiter((cache[w] for own in words for w in own), np.float64, int(counts.sum()))
            begins = np.cumsum(counts) - counts
            some = counts > 0
            first = np.zeros(len(e), bool)
            first[begins[some]] = True
            p = chain_marginals(e, first, crf.transitions, crf.start)
            top, total = np.zeros(len(texts)), np.zeros(len(texts))
            if len(e):
                top[some] = np.maximum.reduceat(p, begins[some])
                total[some] = np.add.reduceat(p, begins[some])
            score = 1 / (1 + np.exp(-np.clip(_document_features(top, total, counts) @ crf.document, -30, 30)))
            found = [None if not spans else _spans(t, p[b:b + c]) if c and x >= 0.5 else []
                     for t, b, c, x in zip(texts, begins, counts, top)]
            yield as_batch({"row": np.arange(lo, hi), "top": top, "total": total, "words": counts, "score": score, "spans": found}, types)
    return tag


def _spans(text: str, p: np.ndarray) -> list[dict]:
    out: list[dict] = []
    last = -2
    for i, w in enumerate(WORD.finditer(text)):
        if p[i] >= 0.5:
            if i == last + 1 and out:
                out[-1] |= {"stop": w.end(), "p": max(out[-1]["p"], float(p[i]))}
            else:
                out.append({"start": w.start(), "stop": w.end(), "p": float(p[i])})
            last = i
    return out


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 20_000, max_windows: int = 20_000,
          max_cues: int = 5_000) -> Field:
    """Learns from labelled documents that are not held out. Without toxic and clean ones among
    them, the field scores every text with the share of toxic labels (0 without labels)."""
    prepare(docs.sparkSession)
    # read again and again: stored once
    known = materialized(labelled(docs, labels.filter(~held_out(F.col("doc_id"))), "toxic", max_docs), "labelled")
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        share = min(max(toxic / max(toxic + clean, 1), 1e-6), 1 - 1e-6)
        return Field(np.zeros(BUCKETS, np.float32), np.zeros((2, 2)), np.array([0.0, -30.0]),
                     np.array([math.log(share / (1 - share)), 0.0, 0.0, 0.0]))
    n = toxic + clean

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    counted = (known.mapInArrow(_cue_counts, "cue string, toxic long, clean long").groupBy("cue")
               .agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).filter(f"t >= {CUE_DOCS}"))
    t, c = F.col("t"), F.col("c")
    g2 = 2 * (part(t, (t + c) * toxic / n) + part(c, (t + c) * clean / n)
              + part(toxic - t, (n - t - c) * toxic / n) + part(clean - c, (n - t - c) * clean / n))
    purity = t / toxic / (t / toxic + c / clean)
    likely = [r["cue"] for r in counted.withColumn("g2", g2).filter((F.col("g2") >= CUE_G2) & (purity >= CUE_PURITY))
              .orderBy(F.desc("g2"), "cue").limit(10 * max_cues).select("cue").collect()]
    # copies of one toxic text share their neighbours: a cue counts as often as its neighbours differ
    varied = (known.filter("toxic = 1").mapInArrow(_neighbours(set(likely)), "cue string, around long")
              .groupBy("cue").agg(F.countDistinct("around").alias("varied")))
    cues = {r["cue"] for r in counted.join(F.broadcast(varied), "cue").withColumn("t", F.least("t", "varied"))
            .withColumn("g2", g2).filter((F.col("g2") >= CUE_G2) & (purity >= CUE_PURITY))
            .orderBy(F.desc("g2"), "cue").limit(max_cues).select("cue").collect()}
    windows = [(list(r["words"]), list(r["marks"])) for r in
               known.mapInArrow(_windows(cues), "doc_id long, at int, words array<string>, marks array<byte>")
               .orderBy(F.xxhash64("doc_id", "at"), "doc_id", "at").limit(max_windows).collect()]
    crf = _train_field(windows) if windows else Field(np.zeros(BUCKETS, np.float32), np.zeros((2, 2)), np.zeros(2))
    model = docs.sparkSession.sparkContext.broadcast(crf)

    def evidence(batches):
        for batch in batches:
            for out in _tag(model, False)(batch.column("text")):
                y = batch.column("toxic").take(out.column("row"))
                yield as_batch({k: out.column(k) for k in ("top", "total", "words")} | {"y": y.cast(pa.int32())},
                               {"top": pa.float64(), "total": pa.float64(), "words": pa.int64(), "y": pa.int32()})

    seen = known.mapInArrow(evidence, "top double, total double, words long, y int").toPandas()   # at most max_docs labels' rows
    crf.document = _fit_logistic(_document_features(*(seen[c].to_numpy() for c in ("top", "total", "words"))),
                                 seen["y"].to_numpy())
    model.unpersist()
    return crf


def score(docs: DataFrame, crf: Field, spans: bool = True, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with score (0 to 1), predicted (1 from 0.3) and the toxic spans
    (start, stop in code points, largest marginal; null unless ``spans``).

    A null text counts as empty and, like a text without words, gets the score of no evidence.
    All rows and the columns ``keep`` (default all) stay; columns of those names are replaced."""
    prepare(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(crf)
    tag = _tag(model, spans)

    def kernel(texts: pa.Array) -> Iterator[pa.RecordBatch]:
        for out in tag(texts):
            s = out.column("score").to_numpy()
            yield as_batch({"score": s, "predicted": (s >= THRESHOLD).astype(np.int32), "spans": out.column("spans")},
                           {"score": pa.float64(), "predicted": pa.int32(), "spans": out.column("spans").type})

    return with_text_columns(
        docs, kernel, "score double; predicted int; spans array<struct<start:int,stop:int,p:double>>", keep)
