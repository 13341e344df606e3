"""Quality by hierarchical empirical Bayes: evidence of the text, of its host and of its path.

A logistic classifier over shape statistics of the whole text (fitted on at most
``max_docs`` labelled rows) gives each document a probability of good quality.
Grouped aggregation sums these per host and per path below it; a host's posterior
mean shrinks towards the global mean, a path's towards its host's, by prior
strengths that are fitted to the spread between sites (method of moments). A
document's final log-odds are its own plus the path's shift from the global mean.

The text decides unless its site is well known: shifts are limited by shrinkage,
and a sparse site moves nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodlake.llm.common import (as_batch, byte_chunks, labelled, materialized, prepare, text_buffer, with_text_columns)
from moodlake.llm.words import SPACE, per_text, words_of

#: Sites that are sent to every task; more are joined by shuffling.
BROADCAST_SITES = 100_000
THRESHOLD = 0.5
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>~^=_{}[]\\@"))
_MARKS = np.isin(np.arange(256), list(b"!?"))
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)])


def features(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Shape statistics of each text of a buffer: shares of symbols, exclamation, capitals, digits and
    letters, of words that follow themselves, that are new to the text and that hold no letter, of
    repeated lines, and the logarithms of length and of mean word length."""
    begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
    size = ends - begins
    w = words_of(data, ends)
    n = np.maximum(w.counts, 1)
    again = np.zeros(len(w.hashes), bool)
    again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (w.text[1:] == w.text[:-1])
    order = np.lexsort((w.hashes, w.text))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (w.hashes[order][1:] != w.hashes[order][:-1]) | (w.text[order][1:] != w.text[order][:-1])
    letters = np.concatenate(([0], np.cumsum(_LETTER[data], dtype=np.int64)))
    bare = letters[w.stops] == letters[w.starts]
    solid = np.maximum(size - per_text(SPACE[data], ends), 1)

    def by_text(flags: np.ndarray, text: np.ndarray = w.text) -> np.ndarray:
        return np.bincount(text[flags], minlength=len(ends))

    lines, repeated = _lines(data, ends)
    rate = [per_text(_SYMBOLS[data], ends) / solid, per_text(_MARKS[data], ends) / solid,
            per_text(_UPPER[data], ends) / solid, per_text(_DIGIT[data], ends) / solid, by_text(again) / n,
            by_text(bare) / n, repeated / np.maximum(lines, 1)]
    logged = [np.log(r + 0.003) for r in rate]
    return np.stack([np.ones(len(ends)), *logged, *rate, by_text(fresh, w.text[order]) / n,
                     np.log1p(w.counts), np.log1p(solid / n), per_text(_LETTER[data], ends) / solid], axis=1)


def _lines(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those equal to an earlier one, per text."""
    lines, repeated = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
    raw, begin = data.tobytes(), 0
    for i, end in enumerate(ends.tolist()):
        own = [x for x in raw[begin:end].split(b"\n") if not x.isspace() and x]
        lines[i], repeated[i] = len(own), len(own) - len(set(own))
        begin = end
    return lines, repeated


@dataclass
class Classifier:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((x - self.mean) / self.scale @ self.weights, -12, 12)))


def _features_kernel(model, with_features: bool):
    types = {"p": pa.float64()} if not with_features else {"x": pa.list_(pa.float64())}

    def kernel(texts: pa.Array) -> Iterator[pa.RecordBatch]:
        data, ends = text_buffer(texts)
        for lo, hi in byte_chunks(ends):
            begin = ends[lo - 1] if lo else 0
            x = features(data[begin:ends[hi - 1]], ends[lo:hi] - begin)
            yield as_batch({"x": x.tolist()} if with_features else {"p": model.value.probability(x)}, types)
    return kernel


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 20_000, ridge: float = 1.0) -> Classifier:
    """Fits the classifier on labelled rows (quality 0 or 1), chosen by a hash of their id. Without
    rows of both labels every text gets the share of good ones (0.5 without labels)."""
    prepare(docs.sparkSession)
    known = labelled(docs, labels, "quality", max_docs)
    seen = with_text_columns(known, _features_kernel(None, True), "x array<double>", ["quality"]).toPandas()
    y = seen["quality"].to_numpy(np.float64)
    width = features(np.zeros(0, np.uint8), np.zeros(1, np.int64)).shape[1]
    x = np.array(seen["x"].tolist(), np.float64).reshape(len(y), width)
    mean, scale = np.zeros(width), np.ones(width)
    w = np.zeros(width)
    if len(y) and 0 < y.mean() < 1:
        mean[1:], scale[1:] = x[:, 1:].mean(0), np.maximum(x[:, 1:].std(0), 1e-6)
        z = (x - mean) / scale
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -12, 12)))
            penalty = ridge * np.r_[1e-6, np.ones(width - 1)]
            w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
    elif len(y):
        w[0] = 12.0 if y.mean() else -12.0
    return Classifier(w, mean, scale)


def site_posteriors(scored: DataFrame) -> DataFrame:
    """host, path, host_p, path_p, shift from rows with host, path and p: posterior means and the
    path's log-odds against the global mean. Sums are combined before the shuffle."""
    paths = materialized(scored.groupBy("host", "path").agg(F.count("p").alias("n"), F.sum("p").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    total = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s")).first()
    mean = min(max((total["s"] or 0.0) / max(total["n"] or 0, 1), 1e-4), 1 - 1e-4)
    strength = _strength(hosts, F.col("hn"), F.col("hs"), F.lit(mean))
    hosts = hosts.withColumn("host_p", (F.col("hs") + F.lit(strength * mean)) / (F.col("hn") + F.lit(strength)))
    joined = paths.join(hosts.select("host", "host_p"), paths["host"].eqNullSafe(hosts["host"])).drop(hosts["host"])
    below = _strength(joined, F.col("n"), F.col("s"), F.col("host_p"))
    path_p = (F.col("s") + F.lit(below) * F.col("host_p")) / (F.col("n") + F.lit(below))
    return joined.select("host", "path", "host_p", path_p.alias("path_p"),
                         (_logit(path_p) - F.lit(float(np.log(mean / (1 - mean))))).alias("shift"))


def _logit(p: Column) -> Column:
    bounded = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(bounded / (1 - bounded))


def _strength(sites: DataFrame, n: Column, s: Column, prior: Column) -> float:
    """Prior strength by the method of moments: how much less the sites' rates vary around their
    prior than single documents would. Between 1 and 10,000 pseudo-documents."""
    r = sites.filter(n > 0).agg(F.sum(n * (s / n - prior) ** 2).alias("spread"), F.count(F.lit(1)).alias("k"),
                                F.sum(n).alias("n"), F.sum(n * n).alias("nn"),
                                F.sum(n * prior * (1 - prior)).alias("v")).first()
    if not r["k"] or r["k"] < 2:
        return 100.0
    v = r["v"] / r["n"]
    between = (r["spread"] - r["k"] * v) / max(r["n"] - r["nn"] / r["n"], 1e-9)
    return float(min(max(v / between - 1, 1.0), 10_000.0)) if between > 0 else 10_000.0


def score(docs: DataFrame, host: Column, path: Column, model: Classifier,
          keep: list[str] | None = None) -> DataFrame:
    """``docs`` with doc_p (the text alone), host_p, path_p, quality_p (all together) and keep (boolean:
    quality_p of 0.5 or more). A null text counts as empty; null hosts and paths are sites of their own.
    All rows and the columns ``keep`` (default all) stay; columns of the new names are replaced."""
    spark = docs.sparkSession
    prepare(spark)
    kernel = _features_kernel(spark.sparkContext.broadcast(model), False)
    new = ["doc_p", "host_p", "path_p", "quality_p", "keep"]
    kept = [c for c in (keep or docs.columns) if c not in new]
    rows = docs.select(F.struct(F.lit(True).alias("_"), *[c for c in kept if c != "text"]).alias("row"), "text",
                       host.alias("host"), path.alias("path"))
    if "text" in kept:                                  # texts are measured twice rather than stored again
        scored, rows = (with_text_columns(rows, kernel, "p double", x) for x in (["host", "path"], rows.columns))
    else:
        scored = rows = materialized(with_text_columns(rows, kernel, "p double", ["row", "host", "path"]), "quality")
    sites = materialized(site_posteriors(scored.select("host", "path", "p")), "sites")
    sites = sites.select(F.col("host").alias("h"), F.col("path").alias("q"), "host_p", "path_p", "shift")
    if sites.count() <= BROADCAST_SITES:
        sites = F.broadcast(sites)                      # at most BROADCAST_SITES rows
    judged = rows.join(sites, rows["host"].eqNullSafe(sites["h"]) & rows["path"].eqNullSafe(sites["q"]), "left")
    odds = _logit(F.col("p")) + F.coalesce("shift", F.lit(0.0))
    quality = 1 / (1 + F.exp(-odds))
    return judged.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in kept], F.col("p").alias("doc_p"), "host_p", "path_p", quality.alias("quality_p"),
                         (quality >= THRESHOLD).alias("keep"))
