"""Quality rules: text statistics and a decision list learned from labelled ones.

Sequential covering in the manner of grow-and-prune rule learners: a rule is a conjunction of thresholds, grown
on two thirds of the remaining rows by information gain, pruned from its end on the other third, kept while it is
precise there; covered rows leave and the next rule starts. The list becomes one ordered Spark expression.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodlake.llm.common import as_batch, byte_chunks, labelled, prepare, text_buffer, with_text_columns
from moodlake.llm.words import SPACE, mix, per_text, words_of

# FIXED VALUES of the base rule
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_MARKS = np.isin(np.arange(256), list(b"!?"))
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)])
_LEADS = (np.arange(256) & 0xC0) != 0x80            # first bytes of code points

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_upper", "n_bare_words",
         "n_echo_words", "n_lines"]
_TYPES = {k: pa.int64() for k in STATS}


def text_statistics(data: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of each text of a buffer. Words are runs of bytes other than ASCII spaces.

    n_words; word_chars: code points in words; n_symbols: characters of ``#*$%&|<>``; n_dup_lines: lines with a word
    equal to an earlier line; n_repeat_words: words in three-word windows found twice or more (compared by 64-bit
    hashes), the first included; n_marks: ``!`` and ``?``; n_upper: ASCII capitals; n_bare_words: words without a
    letter; n_echo_words: words equal to the one before; n_lines: lines with a word."""
    w = words_of(data, ends)
    n = len(w.hashes)
    repeat = np.zeros(n, bool)
    if n >= 3:
        whole = np.flatnonzero(w.text[:-2] == w.text[2:])
        triple = mix(mix(mix(w.hashes[whole]) + w.hashes[whole + 1]) + w.hashes[whole + 2])
        order = np.lexsort((triple, w.text[whole]))
        a, t = triple[order], w.text[whole][order]
        equal = (a[1:] == a[:-1]) & (t[1:] == t[:-1])
        twice = np.zeros(len(order), bool)
        twice[1:] |= equal
        twice[:-1] |= equal
        hit = whole[order[twice]]
        for k in range(3):
            repeat[hit + k] = True
    echo = np.zeros(n, bool)
    echo[1:] = (w.hashes[1:] == w.hashes[:-1]) & (w.text[1:] == w.text[:-1])
    letters = np.concatenate(([0], np.cumsum(_LETTER[data], dtype=np.int64)))
    bare = letters[w.stops] == letters[w.starts]
    lines, again = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
    raw, begin = data.tobytes(), 0
    for i, end in enumerate(ends.tolist()):
        own = [x for x in raw[begin:end].split(b"\n") if x.strip(b" \t\n\v\f\r")]
        lines[i], again[i] = len(own), len(own) - len(set(own))
        begin = end

    def by_text(flags: np.ndarray) -> np.ndarray:
        return np.bincount(w.text[flags], minlength=len(ends)).astype(np.int64)

    return {"n_words": w.counts, "word_chars": per_text(_LEADS[data] & ~SPACE[data], ends),
            "n_symbols": per_text(_SYMBOLS[data], ends), "n_dup_lines": again, "n_repeat_words": by_text(repeat),
            "n_marks": per_text(_MARKS[data], ends), "n_upper": per_text(_UPPER[data], ends), "n_bare_words": by_text(bare),
            "n_echo_words": by_text(echo), "n_lines": lines}


def _statistics_kernel(texts: pa.Array) -> Iterator[pa.RecordBatch]:
    data, ends = text_buffer(texts)
    for lo, hi in byte_chunks(ends):
        begin = ends[lo - 1] if lo else 0
        yield as_batch(text_statistics(data[begin:ends[hi - 1]], ends[lo:hi] - begin), _TYPES)


def with_statistics(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the statistics of the whole texts (null: none); columns of those names are replaced."""
    prepare(docs.sparkSession)
    return with_text_columns(docs, _statistics_kernel, "; ".join(f"{k} long" for k in STATS), keep)


def measures() -> dict[str, Column]:
    """What the rules compare: shares and means of the statistics, as Spark expressions."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {"symbols_per_char": F.col("n_symbols") / chars, "marks_per_char": F.col("n_marks") / chars,
            "upper_per_char": F.col("n_upper") / chars, "bare_per_word": F.col("n_bare_words") / words,
            "echo_per_word": F.col("n_echo_words") / words, "repeat_per_word": F.col("n_repeat_words") / words,
            "dup_per_line": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
            "words": F.col("n_words").cast("double")}


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x >= self.threshold if self.above else x <= self.threshold

    def expression(self) -> Column:
        m = measures()[self.measure]
        return m >= F.lit(self.threshold) if self.above else m <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.measure} {'>=' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x[c.measure])
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, cuts: dict[str, np.ndarray], most: int) -> Rule:
    """Adds the threshold of the largest information gain until no good row is covered."""
    rule: Rule = ()
    covered = np.ones(len(bad), bool)
    while len(rule) < most and (~bad & covered).any():
        p, n = int((bad & covered).sum()), int((~bad & covered).sum())
        if not p:
            break
        best, gain = None, 1e-9
        for name, values in cuts.items():
            v = x[name]
            for above in (True, False):
                order = np.searchsorted(values, v, side="right" if above else "left")
                pos = np.bincount(order[bad & covered], minlength=len(values) + 1)
                neg = np.bincount(order[~bad & covered], minlength=len(values) + 1)
                if above:                           # rows with v >= values[i]
                    pos, neg = pos[::-1].cumsum()[::-1][1:], neg[::-1].cumsum()[::-1][1:]
                else:                               # rows with v <= values[i]
                    pos, neg = pos.cumsum()[:-1], neg.cumsum()[:-1]
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(pos > 0, pos * (np.log2(pos / (pos + neg)) - math.log2(p / (p + n))), 0)
                i = int(g.argmax())
                if g[i] > gain:
                    best, gain = Condition(name, above, float(values[i])), float(g[i])
        if best is None:
            break
        rule += (best,)
        covered &= best.holds(x[best.measure])
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Drops conditions from the end while that does not lower (p - n) / (p + n) on the pruning rows."""
    def worth(r: Rule) -> float:
        c = _covers(r, x, len(bad))
        p, n = int((bad & c).sum()), int((~bad & c).sum())
        return (p - n) / (p + n) if p + n else -1.0

    for k in range(1, len(rule)):
        if worth(rule[:k]) >= worth(rule):
            return rule[:k]
    return rule


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.98, most_rules: int = 16,
                most_conditions: int = 4, cuts: int = 64) -> list[Rule]:
    """An ordered list of rules that mark bad rows. Candidate thresholds: ``cuts`` quantiles of each measure
    over the bad and over all rows."""
    part = (np.arange(len(bad)) % 3) == 2             # rows come in hash order
    grid = {k: np.unique(np.concatenate([np.quantile(v, np.linspace(0, 1, cuts)),
                                         np.quantile(v[bad], np.linspace(0, 1, cuts))])) if bad.any() else
            np.unique(v)[:1] for k, v in x.items()}
    left, rules = np.ones(len(bad), bool), []
    while len(rules) < most_rules and (bad & left).any():
        grow, prune = left & ~part, left & part
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow], grid, most_conditions)
        if not rule:
            break
        rule = _prune(rule, {k: v[prune] for k, v in x.items()}, bad[prune])
        covered = _covers(rule, x, len(bad)) & left
        held, own = covered & prune, covered & grow
        p, n = int((bad & held).sum()), int((~bad & held).sum())
        if p == 0 or p / (p + n) < precision or (bad & own).sum() < precision * own.sum():
            break
        rules.append(rule)
        left &= ~covered
    return rules


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 20_000) -> list[Rule]:
    """Learns from at most ``max_docs`` labelled rows (quality 0 or 1), chosen by a hash of their id. No rows
    or no bad ones: no rules."""
    known = with_statistics(labelled(docs, labels, "quality", max_docs), ["doc_id", "quality"])
    rows = known.select(F.xxhash64("doc_id").alias("h"), "doc_id", "quality",
                        *[m.alias(k) for k, m in measures().items()]).toPandas().sort_values(["h", "doc_id"])
    return learn_rules({k: rows[k].to_numpy(np.float64) for k in measures()}, rows["quality"].to_numpy() == 0)


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional expression: the first rule that holds rejects."""
    out = None
    for rule in rules:
        held = F.lit(True)
        for c in rule:
            held = held & c.expression()
        out = F.when(held, F.lit(False)) if out is None else out.when(held, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[Rule], keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the statistics, base_failed (under 50 words, or more than half of them in repeated three-word
    windows) and kept (false if base_failed, else the decision list's verdict)."""
    stats = with_statistics(docs, keep)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
