"""Exact continuous quantiles without funnelling the data through one task.

Spark's exact ``percentile`` aggregate merges every distinct value of a group
in one final task, so a global p95 over a large window holds the whole window
in one task. ``exact_quantile`` instead finds the values at the two ranks that
``percentile_cont`` interpolates by successive narrowing:

* every pass is one or two distributed aggregates with a one-row result: a
  mergeable ``percentile_approx`` sketch brackets the target rank, then
  conditional counts place it exactly inside, left of or right of the bracket;
* the candidate window shrinks by about ``accuracy / 6`` per pass, and a value
  equal to a bracket end is recognised at once (ties, however many);
* only a window of at most ``max_collect`` values is collected, as
  (value, count) pairs, so a value repeated a billion times is one row.

When the distinct values fit ``max_collect`` (a short window), one partial
aggregation of (value, count) pairs answers in a single pass. The narrowing is
driven from the driver, but the driver only ever sees O(1) rows per pass plus
at most ``max_collect`` rows once.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_COLLECT = 50_000
ACCURACY = 10_000
MAX_PASSES = 64  # each pass shrinks the window ~ACCURACY/6-fold; a handful suffice


def _window(v: Column, lo, lo_incl: bool, hi, hi_incl: bool) -> Column:
    cond = F.lit(True)
    if lo is not None:
        cond = cond & ((v >= F.lit(lo)) if lo_incl else (v > F.lit(lo)))
    if hi is not None:
        cond = cond & ((v <= F.lit(hi)) if hi_incl else (v < F.lit(hi)))
    return cond


def value_at_rank(values: DataFrame, rank: int, n: int, col: str = "v",
                  accuracy: int = ACCURACY, max_collect: int = MAX_COLLECT):
    """The value of 0-based ``rank`` in ascending order of ``values[col]``
    (``n`` = number of non-null values, ``0 <= rank < n``)."""
    v = F.col(col)
    lo = hi = None
    lo_incl = hi_incl = True
    below, n_win = 0, n
    for _ in range(MAX_PASSES):
        win = values.where(_window(v, lo, lo_incl, hi, hi_incl))
        t = rank - below
        if n_win <= max_collect:
            acc = 0
            for val, c in sorted(tuple(r) for r in win.groupBy(col).agg(F.count(F.lit(1))).collect()):
                acc += c
                if acc > t:
                    return val
            raise AssertionError("rank outside the window")  # counts are exact; cannot happen
        p = t / (n_win - 1)
        d = 2.0 / accuracy
        a_lo, a_hi = win.agg(F.percentile_approx(v, F.array(F.lit(max(0.0, p - d)), F.lit(min(1.0, p + d))),
                                                 F.lit(accuracy))).first()[0]
        c = win.agg(F.count_if(v < F.lit(a_lo)), F.count_if(v <= F.lit(a_lo)),
                    F.count_if(v < F.lit(a_hi)), F.count_if(v <= F.lit(a_hi))).first()
        lt_lo, le_lo, lt_hi, le_hi = (int(x) for x in c)
        if t < lt_lo:          # left of the bracket: [lo, a_lo)
            hi, hi_incl, n_win = a_lo, False, lt_lo
        elif t < le_lo:        # ties at the lower bracket end
            return a_lo
        elif t < lt_hi:        # inside: (a_lo, a_hi)
            lo, lo_incl, hi, hi_incl = a_lo, False, a_hi, False
            below, n_win = below + le_lo, lt_hi - le_lo
        elif t < le_hi:        # ties at the upper bracket end
            return a_hi
        else:                  # right of the bracket: (a_hi, hi]
            lo, lo_incl = a_hi, False
            below, n_win = below + le_hi, n_win - le_hi
    raise RuntimeError("rank selection did not converge; were the values changing between passes?")


def _from_counts(pairs, q: float):
    """percentile_cont from sorted (value, count) pairs."""
    n = sum(c for _, c in pairs)
    if n == 0:
        return None
    pos = q * (n - 1)
    r = int(pos)
    frac = pos - r
    acc, lo, hi = 0, None, None
    for val, c in pairs:
        if lo is None and acc + c > r:
            lo = val
        if acc + c > r + 1:
            hi = val
            break
        acc += c
    hi = lo if hi is None else hi
    return float(lo) if frac == 0 else float(lo) + (float(hi) - float(lo)) * frac


def exact_quantile(df: DataFrame, value: Column | str, q: float, accuracy: int = ACCURACY,
                   max_collect: int = MAX_COLLECT):
    """``percentile_cont(q)`` of a numeric column (NULLs ignored), exactly as
    PostgreSQL defines it: position q * (n - 1), linear interpolation
    lo + (hi - lo) * frac between its two neighbouring ranks. None when empty."""
    v = F.col(value) if isinstance(value, str) else value
    raw = df.select(v.alias("v")).where(F.col("v").isNotNull())
    # one pass first: (value, count) pairs by a partial aggregation, fetched only
    # up to the bound; if all distinct values fit, the answer is exact from them
    head = sorted(tuple(r) for r in raw.groupBy("v").count().limit(max_collect + 1).collect())
    if len(head) <= max_collect:
        return _from_counts(head, q)
    # otherwise narrow over a reliable snapshot (shared checkpoint folder): every
    # pass, and every task re-run after a lost executor, sees the same values
    # even if the source is being appended to meanwhile
    from moodlake.session import checkpoint_root

    checkpoint_root(df.sparkSession)  # the configured folder (set on the context if only in the conf)
    vals = raw.checkpoint(eager=True).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = vals.count()
        if n == 0:
            return None
        pos = q * (n - 1)
        r = int(pos)
        frac = pos - r
        lo = value_at_rank(vals, r, n, accuracy=accuracy, max_collect=max_collect)
        if frac == 0:
            return float(lo)
        # the next rank: a tie of lo, or the smallest value above it
        le, nxt = vals.agg(F.count_if(F.col("v") <= F.lit(lo)),
                           F.min(F.when(F.col("v") > F.lit(lo), F.col("v")))).first()
        hi = lo if le > r + 1 else nxt
        return float(lo) + (float(hi) - float(lo)) * frac
    finally:
        vals.unpersist()
