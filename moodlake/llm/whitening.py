"""Whitening of embeddings with a covariance recovered by polarisation.

Vectors become integers, so every sum below is exact. One pass adds up each dimension; a second one centres the
vectors and adds up the squares of every dimension and of every sum of two dimensions. With
``var(x + y) = var(x) + var(y) + 2 cov(x, y)`` differences of those variances give all cross-covariances, and the
assembled matrix (dimensions squared, whatever the number of rows) goes through ``eigh`` on the driver. What tasks
send to each other are partial sums, a row for each dimension or pair and task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodlake.llm.common import as_batch, prepare

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
#: Most dimensions: the covariance matrix is the one thing that passes the driver.
MAX_DIMENSIONS = 4096
#: Scaled components must be smaller, so that integers and differences of two of them fit 64 bits.
BOUND = 2.0 ** 60
#: Rows that a kernel squares at once, and centred values up to which it does so in 64 bits.
_ROWS, _SMALL = 4096, 1 << 22
_LIMB, _LIMBS = 40, 6
_SUMS = {"k": pa.int64()} | {f"l{i}": pa.int64() for i in range(_LIMBS)}
_LOST = 1e-12               # a share of the variance that is none


@dataclass(frozen=True)
class Whitening:
    """``centre`` (integers) plus ``rest / n`` is the mean, ``components`` has a column for each component."""
    n: int
    centre: np.ndarray
    rest: list[int]
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, its components neither null nor non-finite (nor of 2**60 and
    more when scaled)."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(
        vector, lambda x: x.isNotNull() & (F.abs(x.cast("double") * F.lit(float(SCALE))) < F.lit(BOUND)))


def _vectors(embeddings: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The rows that take part, and their number of dimensions."""
    rows = embeddings.filter(usable(F.col(vector)))
    sizes = rows.groupBy(F.size(vector).alias("d")).count()
    width = sizes.agg(F.max_by("d", F.struct("count", "d"))).first()[0] or 0
    if width > MAX_DIMENSIONS:
        raise ValueError(f"vectors of {width} dimensions; at most {MAX_DIMENSIONS}")
    return rows.filter(F.size(vector) == width), width


def _integers(column: pa.Array, width: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return np.floor(values * SCALE).astype(np.int64) + SHIFT


def _limbs(values: list[int]) -> dict[str, list[int]]:
    low = (1 << _LIMB) - 1
    return {f"l{i}": [(v >> _LIMB * i) & low if i < _LIMBS - 1 else v >> _LIMB * i for v in values] for i in range(_LIMBS)}


def _exact_sums(rows: DataFrame, width: int, vector: str, of: Callable[[np.ndarray], list[int]]) -> list[int]:
    """The sums of what ``of`` makes of blocks of integer vectors, exact at any size: each task adds them up as
    Python integers and sends them on in limbs of 40 bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] = []
        for batch in batches:
            x = _integers(batch.column("vector"), width)
            for lo in range(0, len(x), _ROWS):
                own = of(x[lo:lo + _ROWS])
                total = [a + b for a, b in zip(total, own)] if total else own
        if total:
            yield as_batch({"k": list(range(len(total))), **_limbs(total)}, _SUMS)

    parts = (rows.select(F.col(vector).cast("array<double>").alias("vector"))
             .mapInArrow(run, ", ".join(f"{c} long" for c in _SUMS))
             .groupBy("k").agg(*[F.sum(f"l{i}").alias(f"l{i}") for i in range(_LIMBS)]))
    found = {r["k"]: sum(r[f"l{i}"] << _LIMB * i for i in range(_LIMBS)) for r in parts.toLocalIterator()}
    return [found[k] for k in range(len(found))]


def _column_sums(x: np.ndarray) -> list[int]:
    """Sums of the columns, then the number of rows."""
    high, low = (x >> 31).sum(0).tolist(), (x & ((1 << 31) - 1)).sum(0).tolist()
    return [(h << 31) + v for h, v in zip(high, low)] + [len(x)]


def _squares(centre: np.ndarray) -> Callable[[np.ndarray], list[int]]:
    """Sums of the squares of every centred dimension, then of every sum of two (in the order of ``triu_indices``)."""
    def of(x: np.ndarray) -> list[int]:
        z = x - centre
        if np.abs(z).max() >= _SMALL:
            z = z.astype(object)                                # Python integers
        out = [int(v) for v in (z * z).sum(0)]
        for i in range(z.shape[1] - 1):
            pair = z[:, i + 1:] + z[:, i:i + 1]
            out += [int(v) for v in (pair * pair).sum(0)]
        return out
    return of


def fit(embeddings: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The components of largest variance of all usable vectors; None where there are none.

    Of vectors of several lengths those of the commonest length take part (ties: the longer). Components without
    variance (constant or dependent dimensions, a single vector) have ``variances`` of 0."""
    prepare(embeddings.sparkSession)
    rows, width = _vectors(embeddings, vector)
    if not width:
        return None
    *sums, n = _exact_sums(rows, width, vector, _column_sums)
    centre = np.array([s // n for s in sums], np.int64)
    rest = [s % n for s in sums]                                # sums of the centred dimensions
    squares = _exact_sums(rows, width, vector, _squares(centre))
    own = [n * s - r * r for s, r in zip(squares, rest)]        # n * n times the variance
    covariance = np.diag([v / (n * n) for v in own])
    for i, j, s in zip(*map(np.ndarray.tolist, np.triu_indices(width, 1)), squares[width:]):
        of_sum = n * s - (rest[i] + rest[j]) ** 2
        covariance[i, j] = covariance[j, i] = (of_sum - own[i] - own[j]) / (2 * n * n)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    trace = sum(own) / (n * n)
    values = np.where(values > _LOST * trace, values, 0.0)
    model = Whitening(n, centre, rest, vectors * np.where(sign == 0, 1, sign), values,
                      values / trace if trace else np.zeros(len(values)))
    return Whitening(**(vars(model) | {"identity_error": _identity_error(rows, width, vector, model)}))


def _whitened(x: np.ndarray, model: Whitening) -> np.ndarray:
    """NaN for components without variance."""
    centred = (x - model.centre) - np.array([r / model.n for r in model.rest])
    scale = np.where(model.variances > 0, np.sqrt(model.variances), np.nan)
    return centred @ model.components / scale


def _identity_error(rows: DataFrame, width: int, vector: str, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, over the components that have
    variance. The vectors are centred, so products of partial sums lose nothing."""
    some = np.flatnonzero(model.variances > 0)
    if not len(some):
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(some) + 1, len(some)))
        for batch in batches:
            w = _whitened(_integers(batch.column("vector"), width), model)[:, some]
            total += np.concatenate((w.T @ w, w.sum(0)[None]))
        yield as_batch({"k": np.arange(total.size), "s": total.ravel()}, {"k": pa.int64(), "s": pa.float64()})

    sums = dict(rows.select(F.col(vector).cast("array<double>").alias("vector")).mapInArrow(run, "k long, s double")
                .groupBy("k").agg(F.sum("s").alias("s")).toLocalIterator())
    total = np.array([sums[k] for k in range(len(sums))]).reshape(-1, len(some)) / model.n
    return float(np.abs(total[:-1] - np.outer(total[-1], total[-1]) - np.eye(len(some))).max())


def _deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Exact sums of (n x - S)**2; None beyond a long."""
    z, n = x - model.centre, model.n
    rest = max(model.rest, default=0)
    most = max(abs(int(z.max(initial=0))), abs(int(z.min(initial=0)))) * n + rest
    if most * most * z.shape[1] < 1 << 62:
        return ((z * n - np.array(model.rest, np.int64)) ** 2).sum(1).tolist()
    exact = ((z.astype(object) * n - np.array(model.rest, object)) ** 2).sum(1).tolist()
    return [int(v) if v < 1 << 63 else None for v in exact]


def transform(embeddings: DataFrame, model: Whitening | None, vector: str = "embedding",
              keep: list[str] | None = None) -> DataFrame:
    """The usable rows of the model's length with ``whitened`` (an array, null in it for a component without variance)
    and ``deviation`` (the sum over dimensions of (n x - S) squared, in integers; null beyond a long).

    ``keep``: the columns to keep (default all); columns with the new names are replaced. A null id stays a row, and
    repeated rows stay so. Without a model (nothing usable was there to fit) there are no rows."""
    prepare(embeddings.sparkSession)
    kept = [c for c in (embeddings.columns if keep is None else keep) if c not in ("deviation", "whitened")]
    width = 0 if model is None else len(model.centre)
    rows = (embeddings.filter(usable(F.col(vector)) & (F.size(vector) == width))
            .select(F.struct(F.lit(True).alias("_"), *kept).alias("row"), F.col(vector).cast("array<double>").alias("vector")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _integers(batch.column("vector"), width)
            w = _whitened(x, model)
            lost = np.isnan(w)
            values = pa.array(w.ravel(), mask=lost.ravel())
            offsets = pa.array(np.arange(len(w) + 1) * w.shape[1], type=pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(_deviations(x, model), type=pa.int64()), pa.ListArray.from_arrays(offsets, values)],
                names=["row", "deviation", "whitened"])

    kind = rows.schema["row"].dataType.simpleString()
    made = rows.mapInArrow(run, f"row {kind}, deviation long, whitened array<double>")
    return made.select(*[F.col("row")[c].alias(c) for c in kept], "deviation", "whitened")


def long_form(whitened: DataFrame, model: Whitening | None, id_column: str = "vec_id") -> DataFrame:
    """A row for each vector and component: id, component (from 1), n, deviation, whitened, explained, identity_error."""
    explained = [] if model is None else model.explained.tolist()
    shares = F.array(*[F.lit(float(x)) for x in explained]).cast("array<double>")
    return (whitened.select(id_column, "deviation", F.posexplode("whitened").alias("at", "whitened"))
            .select(id_column, (F.col("at") + 1).cast("int").alias("component"),
                    F.lit(0 if model is None else model.n).cast("long").alias("n"), "deviation", "whitened",
                    F.get(shares, F.col("at")).alias("explained"),
                    F.lit(None if model is None else model.identity_error).cast("double").alias("identity_error")))
