"""Vector functions over array<float> columns, as higher-order built-ins: no
Python, but their lambdas are interpreted element by element outside generated
code. For one query over a scan; batches go through the numpy kernels of
``operators.similarity``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v) -> Column:
    return _c(v).cast("array<double>")


def l2_distance(a, b) -> Column:
    """Euclidean distance; NULL when either side is NULL or sizes differ."""
    a, b = as_double(a), as_double(b)
    sq = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), F.sqrt(sq))


def dot(a, b) -> Column:
    a, b = as_double(a), as_double(b)
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    a = as_double(a)
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine_distance(a, b) -> Column:
    """1 - cos(a, b); NULL for zero vectors or size mismatch."""
    den = norm(a) * norm(b)
    return F.when((F.size(_c(a)) == F.size(_c(b))) & (den != 0), F.lit(1.0) - dot(a, b) / den)


def has_dim(v, dim: int) -> Column:
    """Fixed-size guard (the store enforces the declared vector size)."""
    return F.size(_c(v)) == F.lit(dim)
