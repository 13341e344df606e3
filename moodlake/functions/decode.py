"""Decode scorer logits into probabilities and a stance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from moodlake.functions.dictionaries import CLASS_ORDER


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def softmax(logits) -> Column:
    """exp(x - max) / sum(exp(x - max)) per row (max shift for overflow safety)."""
    x = _c(logits).cast("array<double>")
    m = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - m))
    s = F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(e, lambda v: v / s)


def argmax_stance(probs, class_order=CLASS_ORDER) -> Column:
    """Stance of the first maximal class (ties take the lowest index)."""
    p = _c(probs)
    order = F.array(*[F.lit(int(v)) for v in class_order])
    return F.element_at(order, F.array_position(p, F.array_max(p)).cast("int")).cast("short")


def probs_struct(probs, class_order=CLASS_ORDER) -> Column:
    """{neg, neu, pos} from the class positions of -1, 0, +1 in ``class_order``."""
    p = _c(probs)
    idx = {v: i + 1 for i, v in enumerate(class_order)}
    return F.struct(F.element_at(p, idx[-1]).alias("neg"),
                    F.element_at(p, idx[0]).alias("neu"),
                    F.element_at(p, idx[1]).alias("pos"))
