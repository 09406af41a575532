"""Array-as-vector expressions.

Vectors stay ``array<double>`` until the ML boundary, where
``pyspark.ml.functions.array_to_vector`` turns them into ``VectorUDT``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def topic_normalize(gamma, alpha) -> Column:
    """``(gamma - alpha) / sum(gamma - alpha)``; NULL elements if the sum is 0."""
    g = _col(gamma)
    a = _col(alpha) if not isinstance(alpha, (int, float)) else F.lit(float(alpha))
    shifted = F.transform(g, lambda x: x - a)
    total = F.aggregate(shifted, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(shifted, lambda x: F.try_divide(x, total))


def vec_add(a, b) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x + y)


def vec_sub(a, b) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x - y)


def vec_scale(a, s) -> Column:
    s = F.lit(float(s)) if isinstance(s, (int, float)) else _col(s)
    return F.transform(_col(a), lambda x: x * s)


def vec_concat(*vs) -> Column:
    return F.concat(*[_col(v) for v in vs])


def zeros_like(a) -> Column:
    return F.transform(_col(a), lambda x: F.lit(0.0))


def vec_sum(a) -> Column:
    return F.aggregate(_col(a), F.lit(0.0), lambda acc, x: acc + x)
